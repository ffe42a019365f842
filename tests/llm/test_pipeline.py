import base64
import hashlib
import importlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken

from citewright.llm import pii, toxicity
from tests.llm import slow

corpus_pipeline = pytest.importorskip("corpus_pipeline")
entry = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def reference(spark):
    """The pipeline's rows from plain versions of each stage; only the fitted models are the library's."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = [r.asDict() for r in table.collect()]
    model = toxicity.fit(table, labels)
    logit = lambda d: model.intercept + sum(model.weights[g] for g in slow.grams(d["text"]))
    threshold = -0.8472978603872036  # the margin at a score of 0.3
    docs = [d for d in docs if logit(d) < threshold]
    prints = [slow.fingerprint(d["text"]) for d in docs]
    group = slow.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for d, g in zip(docs, group):
        if g not in first or d["doc_id"] < first[g]:
            first[g] = d["doc_id"]
    docs = [d for d, g in zip(docs, group) if first[g] == d["doc_id"]]
    spans = pii.fit(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string"))
    for d in docs:
        text = d["text"] or ""
        base = pii.base_spans(text)
        out, at = "", 0
        for start, kind, end in sorted(base + slow.selected(text, spans, base, pii.candidates)):
            if start >= at:
                out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        d["text"] = d["text"] and out + text[at:]
    rows = [(d["doc_id"], d["text"], d["source"]) for d in docs]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for (i, text, _), n in zip(rows, slow.taken(rows)):
        size = len(slow.WORDS.findall(text or ""))
        ids = own.encode_ordinary(text or "")
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        want += [row] * ((2 * n + size) // (2 * size) if size else 1)
    return want


def test_equals_plain_stages(spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(reference(spark)) and len(got) > 100


def odd_rows():
    rng = random.Random(2)
    words = [f"wort{i}" for i in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    texts = [None, "", " \n", "one", long, long + " end", "mail a.b@c.example.org or +1 (017) 555-7713"]
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    rows = [(k, t, None if k % 5 == 0 else f"s{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    rows += [rows[10], rows[10], (11, texts[12], "s0", 5), (11, "an unrelated text under a repeated id", "s0", 9), (None, texts[13], "s1", 7), (None, "no id here", None, 3), (None, "no id here", None, 3)]
    return rows


EXTRA = ["_id", "_copies", "_k", "_n", "id", "row", "h", "fp", "component", "copies", "text_h", "kept_id", "kept_h", "turn", "own_id", "source_size", "Score"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = odd_rows()
    schema = "doc_id long, text string, source string, n_chars long, lang string, " + ", ".join(f"`{c}` long" for c in EXTRA)
    table = spark.createDataFrame([(*r, None, *(k * 100 + j for j in range(len(EXTRA)))) for k, r in enumerate(rows)], schema)
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(36)] + [(3, None), (None, 1), (7, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return table.repartition(3), folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_input(spark, odd, name):
    docs, folder = odd
    rows = docs.collect()
    got_table = STAGES[name](spark, docs, folder)
    got = got_table.collect()
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0
    if name == "bpe":
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
        assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (0, 1))
        return
    assert got_table.columns == docs.columns
    by_first = {r["_id"]: r for r in rows}  # the first extra column tells rows apart
    for r in got:
        was = by_first[r["_id"]]
        assert all(r[c] == was[c] for c in docs.columns if c not in ("text", "n_chars"))
        assert r["text"] == was["text"] or name == "pii"
    count = Counter(r["_id"] for r in got)
    if name == "simhash near-dedup":
        group = slow.groups([slow.fingerprint(r["text"]) for r in rows], lambda a, b: (a ^ b).bit_count() <= 3)
        best = {}
        for r, g in zip(rows, group):
            best[g] = min(best.get(g, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
        assert len(got) == len(set(group))
        place = {r["_id"]: g for r, g in zip(rows, group)}
        assert all((r["doc_id"] is None, r["doc_id"] or 0) == best[place[r["_id"]]] for r in got)
    elif name == "pii":
        assert len(got) == len(rows) and any("[EMAIL]" in (r["text"] or "") for r in got)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    elif name == "mixing":
        keyed = [(r["doc_id"], r["text"], r["source"]) for r in rows]
        copies = defaultdict(list)
        for r, n in zip(keyed, slow.taken(keyed)):
            size = len(slow.WORDS.findall(r[1] or ""))
            copies[r].append((2 * n + size) // (2 * size) if size else 1)
        found = defaultdict(list)
        for r in rows:
            found[r["doc_id"], r["text"], r["source"]].append(count[r["_id"]])
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in copies.items()}
    else:
        assert max(count.values()) == 1 and count.keys() <= by_first.keys()
        texts = {r["text"] for r in got}
        assert all((r["text"] in texts) == (r["_id"] in count) for r in rows)  # equal texts share their fate


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names

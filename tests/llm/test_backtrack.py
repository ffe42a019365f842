import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from citewright.llm import backtrack
from citewright.llm.queries import TOKENIZER

EXTRA = ["<|endoftext|>", "a <|endoftext|><|endoftext|>  b\n", " <|endoftext", "naïve 日本語 🙂🙂 é", "  two   spaces \n\n x ", "don't we'LL I'd", "  　 ٣٤ ½", "x" * 20_000, " " * 5000 + "a", "\x00\x1c\x85  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def table():
    return backtrack.Vocabulary(TOKENIZER)


def test_same_as_the_library_and_lossless(spark, docs, empty, library):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(EXTRA)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    want = {}
    for r in every.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    got = backtrack.round_trip(every, TOKENIZER).collect()
    assert len(got) == every.count()
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got)
    assert backtrack.round_trip(empty, TOKENIZER).count() == 0
    back = backtrack.decode(backtrack.encode(docs, TOKENIZER), TOKENIZER)
    assert sorted((str(r[0]), r[1]) for r in back.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())


def test_random_pieces_equal_merging(library, table):
    """Letters that tokens share, so that longest matches are often wrong and must give way."""
    rng = random.Random(3)
    given_way = 0
    for alphabet in ("ab", "eart", "thingsed", "aeéñ", "日本語", "xyzqj", "=-_*"):
        for _ in range(300):
            piece = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
            ids = library.encode(piece, add_special_tokens=False).ids
            assert [i for p in table.split(piece) for i in table.encode_piece(p.encode())] == ids
            given_way += len(ids) != len(greedy(table, piece.encode()))
    assert given_way > 50


def greedy(table, text):
    out = []
    while text:
        n = next(n for n in range(min(len(text), 200), 0, -1) if text[:n] in table.by_bytes)
        out.append(table.by_bytes[text[:n]])
        text = text[n:]
    return out


def test_every_token_and_split_characters(library, table):
    """Each id decodes as the library's; ids that end within a character give U+FFFD."""
    for i in range(0, 50257, 7):
        assert table.decode(np.array([i])).decode("utf-8", "replace") == library.decode([i], skip_special_tokens=False)
    ids = library.encode("🙂é", add_special_tokens=False).ids
    for k in range(len(ids) + 1):
        assert table.decode(np.array(ids[:k], np.int64)).decode("utf-8", "replace") == library.decode(ids[:k], skip_special_tokens=False)


def test_work_grows_with_the_piece_only(table):
    counts = []
    for n in (2_000, 20_000):
        calls, compatible = 0, table.compatible

        def counted(a, b):
            nonlocal calls
            calls += 1
            return compatible(a, b)

        table.compatible = counted
        table.encode_piece(b"ab" * (n // 2))
        table.compatible = compatible
        counts.append(calls)
    assert counts[1] < 12 * counts[0]


def test_memory_starts_afresh(table, library, monkeypatch):
    monkeypatch.setattr(backtrack, "KNOWN", 3)
    monkeypatch.setattr(backtrack, "PAIRS", 2)
    known = backtrack.Pieces(table)
    for text in ["one two three four five", "six seven eight", "one two nine", "l" * 500]:
        assert list(known.encode(text)[1]) == library.encode(text, add_special_tokens=False).ids
        assert len(table.pairs) <= 2


def test_other_kinds_are_refused(tmp_path):
    with open(TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            backtrack.Vocabulary(str(path))

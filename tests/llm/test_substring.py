import random
import re

from citewright.llm import substring


def brute(rows):
    """rows: (id, text) in order of precedence."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen, out = set(), []
    for (i, _), words in zip(rows, split):
        gone = set()
        for p in range(len(words) - 19):
            w = tuple(words[p : p + 20])
            if w in seen:
                gone |= set(range(p, p + 20))
            seen.add(w)
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def test_equals_brute_force(plain, monkeypatch):
    rows = sorted((r["doc_id"], r["text"]) for r in plain.collect() if r["text"] is not None)
    rows = sorted(rows + [(r["doc_id"], None) for r in plain.collect() if r["text"] is None], key=lambda r: r[0])
    assert sorted(map(tuple, substring.remove_repeats(plain).collect())) == brute(rows)
    assert sum(r[2] for r in brute(rows)) > 100


def test_repeated_ids_and_nulls(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = [tuple(r) for r in substring.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert substring.remove_repeats(empty).count() == 0


def test_random_small_alphabets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [rng.choice("abc" if i % 2 else "abcdefgh") for _ in range(rng.randint(0, 70))]
        if rows and i % 3 == 0:
            other = rows[rng.randrange(len(rows))][1].split()
            at = rng.randint(0, len(words))
            words[at:at] = other[rng.randint(0, 5) :]
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring.remove_repeats(table).collect())) == brute(rows)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    passage = [b"p%d" % rng.randrange(40) for _ in range(60)]
    seen = {}
    for k in range(6):
        words = [b"q%d" % rng.randrange(40) for _ in range(rng.randint(0, 9))] + passage + [b"r%d" % k] * (k % 3)
        found, doc, begin = substring._layout([words])
        windows, place, key = substring.anchors(found, doc, begin)
        for w, p, a in zip(windows.tolist(), place.tolist(), key.tolist()):
            content = tuple(words[w : w + 20])
            assert seen.setdefault(content, (a, (p - w) % len(found))) [0] == a


def test_ids_that_are_no_numbers(spark):
    words = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([("b", words + " end"), ("a", words), ("c", "x " + words), (None, words)], "doc_id string, text string")
    got = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(docs).collect()}
    assert got == {"a": words, "b": "end", "c": "x", None: ""}

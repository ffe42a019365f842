import random

import xxhash
from pyspark.sql import functions as F

from citewright.llm import simhash


def slow_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps):
    best = dict(enumerate(ids))
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    return [min((best[k] for k in best if find(k) == find(i) and best[k] is not None), default=None) for i in range(len(ids))]


def test_fingerprints_and_groups_equal_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", g) for (i, _), f, g in zip(rows, fps, groups([i for i, _ in rows], fps))), key=str)
    got = sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=str)
    assert got == want


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c", 42)


def test_links_lose_no_pair_and_blocks_agree(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for f in fps for _ in range(4)]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = groups(list(range(len(fps))), fps)
    for block in (2048, 2):
        links = [(r["a"], r["b"]) for r in simhash.near_links(table, block=block).collect()]
        place = {f: i for i, f in enumerate(signed)}
        assert all((a ^ b & (1 << 64) - 1).bit_count() <= 64 for a, b in links)
        parent = list(range(len(fps)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(place[a]), find(place[b])
            parent[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(fps))] == want


def test_one_of_each_group_stays(plain, docs, empty):
    kept = simhash.keep_one_per_group(plain)
    assert kept.columns == plain.columns
    want = {r["component_id"] for r in simhash.simhash_groups(plain).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    again = [r["doc_id"] for r in simhash.keep_one_per_group(docs).collect()]
    assert len(again) == len(set(again))
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one_per_group(empty).count() == 0

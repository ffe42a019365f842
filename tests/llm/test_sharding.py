import zlib
from collections import Counter

from citewright.llm import sharding


def test_assignment(docs, empty):
    got = sharding.assign(docs, sharding.balanced_tree(8)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign(empty, sharding.balanced_tree(8)).count() == 0


def test_weights_and_movement(spark):
    keys = spark.range(40_000)
    tree = sharding.balanced_tree(8)
    heavier = tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree)
    rows = keys.select("id", sharding.shard_of(keys["id"], tree).alias("a"), sharding.shard_of(keys["id"], heavier).alias("b"), sharding.shard_of(keys["id"], sharding.grown(tree)).alias("c")).collect()
    sizes = Counter(r["a"] for r in rows)
    assert max(sizes.values()) < 1.08 * min(sizes.values())
    # the changed shard's region alone gains, and inside it only paths to what grew
    assert not any(r["a"] // 4 == 1 and r["b"] // 4 == 0 for r in rows)
    assert abs(sum(r["b"] == 5 for r in rows) / len(rows) - 0.3) < 0.02
    assert all(r["c"] in (r["a"], 8) for r in rows)
    assert abs(sum(r["c"] == 8 for r in rows) / len(rows) - 1 / 9) < 0.01

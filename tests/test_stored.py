import random

import pytest
from pyspark.sql import functions as F

from citewright.operators.merging import upsert_fill
from citewright.operators.trigrams import TrigramIndex
from citewright.sources.stored import StoredTable


def listing(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_an_update_rewrites_its_buckets_only(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), "id", 16)
    assert table.read() is None
    rows = spark.range(500).select("id", F.lit(None).cast("string").alias("title"), F.lit("x").alias("bucket"))
    merge = lambda old, new: upsert_fill(old, new, "id", ["title"])
    assert len(table.update(rows, merge)) == 16
    before = listing(tmp_path)
    batch = spark.createDataFrame([(3, "three", "y"), (1000, "new", "z"), (3, "three", "y")], "id long, title string, bucket string")
    touched = table.update(batch, merge)
    after = listing(tmp_path)
    assert 1 <= len(touched) <= 2 and all(after[f] == t for f, t in before.items())
    assert {f.split("/")[3] for f in after.keys() - before.keys()} == {f"bucket_={b}" for b in touched}
    got = {r["id"]: (r["title"], r["bucket"]) for r in table.read().collect()}
    assert len(got) == 501 and got[3] == ("three", "x") and got[1000] == ("new", "z") and got[4] == (None, "x")
    assert table.update(batch.limit(0), merge) == set()
    table.clear()
    assert {r["id"] for r in table.read().collect()} == got.keys() and len(listing(tmp_path)) == len({f.split("/")[3] for f in after}) and len(list((tmp_path / "t/lists").glob("[0-9]*"))) == 1


def test_a_failed_update_leaves_the_old_state(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), "id", 4)
    table.update(spark.range(20).withColumn("v", F.lit(1)), lambda old, new: new)
    fails = F.udf(lambda x: 1 // 0, "int")
    for merge in (lambda old, new: new.withColumn("v", fails("id")), lambda old, new: new.withColumn("id", F.col("id") + 1)):
        with pytest.raises(Exception):  # noqa: B017
            table.update(spark.createDataFrame([(5, 7)], "id long, v int"), merge)
        assert table.read().agg(F.count("*"), F.sum("v")).first()[:] == (20, 20)
    table.update(spark.createDataFrame([(5, 7)], "id long, v int"), lambda old, new: old.where("id <> 5").unionByName(new))
    assert table.read().agg(F.count("*"), F.sum("v")).first()[:] == (20, 26)


def test_two_writers(spark, tmp_path):
    one = StoredTable(spark, str(tmp_path / "t"), "id", 4)
    one.update(spark.range(5), lambda old, new: new)

    def other_first(old, new):
        StoredTable(spark, str(tmp_path / "t"), "id", 4).update(spark.range(100, 101), lambda o, n: o.union(n))
        return old.union(new)

    with pytest.raises(RuntimeError, match="another writer"):
        one.update(spark.range(200, 201), other_first)
    assert {r["id"] for r in one.read().collect()} == {*range(5), 100}


def test_trigrams_equal_the_scan(spark, tmp_path):
    rng = random.Random(7)
    words = ["genre", "Genius", "pedagogy", "the", "a", "été", "GENRES", "xyz"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for k in range(300)] + [(None, "genre"), (900, None), (901, "ab"), (5, "second genre text")]
    texts = spark.createDataFrame([*rows, rows[7]], "id long, t string").repartition(3)
    index = TrigramIndex(spark, str(tmp_path / "grams"))
    index.build(texts, "id", "t")
    needles = ["genre", "GEN", "e g", "été a", "nowhere", "ab", "y t", "pedagogy the genre", "zzz", "s"]
    want = {n: {i for i, t in rows if i is not None and t is not None and n.lower() in t.lower()} for n in needles}
    for needle in needles:
        assert {r["id"] for r in index.holding(needle).collect()} == want[needle], needle
    asked = spark.createDataFrame([(n,) for n in [*needles, "genre", None]], "needle string")
    for block in (5000, 7):
        got = {}
        for r in index.holding_any(asked, block).collect():
            got.setdefault(r["needle"], set()).add(r["id"])
        assert got == {n: ids for n, ids in want.items() if ids and len(n) >= 3}
    plan = index.holding("genre")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram," in plan

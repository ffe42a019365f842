from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from citewright.functions import cleaning as K
from citewright.functions import values as V
from citewright.operators import citations as C
from citewright.operators import graphs as G
from citewright.operators import press
from citewright.operators import records as R
from citewright.operators.components import connected_components, spanning_forest


def test_values(spark):
    row = spark.sql("select '2014' as a, '19xx-01' as b, ' -12abc' as c, 'x' as d, cast(null as string) as e").select(
        V.year_of(F.col("a")), V.year_of(F.col("b")), V.leading_int(F.col("c")), V.leading_int(F.col("d")), V.leading_int(F.col("e")),
        V.split_list(F.lit("a; ;b;")), V.slug(F.lit("  Hello, World! ")), K.strip_tags(F.lit("<p>a &amp; b<script>x</script></p>")), K.vocabulary_tags(F.lit("The genre theory"), {"t": ["genre"], "u": ["other"]}),
    ).first()
    assert tuple(row) == (2014, None, -12, 0, None, ["a", "b"], "hello-world", "a & b", "|t|")


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 1)] + [(100 + i, 101 + i) for i in range(40)] + [(1000, 2000 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got[3] == 1 and got[11] == 10 and got[140] == 100 and got[2049] == 1000 and 5 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = spanning_forest(np.array([4, 9, 7]), np.array([9, 2, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {4: 2, 9: 2, 8: 7}


def test_graphs(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 2)], "source long, target long")
    assert abs(sum(r["rank"] for r in G.pagerank(links, 10).collect()) - 1) < 1e-9
    assert tuple(G.transitivity(links).first()) == (1, 5, 0.6)


def test_delayed_recognition_skips_earlier_citations(spark):
    articles = spark.createDataFrame([(1, "2000", 2000, "j"), (2, "1990", 1990, "j"), (3, "2005", 2005, "j"), (4, "2004", 2004, "j")], "id long, pub_date string, year int, journal string")
    citations = spark.createDataFrame([(2, 1, "d", 1), (3, 1, "d", 1), (3, 1, "d", 2), (4, 1, "d", 1)], "source long, target long, doi string, ord int")
    rows = C.sleeping_beauties(articles, citations, least=2).collect()
    assert [(r["id"], r["total"], r["peak"]) for r in rows] == [(1, 3, 2005)]


def test_year_text_filter_drops_bare_years(spark):
    articles = spark.createDataFrame([(1, "2014", "j"), (2, "2014-02-01", "j")], "id long, pub_date string, journal string")
    assert [r["id"] for r in C.by_year_text(articles, 2014, 2014).collect()] == [2]


def test_pairs_of_large_keys(spark):
    rows = [("hot", i % 57) for i in range(80)] + [("k", 3), ("k", 5), ("k", 5), (None, 1), ("k", None)]
    table = spark.createDataFrame(rows, "k string, x long")
    whole = {tuple(r) for r in C.pair_counts(table, "k", "x", 2).collect()}
    assert {tuple(r) for r in C.pair_counts(table, "k", "x", 2, block=7).collect()} == whole and (3, 5, 6) in whole


def test_late_events_and_several_batches(spark, tmp_path):
    """Three files are three batches; an event two days late is dropped, one within the hour counts.

    Spark compares late events with the watermark of the batch before, so they come in the third one.
    """
    import os
    from datetime import datetime

    from citewright.streaming import events as S

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    day = lambda d, h=0, m=0: datetime(2024, 1, d, h, m)
    files = [[(1, day(1, 1), 1, "a", 1.0), (2, day(3, 1), 1, "a", 1.0)], [(4, day(3, 0, 30), 1, "a", 2.0), (2, day(3, 1), 1, "a", 1.0)], [(3, day(1, 2), 1, "a", 5.0), (5, day(3, 2), 1, "a", 4.0)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in os.listdir(f"{tmp_path}/in"):
            if f.endswith(".parquet") and not f.startswith("t"):
                os.rename(f"{tmp_path}/in/{f}", f"{tmp_path}/in/t{k}.parquet")
                os.utime(f"{tmp_path}/in/t{k}.parquet", (1_700_000_000 + k * 100, 1_700_000_000 + k * 100))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["start"].day: (r["n"], r["total"]) for r in S.drain(S.windowed(stream(), "1 day"), "update", ["start", "event_type"]).collect()}
    assert got == {1: (1, 1.0), 3: (4, 8.0)}
    assert sorted(r["event_id"] for r in S.drain(S.once(stream())).collect()) == [1, 2, 4, 5]
    (last,) = S.drain(S.latest(stream()), "update", ["user_id", "event_type"]).collect()
    assert (last["value"], last["n"]) == (4.0, 6)


def test_editors_and_authors_of_equal_sets_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(press, "MEMBERS", 3)
    works = spark.createDataFrame([(k, k % 5) for k in range(50)], "work long, parent long")
    people = spark.createDataFrame([(w, f"n{n}", "editor" if n % 3 == 0 else "author", 1) for w in range(50) for n in range(20) if n < 15 or (w % 5) in (n % 5, (n + 1) % 5)], "work long, name string, role string, place int")
    led = people.where("role = 'editor'").join(works, "work").select("parent", "name").distinct()
    sets, parents = press._by_set(led, "name", "s")
    assert sets.count() == 7 and parents.select("s").distinct().count() == 3 and parents.count() == 9
    held = {(r["parent"], r["name"], r["role"]) for r in people.join(works, "work").collect()}
    want = Counter((e, a) for p, e, x in held if x == "editor" for q, a, y in held if y == "author" and p == q and e != a)
    for top in (2, 220):
        got = {(r["editor"], r["author"]): r["weight"] for r in press.editor_network(works, people, top).collect()}
        best = sorted({a for _, a in want}, key=lambda n: (-sum(k for (_, a), k in want.items() if a == n), n))[:top]
        assert got == {k: n for k, n in want.items() if k[1] in best}


def test_pairs_of_cocited_authors_are_dealt_once(spark, monkeypatch):
    authors = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "z"), (3, "z"), (3, None)], "id long, name string")
    links = spark.createDataFrame([(s, t) for s in (10, 11, 12) for t in (1, 2, 3)] + [(13, 1), (14, 1), (15, 2), (15, 3), (15, 3)], "source long, target long")
    found = R.author_cocitation(authors, links, 2)
    assert {tuple(r) for r in found.collect()} == {("x", "y", 3), ("x", "z", 4), ("y", "z", 3)}
    written = []
    monkeypatch.setattr(R, "cut", lambda df, label: written.append(df) or df)
    R.author_cocitation(authors, links, 2)
    plan = written[-1]._jdf.queryExecution().optimizedPlan().toString()  # of the counted pairs: numbers alone are dealt
    assert "joint" not in plan and [f.dataType.simpleString() for f in written[-1].schema] == ["bigint", "bigint", "bigint"]


def test_shared_references_send_lists_and_no_pairs(spark):
    rows = [(s, t, None) for t in (100, 101) for s in range(8)] + [(s, None, "d") for s in range(0, 8, 2)] + [(s, 200 + s, None) for s in range(8)] + [(90, 100, None), (None, 100, None), (91, None, None), (92, 101, None), (92, 101, None), (92, 5, None), (92, 6, None)]
    citations = spark.createDataFrame(rows, "source long, target long, doi string")
    pairs, size = C._shared_references(citations, 2, 3, 10)
    want = {(a, b, 2 + (a % 2 == 0 and b % 2 == 0)) for a in range(8) for b in range(a + 1, 8)}
    assert {tuple(r) for r in pairs.collect()} == want
    assert {r["source"] for r in size.collect()} == {*range(8), 92}
    few = C._shared_references(citations, 1, 3, 8)[0]  # more citers than 8: 100 and 101 take no part
    assert {tuple(r) for r in few.collect()} == {(a, b, 1) for a in range(0, 8, 2) for b in range(a + 2, 8, 2)}
    assert "hashpartitioning(a#" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and "b#" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_shared_foundations_count_pairs_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(C, "cut", lambda df, label: kept.append(label) or df)
    citations = spark.createDataFrame([(s, 10 * t, None) for s in (1, 2, 3) for t in range(3 + (s < 3))], "source long, target long, doi string")
    assert {tuple(r) for r in C.shared_foundations(citations, 2, 3).collect()} == {(1, 2, 4, 1.0), (1, 3, 3, 0.75), (2, 3, 3, 0.75)}
    assert kept == ["shared"]

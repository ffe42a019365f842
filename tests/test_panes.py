from pyspark.sql import functions as F

from citewright.operators import panes as P


def test_reading_path_scores(spark):
    links = [(1, 2), (3, 1)] + [(100 + k, t) for k in range(20) for t in (1, 9)] + [(1, 500 + k) for k in range(2)] + [(8, 500), (8, 501), (1, 2)]
    citations = spark.createDataFrame([(a, b, "d", 1) for a, b in links] + [(1, None, "x", 2)], "source long, target long, doi string, ord int")
    ids = {n for link in links for n in link}
    records = spark.createDataFrame([(n, "J" if n in (1, 9) else None, "|A|b|" if n in (1, 2) else "|c|") for n in ids], "id long, journal string, tags string")
    got = {r["id"]: tuple(r)[1:] for r in P.reading_path(records, citations, 1).collect()}
    assert got[2] == (5, "cites", "Cited by this article; Cited by this article; shared topic")
    assert got[3] == (2, "cited_by", "Cites this article")
    assert got[9] == (6, "cocited", "Co-cited 20×; same journal")
    assert got[8] == (2, "coupled", "Shares 2 references")
    assert 1 not in got and P.reading_path(records, citations, 77).count() == 0


def test_leading_ranks_grow_with_the_corpus(spark):
    n = 5000
    articles = spark.range(n).select("id", F.col("id").alias("cited_globally"))
    citations = spark.range(n).select(F.lit(0).cast("long").alias("source"), F.col("id").alias("target"), F.lit("d").alias("doi"), F.lit(1).alias("ord"))
    got = P.inside_outside(articles, citations)
    sizes = {r["quadrant"]: r["n"] for r in got.groupBy("quadrant").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"tpc_specific": 100, "imported": 100, "background": 4800}  # a fiftieth part, not 50
    one = P.rank_agreement(got).first()
    assert one["n"] == n and one["rho"] == -1.0
    assert P.divergent(got).where("list = 'imported'").orderBy("place").first()["id"] == n - 1


def test_ranks_of_all(spark):
    rows = spark.createDataFrame([(k, k % 7) for k in range(1000)], "id long, v int").repartition(5)
    got = {r["id"]: r["place"] for r in P.ranked(rows, [F.desc("v"), F.col("id")], "place").collect()}
    assert [got[k] for k in sorted(range(1000), key=lambda k: (-(k % 7), k))] == list(range(1, 1001))


def test_concentration_of_few(spark):
    counts = spark.createDataFrame([(k,) for k in [9, 4, 4, 0, 0, None]], "n int")
    assert tuple(P.concentration(counts, "n").first()) == (6, 3, 17, 1.0, 1.0, 1.0, round(9 / 17, 6))
    assert tuple(P.concentration(counts.limit(0), "n").first()) == (0, 0, 1, 0.0, 0.0, 0.0, 0.0)


def test_reciprocity_of_articles(spark):
    links = [(1, 10, "A", "B"), (1, 10, "A", "B"), (10, 1, "B", "A"), (1, 11, "A", "B"), (12, 1, "B", "A"), (2, 10, "A", "B"), (3, 1, "A", "A"), (13, 2, "C", "A")]
    edges = spark.createDataFrame([(a, b, g, h, 1994, 1990) for a, b, g, h in links], "source long, target long, sg string, tg string, sy int, ty int")
    per = P.reciprocal_articles(edges, "A", "B")
    assert {tuple(r) for r in per.collect()} == {(1, "A", 2, 2, 1), (2, "A", 1, 0, 0), (10, "B", 1, 2, 1), (12, "B", 1, 0, 0)}
    assert [tuple(r) for r in P.most_reciprocal(per, "A").collect()] == [(1, 2, 2, 1)]
    assert {tuple(r) for r in P.reciprocity_decades(edges, "A", "B").collect()} == {(1990, 6, 3, 0.5), (None, 6, 3, 0.5)}


def test_concordance(spark):
    labels = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, "y"), (2, "y"), (None, "y")], "c int, k string")
    assert tuple(P.concordance(labels, "c", "k").first()) == (5, 3, 2, 3, 0.6)

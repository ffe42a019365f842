"""Panes of the chapter tools: delays, reciprocity, shape of influence, inside and outside ranks, teams, reading paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions.cleaning import split_tags
from citewright.operators.citations import degrees, resolved
from citewright.session import cut

LONGEST_DELAY = 50  # fixed: years from which on delays count as one
CANON = (50, 50)  # fixed: a leading rank is among the first 50, or the first 50th part of all where that is more
RELATED = 20  # fixed: how many co-cited and coupled articles a reading path takes
CLOSE = 5  # fixed: points for sharing citations or references at most


def _decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def delay_histogram(edges: DataFrame) -> DataFrame:
    """(sg, tg, delay, n): links by their delay in years, ``LONGEST_DELAY`` and more together."""
    late = F.least(F.col("sy") - F.col("ty"), F.lit(LONGEST_DELAY)).alias("delay")
    return edges.where("sy >= ty").groupBy("sg", "tg", late).agg(F.count("*").alias("n"))


def delay_decades(edges: DataFrame, least: int = 5) -> DataFrame:
    """(sg, tg, decade, mean, n): mean delay by the citing decade, where it has ``least`` links or more."""
    by = edges.where("sy >= ty").groupBy("sg", "tg", _decade(F.col("sy")).alias("decade")).agg(F.round(F.avg(F.col("sy") - F.col("ty")), 2).alias("mean"), F.count("*").alias("n"))
    return by.where(F.col("n") >= least)


def _across(edges: DataFrame, one: str, two: str) -> DataFrame:
    return edges.where(((F.col("sg") == one) & (F.col("tg") == two)) | ((F.col("sg") == two) & (F.col("tg") == one)))


def _returned(edges: DataFrame, one: str, two: str) -> DataFrame:
    """Links between two groups, repeated ones as often, and whether any link goes back."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct().withColumn("back", F.lit(1))
    return _across(edges, one, two).join(back, ["source", "target"], "left")


def reciprocity_decades(edges: DataFrame, one: str, two: str) -> DataFrame:
    """(decade, links, returned, rate) of the links between two groups, by citing decade; a row without decade for all."""
    rows = _returned(edges, one, two).select(_decade(F.col("sy")).alias("decade"), "back")
    every = rows.select(F.explode(F.when(F.col("decade").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.array("decade", F.lit(None).cast("int")))).alias("decade"), "back")
    return every.groupBy("decade").agg(F.count("*").alias("links"), F.count("back").alias("returned")).withColumn("rate", F.round(F.col("returned") / F.col("links"), 6))


def reciprocal_articles(edges: DataFrame, one: str, two: str) -> DataFrame:
    """(id, g, cites, cited_by, partners): articles of both groups with the articles of the other group that
    they cite, that cite them, and that do both; those that cite none are left out."""
    links = _across(edges, one, two).select("source", "target", "sg", "tg").distinct()
    ends = links.select(F.col("source").alias("id"), F.col("sg").alias("g"), F.col("target").alias("other"), F.lit(1).alias("out")).union(links.select("target", "tg", "source", F.lit(2)))
    pairs = ends.groupBy("id", "g", "other").agg(F.sum("out").alias("ways"))  # 1 cites, 2 is cited by, 3 both
    per = pairs.groupBy("id", "g").agg(*(F.count(F.when(F.col("ways").isin(*w), 1)).alias(n) for n, w in (("cites", (1, 3)), ("cited_by", (2, 3)), ("partners", (3,)))))
    return per.where("cites > 0")


def article_reciprocity(per: DataFrame) -> DataFrame:
    """(g, citing, reciprocated, rate): articles that cite the other group, and those of them it cites."""
    by = per.groupBy("g").agg(F.count("*").alias("citing"), F.count(F.when(F.col("cited_by") > 0, 1)).alias("reciprocated"))
    return by.withColumn("rate", F.round(F.col("reciprocated") / F.col("citing"), 6))


def most_reciprocal(per: DataFrame, group: str, top: int = 25) -> DataFrame:
    own = per.where((F.col("g") == group) & (F.col("cited_by") > 0))
    return own.orderBy(F.desc("partners"), F.desc(F.col("cites") + F.col("cited_by")), "id").limit(top).select("id", "cites", "cited_by", "partners")


def concentration(counts: DataFrame, value: str) -> DataFrame:
    """One row: articles, how many have none, the total, and the shares of the first 10, 50, 100 and hundredth part.

    Without any the total counts as 1. Counts by value take the place of an order of all articles.
    """
    by = counts.groupBy(F.coalesce(F.col(value), F.lit(0)).alias("v")).agg(F.count("*").alias("k"))
    run = by.withColumn("above", F.sum("k").over(Window.orderBy(F.desc("v"))) - F.col("k")).withColumn("n", F.sum("k").over(Window.partitionBy()))  # a row per distinct value

    def share(first: Column) -> Column:
        inside = F.greatest(F.lit(0), F.least(F.col("k"), first - F.col("above")))
        return F.sum(inside * F.col("v"))

    hundredth = F.greatest(F.lit(1), F.floor(F.col("n") / 100))
    sums = run.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("articles"), F.coalesce(F.max(F.when(F.col("v") == 0, F.col("k"))), F.lit(0)).alias("without"),
        F.greatest(F.coalesce(F.sum(F.col("k") * F.col("v")), F.lit(0)), F.lit(1)).alias("total"),
        *(share(F.lit(k)).alias(f"top_{k}") for k in (10, 50, 100)), share(hundredth).alias("top_percent"),
    )
    shares = [F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("total"), 6).alias(c) for c in ("top_10", "top_50", "top_100", "top_percent")]
    return sums.select("articles", "without", "total", *shares)


def frequencies(counts: DataFrame, value: str, top: int = 200) -> DataFrame:
    """(count, articles): how many articles have each count above 0, the lowest ``top`` counts."""
    return counts.where(F.col(value) > 0).groupBy(F.col(value).alias("count")).agg(F.count("*").alias("articles")).orderBy("count").limit(top)


def rank_frequencies(counts: DataFrame, value: str, top: int = 500) -> DataFrame:
    """(rank, count) of the ``top`` articles by count, counts of 0 left out."""
    best = counts.where(F.col(value) > 0).orderBy(F.desc(value)).limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc(value))).alias("rank"), F.col(value).alias("count"))  # ``top`` rows


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their places, from 1, in an order of all that should leave no ties.

    Rows are dealt out by ranges of the order and stored; each range numbers its own rows, after the sizes of
    the ranges before it. No task holds more than a range.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(before, "_part").select(*rows.columns, (F.col("_before") + inside).alias(name))


def inside_outside(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, n_in, cited_globally, internal_rank, global_rank, quadrant) of articles cited anywhere.

    Ranks have no ties (the smaller id leads). shared_canon leads both here and globally, tpc_specific
    here only, imported globally only, background neither.
    """
    n = degrees(articles, citations).select("id", "n_in").join(articles.select("id", F.coalesce("cited_globally", F.lit(0)).alias("cited_globally")), "id")
    cited = n.where("n_in > 0 or cited_globally > 0")
    both = ranked(ranked(cited, [F.desc("n_in"), F.col("id")], "internal_rank"), [F.desc("cited_globally"), F.col("id")], "global_rank")
    size = cited.agg(F.greatest(F.lit(CANON[0]), F.floor(F.count("*") / CANON[1])).alias("first"))  # one row
    here, there = F.col("internal_rank") <= F.col("first"), F.col("global_rank") <= F.col("first")
    quadrant = F.when(here & there, "shared_canon").when(here, "tpc_specific").when(there, "imported").otherwise("background")
    return both.crossJoin(F.broadcast(size)).select("id", "n_in", "cited_globally", "internal_rank", "global_rank", quadrant.alias("quadrant"))


def divergent(quadrants: DataFrame, top: int = 25) -> DataFrame:
    """(list, place, id): the leaders that lead on one side only."""
    lists = (("tpc_specific", "internal_rank"), ("imported", "global_rank"))
    parts = [quadrants.where(F.col("quadrant") == name).orderBy(rank).limit(top).select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(rank)).alias("place"), "id") for name, rank in lists]
    return parts[0].union(parts[1])


def rank_agreement(quadrants: DataFrame) -> DataFrame:
    """One row: articles, those of each quadrant, and the correlation of both ranks."""
    names = ("shared_canon", "tpc_specific", "imported", "background")
    gap = (F.col("internal_rank") - F.col("global_rank")).cast("double")
    sums = quadrants.agg(F.count("*").alias("n"), *(F.count(F.when(F.col("quadrant") == q, 1)).alias(q) for q in names), F.sum(gap * gap).alias("d"))
    n = F.col("n").cast("double")
    return sums.select("n", *names, F.when(F.col("n") > 1, F.round(1 - 6 * F.col("d") / (n * (n * n - 1)), 6)).alias("rho"))


def team_decades(years: DataFrame) -> DataFrame:
    """(decade, articles, solo_share, mean_size, largest) from yearly rows of ``chapters.team_years``: means are of the yearly means to 2 places."""
    by = years.groupBy(_decade(F.col("year")).alias("decade")).agg(
        F.sum("articles").alias("articles"), F.round(F.sum(F.round(F.col("solo_share") * F.col("articles"))) / F.sum("articles"), 6).alias("solo_share"),
        F.round(F.sum(F.round("mean_size", 2) * F.col("articles")) / F.sum("articles"), 6).alias("mean_size"), F.max("largest").alias("largest"))
    return by


def concordance(labels: DataFrame, citing: str, coupling: str) -> DataFrame:
    """One row: labelled articles and how many have the citation label most frequent in their coupling
    cluster (ties: the smaller), with the numbers of clusters."""
    pairs = labels.select(F.col(citing).alias("c"), F.col(coupling).alias("k")).dropna().groupBy("c", "k").agg(F.count("*").alias("n"))
    best = pairs.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("best"), F.sum("n").alias("n"))
    sums = best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(-F.col("best.n")), F.lit(0)).alias("concordant"), F.count("*").alias("coupling_clusters"))
    own = pairs.agg(F.countDistinct("c").alias("citation_communities"))  # two rows of one
    return sums.crossJoin(F.broadcast(own)).withColumn("rate", F.round(F.col("concordant") / F.greatest("n", F.lit(1)), 6))


def reading_path(records: DataFrame, citations: DataFrame, article: int) -> DataFrame:
    """(id, score, relations, reason): what to read around an article, the best first.

    Each link to or from the article counts 2, an article cited along with it or citing the same articles
    the number of those, 5 at most (the ``RELATED`` first of each kind, ties by id), a shared tag 1, the same
    journal 1. ``records`` has id, journal and tags.
    """
    links = resolved(citations)
    cited = links.where(F.col("source") == article).select(F.col("target").alias("id"), F.lit(0).alias("order"), F.lit("cites").alias("kind"), F.lit(1).cast("long").alias("weight"))
    citing = links.where(F.col("target") == article).select(F.col("source").alias("id"), F.lit(1), F.lit("cited_by"), F.lit(1).cast("long"))

    def near(own: str, other: str, order: int, kind: str) -> DataFrame:
        keys = links.where(F.col(own) == article).select(other).distinct()
        found = links.join(keys, other, "left_semi").where(F.col(own) != article).groupBy(F.col(own).alias("id")).agg(F.countDistinct(other).alias("weight"))
        known = found.join(records.select("id"), "id", "left_semi")
        return known.orderBy(F.desc("weight"), "id").limit(RELATED).select("id", F.lit(order), F.lit(kind), "weight")

    every = cited.union(citing).union(near("target", "source", 2, "cocited")).union(near("source", "target", 3, "coupled")).where(F.col("id") != article)
    count = F.col("weight").cast("string")
    # fixed: how reasons are worded
    reason = (
        F.when(F.col("kind") == "cites", "Cited by this article").when(F.col("kind") == "cited_by", "Cites this article").when(F.col("kind") == "cocited", F.concat(F.lit("Co-cited "), count, F.lit("×")))
        .otherwise(F.concat(F.lit("Shares "), count, F.when(F.col("weight") == 1, " reference").otherwise(" references")))
    )
    points = F.when(F.col("order") < 2, 2).otherwise(F.least("weight", F.lit(CLOSE)))
    by = every.groupBy("id").agg(F.sum(points).alias("points"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.sort_array(F.collect_list(F.struct("order", reason.alias("r")))).alias("why"))
    seed = records.where(F.col("id") == article).select(F.coalesce("journal", F.lit("")).alias("j"), F.coalesce(split_tags(F.col("tags")), F.array().cast("array<string>")).alias("ts")).limit(1)
    joined = by.join(records.select("id", "journal", "tags"), "id").crossJoin(F.broadcast(seed))  # one row
    topic = F.coalesce(F.arrays_overlap(split_tags(F.col("tags")), "ts"), F.lit(False))
    same = F.coalesce("journal", F.lit("")) == F.col("j")
    more = F.array_compact(F.array(F.when(topic, "shared topic"), F.when(same, "same journal")))
    text = F.array_join(F.concat(F.transform("why", lambda x: x["r"]), more), "; ")
    score = F.col("points") + topic.cast("int") + same.cast("int")
    return joined.select("id", score.cast("long").alias("score"), F.array_join("kinds", ",").alias("relations"), text.alias("reason")).orderBy(F.desc("score"), "id")

"""Affiliations(id, name, place): institutions by articles, years and people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _top(rows: DataFrame, limit: int) -> DataFrame:
    by = rows.where("place is not null").groupBy("place").agg(F.countDistinct("id").alias("articles"), F.countDistinct("name").alias("people"))
    return by.orderBy(F.desc("articles"), "place").limit(limit)


def top_institutions(rows: DataFrame, limit: int = 25) -> DataFrame:
    return _top(rows, limit)


def by_year(rows: DataFrame, articles: DataFrame, top: int = 10, since: int = 1990) -> DataFrame:
    """Articles per year of the ``top`` institutions, years without any as 0."""
    best = _top(rows, top).select("place")
    years = rows.join(best, "place", "left_semi").select("place", "id").distinct().join(articles.where(F.col("year") >= since).select("id", "year"), "id")
    n = years.groupBy("place", "year").agg(F.count("*").alias("n"))
    span = n.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("year"))
    grid = best.crossJoin(F.broadcast(span))  # ``top`` rows and the years
    return grid.join(n, ["place", "year"], "left").select("place", "year", F.coalesce("n", F.lit(0)).alias("n"))


def top_people(rows: DataFrame, place: int, limit: int = 10) -> DataFrame:
    return rows.where(F.col("place") == place).groupBy("name").agg(F.countDistinct("id").alias("articles")).orderBy(F.desc("articles"), "name").limit(limit)


def articles_of(rows: DataFrame, articles: DataFrame, place: int, limit: int = 200, offset: int = 0) -> DataFrame:
    found = articles.join(rows.where(F.col("place") == place).select("id"), "id", "left_semi")
    return found.select("id", "pub_date", "journal").orderBy(F.desc("pub_date"), "id").offset(offset).limit(limit)


def of_author(rows: DataFrame, name: str) -> DataFrame:
    return rows.where((F.col("name") == name) & F.col("place").isNotNull()).groupBy("place").agg(F.countDistinct("id").alias("articles"))


def editorial_stamps(rows: DataFrame, least: int = 25, dominance: float = 0.35) -> DataFrame:
    """(journal, place, reason): institutions that a journal's office, not its authors, put there.

    ``rows(name, journal, place, book)``. Dominance: a journal with ``least`` or more placed authors
    has ``dominance`` of them at one institution. Single venue: ``least`` authors, one journal, no book.
    The second reason replaces the first.
    """
    placed = rows.where("place is not null")
    papers = placed.where("not book and journal is not null")
    total = papers.groupBy("journal").agg(F.countDistinct("name").alias("total")).where(F.col("total") >= least)
    pair = papers.groupBy("journal", "place").agg(F.countDistinct("name").alias("authors")).join(total, "journal").where(F.col("authors") >= dominance * F.col("total"))
    only = placed.groupBy("place").agg(
        F.countDistinct("name").alias("authors"), F.countDistinct(F.when(~F.col("book"), F.col("journal"))).alias("venues"),
        F.count(F.when(F.col("book"), 1)).alias("books"), F.min(F.when(~F.col("book"), F.col("journal"))).alias("journal"),
    ).where((F.col("authors") >= least) & (F.col("venues") == 1) & (F.col("books") == 0))
    both = pair.select("journal", "place", F.lit("dominance").alias("reason")).union(only.select("journal", "place", F.lit("single-venue")))
    return both.groupBy("journal", "place").agg(F.max("reason").alias("reason"))


def drop_stamps(rows: DataFrame, stamps: DataFrame) -> DataFrame:
    """``rows`` with stamped institutions set to null."""
    found = rows.join(stamps.select("journal", "place", F.lit(True).alias("_stamped")), ["journal", "place"], "left")
    return found.withColumn("place", F.when(F.col("_stamped").isNull(), F.col("place"))).drop("_stamped").select(*rows.columns)

"""Entity resolution of harvested records against deposited ones, and applying its merges."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.functions.names import unused
from citewright.functions.values import norm_title, ordinal
from citewright.operators.removal import suppressed
from citewright.session import batch_rows, cut

REVIEW = r"(?i)^(book )?review( essay)?:?\s+"  # fixed: the prefixes that harvests disagree on
STEM = 25


KEY = 16  #: bytes of the SHA-256 digest that stands for a title


def _key(title: Column) -> Column:
    return F.substring(F.unhex(F.sha2(title, 256)), 1, KEY)


def _starts(titles: pd.Series) -> pd.Series:
    """The keys of all starts of a title that end at a word before the last."""

    def of(title: str) -> list[bytes]:
        done, keys = hashlib.sha256(), []
        words = title.split(" ")
        for k, word in enumerate(words[:-1]):
            done.update((f" {word}" if k else word).encode())
            keys.append(done.copy().digest()[:KEY])
        return keys

    return titles.map(of)


def _extends(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(long, short): keys of titles where one of ``shorter(t)``, keys, is a start of one of ``longer(title)``, texts,
    that ends at a word. Of a long title nothing but keys leaves the task that reads it."""
    run = F.pandas_udf(_starts, "array<binary>")
    starts = longer.where(F.contains("title", F.lit(" "))).select(_key(F.col("title")).alias("long"), F.explode(run("title")).alias("short"))
    return starts.join(shorter.select(F.col("t").alias("short")), "short").select("long", "short").distinct()


def match_cascade(rows: DataFrame, canonical: str = "crossref") -> DataFrame:
    """(canonical, duplicate, stage) for rows(id, title, year, source, filled); the first rule that finds one row wins.

    Rows of source ``canonical`` take in others by 1: title and year; 2: a title that occurs once;
    3: a title that extends the other by words, if only one does, occurs once and has 25 characters
    in common or the same year; 4: that one title's only row of the same year. Titles without a
    review prefix follow, as stages 5 to 8. What is left merges by title and year (stage 9) into the
    row with most filled fields. All comparisons are joins on digests of normalised titles and of their starts.
    """
    batch_rows(rows.sparkSession, 1000)
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    own, title = F.coalesce(F.col("source") == canonical, F.lit(False)), F.coalesce("title", F.lit(""))
    bare = F.regexp_replace(title, REVIEW, "")
    texts = F.array(norm_title(title), F.when(~F.col("own") & (bare != title), norm_title(bare)))
    turns = rows.select("id", "filled", own.alias("own"), year.alias("y"), title.alias("title")).select("id", "filled", "own", "y", F.posexplode(texts).alias("turn", "title"))
    keyed = cut(turns.where("title is not null").select("id", "filled", "own", "y", "turn", F.length("title").alias("size"), _key(F.col("title")).alias("t")), "titles")
    canon = keyed.where("own").select(F.col("id").alias("canonical"), "t", "y", "size")
    others = keyed.where("not own and turn = 0").select("id", "filled", "y", "t")
    tries = keyed.where("not own and size > 0").select("id", "y", "turn", "t", "size")
    by_key = canon.groupBy("t", "y").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")
    by_title = canon.groupBy("t").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical"), F.min("y").alias("cy"), F.min("size").alias("csize"))
    once = by_title.where("n = 1")
    stages = [tries.join(by_key, ["t", "y"]).select("id", "canonical", "turn", F.lit(1).alias("stage")), tries.join(once, "t").select("id", "canonical", "turn", F.lit(2).alias("stage"))]
    # pairs (t, c) where one title extends the other
    asked = tries.select("t").distinct()
    titles = by_title.select("t")
    pairs = _extends(turns.where("own").select("title"), asked).select(F.col("short").alias("t"), F.col("long").alias("c")).union(_extends(turns.where("not own").select("title"), titles).select("long", "short"))
    alone = pairs.groupBy("t").agg(F.count("*").alias("k"), F.min("c").alias("c")).where("k = 1").drop("k")
    near = tries.join(alone, "t")
    stem = F.least("size", "csize") >= STEM
    third = near.join(once.withColumnRenamed("t", "c"), "c").where(stem | (F.col("cy") == F.col("y")))
    fourth = near.where("y <> ''").join(by_key.withColumnRenamed("t", "c"), ["c", "y"])
    stages += [third.select("id", "canonical", "turn", F.lit(3).alias("stage")), fourth.select("id", "canonical", "turn", F.lit(4).alias("stage"))]
    found = reduce(DataFrame.union, stages).withColumn("stage", F.col("turn") * 4 + F.col("stage"))
    found = found.groupBy("id").agg(F.min(F.struct("stage", "canonical")).alias("m")).select("m.canonical", F.col("id").alias("duplicate"), "m.stage")
    left = others.join(found, others["id"] == found["duplicate"], "left_anti")
    keeper = left.groupBy("t", "y").agg(F.min_by("id", F.struct(-F.col("filled"), F.col("id"))).alias("canonical"), F.count("*").alias("n")).where("n > 1")
    rest = left.join(keeper, ["t", "y"]).where("id <> canonical").select("canonical", F.col("id").alias("duplicate"), F.lit(9).alias("stage"))
    return found.union(rest)


def filled(columns: list[str]):
    """How many of the columns hold something."""
    return reduce(add, (F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns), F.lit(0))


def apply_merges(rows: DataFrame, merges: DataFrame, fill: list[str]) -> DataFrame:
    """``rows`` without duplicates; empty ``fill`` columns of canonical rows take the value of the
    duplicate with the smallest id that has one."""
    into, *new = unused(["into", *(f"new_{c}" for c in fill)], rows)
    gone = merges.select(F.col("duplicate").alias("id"), F.col("canonical").alias(into))
    value = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    given = rows.join(gone, "id").groupBy(into).agg(*(F.min_by(value(c), F.when(value(c).isNotNull(), F.col("id"))).alias(m) for c, m in zip(fill, new)))
    kept = rows.join(gone.select("id"), "id", "left_anti").join(given.withColumnRenamed(into, "id"), "id", "left")
    names = dict(zip(fill, new))
    return kept.select(*(F.coalesce(value(c), names[c], c).alias(c) if c in names else c for c in rows.columns))


def repoint(citations: DataFrame, merges: DataFrame) -> DataFrame:
    """Links of duplicates moved to their canonical rows, on both ends."""
    for end in ("source", "target"):
        (to,) = unused(["moved_to"], citations)
        moved = merges.select(F.col("duplicate").alias(end), F.col("canonical").alias(to))
        citations = citations.join(moved, end, "left").withColumn(end, F.coalesce(to, end)).drop(to)
    return citations


def upsert_fill(target: DataFrame, batch: DataFrame, key: str, fill: list[str], ledger: DataFrame | None = None) -> DataFrame:
    """``target`` with rows of new keys added and, for known keys, only empty ``fill`` columns taken
    from the batch. Of equal keys in the batch the one with the smallest other values counts. Names of
    ``ledger`` in lists of authors and editors come in as tokens."""
    batch = suppressed(batch, ledger)
    others = [c for c in target.columns if c != key]
    n, known, *new = unused(["n", "known", *(f"new_{c}" for c in others)], target, batch)
    names = dict(zip(others, new))
    fresh = batch.withColumn(n, ordinal(*(F.col(c) for c in others), by=(key,))).where(F.col(n) == 1).select(key, *(F.col(c).alias(names[c]) for c in others))
    both = target.withColumn(known, F.lit(True)).join(fresh, key, "full_outer")
    pick = lambda c: F.when(F.col(known), F.coalesce(c, names[c]) if c in fill else F.col(c)).otherwise(F.col(names[c]))
    return both.select(*(pick(c).alias(c) if c != key else c for c in target.columns))

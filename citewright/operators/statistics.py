"""Rank correlation, rank test and agreement of labelings, from counts of values.

Windows without a partition run over distinct values, which rows are first counted by.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rational approximation of the error function (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function of a value of 0 or more, within 2e-7."""
    t = 1 / (1 + ERF_P * x)
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + a) * t
    return series * F.pow(F.lit(exp(1)), -x * x)


def average_ranks(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """(value, rank) of a table with one row per value; rows of equal values share their mean rank."""
    upto = F.sum(n).over(Window.orderBy(value))
    return counts.select(value, (upto - (F.col(n) - 1) / 2).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and rho over the rows where both values are known; null where one never varies."""
    pairs = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n"))
    rx, ry = (average_ranks(pairs.groupBy(v).agg(F.sum("n").alias("n")), v).withColumnRenamed("rank", f"r{v}") for v in "xy")
    both = pairs.join(rx, "x").join(ry, "y")
    total = lambda c: F.sum(F.col("n") * c)
    sums = both.agg(F.sum("n").alias("n"), total(F.col("rx") * F.col("ry")).alias("xy"), total(F.col("rx") ** 2).alias("xx"), total(F.col("ry") ** 2).alias("yy"))
    base = F.col("n") * ((F.col("n") + 1) / 2) ** 2  # what equal ranks would give
    spread = (F.col("xx") - base) * (F.col("yy") - base)
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(spread > 0, F.round((F.col("xy") - base) / F.sqrt(spread), 6)).alias("rho"))


def mann_whitney(rows: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: sizes, U of ``first``, z and two-sided p (normal approximation, corrected for ties
    and continuity). Without rows in one group, or with one value only, z and p are null."""
    own = rows.select(F.col(value).alias("v"), (F.col(group) == first).cast("int").alias("one")).where(F.col(group).isin(first, second)).dropna()
    counts = own.groupBy("v").agg(F.count("*").alias("n"), F.sum("one").alias("one"))
    ranked = counts.join(average_ranks(counts.select("v", "n"), "v"), "v")
    n, a = F.col("n"), F.col("n_first")
    sums = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("one"), F.lit(0)).alias("n_first"), F.sum(F.col("one") * F.col("rank")).alias("ranks"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    b = n - a
    u = sums.select((F.col("ranks") - a * (a + 1) / 2).alias("u"), a, b.alias("n_second"), F.sqrt(a * b / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))).alias("sd"))
    z = (F.greatest("u", a * F.col("n_second") - F.col("u")) - a * F.col("n_second") / 2 - 0.5) / F.col("sd")
    scored = u.withColumn("z", F.when(F.col("sd") > 0, z))
    p = F.when(F.col("z") > 0, erfc(F.col("z") / F.sqrt(F.lit(2.0)))).when(F.col("z").isNotNull(), 1.0)
    return scored.select("n_first", "n_second", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"), F.round(p, 6).alias("p"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, normalised mutual information (arithmetic mean) and adjusted Rand index.

    Two labelings that both hold one class only agree fully.
    """
    cells = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))
    choose = lambda c: c * (c - 1) / 2
    log_sum = F.sum(F.col("n") * F.ln("n"))

    def side(s: str) -> DataFrame:
        return cells.groupBy(s).agg(F.sum("n").alias("n")).agg(log_sum.alias(f"l{s}"), F.sum(choose(F.col("n"))).alias(f"c{s}"))

    sums = cells.agg(F.sum("n").alias("n"), log_sum.alias("l"), F.sum(choose(F.col("n"))).alias("c"))
    every = sums.crossJoin(side("a")).crossJoin(side("b"))  # one row each
    n = F.col("n")
    ha, hb, joint = (F.ln(n) - F.col(c) / n for c in ("la", "lb", "l"))
    expected = F.col("ca") * F.col("cb") / choose(n)
    mean = (F.col("ca") + F.col("cb")) / 2
    nmi = F.when(ha + hb < 1e-12, 1.0).otherwise(F.round(2 * (ha + hb - joint) / (ha + hb), 6))
    ari = F.when((n < 2) | (mean == expected), 1.0).otherwise(F.round((F.col("c") - expected) / (mean - expected), 6))
    return every.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(n > 0, nmi).alias("nmi"), F.when(n > 0, ari).alias("ari"))

"""Which filter removes what: steps of every order of the filters, and each filter's fair share.

Five yes-or-no filters make 32 coalitions. All that an order of them does is differences of coalition
removals, v(S) = documents failing any filter of S: one table of 32 counts for each part of the corpus
answers all 120 orders. The fair share (Shapley value) is the solution of a least squares problem: the
additive game closest to v under the Shapley kernel, its shares summing to v of all filters. Its normal
equations are the same for every part and linear in v, so they are solved once, in rationals, for each
coalition's unit vector; a part's shares are then whole-number combinations of its 32 counts.

All work on documents is DataFrame expressions and partial aggregates. Equal texts meet as digests,
counted before they meet, so a text that many documents share is a few rows.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 200  #: A: fewer words fail
MIN_DISTINCT = 50  #: B: a smaller percentage of distinct words fails
MAX_CAPITALS = 3  #: C: a larger percentage of capitals fails
SYMBOLS = "[#$%&*|]"  #: D: any of these fails
REPEAT = 1 << FILTERS.index("E")  #: E: the text of a smaller id


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` fails; E needs the other documents."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = (
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    )
    bits = [F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): documents by the filters they fail and by their labels.

    Null texts are empty texts, a null lang is the part ''. Rows with an id fail E if a row with the
    same text has a smaller one, so repeated rows of the smallest id pass; rows without an id neither
    fail E nor make others fail. A document is good or toxic if any of its labels says so. Other columns
    are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_failures(text).alias("failed"),
    ).withColumn("key", F.coalesce(F.col("id").cast("string"), F.hex("digest")))  # rows without id don't meet in one task
    flags = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("string").alias("key"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    kind = ["part", "failed", "good", "toxic"]
    by_id = (
        rows.join(flags, (rows["key"] == flags["key"]) & rows["id"].isNotNull(), "left")
        .select("digest", "id", "part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        .groupBy("digest", "id", *kind)
        .agg(F.count("*").alias("n"))
    )
    copies = by_id.groupBy("digest", F.col("id").isNotNull().alias("known"), *kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    # By now a digest has at most a row for each part and label, the languages of one text: small windows.
    first = F.min("least.id").over(Window.partitionBy("digest"))
    own = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    marked = copies.withColumn("first", first).withColumn("later", F.when(F.col("known"), F.col("n") - own).otherwise(0))
    both = F.array(
        F.struct(F.col("failed"), (F.col("n") - F.col("later")).alias("n")),
        F.struct((F.col("failed") + REPEAT).alias("failed"), F.col("later").alias("n")),
    )
    split = marked.select("part", "good", "toxic", F.inline(both))
    return split.where("n > 0").groupBy(*kind).agg(F.sum("n").alias("n"))


def coalition_removals(counts: DataFrame) -> DataFrame:
    """(part, total, v): v[S] has the documents, good and toxic ones, that fail any filter of S, S from 0 to 31."""
    everything = (1 << len(FILTERS)) - 1
    hit = F.col("failed").bitwiseAND(F.col("s")) != 0
    by_set = (
        counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(everything))).alias("s"))
        .groupBy("part", "s")
        .agg(
            F.sum("n").alias("total"),
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n"),
            F.sum(F.when(hit, F.col("n") * F.col("good")).otherwise(0)).alias("good"),
            F.sum(F.when(hit, F.col("n") * F.col("toxic")).otherwise(0)).alias("toxic"),
        )
    )
    return by_set.groupBy("part").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("v"))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with ``matrix`` X = ``right``, by elimination in rationals."""
    rows = [[*m, *r] for m, r in zip(matrix, right, strict=True)]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [row[len(matrix) :] for row in rows]


def share_weights(n: int) -> list[list[Fraction]]:
    """w[i][S]: the share of filter i is the sum of w[i][S] v(S).

    Shares minimise sum k(S) (v(S) - sum of shares in S)^2 over proper coalitions, k the Shapley kernel,
    and sum to v of all filters: a bordered system, solved for the unit vector of each coalition.
    """
    every = (1 << n) - 1
    member = [[s >> i & 1 for i in range(n)] for s in range(every + 1)]
    kernel = {s: Fraction(n - 1, comb(n, sum(member[s])) * sum(member[s]) * (n - sum(member[s]))) for s in range(1, every)}
    normal = [[sum((k * member[s][i] * member[s][j] for s, k in kernel.items()), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    normal.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel.get(s, Fraction(0)) * member[s][i] for s in range(every + 1)] for i in range(n)]
    right.append([Fraction(int(s == every)) for s in range(every + 1)])
    return solve(normal, right)[:n]


def steps() -> list[dict]:
    """The steps of all orders: the filter's bit, the coalitions before and after it, its weights times 120."""
    n = len(FILTERS)
    orders = factorial(n)
    weights = [[w * orders for w in row] for row in share_weights(n)]
    assert all(w.denominator == 1 for row in weights for w in row)
    out = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            out.append({"o": "".join(FILTERS[k] for k in order), "step": step, "bit": 1 << i, "before": before, "after": before | 1 << i, "w": [int(w) for w in weights[i]]})
            before |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A row for each part, order and step, zeros included; what ``failure_counts`` says of odd input
    holds. A table without documents has no parts and gives no rows.
    """
    removals = coalition_removals(failure_counts(docs, labels))
    kind = "array<struct<o string, step int, bit int, before int, after int, w array<bigint>>>"
    rows = removals.select("part", "total", "v", F.inline(F.from_json(F.lit(json.dumps(steps())), kind)))
    every = F.lit((1 << len(FILTERS)) - 1)

    def v(coalition: Column, what: str = "n") -> Column:
        return F.get(F.col("v"), coalition)[what]

    removed = v(F.col("after")) - v(F.col("before"))
    shares = F.zip_with(F.col("v"), F.col("w"), lambda x, w: x["n"] * w)
    return rows.select(
        "part",
        F.col("o").alias("filter_order"),
        "step",
        (F.col("total") - v(F.col("after"))).alias("kept"),
        removed.alias("removed"),
        (v(F.col("bit")) - removed).alias("redundant"),
        (v(every) - v(every - F.col("bit"))).alias("unique_fails"),
        (v(F.col("after"), "good") - v(F.col("before"), "good")).alias("good_lost"),
        (v(F.col("after"), "toxic") - v(F.col("before"), "toxic")).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )

"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule is the fractional part of t times the golden ratio; mapped through the
sources' cumulative target shares it names a source, and every stretch of slots serves each source
near its share. A source's documents, shuffled by a hash, form a stream that is cut into blocks of
equal words; the source's slots, ranked, take its blocks one after the other and start again when
they are used up.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions.names import unused
from citewright.session import cut

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 64
SLOTS = 1 << 18  #: a mix has at least so many slots, if it has as many words
CELLS = 1 << 12  #: of the unit interval, to look up the slots' sources
CHUNK = 1 << 16  #: slots ranked together
BROADCAST = 100_000  #: sources up to which their targets go to every task
SALTS = 64
_GOLDEN = Fraction(11400714819323198485, 1 << 64)  # 1 / golden ratio, to 64 bits
_STEP = 1 << 20


def _point() -> F.Column:
    """The fractional part of (t + 1/2) / golden ratio, exact enough for any t below 2 ** 40."""
    high = F.floor(F.col("t") / F.lit(_STEP)) * F.lit(float(_GOLDEN * _STEP % 1))
    low = (F.col("t") % F.lit(_STEP) + F.lit(0.5)) * F.lit(float(_GOLDEN))
    return (high + low) % F.lit(1.0)


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), a row for each source.

    Sources in code point order, null last, weigh 5, 2, 1 and again. They share the whole; a target
    stops at ``REPEATS`` times its source, and what is above goes to the others by weight. That
    level is found by order of size per weight: a source is at its limit if the level that the ones
    before it leave is above its own. There is a row per source here, whatever the documents.
    """
    ranked = sources.selectExpr("source", "source_size", "row_number() over (order by source asc nulls last) as place")
    weigh = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weigh.cast("long")).withColumn("most", F.col("source_size") * REPEATS)
    before = "rows between unbounded preceding and 1 preceding"
    order = "order by most / weight, place"
    ranked = ranked.selectExpr(
        "*", "sum(source_size) over () as whole", "sum(weight) over () as weights",
        f"coalesce(sum(most) over ({order} {before}), 0) as most_before", f"coalesce(sum(weight) over ({order} {before}), 0) as weight_before",
    )
    ranked = ranked.withColumn("full", (F.col("whole") - F.col("most_before")) * F.col("weight") >= F.col("most") * (F.col("weights") - F.col("weight_before")))
    ranked = ranked.selectExpr("*", "whole - sum(if(full, most, 0)) over () as rest", "sum(if(full, 0, weight)) over () as rest_weight")
    return ranked.selectExpr("source", "source_size", "weight", "place", "whole", "cast(if(full, most, rest * weight / rest_weight) as double) as target")


def schedule(mix: DataFrame, slots: int) -> DataFrame:
    """(source place, rank) of each slot: the k-th slot of a source has rank k, from 0."""
    spark = mix.sparkSession
    edges = mix.where("target > 0").selectExpr("place", "sum(target) over (order by place) as upto", "target", "sum(target) over () as all")
    edges = edges.selectExpr("place", "(upto - target) / all as low", "if(upto = max(upto) over (), 1.0, upto / all) as high")
    cells = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(slots).select(F.col("id").alias("t")).withColumn("u", _point()).withColumn("cell", F.floor(F.col("u") * CELLS))
    chosen = points.join(cells, "cell").where("u >= low and u < high").select("t", "place", F.floor(F.col("t") / CHUNK).alias("chunk"))
    counts = chosen.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.selectExpr("place", "chunk", "sum(n) over (partition by place order by chunk) - n as before")
    numbered = chosen.selectExpr("place", "chunk", "row_number() over (partition by place, chunk order by t) - 1 as k")
    return numbered.join(offsets, ["place", "chunk"]).selectExpr("place", "before + k as rank")


def mix_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) for each row.

    size is the number of words, 0 for null and blank texts, which are never taken. A null source is
    a source. The order of a source's documents is a hash of id and text, so reruns agree; repeated rows
    follow each other and are taken on their own; null ids are one more id; a very long text fills
    as many blocks as it needs; other columns, whatever their names, are ignored; an empty table
    gives no rows.
    """
    return _taken(docs, id_col, text_col, source_col).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, h, size, source_size, target, taken) for each row; h is a hash of its text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("h"), size.alias("size"))
    rows = cut(rows.withColumn("order", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "h"))), "sizes")
    mix = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    whole, sources = mix.agg(F.coalesce(F.max("whole"), F.lit(0)), F.count("*")).first()
    block = max(1, min(BLOCK_WORDS, whole // SLOTS))
    uses = _uses(mix, schedule(mix, -(-whole // block)), block)
    placed = _with_mix(rows, mix, sources).withColumn("bucket", F.substring("order", 1, 3))
    sums = placed.groupBy("place", "bucket").agg(F.sum("size").alias("z"))
    offsets = sums.selectExpr("place", "bucket", "sum(z) over (partition by place order by bucket) - z as before")
    streamed = placed.selectExpr("*", "sum(size) over (partition by place, bucket order by order, id, size, h rows between unbounded preceding and current row) - size as inner")
    streamed = streamed.join(offsets, ["place", "bucket"]).withColumn("first", F.col("before") + F.col("inner")).withColumn("last", F.col("first") + F.col("size"))
    streamed = cut(streamed.select("id", "source", "h", "source_size", "target", "size", "place", "first", "last").withColumn("row", F.monotonically_increasing_id()), "stream")
    # a document's words by block: all blocks between its first and last word
    parts = streamed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(last - 1) div {block}"))))
    parts = parts.selectExpr("row", "place", "block", f"least(last, (block + 1) * {block}) - greatest(first, block * {block}) as words")
    taken = parts.join(uses, ["place", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return streamed.join(taken, "row", "left").select("id", "source", "h", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _with_mix(rows: DataFrame, mix: DataFrame, sources: int) -> DataFrame:
    """``rows`` with their source's line of ``mix``: broadcast up to ``BROADCAST`` lines, beyond that
    each line goes out ``SALTS`` times, so that a source with a third of all rows has as many tasks."""
    if sources <= BROADCAST:
        return rows.join(F.broadcast(mix.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    lines = mix.withColumnRenamed("source", "_s").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    return salted.join(lines, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_k"))).drop("_s", "_k", "_salt")


def _uses(mix: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """(place, block, uses): how often the slots of a source take each of its blocks."""
    blocks = mix.where("source_size > 0").selectExpr("place", f"(source_size + {block} - 1) div {block} as blocks")
    taken = slots.join(blocks, "place").where(F.col("rank") < F.col("blocks") * REPEATS)
    return taken.groupBy("place", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each document as often as its words are taken, rounded.

    Only where a source's last block ends inside a document does rounding change anything. A
    document whose words aren't taken is left out; one without words (null, blank) stays as it is.
    Rows decide, not ids: repeated ids and repeated rows are taken each on their own. All columns
    come back as they are, whatever their names; an empty table stays empty.
    """
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int"))
    i, s, h, c, mark, n = unused(["own_id", "own_source", "own_h", "copies", "text_h", "turn"], docs)
    rows = _taken(docs, id_col, text_col, source_col).select(F.col("id").alias(i), F.col("source").alias(s), F.col("h").alias(h), copies.alias(c))
    # equal rows share a key: together they hold its list of copies, the k-th of them takes the k-th entry
    counts = cut(rows.groupBy(i, s, h).agg(F.sort_array(F.collect_list(c)).alias(c)), "copies")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    entry = F.lit(1)
    if counts.where(F.size(c) > 1).limit(1).count():
        marked = marked.withColumn(n, F.row_number().over(Window.partitionBy(id_col, source_col, mark).orderBy(F.lit(0))))
        entry = F.col(n)
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).cast("string").eqNullSafe(F.col(s)) & (F.col(mark) == F.col(h))
    out = marked.join(counts, same).withColumn(c, F.element_at(c, entry)).where(F.col(c) > 0)
    return out.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*(F.col(f"`{x}`") for x in docs.columns))

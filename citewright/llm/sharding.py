"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards; a subtree weighs what its shards weigh. A row descends from
level to level: each child draws -ln(u) / weight from a hash of the key and the child's name, and
the smallest draw wins. Where weights change, rows move only into or out of those subtrees. A tree
grown by one shard puts it into a region of its own, so that only the new shard takes rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096  #: per shard, for gapless slots; the table of offsets has shards x BUCKETS rows at most


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, per_rack: int = 2, per_region: int = 4) -> tuple[Leaf, ...]:
    """Equal shards 0 to ``shards - 1``, filled rack by rack and region by region."""
    return tuple(Leaf(f"g{s // per_region}", f"r{s // per_rack}", s) for s in range(shards))


def grown(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard in a new region; no other subtree changes its weight."""
    shard = max((x.shard for x in tree), default=-1) + 1
    return (*tree, Leaf(f"new{shard}", f"new{shard}", shard, weight))


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(weight))


def _descend(key: Column, tree: tuple[Leaf, ...], levels: tuple[str, ...]) -> Column:
    if not levels:
        return F.lit(tree[0].shard)
    level, below = levels[0], levels[1:]
    children: dict[str, list[Leaf]] = {}
    for leaf in tree:
        children.setdefault(str(getattr(leaf, level)), []).append(leaf)
    picks = {name: _descend(key, tuple(own), below) for name, own in sorted(children.items())}
    if len(picks) == 1:
        return next(iter(picks.values()))
    draws = [F.struct(_draw(key, f"{level}:{n}", sum(x.weight for x in children[n])).alias("draw"), F.lit(i).alias("i")) for i, n in enumerate(picks)]
    best = F.least(*draws)["i"]
    out = F.lit(None).cast("int")
    for i, pick in reversed(list(enumerate(picks.values()))):
        out = F.when(best == i, pick).otherwise(out)
    return out


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard of a key; a null key is a key like any other."""
    return _descend(F.coalesce(key.cast("string"), F.lit("")), tree, ("region", "rack", "shard")).cast("int")


def assign(docs: DataFrame, tree: tuple[Leaf, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    The law is `key`: the id and the tree decide. size is the text's UTF-8 bytes plus 1; a null text
    counts as empty, a very long one is one row like any other. Slots count from 0 without gaps in
    each shard: rows are numbered inside hash buckets of id and text, and the buckets' counts, a
    table of fixed size, give the offsets. Equal draws go to the child that comes first by name.
    Repeated rows get slots of their own; null ids are placed like one more id; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(F.col(id_col), tree).alias("shard"),
        shard_of(F.col(id_col), grown(tree)).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.selectExpr("shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as before")
    numbered = placed.selectExpr(
        "*", "row_number() over (partition by shard, bucket order by id, text_crc32, size) - 1 as place"
    )
    # offsets: at most (shards of the tree + 1) x BUCKETS rows
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("place")).cast("long").alias("slot"), "grown_shard",
    )

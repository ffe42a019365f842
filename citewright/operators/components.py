"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.session import drop_path, shared_path


def spanning_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, smallest node of its group) of the groups that ``left[i]-right[i]`` join."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local_forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            a, b = spanning_forest(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            yield pd.DataFrame({"a": a, "b": b})


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a long, b long)``; component is its smallest node.

    Each round is one large-star and one small-star step: two aggregations and joins on node ids,
    with the number of edges never growing. Batches first shrink to spanning forests inside their
    tasks, which keeps hub nodes to one row per batch. Rounds end when the edge set no longer
    changes; the driver sees one count and one checksum per round. Edges with a null end and
    self-loops link nothing; an edge table without rows gives no rows.
    """
    spark = edges.sparkSession
    step = (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .mapInPandas(_local_forests, "a long, b long")
    )
    path = shared_path(spark, "edges")
    step.distinct().write.parquet(path)
    before = None
    for _ in range(max_rounds):
        now = spark.read.schema("a long, b long").parquet(path)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        # large star: neighbours above a node point to the smallest node around it
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its lower neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, path = path, shared_path(spark, "edges")
        small.select("e.a", "e.b").where("a <> b").distinct().write.parquet(path)
        drop_path(spark, old)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    now = spark.read.schema("a long, b long").parquet(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector is rotated at random; the signs are its code, and how far the code's direction lies
from the vector is a correction factor. Both are stored once for each vector. <code(y), x> / factor(y)
estimates the inner product of x and y without bias, and the factor bounds its error.

Pairs come from hash tables over sign bits of further rotations: two vectors at the threshold share
a key of k bits with probability (1 - angle / pi) ** k, and the number of tables follows from the
share of threshold pairs that may be missed, ``MISS``. Key width grows with the logarithm of the
table, so that buckets keep their size. In the buckets lie the first ``SKETCH`` of those bits alone:
each differs between two vectors with probability angle / pi, so pairs with more differing bits than
pairs at the threshold have, but for a share ``MISS`` of them, are dropped, and so are pairs whose
bits show a common key in an earlier table. Vectors are fetched only for members of the pairs left.
There the estimate and its bound decide which pairs are computed exactly, in double precision. A pair
counts only in the first table that both share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.operators.components import connected_components, spanning_forest
from citewright.session import batch_rows, cut

THRESHOLD = 0.95
MISS = 1e-6  #: chance that no table has a pair that lies exactly at the threshold, and again that its codes differ too much
BOUND = 5.0  #: error bound of an estimate, in its standard deviations: 3e-7 of the pairs at the threshold lie beyond
SKETCH = 256  #: sign bits that are compared in buckets
BUCKET = 8  #: log2 of the members of a bucket, about
BATCH_ROWS = 10_000
BLOCK = 2048  #: members of a bucket in one block; larger buckets go as pairs of blocks
SEED = 20240


def tables_for(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, number of tables) for ``rows`` distinct vectors."""
    bits = min(max(round(math.log2(max(rows, 2))) - BUCKET, 4), 48)
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - share)))


def rotation(dim: int, k: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares in range
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def sign_bits(unit: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) sign bits from as many rotations as they need."""
    dim = unit.shape[1]
    return np.concatenate([unit @ rotation(dim, 1 + k).T > 0 for k in range(-(-count // dim))], axis=1)[:, :count]


def keys_of(signs: np.ndarray, bits: int) -> np.ndarray:
    """(rows, tables) keys of ``bits`` sign bits each, in their order."""
    tables = signs.shape[1] // bits
    return signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def differing_bits(dim: int, threshold: float, miss: float = MISS) -> int:
    """The most bits that codes of a pair at the threshold differ in, but for a share ``miss`` of the pairs."""
    p = math.acos(min(threshold, 1.0)) / math.pi
    if p <= 0:
        return 0
    log = math.log
    terms = (math.lgamma(dim + 1) - math.lgamma(k + 1) - math.lgamma(dim - k + 1) + k * log(p) + (dim - k) * log(1 - p) for k in range(dim, -1, -1))
    tail = 0.0
    for k, term in zip(range(dim, -1, -1), terms, strict=True):
        tail += math.exp(term)
        if tail > miss:
            return k
    return 0


CODE = "code binary, factor double"


def encode(unit: np.ndarray) -> pd.DataFrame:
    """The stored columns ``CODE`` of unit vectors of one length."""
    dim = unit.shape[1]
    rotated = unit @ rotation(dim, 0).T
    signs = np.where(rotated > 0, 1.0, -1.0)
    packed = np.packbits(rotated > 0, axis=1)
    factor = np.maximum((signs * rotated).sum(axis=1) / math.sqrt(dim), 1e-6)
    return pd.DataFrame({"code": [r.tobytes() for r in packed], "factor": factor})


def unpacked(codes: pd.Series, dim: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, count=dim)


class Codes:
    """Codes of ``dim`` bits, unpacked to compare them; with factors and unit vectors also estimates."""

    def __init__(self, pdf: pd.DataFrame, dim: int, unit: np.ndarray | None = None):
        self.signs = unpacked(pdf["code"], dim).astype(np.float32) * 2 - 1
        self.dim, self.unit = dim, unit
        if unit is not None:
            self.rotated = (unit @ rotation(dim, 0).T).astype(np.float32)
            self.factor = pdf["factor"].to_numpy()
            self.error = BOUND * np.sqrt(np.maximum(1 - self.factor**2, 0) / self.factor**2 / max(dim - 1, 1)) + 1e-5

    def _bound(self, dots: np.ndarray, b: np.ndarray | slice) -> np.ndarray:
        return dots / (self.factor[b] * math.sqrt(self.dim)) + self.error[b]

    def may_reach(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        if self.unit is None:
            return np.einsum("ij,ij->i", self.signs[a], self.signs[b]) >= self.dim - 2 * differing_bits(self.dim, threshold)
        return self._bound(np.einsum("ij,ij->i", self.rotated[a], self.signs[b]), b) >= threshold

    def block(self, a: slice, b: slice, threshold: float) -> np.ndarray:
        if self.unit is None:
            return self.signs[a] @ self.signs[b].T >= self.dim - 2 * differing_bits(self.dim, threshold)
        return self._bound(self.rotated[a] @ self.signs[b].T, b) >= threshold


GROUP = ["dim", "t", "key", "i", "j"]


def _by_group(work):
    """``work`` on frames of whole groups of one vector length; rows come sorted by ``GROUP``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            same = (pdf[GROUP] == pdf[GROUP].iloc[-1]).all(axis=1)
            held, done = pdf[same], pdf[~same]
            for _, part in done.groupby("dim", sort=False):
                yield work(part.reset_index(drop=True))
        if held is not None and len(held):
            yield work(held.reset_index(drop=True))

    return run


def _pairs(pdf: pd.DataFrame, threshold: float, unit: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs inside groups whose codes, or bounds where vectors are there, may reach the threshold; of two blocks only pairs across."""
    codes = Codes(pdf, SKETCH if unit is None else unit.shape[1], unit)
    group, m = pdf[GROUP].to_numpy(), pdf["m"].to_numpy()
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    size = np.diff(np.r_[new, len(pdf)])
    end = np.repeat(new + size, size)
    cross = group[:, 3] != group[:, 4]

    def fine(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = ~cross[a] | (m[a] != m[b])
        return a[keep], b[keep]

    at, shift = np.flatnonzero(np.repeat(size <= 64, size)), 0
    while True:
        shift += 1
        at = at[at + shift < end[at]]
        if not len(at):
            break
        for k in range(0, len(at), 100_000):
            a = at[k : k + 100_000]
            a = a[codes.may_reach(a, a + shift, threshold)]
            yield fine(a, a + shift)
    for s, z in zip(new[size > 64].tolist(), size[size > 64].tolist()):
        for k in range(s, s + z, 256):
            rows = slice(k, min(k + 256, s + z))
            a, b = np.nonzero(codes.block(rows, slice(s, s + z), threshold))
            a, b = a + k, b + s
            yield fine(a[a < b], b[a < b])


def _survivors(bits: int, threshold: float):
    """Members of groups that are in some pair of close codes that no earlier table is seen to have."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, t = keys_of(unpacked(pdf["code"], SKETCH), bits), pdf["t"].to_numpy()
        column = np.arange(keys.shape[1])
        alive = np.zeros(len(pdf), bool)
        for a, b in _pairs(pdf, threshold):
            for k in range(0, len(a), 200_000):
                x, y = a[k : k + 200_000], b[k : k + 200_000]
                new = ~((keys[x] == keys[y]) & (column < t[x][:, None])).any(axis=1)
                alive[x[new]] = alive[y[new]] = True
        return pdf.loc[alive, [*GROUP, "m", "node"]]

    return _by_group(work)


def _links(bits: int, tables: int, threshold: float, stored: type):
    """Per node the partners' rows (kind 0: a, rows), and spanning edges (kind 1: a, b)."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        node, n, t = (pdf[c].to_numpy() for c in ("node", "n", "t"))
        unit = units(np.frombuffer(b"".join(pdf["vector"]), stored).reshape(len(pdf), -1).astype(np.float64))
        found_rows, found_a, found_b = np.zeros(len(pdf), np.int64), [], []
        for a, b in _pairs(pdf, threshold, unit):
            close = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[close], b[close]
            if not len(a):
                continue
            rows, at = np.unique(np.r_[a, b], return_inverse=True)
            keys = keys_of(sign_bits(unit[rows], bits * tables), bits)
            ka, kb = keys[at[: len(a)]], keys[at[len(a) :]]
            first = (ka == kb).argmax(axis=1) == t[a]  # a pair is this table's if no earlier one has it
            a, b = a[first], b[first]
            np.add.at(found_rows, a, n[b])
            np.add.at(found_rows, b, n[a])
            if len(a):
                x, y = spanning_forest(node[a], node[b])
                found_a.append(x)
                found_b.append(y)
        some = np.flatnonzero(found_rows)
        a = np.concatenate([node[some], *found_a])
        b = np.concatenate([found_rows[some], *found_b])
        kind = np.r_[np.zeros(len(some), np.int32), np.ones(len(a) - len(some), np.int32)]
        return pd.DataFrame({"kind": kind, "a": a, "b": b})

    return _by_group(work)


def usable(vector: str) -> F.Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def embedding_groups(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    n_links counts the other rows at cosine ``threshold`` or more; component_id is the smallest id
    reachable over links. Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and vectors of different lengths never link. A cosine of exactly ``threshold``
    in double precision links. Equal vectors are compared once and count as often as they occur; very
    long vectors are vectors like any other; rows with a null id take part; ids are cast to long;
    other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    batch_rows(table.sparkSession, BATCH_ROWS)
    single = table.schema[vector_col].dataType.elementType.typeName() == "float"  # stored as they are given
    width = np.float32 if single else np.float64
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable("v"), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = cut(rows.withColumn("h", F.unhex(F.sha2(F.col("v").cast("string"), 256))), "vectors")  # digests stand for vectors from here on
    same = rows.where(F.col("v").isNotNull()).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.first("v").alias("v"))
    distinct = cut(same.withColumn("node", F.monotonically_increasing_id()), "distinct")
    total = distinct.count()
    bits, tables = tables_for(total, threshold)

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                for k in range(0, len(part), 1000):
                    own = part.iloc[k : k + 1000].reset_index(drop=True)
                    raw = np.stack(own["v"].to_list()).astype(np.float64)
                    unit = units(raw)
                    signs = sign_bits(unit, max(bits * tables, SKETCH))
                    columns = {"node": own["node"], "n": own["n"], "dim": np.int32(dim), "vector": [r.tobytes() for r in raw.astype(width)]}
                    columns |= {"keys": list(keys_of(signs[:, : bits * tables], bits)), "sketch": [r.tobytes() for r in np.packbits(signs[:, :SKETCH], axis=1)]}
                    yield pd.concat([pd.DataFrame(columns), encode(unit)], axis=1)

    codes = distinct.select("node", "n", "v").mapInPandas(stored, f"node long, n long, dim int, vector binary, keys array<long>, sketch binary, {CODE}")
    codes = cut(codes, "codes")  # one row per vector: its code, factor and keys
    keyed = codes.select("dim", "node", F.col("sketch").alias("code"), F.posexplode("keys").alias("t", "key"))
    large = keyed.groupBy("dim", "t", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = keyed.join(cut(large, "buckets"), ["dim", "t", "key"], "left").withColumn("m", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("m", "o")).withColumn("j", F.greatest("m", "o"))
    compared = placed.select(*GROUP, "m", "node", "code").repartition(*GROUP).sortWithinPartitions(*GROUP)
    alive = cut(compared.mapInPandas(_survivors(bits, threshold), "dim int, t int, key long, i int, j int, m int, node long"), "alive")
    fetched = alive.join(codes.select("node", "n", "code", "factor", "vector"), "node").select(*GROUP, "m", "node", "n", "code", "factor", "vector").repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = cut(fetched.mapInPandas(_links(bits, tables, threshold, width), "kind int, a long, b long"), "links")
    partners = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("partners"))
    parts = connected_components(found.where("kind = 1").select("a", "b"))
    joined = distinct.select("h", "n", "rep", "node").join(partners, "node", "left").join(parts, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = joined.join(least, "component").select("h", (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), "component_id")
    known = cut(known, "known")
    out = rows.where(F.col("v").isNotNull()).select("h", "id").join(known, "h").select("id", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

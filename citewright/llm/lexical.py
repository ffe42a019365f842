"""Ranked lexical search by dense matrix products: item vocabulary tiles times document impact tiles.

A document's score for an item is a sum of products: the item's weight of a term (count times inverse
frequency) and the document's impact of it (a saturated frequency), both whole numbers. Items are taken in
tiles; a tile's vocabulary is the terms of its items alone, so tiles are small and dense. Documents
are stored once as (term number, frequency) lists; a task turns a run of them into a matrix of impacts and
multiplies. Impacts are below 10**6 and the weights of an item are dealt into planes of less than
2**53 / 10**6 each, so every partial sum of a product is a whole number below 2**53: float64 holds it
exactly, whatever order BLAS adds in. Planes are added as 64-bit integers.

A task keeps the k best documents of each item, ties by id, and hands on only those; windows rank them
over all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.session import batch_rows, cut, drop_path, shared_path

SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  #: what stands between terms
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SATURATION, LENGTH_SHARE = 8, 75  #: the frequency at which an impact is half of its limit, and the percentage of it that grows with length
SCALE = 1_000_000_000
IMPACT_LIMIT = SCALE // 1000  #: impacts are below: (SCALE tf) div (1000 tf + a positive number)
PLANE = 2**53 // IMPACT_LIMIT  #: weights that an item has in one plane at most
BLOCK_TERMS = 400_000  #: terms of items that one pass over the documents serves, about
TILE_ITEMS, TILE_TERMS = 256, 8192
TILE_CELLS = 4_000_000  #: numbers in a matrix of impacts at most
BATCH_ROWS = 500
SALTS = 64

_FOLD = bytes(ord(" ") if b < 0x80 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 0x80 else b for b in range(256))


def split_terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text; bytes above 0x7F belong to terms."""
    return text.translate(_FOLD).split()


def term_list(text: Column) -> Column:
    """The terms of a text as an array; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), SPLIT), "")


class Tile:
    """Some items over the terms that they have: planes of weights by item and term."""

    def __init__(self, items: list[int], weights: list[dict[int, int]]):
        self.items = np.array(items)
        self.columns = np.array(sorted(set().union(*weights)), dtype=np.int64)
        place = {c: k for k, c in enumerate(self.columns.tolist())}
        planes: list[np.ndarray] = []
        for row, own in enumerate(weights):
            plane, room = 0, PLANE
            for column, weight in own.items():
                while weight:  # what doesn't fit goes on in the next plane
                    if not room:
                        plane, room = plane + 1, PLANE
                    if plane == len(planes):
                        planes.append(np.zeros((len(items), len(place))))
                    part = min(weight, room)
                    planes[plane][row, place[column]] += part
                    weight, room = weight - part, room - part
        self.planes = planes

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """Items by documents, exact."""
        total = np.zeros((len(self.items), impacts.shape[1]), dtype=np.int64)
        for plane in self.planes:
            total += (plane @ impacts).astype(np.int64)
        return total


def tiles(weights: dict[int, dict[int, int]]) -> list[Tile]:
    """Items (number to term weights) in tiles of bounded size; one with more terms than a tile has its own."""
    out, items, terms = [], [], set()
    for item, own in weights.items():
        if not own:
            continue
        if items and (len(items) == TILE_ITEMS or len(terms | own.keys()) > TILE_TERMS):
            out.append(Tile(items, [weights[i] for i in items]))
            items, terms = [], set()
        items.append(item)
        terms |= own.keys()
    return out + ([Tile(items, [weights[i] for i in items])] if items else [])


class Best:
    """The k highest scores of each item, ties by smaller id; missing ids (largest) come last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, dtype=np.int64)  # what a score must reach
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the id is missing, id

    def add(self, items: np.ndarray, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        row, doc = np.nonzero(scores >= self.least[items][:, None])
        if not len(row):
            return
        new = [items[row], scores[row, doc], missing[doc], ids[doc]]
        item, score, gone, key = (np.concatenate([a, b]) for a, b in zip(self.kept, new, strict=True))
        order = np.lexsort((key, gone, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        keep = order[rank < self.k]
        self.kept = [item[rank < self.k], score[keep], gone[keep], key[keep]]
        last = rank == self.k - 1
        self.least[item[last]] = score[order[last]]


def _documents(docs: DataFrame, columns: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, counts): the number of terms, and those that the items have with their frequencies."""
    batch_rows(docs.sparkSession, BATCH_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = split_terms(text.as_py() or b"")
                found = Counter(map(number, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(list(found))
                counts.append(list(found.values()))
            parts = [pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), *parts], ["doc", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc long, n long, terms array<int>, counts array<bigint>")


def _best(stored: DataFrame, parts: list[Tile], items: int, terms: int, corpus: tuple[int, int], k: int) -> DataFrame:
    """(item, score, doc): the k best documents of each item in each task."""
    shared = stored.sparkSession.sparkContext.broadcast(parts)
    total, length = corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place = Best(items, k), np.full(terms, -1)
        for batch in batches:
            ids = batch.column("doc")
            missing, key = np.asarray(ids.is_null()).astype(np.int64), np.asarray(ids.fill_null(0))
            n = np.asarray(batch.column("n"))
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * total) // length
            lists = batch.column("terms")
            of = np.repeat(np.arange(len(n)), np.asarray(lists.value_lengths()))
            term, count = np.asarray(lists.flatten()), np.asarray(batch.column("counts").flatten())
            impact = ((SCALE * count) // (1000 * count + SATURATION * m[of])).astype(np.float64)
            for tile in shared.value:
                place[tile.columns] = np.arange(len(tile.columns))
                column = place[term]
                place[tile.columns] = -1
                own = column >= 0
                row, doc, value = column[own], of[own], impact[own]
                width = max(1, TILE_CELLS // len(tile.columns))
                for first in range(0, len(n), width):
                    a, b = np.searchsorted(doc, (first, first + width))
                    size = min(width, len(n) - first)
                    impacts = np.zeros((len(tile.columns), size))
                    impacts[row[a:b], doc[a:b] - first] = value[a:b]
                    best.add(tile.items, tile.scores(impacts), missing[first : first + size], key[first : first + size])
        item, score, gone, doc = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=gone.astype(bool))], ["item", "score", "doc"])

    return stored.mapInArrow(run, "item long, score long, doc long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc", "score"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0 only.

    ``doc_id`` is a whole number. Null and empty texts have no terms: such documents count for
    nothing and such items get no rows. Each document row is ranked on its own, so repeated rows
    have ranks of their own; a missing doc_id comes after all others of its score. Item rows with one
    item_id and different texts are one item with the terms of all, equal rows count once. Other columns
    are ignored; without documents or items there are no rows.

    Items whose distinct terms exceed about ``block_terms`` together are served in several passes over
    the documents, so what is broadcast doesn't grow with the items; one item's own terms are never parted.
    """
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").alias("id"), F.col("text").alias("t")).distinct()
    wanted = cut(texts.select("id", F.explode(term_list(F.col("t"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c")), "items")
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    out = None
    for block in range(blocks):
        found = _search_block(rows, wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block), items.schema["item_id"].dataType, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, wanted: DataFrame, kind, k: int) -> DataFrame:
    spark = docs.sparkSession
    entries = wanted.collect()  # bounded: the terms of one block of items
    numbers = {i: n for n, i in enumerate(dict.fromkeys(r["id"] for r in entries))}
    columns = {t: n for n, t in enumerate(dict.fromkeys(r["term"].encode() for r in entries))}
    path = shared_path(spark, "lexical")
    _documents(docs, columns).write.parquet(path)
    stored = spark.read.schema("doc long, n long, terms array<int>, counts array<bigint>").parquet(path)
    total, length = stored.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect())  # at most a row for each column
    weights: dict[int, dict[int, int]] = {n: {} for n in numbers.values()}
    for r in entries:
        column = columns[r["term"].encode()]
        if column in holding:
            weight = math.floor(1000 * math.log((2 * total + 2) / (2 * holding[column] + 1)))
            if weight:
                weights[numbers[r["id"]]][column] = weight * r["c"]
    best = _ranked(_best(stored, tiles(weights), len(numbers), len(columns), (total, max(1, length)), k), k)
    named = spark.createDataFrame([(n, i) for i, n in numbers.items()], f"item long, item_id {kind.simpleString()}")
    out = cut(best.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"), "ranked")
    drop_path(spark, path)
    return out

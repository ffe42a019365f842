"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance.

Candidate search is pigeonring filtering. A fingerprint is a ring of four 16-bit segments. If two
fingerprints differ in at most 3 bits, some segment starts a chain whose first l segments differ in
at most floor(3 l / 4) bits for every l: 0, 1, 2, 3. The first segment (equal) and an equal half of
the second (at most one differing bit, so at least one half is equal) form a 24-bit bucket key; the
rest of the chain is checked before the full distance. No pair within the distance is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.functions.names import unused
from citewright.operators.components import connected_components
from citewright.session import batch_rows, cut

SEED = 42
SHINGLE = 3
DISTANCE = 3
BATCH_ROWS = 2000
BLOCK = 2048  #: members of a bucket compared in one task; larger buckets go as pairs of blocks


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = SHINGLE
    shingles = [b" ".join(words)] if len(words) < n else list(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        part = shingles[at : at + 65536]
        digests = b"".join(map(xxhash.xxh64_digest, part, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):  # sums of at most 255 bits fit in a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp) for each row: a hash of its text, and the unsigned fingerprint in a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.fromiter(map(fingerprint, pdf["text"]), np.uint64, len(pdf)).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "h": pdf["h"], "fp": found})

    batch_rows(docs.sparkSession, BATCH_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, h long, fp long")


def _segment(fp: str, i: int):
    return F.shiftrightunsigned(F.col(fp), 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))


def _keys() -> F.Column:
    keys = []
    for i in range(4):
        follow = _segment("fp", (i + 1) % 4)
        for half, part in ((0, F.shiftrightunsigned(follow, 8)), (1, follow.bitwiseAND(F.lit(0xFF)))):
            tag = F.lit((2 * i + half) << 24).cast("long")
            keys.append(tag + F.shiftleft(_segment("fp", i), 8) + part)
    return F.array(*keys)


def _links(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf.iloc[-1]
            same = (pdf["key"] == last["key"]) & (pdf["i"] == last["i"]) & (pdf["j"] == last["j"])
            held, done = pdf[same], pdf[~same]
            if len(done):
                yield _forest(done, distance)
        if held is not None and len(held):
            yield _forest(held, distance)

    return run


def _forest(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Spanning edges of the links among the rows that share (key, i, j); rows come sorted by them."""
    key, i, j = (pdf[c].to_numpy() for c in ("key", "i", "j"))
    fp = pdf["fp"].to_numpy().view(np.uint64)
    turn = (16 * ((key >> 24) // 2)).astype(np.uint64)
    ring = np.where(turn > 0, (fp << turn) | (fp >> ((np.uint64(64) - turn) % np.uint64(64))), fp)
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    end = np.repeat(np.r_[new[1:], len(key)], np.diff(np.r_[new, len(key)]))
    root = np.arange(len(key))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at, shift = np.arange(len(key)), 0
    while True:
        shift += 1
        at = at[at + shift < end[at]]
        if not len(at):
            break
        x = ring[at] ^ ring[at + shift]
        keep = at
        spent = np.zeros(len(at), np.uint8)
        for step in (1, 2, 3):  # the chain's budgets: floor(distance * (step + 1) / 4)
            spent = spent + np.bitwise_count((x >> np.uint64(48 - 16 * step)) & np.uint64(0xFFFF))
            fine = spent <= distance * (step + 1) // 4
            keep, x, spent = keep[fine], x[fine], spent[fine]
            if not len(keep):
                break
        if len(keep):
            fine = np.bitwise_count(fp[keep] ^ fp[keep + shift]) <= distance
            for p in keep[fine].tolist():
                a, b = find(p), find(p + shift)
                if a != b:
                    root[max(a, b)] = min(a, b)
    roots = np.array([find(x) for x in np.flatnonzero(root != np.arange(len(key)))], np.int64)
    moved = np.flatnonzero(root != np.arange(len(key)))
    signed = pdf["fp"].to_numpy()
    return pd.DataFrame({"a": signed[moved], "b": signed[roots]})


def near_links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within ``distance`` would.

    ``distinct`` holds each fingerprint once. Buckets larger than ``block`` are split into blocks,
    and each pair of blocks is compared on its own, so that no task holds more than two blocks.
    """
    if distance != 3:
        raise ValueError("the segments and keys are laid out for a distance of 3")
    keyed = distinct.select("fp", F.explode(_keys()).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.coalesce(blocks, F.lit(1))).cast("int")
    placed = keyed.join(large, "key", "left").withColumn("m", mine)
    other = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))
    placed = placed.select("fp", "key", "m", F.explode(other).alias("o"))
    placed = placed.select("fp", "key", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"))
    return (
        placed.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInPandas(_links(distance), "a long, b long")
    )


def _grouped(fps: DataFrame) -> DataFrame:
    """(fp, component_id) for each fingerprint of ``fps(id, h, fp)``."""
    distinct = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    parts = connected_components(near_links(distinct.select("fp")))
    joined = distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    return cut(joined.join(least, "component").select("fp", "component", "component_id"), "groups")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of at most 3 differing bits; ids may be of
    any type that has an order. Null, empty and blank texts have fingerprint zero and link like any
    other; very long texts are fingerprinted whole; rows with a null id take part and get the group's
    smallest id (null if it has none); repeated rows come back repeated; other columns, whatever
    their names, are ignored; an empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    return fps.join(_grouped(fps), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Rows decide, not ids: of rows that repeat an id, one whose text is in another group stays as that
    group's smallest. Null ids come after all others; of equal ids in a group the smaller text hash
    stays, of equal rows any one. Null and blank texts are one group; all columns stay as they are,
    whatever their names; an empty table stays empty.
    """
    fps = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    placed = fps.join(_grouped(fps), "fp")
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("best"))
    own_id, own_h, mark = unused(["kept_id", "kept_h", "text_h"], docs)
    kept = cut(best.select(F.col("best.id").alias(own_id), F.col("best.h").alias(own_h)), "kept")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    out = marked.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_h)), "left_semi")
    # only where rows repeat both id and text, a second pass picks one of them
    twice = fps.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if twice.count():
        out = out.dropDuplicates([id_col, mark])
    return out.drop(mark)

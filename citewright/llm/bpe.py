"""Byte-level BPE with the tokenizers library over Arrow batches.

Byte-level vocabularies spell each byte as one printable character. ``byte_table`` is that mapping;
decoding joins the tokens' characters, maps them back to bytes, and only then reads UTF-8, so that a
character split over tokens comes back whole.

Merges never cross the pieces that the byte-level splitter makes, and texts repeat most of their
pieces. So a batch's distinct pieces go through the library once, and their ids, spelled ids and
decoded bytes serve every text that holds them.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.session import batch_rows

BATCH_ROWS = 1000
BATCH_CHARS = 300_000  #: characters handed to the library at a time
KNOWN = 200_000  #: pieces that a task remembers; beyond that it starts afresh

# Fixed: the split of byte-level BPE, as the vocabulary's own pre-tokenizer makes it.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as it is, the rest from 256 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """One tokenizer file; each task loads its own, so that idle workers hold none."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        back = {c: b for b, c in enumerate(byte_table())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if i not in special:
                self.pieces[i] = bytes(back[c] for c in token)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for part in _portions(texts):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and, for each, the code points (start, end) of the text that it takes part in."""
        return [(e.ids, e.offsets) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, texts: list[str], known: dict[str, tuple[int, str, bytes]]) -> list[list[str]]:
        """The pieces of each text; ``known`` gets their (number of ids, spelled ids, decoded bytes)."""
        split = [PIECES.findall(t) for t in texts]
        new = list(set().union(*split).difference(known))
        for piece, ids in zip(new, self.encode(new), strict=True):
            known[piece] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return split

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(id, ids array<int>[, starts array<int>, ends array<int>]) per row.

    Null texts count as empty and have no ids. Very long texts are one row like any other. Repeated
    rows and null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    batch_rows(docs.sparkSession, BATCH_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            columns, names = [batch.column("id")], ["id"]
            if offsets:
                found = codec.encode_with_offsets(texts)
                parts = [[i for i, _ in found], [[a for a, _ in o] for _, o in found], [[b for _, b in o] for _, o in found]]
                names += ["ids", "starts", "ends"]
            else:
                parts = [list(codec.encode(texts))]
                names += ["ids"]
            columns += [pa.array(p, pa.list_(pa.int32())) for p in parts]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, fields).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, bytes, text): the exact bytes, and their text, with U+FFFD where they aren't UTF-8.

    Null and empty ids give no bytes; repeated rows and null ids are kept; other columns are
    ignored; an empty table gives no rows. An id that the vocabulary lacks is an error.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            raw = [codec.decode(x or []) for x in ids]
            text = pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(raw, pa.binary()), text], ["id", "ids", "bytes", "text"])

    out = encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, ids array<int>, bytes binary, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each batch is encoded, digested and decoded in one pass.

    Null texts count as empty: no tokens, digests of nothing. A very long text is one row like any
    other. Repeated rows and null ids are kept; other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    batch_rows(docs.sparkSession, BATCH_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = Codec(path), {}
        for batch in batches:
            n, spelled, decoded = [], [], []
            for texts in _portions([t or "" for t in batch.column("text").to_pylist()]):
                if len(known) > KNOWN:
                    known = {}
                for pieces in codec.learn(texts, known):
                    counts, ids, raw = zip(*map(known.__getitem__, pieces)) if pieces else ((), (), ())
                    n.append(sum(counts))
                    spelled.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(raw)).hexdigest())
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``BATCH_CHARS`` characters."""
    first, chars = 0, 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield texts[first : k + 1]
            first, chars = k + 1, 0
    if first < len(texts):
        yield texts[first:]

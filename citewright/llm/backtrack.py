"""BPE encoding by longest matches with backtracking, decoding by an offset table.

An Aho-Corasick machine over the reversed tokens finds the longest token that starts at every byte of a
piece in one scan. The encoder takes the longest token, then the next one, as long as neighbours are
compatible: two tokens are if plain BPE, merging the lowest rank first, would leave the border between
them standing. That is decided from the two tokens alone, by undoing their merges from the last to the
first, and remembered in a table. If no token at a place fits its left neighbour, the place is closed and
the neighbour gives way to a shorter one. A sequence whose neighbours are all compatible is the one that
merging gives, and each place is closed at most once, so the work is linear in the piece.

Spark deals out the texts; a task holds the vocabulary, the pieces it has met (up to a limit, then
afresh) and one text at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.llm.bpe import PIECES, byte_table
from citewright.session import batch_rows

BATCH_ROWS = 500
KNOWN = 200_000  #: pieces that a task remembers; beyond that it starts afresh
KNOWN_CHARS = 200  #: longer pieces are encoded each time
PAIRS = 1_000_000  #: pairs in the table of compatible tokens; beyond that it starts afresh


class Vocabulary:
    """The tokens of a byte-level BPE file, numbered by rank: bytes 0 to 255, then merges in order.

    Files with a normalizer, a prefix space, unknown, joining or dropped pieces, or added tokens that take
    white space or whole words only are refused: those settings change what encoding means.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        vocab = model["vocab"]
        spelled = byte_table()
        self.tokens = [bytes([b]) for b in range(256)]
        self.ids = [vocab[c] for c in spelled]
        self.head, self.tail = list(range(256)), list(range(256))  # the two tokens that a merge joins
        self.merges: dict[tuple[int, int], int] = {}
        number = {c: b for b, c in enumerate(spelled)}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if left + right in number:
                raise ValueError(f"{path} merges to {left + right!r} twice")
            pair = number[left], number[right]
            number[left + right] = self.merges[pair] = len(self.tokens)
            self.tokens.append(self.tokens[pair[0]] + self.tokens[pair[1]])
            self.ids.append(vocab[left + right])
            self.head.append(pair[0])
            self.tail.append(pair[1])
        self.sizes = list(map(len, self.tokens))
        self.by_bytes = {t: k for k, t in enumerate(self.tokens)}
        self.machine = ahocorasick.Automaton()
        for k, token in enumerate(self.tokens):
            self.machine.add_word(token[::-1].decode("latin-1"), k)
        self.machine.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path} has added tokens that depend on what stands beside them")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self._offset_table(vocab, number)

    def _offset_table(self, vocab: dict[str, int], number: dict[str, int]) -> None:
        """The bytes of all ids in a row, and where each id's begin."""
        size = 1 + max([*vocab.values(), *self.special.values()])
        texts = [b""] * size
        for token, k in number.items():
            texts[vocab[token]] = self.tokens[k]
        for token, k in self.special.items():
            texts[k] = token.encode()
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def stands(self, left: int, right: int, limit: int) -> bool:
        """Whether merges of a rank below ``limit`` leave the border between two tokens standing."""
        while True:
            joined = self.merges.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:  # the left one was made last: before that, its second part was at the border
                if left < 256:
                    return True
                limit, left = left, self.tail[left]
            else:  # of equal ranks the left one is merged first, so the right one was made last
                if right < 256:
                    return True
                limit, right = right + 1, self.head[right]

    def compatible(self, left: int, right: int) -> bool:
        """Whether plain BPE makes ``right`` and leaves it beside ``left`` (-1: at the start)."""
        found = self.pairs.get((left, right))
        if found is None:
            made = right < 256 or self.stands(self.head[right], self.tail[right], right)
            found = made and (left < 0 or self.stands(left, right, len(self.tokens)))
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def shorter(self, token: int) -> int:
        """The longest token that ``token`` begins with, or -1."""
        found = self._shorter.get(token)
        if found is None:
            text = self.tokens[token]
            found = next((self.by_bytes[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.by_bytes), -1)
            self._shorter[token] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of a piece that no split goes through."""
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, token in self.machine.iter(piece[::-1].decode("latin-1")):
            if longest[n - 1 - end] < 0:  # matches that end at one place come longest first
                longest[n - 1 - end] = token
        usable = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0 and not (usable[at + self.sizes[token]] and self.compatible(before, token)):
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at += self.sizes[token]
                token = longest[at]
            else:
                usable[at] = 0
                token = out.pop()
                at -= self.sizes[token]
        return [self.ids[t] for t in out]

    def split(self, text: str) -> Iterator[str | int]:
        """Pieces of a text in order; added tokens, which encoding keeps whole, as their ids."""
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield self.special[part]
            else:
                yield from PIECES.findall(part)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``, gathered from the offset table."""
        first = self.starts[ids]
        size = self.starts[ids + 1] - first
        if not len(ids):
            return b""
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1]) + np.repeat(first - ends + size, size)].tobytes()


class Pieces(dict):
    """Pieces met so far, with their ids: spelled in decimal and as packed integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str | int) -> tuple[str, bytes]:
        ids = [piece] if isinstance(piece, int) else self.vocabulary.encode_piece(piece.encode())
        found = ",".join(map(str, ids)), np.array(ids, np.int32).tobytes()
        if isinstance(piece, int) or len(piece) <= KNOWN_CHARS:
            self[piece] = found
        return found

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """The ids of ``text``, in decimal with commas and as integers."""
        if len(self) > KNOWN:
            self.clear()
        marks = self.vocabulary.marks
        pieces = self.vocabulary.split(text) if marks and marks.search(text) else PIECES.findall(text)
        found = list(map(self.__getitem__, pieces))
        return ",".join([x[0] for x in found]), np.frombuffer(b"".join([x[1] for x in found]), np.int32)


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for all tasks that a worker runs."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row.

    Null texts count as empty and have no ids. Very long texts are one row like any other. Repeated
    rows and null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    batch_rows(docs.sparkSession, BATCH_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(vocabulary(path))
        for batch in batches:
            ids = [known.encode(t or "")[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text): U+FFFD stands for bytes that aren't UTF-8, as where ids end inside a character.

    Null and empty ids give an empty text; repeated rows and null ids are kept; other columns are
    ignored; an empty table gives no rows. An id that the vocabulary lacks is an error.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            if any(len(x) and not 0 <= x.min() <= x.max() < len(table.starts) - 1 for x in ids):
                raise ValueError("an id outside the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([table.decode(x).decode("utf-8", "replace") for x in ids], pa.string())], ["id", "text"])

    out = encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, its ids digested and decoded.

    Null texts count as empty: no tokens, digests of nothing. A very long text is one row like any
    other. Repeated rows and null ids are kept; other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    batch_rows(docs.sparkSession, BATCH_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)
        known = Pieces(table)
        for batch in batches:
            n, spelled, decoded = [], [], []
            for text in batch.column("text"):
                decimal, ids = known.encode(text.as_py() or "")
                n.append(len(ids))
                spelled.append(hashlib.sha256(decimal.encode()).hexdigest())
                decoded.append(hashlib.sha256(table.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)

"""Substring dedup by recompression.

A text's words become 64-bit names. A run of one word becomes a name for (word, length). Rounds then
rename pairs: where a name of the left class is followed by one of the right class, the two become
one name (equal neighbours are of one class and never pair). Class and new names are hashes, so every task gives equal content
equal names: naming is global without a dictionary. A symbol that depends on ``FREEZE`` words or more takes
no further part. Each surviving symbol knows which words its parse depends on: a window that covers
them holds the same symbol wherever it occurs.

So a window can only repeat if every symbol that it determines occurs more than once in the corpus.
Spark counts symbols, and only windows whose symbols all repeat are compared, by a 128-bit digest of
their words. Within a batch the first of equal windows stands for the others, so a frequent passage
costs a row for each batch and not for each occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.session import cut

WINDOW = 20
FREEZE = 9  #: words of context from which a symbol stays as it is; so nearly all fit in a window
ROUNDS = 6
BATCH_WORDS = 600_000
SALTS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def names(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def parse(word_names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the joined texts: (name, first word, end, first and end of the words it depends on).

    ``doc`` holds each word's text; symbols never cross texts. What lies beyond a text's rim isn't
    known: a symbol that depends on it reaches one word beyond the text, so no window covers it.
    """
    # runs of one word; that a run, or a single word, ends where it does takes a look at both sides
    joined = (word_names[1:] == word_names[:-1]) & (doc[1:] == doc[:-1])
    start = np.flatnonzero(np.r_[True, ~joined])
    end = np.r_[start[1:], len(word_names)]
    name = np.where(end - start > 1, _mix(word_names[start] + (end - start).astype(np.uint64) * _ODD), word_names[start])
    low, high = start - 1, end + 1
    for k in range(ROUNDS):
        if len(name) < 2:
            break
        live = high - low < FREEZE
        right = (_mix(name + np.uint64((k + 1) * int(_ODD) % (1 << 64))) & np.uint64(1)) > 0
        near = doc[start[1:]] == doc[start[:-1]]
        pair = live[:-1] & live[1:] & ~right[:-1] & right[1:] & near
        first, second = np.r_[pair, False], np.r_[False, pair]
        # a live symbol that stays single knows it from one neighbour: the next if it is of the left
        # class, else the one before
        asks_next = live & ~first & ~right
        asks_last = live & ~second & right
        next_low, next_high = np.r_[np.where(near, low[1:], start[:-1]), start[-1:]], np.r_[np.where(near, high[1:], end[:-1] + 1), end[-1:] + 1]
        last_low, last_high = np.r_[start[:1] - 1, np.where(near, low[:-1], start[1:] - 1)], np.r_[end[:1], np.where(near, high[:-1], end[1:])]
        new_low = np.where(asks_next, np.minimum(low, next_low), np.where(asks_last, np.minimum(low, last_low), low))
        new_high = np.where(asks_next, np.maximum(high, next_high), np.where(asks_last, np.maximum(high, last_high), high))
        keep = np.flatnonzero(~second)
        merged = first[keep]
        other = keep + merged
        paired = _mix(name[keep] * _ODD + name[other] + np.uint64(k))
        name = np.where(merged, paired, name[keep])
        start, end = start[keep], end[other]
        low, high = np.minimum(new_low[keep], new_low[other]), np.maximum(new_high[keep], new_high[other])
    return name, start, end, low, high


def _stretch(word_names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words in each [low, high), from running sums of a polynomial modulo 2 ** 64."""
    n = len(word_names)
    base = int(_MIX)
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
    total = np.r_[np.uint64(0), np.cumsum(word_names * up[:n])]
    return _mix((total[high] - total[low]) * down[low])


def anchors(word_names: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, key): for each window the least symbol that it determines, or else itself.

    A symbol's key is its name with the words that it depends on, which the window covers; so equal
    windows have equal anchors at equal distances, whatever is around them. Symbols are placed by
    the first of those words, windows by their first word and the number of all words.
    """
    n = len(word_names)
    name, start, _, low, high = parse(word_names, doc)
    own = doc[start]
    fits = (high - low <= WINDOW) & (low >= begin[own]) & (high <= begin[own + 1])
    name, low, high = name[fits], low[fits], high[fits]
    key = _mix(name ^ _stretch(word_names, low, high)) >> np.uint64(1)
    order = np.lexsort((key, high, low))
    lead = order[np.r_[True, low[order][1:] != low[order][:-1]]] if len(order) else order
    keys = np.full(n + WINDOW, np.iinfo(np.int64).max, np.int64)
    width = np.full(n + WINDOW, 2 * WINDOW, np.int16)
    keys[low[lead]] = key[lead].view(np.int64)
    width[low[lead]] = high[lead] - low[lead]
    best = np.full(n, np.iinfo(np.int64).max, np.int64)
    offset = np.zeros(n, np.int8)
    for k in range(WINDOW - 2):
        better = keys[k : n + k] < best
        better &= width[k : n + k] <= WINDOW - k
        np.copyto(best, keys[k : n + k], where=better)
        np.copyto(offset, np.int8(k), where=better)
    windows = np.flatnonzero(np.arange(n) + WINDOW <= begin[doc + 1])
    best, place = best[windows], windows + offset[windows]
    bare = np.flatnonzero(best == np.iinfo(np.int64).max)  # a window that determines no symbol is its own
    place[bare] = n + windows[bare]
    best[bare] = (_stretch(word_names, windows[bare], windows[bare] + WINDOW) >> np.uint64(1)).view(np.int64)
    return windows, place, best


def _batches(pdf: pd.DataFrame, column: str) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Slices of about ``BATCH_WORDS`` words with their words; one text is never cut."""
    first, n, found = 0, 0, []
    for k, text in enumerate(pdf[column]):
        found.append(words_of(text))
        n += len(found[-1])
        if n >= BATCH_WORDS:
            yield pdf.iloc[first : k + 1], found
            first, n, found = k + 1, 0, []
    if found:
        yield pdf.iloc[first:], found


def _layout(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    begin = np.r_[0, np.cumsum(lengths)]
    return names([w for ws in words for w in ws]), np.repeat(np.arange(len(words)), lengths), begin


def symbols(rows: DataFrame) -> DataFrame:
    """(symbol, row, place) of all symbols that are some window's anchor.

    Symbols that a batch holds more than once are known to repeat: all their places come under a
    symbol below zero that only their row has, and the symbol itself comes once for the batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, words in _batches(pdf, "text"):
                found, doc, begin = _layout(words)
                if not len(found):
                    continue
                _, place, key = anchors(found, doc, begin)
                place, first = np.unique(place, return_index=True)
                key = key[first]
                word = place % len(found)
                own = doc[word]
                near = (word - begin[own]).astype(np.int32)
                near = np.where(place < len(found), near, -1 - near)  # windows count below zero
                row = part["row"].to_numpy()[own]
                _, lead, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                known = times[which] > 1
                again = lead[times > 1]
                yield pd.DataFrame({
                    "symbol": np.r_[np.where(known, -1 - (row & np.int64((1 << 62) - 1)), key), key[again]],
                    "row": np.r_[row, row[again]], "place": np.r_[near, near[again]],
                })

    return rows.mapInPandas(run, "symbol long, row long, place int")


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows that may repeat, as (digest a and b, row, stretch): the place above 32 bits, and below

    them 0 for the first of equal windows in its batch, or the length of a run of windows that are
    known to repeat, which come under their row instead of a digest."""
    for pdf in batches:
        pdf = pdf.sort_values("row")
        for part, words in _batches(pdf, "text"):
            found, doc, begin = _layout(words)
            if not len(found):
                continue
            window, place, _ = anchors(found, doc, begin)
            repeated = np.zeros(2 * len(found), bool)
            for k, places in enumerate(part["places"]):
                at = np.asarray(places, np.int64)
                repeated[np.where(at >= 0, begin[k] + at, len(found) + begin[k] - 1 - at)] = True
            may = window[repeated[place]]
            if not len(may):
                continue
            flat = [w for ws in words for w in ws]
            joined = b" ".join(flat)
            at = np.r_[0, np.cumsum([len(w) + 1 for w in flat])]
            digest = b"".join(xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(at[may].tolist(), (at[may + WINDOW] - 1).tolist()))
            key = np.frombuffer(digest, np.dtype([("a", ">i8"), ("b", ">i8")]))
            a, b = key["a"].astype(np.int64), key["b"].astype(np.int64)
            order = np.lexsort((may, b, a))  # rows come in order, so the first place is the earliest
            lead = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
            first = np.zeros(len(may), bool)
            first[order[lead]] = True
            rows, place = part["row"].to_numpy()[doc[may]], (may - begin[doc[may]]).astype(np.int64)
            yield pd.DataFrame({"a": a[first], "b": b[first], "row": rows[first], "stretch": place[first] << 32})
            later = np.flatnonzero(~first)
            if len(later):
                head = np.flatnonzero(np.r_[True, (np.diff(may[later]) != 1) | (np.diff(doc[may[later]]) != 0)])
                n = np.diff(np.r_[head, len(later)])
                k = later[head]
                yield pd.DataFrame({"a": rows[k], "b": np.int64(0), "row": rows[k], "stretch": place[k] << 32 | n})


def _removed(n_words: int, stretches) -> np.ndarray:
    gone = np.zeros(n_words + 1, np.int32)
    if stretches is not None and len(stretches):
        found = np.asarray(stretches, np.int64)
        start, n = found >> 32, np.maximum(found & 0xFFFFFFFF, 1)
        np.add.at(gone, start, 1)
        np.add.at(gone, np.minimum(start + n + WINDOW - 1, n_words), -1)
    return np.cumsum(gone)[:n_words] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text) for each row.

    Each word goes that a window covers whose words also start earlier: in a smaller id, or earlier
    in the same row. Null and blank texts have no words; texts below a window's length keep theirs;
    a null id comes after all others; ids may be of any type that orders; rows that repeat an id come in the order of their texts, and
    repeated rows lose all windows but the first row's; other columns are ignored; an empty table
    gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = texts.select("id", F.xxhash64("text").alias("h"))
    twice = cut(keyed.groupBy("id").agg(F.count("*").alias("n"), F.first("h").alias("h")).where("n > 1 or id is null"), "repeated-ids")
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if not whole or twice.limit(1).count():  # ids that aren't whole numbers or don't tell rows apart: number the rows first
        order = texts.select("id", "text").orderBy(F.asc_nulls_last("id"), "text")
        texts = cut(order.withColumn("row", F.monotonically_increasing_id()), "numbered")
    else:
        texts = texts.withColumn("row", F.col("id").cast("long"))
    texts = texts.select("id", "row", "text").where("row is not null")  # no row lacks one; said here, so that both exchanges of texts are one
    # exact copies first: all windows of a later copy start earlier, so only first copies go on
    digest = texts.select("row", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    # a text with very many copies meets its first row in as many tasks as it has salts
    salted = digest.groupBy("digest", "salt").agg(F.min("row").alias("first"), F.count("*").alias("copies"))
    firsts = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("copies").alias("copies")).where("copies > 1")
    lines = salted.select("digest", "salt").join(firsts, "digest")
    copies = digest.join(lines, ["digest", "salt"]).where("row <> first").select("row", F.lit(True).alias("copy"))
    found = symbols(texts.select("row", "text"))
    repeated = found.selectExpr("*", "count(*) over (partition by symbol) as times").where("symbol < 0 or times > 1")
    places = repeated.groupBy("row").agg(F.collect_list("place").alias("places"))
    # the id goes along so that this exchange of texts is the one that the last join uses
    marked = texts.join(places, "row").join(copies, "row", "left").where("copy is null").select("id", "row", "text", "places")
    windows = marked.mapInPandas(_windows, "a long, b long, row long, stretch long")
    ranked = windows.selectExpr("*", "row_number() over (partition by a, b order by row, stretch) as k")
    gone = ranked.where("k > 1 or stretch % 4294967296 > 0").groupBy("row").agg(F.collect_list("stretch").alias("gone"))
    final = texts.join(copies, "row", "left").join(gone, "row", "left")
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, copy, cuts in zip(pdf["text"], pdf["copy"], pdf["gone"]):
                words = words_of(text)
                if copy is True and len(words) >= WINDOW:
                    out.append((len(words), len(words), ""))
                    continue
                gone = _removed(len(words), cuts)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
            got = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])
            yield pd.concat([pdf[["id"]].reset_index(drop=True), got], axis=1)

    return final.select("id", "text", "copy", "gone").mapInPandas(finish, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)

"""Toxicity: character n-grams scaled by naive Bayes log-count ratios, and a linear classifier.

A document's features are the hashed character n-grams that occur in it. On the training rows each
n-gram's log-count ratio r compares its share among toxic and other documents; the n-grams that say
most (by G2) are kept, each occurrence counts r, and logistic regression weighs them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.session import batch_rows, cut

ORDERS = (3, 4, 5)
BITS = 20
FEATURES = 4096  #: n-grams that the classifier weighs
BATCH_ROWS = 1000
THRESHOLD = 0.3
_MULTIPLIER = np.uint32(2654435761)


def _grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document of each byte, and for each order the hashed n-gram that starts there.

    Texts are lower-cased and their bytes joined with spaces around; n-grams that reach into the
    next text get hash 0, which is never a feature.
    """
    raw = [b" " + " ".join(t.lower().split()).encode("utf-8", "replace") + b" " for t in texts]
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(b) for b in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    out, h = [], np.zeros(len(data), np.uint32)
    for k in range(max(ORDERS)):
        n = len(data) - k
        if n <= 0:
            h = np.zeros(0, np.uint32)
        else:
            h = h[:n] * np.uint32(16777619) + data[k:] + np.uint32(1)
        if k + 1 in ORDERS:
            bins = ((h * _MULTIPLIER) >> np.uint32(32 - BITS)).astype(np.int32)
            whole = owner[: len(bins)] == owner[k : k + len(bins)]
            out.append(np.where(whole, bins, 0))
    return owner, out


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) pairs, each once; only n-grams marked in ``wanted`` if that is given."""
    owner, grams = _grams(texts)
    docs, bins = [], []
    for b in grams:
        at = np.flatnonzero(b if wanted is None else wanted[b])
        docs.append(owner[at])
        bins.append(b[at])
    key = np.unique(np.concatenate(docs).astype(np.int64) << BITS | np.concatenate(bins))
    return (key >> BITS).astype(np.int64), key & ((1 << BITS) - 1)


def _pieces(texts: list[str], chars: int = 250_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``chars`` characters, so that memory doesn't follow the batch."""
    at, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield at, texts[at : k + 1]
            at, n = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


class ToxicityModel:
    """``weights`` by n-gram (0: not a feature), and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.wanted = weights != 0

    def scores(self, texts: list[str]) -> np.ndarray:
        margin = np.full(len(texts), self.intercept)
        if self.wanted.any():
            for at, part in _pieces(texts):
                doc, gram = present(part, self.wanted)
                margin[at : at + len(part)] += np.bincount(doc, self.weights[gram], len(part))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def held_out(id_col: str) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; a null id never does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from all labelled documents outside the held-out fold.

    Null labels are left out; of several labels of one document the largest counts; rows that repeat
    an id are trained on each. Null texts count as empty, very long ones are read whole. Of n-grams
    with equal G2 the smaller hash goes first. Other columns, whatever their names, are ignored.
    Without both classes, as in empty tables, the score is a constant: the training share of label 1
    (0 without rows).
    """
    spark = docs.sparkSession
    batch_rows(spark, BATCH_ROWS)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # labels grow with the documents, so they are shuffled at any size
    train = cut(texts.join(marked.hint("merge"), "id").select("text", "y"), "toxic-train")
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows, toxic = sum(totals.values()), totals.get(1, 0)
    if not toxic or toxic == rows:
        share = min(max(toxic / rows if rows else 0.0, 1e-9), 1 - 1e-9)
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(share / (1 - share))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for pdf in batches:
            texts, y = pdf["text"].tolist(), (pdf["y"].to_numpy() == 1).astype(int)
            for at, part in _pieces(texts):
                doc, gram = present(part)
                for k in (0, 1):
                    seen[k] += np.bincount(gram[y[at + doc] == k], minlength=1 << BITS)
        found = np.flatnonzero(seen.sum(0))
        yield pd.DataFrame({"gram": found, "neg": seen[0][found], "pos": seen[1][found]})

    counts = train.mapInPandas(count, "gram long, neg long, pos long").groupBy("gram").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    neg, pos = F.col("neg"), F.col("pos")
    n = neg + pos

    def part(seen: F.Column, share: float) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0.0)

    p = toxic / rows
    absent = [part_ for part_ in (F.lit(toxic) - pos, F.lit(rows - toxic) - neg)]
    rest = F.lit(rows) - n
    g2 = part(pos, p) + part(neg, 1 - p) + sum(F.when((a > 0) & (rest > 0), a * F.log(a / (rest * s))).otherwise(0.0) for a, s in zip(absent, (p, 1 - p)))
    best = counts.where(n >= 2).withColumn("g2", g2).orderBy(F.desc("g2"), "gram").limit(FEATURES)
    chosen = best.select("gram", "neg", "pos").toPandas()  # FEATURES rows at most
    ratio = np.log((1 + chosen["pos"].to_numpy()) / (2 + toxic)) - np.log((1 + chosen["neg"].to_numpy()) / (2 + rows - toxic))
    place = np.full(1 << BITS, -1)
    place[chosen["gram"].to_numpy()] = np.arange(len(chosen))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = place >= 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            xs = []
            for _, part_ in _pieces(texts):
                doc, gram = present(part_, wanted)
                at = place[gram]
                cuts = np.searchsorted(doc, np.arange(len(part_) + 1))
                for k in range(len(part_)):
                    own = np.sort(at[cuts[k] : cuts[k + 1]])
                    xs.append((own.tolist(), ratio[own].tolist()))
            yield pd.DataFrame({"label": (pdf["y"] == 1).astype(float), "i": [x[0] for x in xs], "v": [x[1] for x in xs]})

    size = len(chosen)
    as_vector = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())  # Spark has no function for sparse vectors
    entries = train.mapInPandas(vectors, "label double, i array<int>, v array<double>")
    table = cut(entries.select("label", as_vector("i", "v").alias("features")), "toxic-entries")
    model = LogisticRegression(maxIter=100, regParam=0.002, standardization=False).fit(table)
    weights = np.zeros(1 << BITS)
    weights[chosen["gram"].to_numpy()] = model.coefficients.toArray() * ratio
    return ToxicityModel(weights, float(model.intercept))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row.

    Null and empty texts get the intercept's score, very long ones are read whole; ids, null or
    repeated, are only passed on; other columns, whatever their names, are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    batch_rows(spark, BATCH_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "score": shared.value.scores([t or "" for t in pdf["text"]])})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more.

    Rows decide, whatever their ids; repeated rows stay or go together; null and empty texts score as
    the intercept does. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    batch_rows(docs.sparkSession, BATCH_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t or "" for t in texts]))

    return docs.where(scored(F.col(text_col)) < threshold)

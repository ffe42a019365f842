"""A corpus pipeline: toxicity, near-duplicates, personal data, mixing, tokens.

What holds for every stage: rows decide, not ids, so repeated and null ids are rows like any other;
columns beside doc_id, text, source and n_chars, whatever their names, come back as they are; a very
long text is read whole; an empty table gives an empty table. The docstrings say the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citewright.llm import bpe, mixing, pii, simhash, toxicity
from citewright.llm.queries import TOKENIZER
from citewright.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of ``docs``, doesn't reject.

    Null and empty texts score what a text without features scores, and stay unless most labels are
    toxic; repeated rows stay or go together; without labels of both classes the score is the share of
    toxic ones.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Null, empty and blank texts are one group; null ids come last; of equal ids the smaller hash of
    the text stays, and of equal rows one.
    """
    return simhash.keep_one_per_group(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows the text.

    Null and empty texts stay as they are, n_chars of a null text is null; repeated rows are masked
    alike.
    """
    masked = pii.redact(docs, pii.fit(docs))
    return masked.selectExpr(*("cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Documents without words (null, empty, blank) stay once; a null source is a source; repeated rows
    are taken each on their own; ties in the order of a source are told apart by hashes of id and text.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix.

    Null texts count as empty and have no tokens; a document that the mix holds twice comes twice.
    """
    return bpe.round_trip(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: Learnt models, hashes and a tokenizer: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs

"""Upkeep of the index: what to fetch or clean next, replaced references, reconciled titles, new tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.functions.cleaning import institution, vocabulary_tags
from citewright.functions.names import unused

STUB = "Preview this article"  # fixed: how abstracts that hold nothing begin
SHORT = 42  # fixed: characters of a journal's label, beyond which it ends after 40


def short_journal(name: Column) -> Column:
    """A journal's name up to a colon, cut with an ellipsis where it is long."""
    short = F.trim(F.split_part(name, F.lit(":"), F.lit(1)))
    return F.when(F.length(short) <= SHORT, short).otherwise(F.concat(F.substring(short, 1, SHORT - 2), F.lit("…")))


def retag(records: DataFrame, vocabulary: dict[str, list[str]], texts: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """All rows with tags anew from their texts."""
    return records.withColumn("tags", vocabulary_tags(F.concat_ws(" ", *texts), vocabulary))


def known_tag(tag: Column, vocabulary: dict[str, list[str]]) -> Column:
    return F.coalesce(F.lower(F.trim(tag)).isin(*(t.lower() for t in vocabulary)), F.lit(False))


def replace_references(citations: DataFrame, fetched: DataFrame) -> DataFrame:
    """``citations`` with all rows of each source in ``fetched`` replaced by the new ones."""
    return citations.join(fetched.select("source").distinct(), "source", "left_anti").select(*citations.columns).unionByName(fetched.select(*citations.columns))


def delete_references(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """``citations`` without the rows of ``sources(source)``."""
    return citations.join(sources.select("source").distinct(), "source", "left_anti").select(*citations.columns)


def without_stubs(records: DataFrame) -> DataFrame:
    """Abstracts that are stubs, in any case, become null, and with a doi what found nothing is to be looked up again."""
    abstract = F.when(~F.coalesce(F.lower("abstract").startswith(STUB.lower()), F.lit(False)), F.col("abstract"))
    rows = records.withColumn("abstract", abstract)
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    again = has("doi") & (~F.coalesce(has("work"), F.lit(False)) | F.col("abstract").isNull())
    return rows.withColumn("enriched_at", F.when(~again, F.col("enriched_at")))


def to_enrich(records: DataFrame) -> DataFrame:
    """Articles with a doi that were never looked up, newest first."""
    return records.where("doi is not null and doi <> '' and enriched_at is null").orderBy(F.desc("pub_date"), "id")


def changed_titles(records: DataFrame, deposited: DataFrame, source: str) -> DataFrame:
    """(id, title, new_title) of articles of a source whose deposited title, by doi, is another one."""
    (new,) = unused(["new_title"], records)
    names = deposited.where("title is not null and title <> ''").groupBy(F.lower(F.trim("doi")).alias("_doi")).agg(F.max("title").alias(new))
    own = records.where((F.col("source") == source) & F.col("doi").isNotNull()).withColumn("_doi", F.lower(F.trim("doi")))
    return own.join(names, "_doi").where(~F.col(new).eqNullSafe(F.col("title"))).select("id", "title", new)


def orphan_journals(records: DataFrame, listed: DataFrame, source: str) -> DataFrame:
    """Journals that articles of a source have and ``listed(journal)`` lacks, with their articles."""
    return records.where(F.col("source") == source).join(listed.select("journal"), "journal", "left_anti").groupBy("journal").agg(F.count("*").alias("n"))


def gaps(expected: DataFrame, records: DataFrame) -> DataFrame:
    """expected(journal, remote) with the articles indexed and what is missing, largest gap first, unknown last."""
    n = records.groupBy("journal").agg(F.count("*").alias("n"))
    found = expected.join(n, "journal", "left").select("journal", "remote", F.coalesce("n", F.lit(0)).alias("indexed"))
    return found.withColumn("gap", F.col("remote") - F.col("indexed")).orderBy(F.desc_nulls_last("gap"), "journal")


def work_places(people: DataFrame, known: DataFrame) -> DataFrame:
    """people(work_doi, name, raw) with a place: the known one of (doi, name) in any case, else one from the raw text."""
    place, doi, who = unused(["known_place", "known_doi", "known_name"], people)
    seen = known.groupBy(F.lower("doi").alias(doi), F.lower("name").alias(who)).agg(F.max("place").alias(place))
    out = people.join(seen, (F.lower("work_doi") == F.col(doi)) & (F.lower("name") == F.col(who)), "left")
    return out.withColumn("place", F.coalesce(place, institution(F.col("raw")))).drop(place, doi, who)


def upsert_places(places: DataFrame, batch: DataFrame) -> DataFrame:
    """places(key, name, country) in which rows of known keys take the batch's values and new ones are
    added; of equal keys the batch's last by name counts, rows without a key come once a name that is not there."""
    last = batch.where("key is not null").groupBy("key").agg(F.max(F.struct("name", "country")).alias("x")).select("key", "x.name", "x.country")
    keyed = places.join(last.select("key"), "key", "left_anti").select("key", "name", "country").unionByName(last)
    bare = batch.where("key is null").groupBy("name").agg(F.max("country").alias("country")).join(keyed.select("name"), "name", "left_anti")
    return keyed.unionByName(bare.select(F.lit(None).cast("string").alias("key"), "name", "country"))


def is_fresh(affiliations: DataFrame, articles: DataFrame, year: int, years: int = 5) -> DataFrame:
    """One row: whether any affiliation belongs to an article of the last ``years`` years."""
    last = affiliations.select("id").distinct().join(articles.select("id", "year"), "id").agg(F.max("year").alias("last"))
    return last.select("last", F.coalesce(F.col("last") >= year - years, F.lit(False)).alias("fresh"))

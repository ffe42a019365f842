"""What the pages of one article, author or book show, the book catalogue, and updates of single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.functions.names import unused
from citewright.functions.values import ordinal
from citewright.operators.removal import suppressed

BOOK_LOG = "books:"  # fixed: what marks a publisher's entry in the fetch log
PARTS = ("chapter", "front-matter")


def holds(text: str, part: str) -> Column:
    """Whether a column contains ``part`` in any case."""
    return F.coalesce(F.contains(F.lower(F.col(text)), F.lit(part.lower())), F.lit(False))


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def newest(records: DataFrame, now: str, days: int = 7) -> DataFrame:
    return records.where(F.col("fetched_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def articles_of(records: DataFrame, author: str) -> DataFrame:
    """Articles whose author list contains the name, newest first."""
    return records.where(holds("authors", author)).orderBy(F.desc("pub_date"), "id")


def books_of(books: DataFrame, author: str) -> DataFrame:
    """Whole books that the name wrote or edited."""
    return books.where(~F.col("record_type").isin(*PARTS) & (holds("authors", author) | holds("editors", author))).orderBy(F.desc("year"), "title", "id")


def by_letter(names: DataFrame, people: DataFrame, letter: str) -> DataFrame:
    """Names whose last word starts with ``letter``, by last and then first words, with what is known of them."""
    words = F.split(F.trim("name"), r"\s+")
    last = F.upper(F.element_at(words, -1))
    found = names.select("name").distinct().withColumn("last", last).where(F.col("last").startswith(letter.upper()))
    return found.join(people, "name", "left").withColumn("first", F.upper(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))).orderBy("last", "first", "name")


def with_institutions(authors: DataFrame, people: DataFrame, limit: int = 500) -> DataFrame:
    """The names on most articles with institution and orcid."""
    top = authors.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)
    return top.join(people.select("name", "institution", "orcid"), "name", "left")


def places_by_article(affiliations: DataFrame, author: str) -> DataFrame:
    """(id, places) of an author: the distinct places of each article."""
    return affiliations.where(F.col("name") == author).groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def places_of_article(affiliations: DataFrame, article: int) -> DataFrame:
    return affiliations.where(F.col("id") == article).groupBy("name").agg(F.sort_array(F.collect_set("place")).alias("places"))


def books_page(books: DataFrame, publisher: str | None = None, book_type: str | None = None, year_from: int | None = None, year_to: int | None = None, query: str | None = None) -> DataFrame:
    """Whole books that pass all given filters."""
    found = books.where("record_type = 'book'")
    for name, value in (("publisher", publisher), ("book_type", book_type)):
        if value:
            found = found.where(F.col(name) == value)
    if year_from is not None:
        found = found.where(F.col("year") >= year_from)
    if year_to is not None:
        found = found.where(F.col("year") <= year_to)
    return found.where(holds("title", query) | holds("editors", query) | holds("authors", query)) if query else found


def chapters_of(books: DataFrame, parent: int) -> DataFrame:
    """A book's parts, front matter first, then by doi and pages."""
    return books.where(F.col("parent") == parent).orderBy(F.when(F.col("record_type") == "front-matter", 0).otherwise(1), "doi", "pages", "id")


def publishers(books: DataFrame) -> DataFrame:
    part = F.col("record_type").isin(*PARTS)
    n = lambda c: F.count(F.when(c, 1))
    return books.where("publisher is not null").groupBy("publisher").agg(n(F.col("record_type") == "book").alias("books"), n(part).alias("chapters"))


def upsert_books(books: DataFrame, batch: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``books`` after a harvest: known dois take over ``cited_by``, new ones are added; names of ``ledger`` come in as tokens.

    Of rows of the batch with one doi the last by ``seq`` counts; rows without a doi are always added.
    """
    batch = suppressed(batch, ledger)
    columns = [c for c in books.columns]
    n, new, seen = unused(["n", "new_cited", "seen"], books, batch)
    named = batch.where("doi is not null").withColumn(n, ordinal(F.desc("seq"), by=("doi",))).where(F.col(n) == 1).drop(n)
    counts = named.select("doi", F.coalesce("cited_by", F.lit(0)).alias(new), F.lit(True).alias(seen))
    known = books.join(counts, "doi", "left").withColumn("cited_by", F.when(F.col(seen), F.col(new)).otherwise(F.col("cited_by"))).select(*columns)
    fresh = named.join(books.select("doi"), "doi", "left_anti")
    bare = batch.where("doi is null")
    return known.unionByName(fresh.select(*columns)).unionByName(bare.select(*columns))


def cull_books(books: DataFrame, publisher: str, keep: Column) -> DataFrame:
    """``books`` without those of ``publisher`` that ``keep`` rejects, and without their parts."""
    gone = books.where((F.col("publisher") == publisher) & (F.col("record_type") == "book") & ~F.coalesce(keep, F.lit(False))).select("id")
    left = books.join(gone, "id", "left_anti")
    return left.join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti").select(*books.columns)


def update_fields(rows: DataFrame, changes: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``policy`` taken from ``changes``, one row a key.

    "set" takes the new value, "keep" the old one unless it is null or empty, "new" the new one unless
    it is null. Keys that ``rows`` lacks change nothing; rows without a change stay.
    """
    marks = unused([f"new_{c}" for c in policy], rows, changes)
    (found,) = unused(["found"], rows, changes)
    new = changes.select(key, *(F.col(c).alias(m) for c, m in zip(policy, marks)), F.lit(True).alias(found))
    out = rows.join(new, key, "left")
    for (c, how), m in zip(policy.items(), marks):
        old = F.col(c)
        filled = old.isNotNull() & (old.cast("string") != "")
        taken = {"set": F.col(m), "keep": F.when(filled, old).otherwise(F.col(m)), "new": F.coalesce(m, c)}[how]
        out = out.withColumn(c, F.when(F.col(found), taken).otherwise(old))
    return out.select(*rows.columns)


def latest_rows(log: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``log`` in which rows of ``batch`` replace those of the same key (watermarks, fetch states)."""
    return log.join(batch.select(key), key, "left_anti").unionByName(batch)


def unique_links(rows: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the new ones of ``batch``; null keys never count as equal."""
    known = rows.select(*keys).distinct()
    whole = batch.where(" and ".join(f"{k} is not null" for k in keys))
    partly = batch.where(" or ".join(f"{k} is null" for k in keys))
    fresh = whole.dropDuplicates(keys).join(known, keys, "left_anti")
    return rows.unionByName(fresh.select(*rows.columns)).unionByName(partly.select(*rows.columns))


def open_access(records: DataFrame, journals: list[str]) -> DataFrame:
    """``records`` in which articles of gold open-access journals say so and link somewhere."""
    gold = F.col("journal").isin(journals) & ~F.coalesce(F.col("oa_status") == "gold", F.lit(False))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    link = F.coalesce(filled("oa_url"), F.concat(F.lit("https://doi.org/"), filled("doi")), filled("url"))
    return records.withColumn("oa_url", F.when(gold, link).otherwise(F.col("oa_url"))).withColumn("oa_status", F.when(gold, "gold").otherwise(F.col("oa_status")))


def next_to_fetch(records: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles not in ``done(id)``, oldest first."""
    left = records.join(done.select("id"), "id", "left_anti").orderBy("pub_date", "id")
    return left if limit is None else left.limit(limit)


def sidebar(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """clusters(cluster, place, journal) with each journal's number of articles, 0 where there are none."""
    n = records.groupBy("journal").agg(F.count("*").alias("n"))
    return clusters.join(n, "journal", "left").select("cluster", "place", "journal", F.coalesce("n", F.lit(0)).alias("n")).orderBy("place", "journal")

"""Readers of deposited works, feeds and tables as article rows; all parsing is column expressions.

Each reader takes a path (files or folders) that Spark splits by file, and gives the same columns:
doi, title, authors (joined by '; '), abstract, pub_date, journal, url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from citewright.functions.cleaning import clean_title, match_key, strip_tags
from citewright.functions.values import reference_key

_DATE = "struct<`date-parts`: array<array<int>>>"
WORK = (
    "DOI string, URL string, title array<string>, subtitle array<string>, abstract string, `container-title` array<string>, type string, ISBN array<string>, "
    f"author array<struct<given: string, family: string, name: string>>, `published-print` {_DATE}, `published-online` {_DATE}, issued {_DATE}, published {_DATE}, "
    "reference array<struct<key: string, DOI: string, unstructured: string, `article-title`: string>>"
)
DC = "title string, creator array<string>, description array<string>, date array<string>, identifier array<string>, source array<string>"
ITEM = "title string, link string, pubDate string, creator array<string>, description string"
COLUMNS = ("doi", "title", "authors", "abstract", "pub_date", "journal", "url")


def empty_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def date_of(parts: Column) -> Column:
    """yyyy-MM-dd of [year, month, day], missing parts as 1; null without a year."""
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.when(at(1).isNotNull(), F.format_string("%04d-%02d-%02d", at(1), F.coalesce(at(2), F.lit(1)), F.coalesce(at(3), F.lit(1))))


def names(people: Column) -> Column:
    """'given family; ..' of an array of author structs; null if nobody has a name."""
    full = F.transform(people, lambda p: F.coalesce(empty_to_null(F.concat_ws(" ", p["given"], p["family"])), empty_to_null(p["name"])))
    return empty_to_null(F.array_join(F.filter(full, lambda n: n.isNotNull()), "; "))


def full_title(title: Column, subtitle: Column) -> Column:
    """Title and subtitle, unless the title already holds it."""
    title, subtitle = empty_to_null(clean_title(title)), empty_to_null(clean_title(subtitle))
    add = subtitle.isNotNull() & ~F.contains(F.lower(title), F.lower(subtitle))
    return F.when(add, F.concat(title, F.lit(": "), subtitle)).otherwise(title)


def deposited_works(spark: SparkSession, path: str, wrapped: bool = True) -> DataFrame:
    """Works of a registration agency with type, isbn and references; pages that hold them in
    message.items (``wrapped``), or one work per line."""
    work = StructType.fromDDL(WORK)
    if wrapped:
        page = StructType([StructField("message", StructType([StructField("items", ArrayType(work))]))])
        works = spark.read.schema(page).json(path, multiLine=True).select(F.explode("message.items").alias("w")).select("w.*")
    else:
        works = spark.read.schema(work).json(path)
    return works.select(*work_columns())


def work_columns() -> list[Column]:
    """The columns of ``deposited_works`` over those of ``WORK``."""
    date = F.coalesce(*(date_of(F.try_element_at(F.col(f"`{c}`")["date-parts"], F.lit(1))) for c in ("published-print", "published-online", "issued", "published")))
    first = lambda c: F.try_element_at(c, F.lit(1))
    isbn = F.coalesce(first(F.filter("ISBN", lambda x: F.length(x) == 13)), first(F.col("ISBN")))
    return [
        clean_doi(F.col("DOI")).alias("doi"), full_title(first(F.col("title")), first(F.col("subtitle"))).alias("title"), names(F.col("author")).alias("authors"),
        empty_to_null(strip_tags(F.col("abstract"))).alias("abstract"), date.alias("pub_date"), first(F.col("`container-title`")).alias("journal"), F.col("URL").alias("url"),
        F.col("type"), isbn.alias("isbn"), F.col("reference"),
    ]


def references(works: DataFrame) -> DataFrame:
    """(source_doi, ord, doi, title): one row per reference in order; without a DOI its text gives
    one, else a key from the text's hash stands in."""
    one = works.select(F.col("doi").alias("source_doi"), F.posexplode("reference").alias("ord", "r"))
    text = F.coalesce(F.col("r.unstructured"), F.col("r.article-title"))
    doi = F.coalesce(clean_doi(F.col("r.DOI")), doi_in(text), reference_key(text))
    return one.select("source_doi", "ord", doi.alias("doi"), F.coalesce(F.col("r.article-title"), quoted_title(text)).alias("title"))


ANCHOR = 15  #: characters that a title must have to be looked for, and by which containment is searched


def resolve(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """``refs`` with target: the article of the DOI, else the one whose title is the reference's, else
    one whose title holds the reference's or is held by it.

    Titles are compared by ``match_key`` and need ``ANCHOR`` characters or more (articles' more). Of
    several articles with a DOI or title the largest id counts, of several by containment the smallest.
    """
    by_doi = articles.groupBy(clean_doi(F.col("doi")).alias("doi")).agg(F.max("id").alias("_d")).where("doi is not null")
    known = articles.groupBy(match_key(F.col("title")).alias("_t")).agg(F.max("id").alias("_i")).where(F.length("_t") > ANCHOR)
    asked = refs.withColumn("_t", match_key(F.col("title"))).withColumn("_t", F.when(F.length("_t") >= ANCHOR, F.col("_t")))
    found = asked.join(by_doi, "doi", "left").join(known, "_t", "left")
    near = contained(found.where("_d is null and _i is null and _t is not null").select("_t").distinct(), known)
    return found.join(near, "_t", "left").withColumn("target", F.coalesce("_d", "_i", "_n")).drop("_t", "_d", "_i", "_n")


def contained(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(_t, _n): for titles ``asked(_t)`` the smallest id of ``known(_t, _i)`` that contains it or is contained.

    A text that contains another holds its first ``ANCHOR`` characters somewhere: pairs come from joins
    of those with all stretches of that length, and only they are compared.
    """
    places = F.sequence(F.lit(1), F.length("_t") - ANCHOR + 1)
    stretches = F.array_distinct(F.transform(places, lambda k: F.substr(F.col("_t"), k, F.lit(ANCHOR))))
    start = F.substring("_t", 1, ANCHOR).alias("_a")
    other = lambda rows: rows.withColumnRenamed("_t", "_o")
    inside = asked.select("_t", start).join(other(known.select("_t", "_i", F.explode(stretches).alias("_a"))), "_a").where(F.contains("_o", "_t"))
    around = asked.select("_t", F.explode(stretches).alias("_a")).join(other(known.select("_t", "_i", start)), "_a").where(F.contains("_t", "_o"))
    return inside.select("_t", "_i").union(around.select("_t", "_i")).groupBy("_t").agg(F.min("_i").alias("_n"))


def clean_doi(doi: Column) -> Column:
    return empty_to_null(F.lower(doi))


def doi_in(text: Column) -> Column:
    """The first DOI of a text, in lower case without full stops at its end: an entry between blanks,
    quotes, commas, semicolons and angle brackets that has a registrant's number and a slash."""
    entries = F.split(F.regexp_replace(text, r"10\.([0-9]{4,})/", "\n10.$1/"), r"[\s,;\"'<>]+")
    found = F.try_element_at(F.filter(entries, lambda e: e.rlike(r"^10\.[0-9]{4,}/.")), F.lit(1))
    return empty_to_null(F.lower(F.rtrim(found, F.lit("."))))


def quoted_title(text: Column) -> Column:
    return empty_to_null(F.regexp_extract(text, "[\u201c\"]\\s*(.+?)\\s*[\u201d\"]", 1))


def short_abstract(text: Column, least: int = 80, most: int = 2000) -> Column:
    """Plain text of over ``least`` characters; what exceeds ``most`` ends at a word with an ellipsis."""
    plain = strip_tags(text)
    cut = F.concat(F.regexp_replace(F.substring(plain, 1, most), r"\s\S*$", ""), F.lit("\u2026"))
    return F.when(F.length(plain) > least, F.when(F.length(plain) > most, cut).otherwise(plain))


def oai_records(spark: SparkSession, path: str, journal: str) -> DataFrame:
    """Dublin Core records of OAI harvests (XML); records without a title or an author are wrappers."""
    rows = spark.read.format("xml").options(rowTag="record", ignoreNamespace="true").schema(f"metadata struct<dc: struct<{nested(DC)}>>").load(path).select("metadata.dc.*")
    return rows.select(*dublin_core(F.lit(journal))).where("title is not null and authors is not null")


def dublin_core(journal: Column) -> list[Column]:
    """Article columns over those of ``DC``."""
    first = lambda c: F.try_element_at(c, F.lit(1))
    doi = first(F.filter(F.transform("identifier", doi_in), lambda d: d.isNotNull()))
    url = first(F.filter("identifier", lambda x: x.startswith("http")))
    return [
        doi.alias("doi"), empty_to_null(strip_tags(F.col("title"))).alias("title"), empty_to_null(F.array_join(F.transform("creator", lambda x: F.trim(x)), "; ")).alias("authors"),
        short_abstract(first(F.col("description"))).alias("abstract"), iso_date(first(F.col("date"))).alias("pub_date"), journal.alias("journal"), url.alias("url"),
    ]


def feed_items(spark: SparkSession, path: str, journal: str) -> DataFrame:
    """Items of RSS feeds (XML files)."""
    rows = spark.read.format("xml").options(rowTag="item", ignoreNamespace="true").schema(ITEM).load(path)
    return rows.select(
        doi_in(F.col("link")).alias("doi"), empty_to_null(strip_tags(F.col("title"))).alias("title"), empty_to_null(F.array_join(F.transform("creator", lambda x: F.trim(x)), "; ")).alias("authors"),
        short_abstract(F.col("description")).alias("abstract"), iso_date(F.col("pubDate")).alias("pub_date"), F.lit(journal).alias("journal"), F.trim("link").alias("url"),
    )


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd of an ISO or mail date, else the first year of the 1900s or 2000s alone."""
    mail = F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("d MMM yyyy"))
    day = F.coalesce(empty_to_null(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)), F.date_format(mail, "yyyy-MM-dd"))
    return F.coalesce(day, empty_to_null(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)))


def table_rows(spark: SparkSession, path: str, names_of: dict[str, str], journal: str | None = None) -> DataFrame:
    """CSV files with a header; ``names_of`` maps our columns to theirs, others are null. Rows without a title go."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    found = [(empty_to_null(F.col(f"`{names_of[c]}`")) if c in names_of else F.lit(journal if c == "journal" else None).cast("string")).alias(c) for c in COLUMNS]
    return rows.select(*found).where("title is not null")


def decoded_abstract(index: Column) -> Column:
    """Text of an inverted index map<word, array<position>>; null if it is empty."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return empty_to_null(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "))


OPEN_WORK = (
    "id string, doi string, abstract_inverted_index map<string, array<int>>, cited_by_count long, open_access struct<oa_status: string, oa_url: string>, best_oa_location struct<pdf_url: string, landing_page_url: string>, "
    "authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, author_position: string, raw_affiliation_strings: array<string>, "
    "institutions: array<struct<id: string, ror: string, display_name: string, country_code: string, type: string>>>>"
)
POST = "id long, link string, date string, date_gmt string, title struct<rendered: string>, excerpt struct<rendered: string, protected: boolean>, content struct<protected: boolean>, _embedded struct<author: array<struct<name: string>>>"
ENTRY = "title string, link array<struct<_href: string, _rel: string>>, published string, updated string, author array<struct<name: string>>, summary string, content string"


def open_works(spark: SparkSession, path: str) -> DataFrame:
    """Works of an open index (JSON lines): work, doi, abstract, oa_status, oa_url, cited_by, authorships."""
    rows = spark.read.schema(OPEN_WORK).json(path)
    link = F.coalesce(empty_to_null(F.col("open_access.oa_url")), empty_to_null(F.col("best_oa_location.pdf_url")), empty_to_null(F.col("best_oa_location.landing_page_url")))
    return rows.select(
        F.col("id").alias("work"), clean_doi(F.regexp_replace("doi", "^https?://(dx[.])?doi[.]org/", "")).alias("doi"), decoded_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        empty_to_null(F.col("open_access.oa_status")).alias("oa_status"), link.alias("oa_url"), F.col("cited_by_count").alias("cited_by"), "authorships",
    )


def authorships(works: DataFrame) -> DataFrame:
    """(work, doi, author, name, orcid, position, institution, place, ror, country, kind, raw): a row per
    author and named institution, one without for authors that have none."""
    one = works.select("work", "doi", F.explode("authorships").alias("a"))
    named = F.filter("a.institutions", lambda i: F.coalesce(i["display_name"], F.lit("")) != "")
    none = F.coalesce(F.size("a.institutions"), F.lit(0)) <= 0
    rows = one.withColumn("none", none).withColumn("i", F.explode_outer(named)).where(F.col("i").isNotNull() | F.col("none"))
    return rows.select(
        "work", "doi", F.col("a.author.id").alias("author"), F.coalesce("a.author.display_name", F.lit("")).alias("name"), F.regexp_replace("a.author.orcid", "^https?://orcid[.]org/", "").alias("orcid"),
        F.col("a.author_position").alias("position"), F.col("i.id").alias("institution"), F.col("i.display_name").alias("place"), F.col("i.ror").alias("ror"), F.col("i.country_code").alias("country"), F.col("i.type").alias("kind"),
        empty_to_null(F.array_join("a.raw_affiliation_strings", "; ")).alias("raw"),
    )


def open_links(spark: SparkSession, path: str) -> DataFrame:
    """(doi, oa_url) of an open-access lookup (JSON lines): the best place's file, else its page, else nothing."""
    rows = spark.read.schema("doi string, best_oa_location struct<url_for_pdf: string, url: string>").json(path)
    return rows.select(clean_doi(F.col("doi")).alias("doi"), F.coalesce(empty_to_null(F.col("best_oa_location.url_for_pdf")), empty_to_null(F.col("best_oa_location.url")), F.lit("")).alias("oa_url"))


def paper_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doi, paper, citations) of a paper index (JSON lines)."""
    rows = spark.read.schema("paperId string, citationCount long, externalIds struct<DOI: string>").json(path)
    return rows.select(clean_doi(F.col("externalIds.DOI")).alias("doi"), F.coalesce("paperId", F.lit("")).alias("paper"), F.coalesce("citationCount", F.lit(0)).alias("citations"))


def blog_posts(spark: SparkSession, path: str, journal: str, since: str | None = None) -> DataFrame:
    """Posts of a blog's interface (JSON arrays, a page a file); protected posts and those without title or link go."""
    rows = spark.read.schema(POST).json(path, multiLine=True)
    guarded = F.coalesce(F.col("content.protected"), F.lit(False)) | F.coalesce(F.col("excerpt.protected"), F.lit(False))
    date = F.coalesce(empty_to_null(F.col("date_gmt")), empty_to_null(F.col("date")))
    plain = strip_tags(F.col("excerpt.rendered"))
    rows = rows.where(~guarded).select(
        F.lit(None).cast("string").alias("doi"), empty_to_null(strip_tags(F.col("title.rendered"))).alias("title"),
        empty_to_null(F.array_join(F.filter(F.transform("_embedded.author", lambda a: F.trim(a["name"])), lambda n: n != ""), "; ")).alias("authors"),
        F.when(F.length(plain) >= 80, plain).alias("abstract"), F.substring(date, 1, 10).alias("pub_date"), F.lit(journal).alias("journal"), empty_to_null(F.col("link")).alias("url"),
    )
    rows = rows.where("title is not null and url is not null")
    return rows if since is None else rows.where(F.col("pub_date") >= since)


def atom_entries(spark: SparkSession, path: str, journal: str) -> DataFrame:
    """Entries of Atom feeds (XML files)."""
    rows = spark.read.format("xml").options(rowTag="entry", ignoreNamespace="true").schema(ENTRY).load(path)
    links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    url = F.coalesce(F.try_element_at(links, F.lit(1))["_href"], F.try_element_at(F.col("link"), F.lit(1))["_href"])
    return rows.select(
        doi_in(url).alias("doi"), empty_to_null(strip_tags(F.col("title"))).alias("title"), empty_to_null(F.array_join(F.transform("author", lambda a: F.trim(a["name"])), "; ")).alias("authors"),
        short_abstract(F.coalesce("summary", "content")).alias("abstract"), F.coalesce(iso_date(F.col("published")), iso_date(F.col("updated"))).alias("pub_date"), F.lit(journal).alias("journal"), F.trim(url).alias("url"),
    )


def nested(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ") for part in ddl.split(", ")))

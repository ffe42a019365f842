"""A publisher's list: works(work, type, title, journal, year, parent, cited_by), people(work, name, role, place)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions.values import decade_of, percent
from citewright.operators.citations import pair_counts


def _authors(people: DataFrame) -> DataFrame:
    return people.where("role = 'author'").select("work", "name").distinct()


def with_names(works: DataFrame, people: DataFrame, names: int = 6) -> DataFrame:
    """``works`` with the first ``names`` author names in order, or null."""
    by = _authors(people).join(works.select("work"), "work", "left_semi").groupBy("work").agg(F.array_join(F.slice(F.sort_array(F.collect_list("name")), 1, names), "; ").alias("authors"))
    return works.join(by, "work", "left")


def most_cited(works: DataFrame, people: DataFrame, limit: int = 40) -> DataFrame:
    best = works.orderBy(F.desc("cited_by"), "work").limit(limit)
    return with_names(best, people).select("work", "type", "year", "cited_by", "authors")


def chapters(works: DataFrame, people: DataFrame, parent: int) -> DataFrame:
    """Parts of one collection with their authors."""
    return with_names(works.where(F.col("parent") == parent), people).select("work", "title", "year", "cited_by", "authors")


def cross_format_authors(works: DataFrame, people: DataFrame, least: int = 2, limit: int = 40) -> DataFrame:
    """Authors of works of ``least`` or more types."""
    by = _authors(people).join(works.select("work", "type", "cited_by"), "work").groupBy("name").agg(F.countDistinct("type").alias("formats"), F.count("*").alias("works"), F.sum("cited_by").alias("citations"))
    return by.where(F.col("formats") >= least).orderBy(F.desc("formats"), F.desc("works"), "name").limit(limit)


def copresence(works: DataFrame, people: DataFrame, least: int = 1, top: int = 180) -> DataFrame:
    """(a, b, weight): authors by the collections both have parts in, among the ``top`` with most collections."""
    held = _authors(people).join(works.select("work", "parent"), "work").select("parent", "name").distinct()
    best = held.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    return pair_counts(held.join(best.select("name"), "name", "left_semi"), "parent", "name", least)


def editor_network(works: DataFrame, people: DataFrame, top: int = 220, least: int = 1) -> DataFrame:
    """(editor, author, weight): collections of an editor that an author has a part in, for the ``top``
    authors by such links and for all authors who are editors themselves.

    Authors are ranked before pairs are formed: an author's links are the editors of each of their
    collections, without the author. Names with equal sets of collections are counted as one, so a pair is
    counted once for the sets and comes once for each pair of names, not once a collection.
    """
    place = works.select("work", "parent")
    held = _authors(people).join(place, "work").select("parent", F.col("name").alias("author")).distinct()
    led = people.where("role = 'editor'").join(place, "work").select("parent", F.col("name").alias("editor")).distinct()
    size = led.groupBy("parent").agg(F.count("*").alias("editors"))
    own = led.select("parent", F.col("editor").alias("author"), F.lit(1).alias("own"))
    links = held.join(size, "parent").join(own, ["parent", "author"], "left").groupBy("author").agg(F.sum(F.col("editors") - F.coalesce("own", F.lit(0))).alias("links"))
    best = links.orderBy(F.desc("links"), "author").limit(top).where(F.col("links") >= least)
    shown = best.select("author").union(led.select("editor")).distinct()
    editors, led_by = _by_set(led, "editor", "es")
    authors, held_by = _by_set(held.join(shown, "author", "left_semi"), "author", "as")
    weights = led_by.join(held_by, "parent").groupBy("es", "as").agg(F.count("*").alias("weight"))
    blocks = authors.groupBy("as").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    authors = authors.join(blocks, "as").select("as", F.pmod(F.xxhash64("author"), "blocks").cast("int").alias("block"), "author")
    rows = weights.join(blocks, "as").join(editors, "es").select("as", "editor", "weight", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tasks = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but each row pairs with a block of names
    return rows.repartition(tasks, "editor", "block").join(authors, ["as", "block"]).where("editor <> author").select("editor", "author", "weight")


MEMBERS = 250  #: names of one set that a task pairs at a time, about


def _by_set(rows: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, name), (key, parent)) of the distinct ``rows(parent, name)``: names by their set of parents, and the sets once each."""
    sets = rows.groupBy(name).agg(F.sort_array(F.collect_list("parent")).alias("parents")).withColumn(key, F.sha2(F.concat_ws(",", F.col("parents").cast("array<string>")), 256))
    return sets.select(key, name), sets.groupBy(key).agg(F.any_value("parents").alias("parents")).select(key, F.explode("parents").alias("parent"))


def coauthorship(people: DataFrame, least_works: int = 2, top: int = 160) -> DataFrame:
    """(a, b, weight) among the ``top`` authors with ``least_works`` or more works."""
    rows = _authors(people)
    best = rows.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least_works).orderBy(F.desc("n"), "name").limit(top)
    return pair_counts(rows.join(best.select("name"), "name", "left_semi"), "work", "name", 1)


def anatomy(works: DataFrame) -> DataFrame:
    """Collections by their number of parts, with the median over all collections."""
    parts = works.where("parent is not null").groupBy("parent").agg(F.count("*").alias("parts"))
    middle = parts.agg(F.median("parts").alias("median_parts"))
    return parts.groupBy("parts").agg(F.count("*").alias("collections")).crossJoin(F.broadcast(middle))  # one row


def place_decades(works: DataFrame, people: DataFrame, top: int = 8) -> DataFrame:
    """Works per decade of the ``top`` institutions."""
    best = people.where("place is not null").groupBy("place").agg(F.countDistinct("work").alias("n")).orderBy(F.desc("n"), "place").limit(top)
    rows = people.join(best.select("place"), "place", "left_semi").join(works.where("year is not null").select("work", "year"), "work")
    return rows.groupBy("place", decade_of(F.col("year")).alias("decade")).agg(F.countDistinct("work").alias("works"))


def place_journals(works: DataFrame, people: DataFrame, top: int = 22) -> DataFrame:
    """Works per journal of the ``top`` institutions."""
    best = people.where("place is not null").groupBy("place").agg(F.countDistinct("work").alias("n")).orderBy(F.desc("n"), "place").limit(top)
    return people.join(best.select("place"), "place", "left_semi").join(works.select("work", "journal"), "work").groupBy("place", "journal").agg(F.countDistinct("work").alias("works"))


def affiliation_coverage(works: DataFrame, people: DataFrame) -> DataFrame:
    """Share of author rows that name an institution: by type and decade, and overall (both null)."""
    rows = people.where("role = 'author'").join(works.where("year is not null").select("work", "type", decade_of(F.col("year")).alias("decade")), "work")
    by = rows.groupingSets([["type", "decade"], []], "type", "decade").agg(F.count("*").alias("n"), F.count("place").alias("placed"))
    return by.withColumn("percent", percent(F.col("placed"), F.col("n")))


def topic_decades(tags: DataFrame, articles: DataFrame, top: int = 8) -> DataFrame:
    best = tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(top)
    rows = tags.join(best.select("tag"), "tag", "left_semi").join(articles.select("id", "year"), "id")
    return rows.groupBy("tag", decade_of(F.col("year")).alias("decade")).agg(F.count("*").alias("n"))


def team_decades(works: DataFrame, people: DataFrame) -> DataFrame:
    """Works per decade and number of authors, four and more together."""
    team = _authors(people).groupBy("work").agg(F.least(F.count("*"), F.lit(4)).cast("int").alias("team"))
    return team.join(works.where("year is not null").select("work", "year"), "work").groupBy(decade_of(F.col("year")).alias("decade"), "team").agg(F.count("*").alias("n"))


def coauthorship_trend(works: DataFrame, people: DataFrame) -> DataFrame:
    team = _authors(people).groupBy("work").agg(F.count("*").alias("n"))
    by = team.join(works.where("year is not null").select("work", "year"), "work").groupBy("year")
    return by.agg(F.count("*").alias("works"), F.round(F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)), 6).alias("multi_share"), F.round(F.avg("n"), 6).alias("mean_authors"))


def lifelines(works: DataFrame, present: int) -> DataFrame:
    """Journals with their span; historical ones have nothing from ``present`` on."""
    by = works.groupBy("journal").agg(F.count("*").alias("works"), F.min("year").alias("first"), F.max("year").alias("last"), F.countDistinct("year").alias("years"), F.sum("cited_by").alias("citations"))
    return by.withColumn("historical", F.col("last") < present)


def term_series(works: DataFrame, terms: list[str]) -> DataFrame:
    """Per year and term the titles with a word that starts with it, and their share of the year's titles."""
    rows = works.where("year is not null").groupBy("year").agg(F.count("*").alias("titles"), *(F.count(F.when(F.col("title").rlike(rf"(?i)\b{t}"), 1)).alias(t) for t in terms))
    long = rows.select("year", "titles", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(t).alias("n")) for t in terms))).alias("x"))
    return long.select("year", "x.term", "x.n", F.round(F.col("x.n") / F.col("titles"), 6).alias("share"))


def spotlight(works: DataFrame, journal: str) -> DataFrame:
    """One journal's works per year, and their share of all works."""
    own = F.count(F.when(F.col("journal") == journal, 1))
    return works.where("year is not null").groupBy("year").agg(own.alias("works"), F.round(own / F.count("*"), 6).alias("share")).where("works > 0")


def shares(counts: DataFrame, value: str) -> DataFrame:
    """Shares of the total that the top 1 and 10 percent and the bottom half of the rows hold.

    Rows are counted per distinct value first; only these counts meet in one window.
    """
    by = counts.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    run = by.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("v")))).withColumn("before", F.col("upto") - F.col("n"))
    total = by.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("v")).alias("total"))
    at = run.crossJoin(F.broadcast(total))  # one row

    def held(rows):
        return F.sum(F.col("v") * F.greatest(F.lit(0), F.least(F.col("n"), rows - F.col("before"))))

    rows, whole = F.col("rows"), F.max("total")
    first = [F.round(held(F.greatest(F.lit(1), F.floor(rows / k))) / whole, 6).alias(name) for k, name in ((100, "top_1"), (10, "top_10"))]
    return at.agg(*first, F.round((whole - held(rows - F.floor(rows / 2))) / whole, 6).alias("bottom_half"), F.max("rows").alias("n"))

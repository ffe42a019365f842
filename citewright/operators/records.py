"""Operators on articles, authors, tags, works and texts: listings, facets, collaboration, press."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions.names import unused
from citewright.functions.values import ordinal
from citewright.operators.citations import BLOCKS, by_year_text, in_blocks, pair_counts
from citewright.operators.removal import normal_name
from citewright.session import cut


def article_page(articles: DataFrame, limit: int = 50, offset: int = 0, **ranges) -> DataFrame:
    return by_year_text(articles, **ranges).select("id", "pub_date", "journal", "source").orderBy(F.desc("pub_date"), "id").offset(offset).limit(limit)


def facet(articles: DataFrame) -> DataFrame:
    return articles.groupBy("journal").agg(F.count("*").alias("n"), F.min("source").alias("source"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def tag_cooccurrence(tags: DataFrame) -> DataFrame:
    return pair_counts(tags, "id", "tag", 1)


def related(tags: DataFrame, articles: DataFrame, article: int, limit: int = 5) -> DataFrame:
    """Articles that share most tags with one."""
    own = tags.where(F.col("id") == article).select("tag")
    shared = tags.where(F.col("id") != article).join(own, "tag", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))
    return shared.join(articles.select("id", "pub_date"), "id").orderBy(F.desc("shared"), F.desc("pub_date"), "id").limit(limit)


def search(texts: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows whose words hold, for each word of ``query``, one that starts with it."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    wanted = [F.exists(words, _prefix(part)) for part in query.lower().split()]
    return texts.where(reduce(and_, wanted)) if wanted else texts


def _prefix(part: str):
    return lambda word: word.startswith(part)


def author_links(authors: DataFrame, least_papers: int, top: int, least: int = 1) -> DataFrame:
    """Co-author pairs among the ``top`` authors with enough papers; repeated names in a list count."""
    best = authors.groupBy("name").agg(F.count("*").alias("papers")).where(F.col("papers") >= least_papers).orderBy(F.desc("papers"), "name").limit(top)
    kept = authors.join(best.select("name"), "name", "left_semi").select("id", F.struct("name", "pos").alias("who"))
    pairs = kept.alias("x").join(kept.alias("y"), "id").where("x.who < y.who")
    return pairs.groupBy(F.col("x.who.name").alias("a"), F.col("y.who.name").alias("b")).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def coauthors(authors: DataFrame, name: str) -> DataFrame:
    own = authors.where(F.col("name") == name).select("id").distinct()
    found = authors.join(own, "id", "left_semi").where(F.col("name") != name).select("id", "name").distinct()
    return found.groupBy("name").agg(F.count("*").alias("shared"), F.slice(F.sort_array(F.collect_set("id")), 1, 5).cast("string").alias("first_ids"))


def citing_venues(authors: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    own = authors.where(F.col("name") == name).select(F.col("id").alias("target")).distinct()
    return edges.join(own, "target", "left_semi").groupBy(F.col("sj").alias("journal")).agg(F.count("*").alias("n"))


def cocitation_partners(authors: DataFrame, edges: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Authors cited together with ``name``, by citing articles."""
    cited = edges.select("source", "target").distinct().join(authors.select(F.col("id").alias("target"), "name").distinct(), "target").select("source", "name").distinct()
    with_me = cited.where(F.col("name") == name).select("source")
    return cited.where(F.col("name") != name).join(with_me, "source", "left_semi").groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "name").limit(limit)


def partnerships(authors: DataFrame, articles: DataFrame, least: int) -> DataFrame:
    own = authors.select("id", "name").distinct()
    pairs = own.alias("x").join(own.alias("y"), "id").where("x.name < y.name").select("id", F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    found = pairs.join(articles.select("id", "year", "journal"), "id").groupBy("a", "b").agg(F.count("*").alias("n"), (F.max("year") - F.min("year")).alias("span"), F.countDistinct("journal").alias("journals"))
    kind = F.when(F.col("n") == 1, "one_shot").when(F.col("span") < 3, "short_term").otherwise("persistent")
    return found.where(F.col("n") >= least).withColumn("kind", kind)


def overview(works: DataFrame, work_authors: DataFrame) -> DataFrame:
    people = work_authors.agg(F.countDistinct("name").alias("people"))
    counts = works.groupBy("type").agg(F.count("*").alias("works"), F.sum("cited_by").alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return counts.crossJoin(F.broadcast(people))  # one row


def house_authors(works: DataFrame, work_authors: DataFrame, limit: int = 30) -> DataFrame:
    joined = work_authors.where("role = 'author'").select("work", "name").distinct().join(works, "work")
    return joined.groupBy("name").agg(F.count("*").alias("works"), F.sum("cited_by").alias("citations"), F.countDistinct("type").alias("formats")).orderBy(F.desc("works"), "name").limit(limit)


def editor_author_overlap(work_authors: DataFrame) -> DataFrame:
    names = [work_authors.where(F.col("role") == r).select("name").distinct().withColumn(r, F.lit(1)) for r in ("editor", "author")]
    kind = F.when(F.col("editor").isNull(), "author only").when(F.col("author").isNull(), "editor only").otherwise("both")
    return names[0].join(names[1], "name", "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def collections(works: DataFrame, work_authors: DataFrame) -> DataFrame:
    """Each parent with its parts, and distinct authors and editors over them."""
    people = work_authors.join(works.select("work", "parent"), "work").groupBy("parent").agg(
        F.countDistinct(F.when(F.col("role") == "author", F.col("name"))).alias("authors"), F.countDistinct(F.when(F.col("role") == "editor", F.col("name"))).alias("editors"))
    return works.groupBy("parent").agg(F.count("*").alias("parts"), F.sum("cited_by").alias("citations")).join(people, "parent", "left").na.fill(0)


def institutions(work_authors: DataFrame) -> DataFrame:
    return work_authors.groupBy("place").agg(F.countDistinct("work").alias("works"), F.countDistinct("name").alias("people"))


def title_terms(works: DataFrame, late: int, top: int = 60) -> DataFrame:
    """Words of titles, once for each title, in total and from year ``late`` on."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), F.lit(0)))
    rows = works.select("year", F.explode(words).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("year") >= late, 1).otherwise(0)).alias("late")).orderBy(F.desc("n"), "term").limit(top)


def crossover(work_authors: DataFrame, works: DataFrame, first: str, second: str) -> DataFrame:
    kinds = work_authors.join(works.select("work", "type"), "work").groupBy("name").agg(F.max(F.when(F.col("type") == first, 1)).alias("x"), F.max(F.when(F.col("type") == second, 1)).alias("y"))
    kind = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), "both").when(F.col("x").isNotNull(), "first only").when(F.col("y").isNotNull(), "second only").otherwise("neither")
    return kinds.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def citations_by_age(works: DataFrame) -> DataFrame:
    """Per year the upper median of citations, the mean and the number of works, from counts by value."""
    by = works.where("year is not null").groupBy("year", "cited_by").agg(F.count("*").alias("k"))
    w = Window.partitionBy("year")
    at = by.withColumn("upto", F.sum("k").over(w.orderBy("cited_by"))).withColumn("n", F.sum("k").over(w))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("cited_by")))
    return at.groupBy("year").agg(F.max("n").alias("n"), median.alias("median"), F.round(F.sum(F.col("k") * F.col("cited_by")) / F.max("n"), 6).alias("mean"))


def upsert_ignore(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` with the rows of ``batch`` whose key is new; of equal keys the first by ``order``."""
    (n,) = unused(["n"], target, batch)
    fresh = batch.join(target.select(key), key, "left_anti").withColumn(n, ordinal(F.col(order), by=(key,))).where(F.col(n) == 1).drop(n)
    return target.unionByName(fresh)


def suppress(authors: DataFrame, ledger: DataFrame) -> DataFrame:
    """``authors`` with names of the ledger (name, token) replaced by their tokens, by normalised name."""
    norm, token = unused(["norm", "new_token"], authors)
    tokens = ledger.groupBy(normal_name(F.col("name")).alias(norm)).agg(F.min("token").alias(token))
    found = authors.withColumn(norm, normal_name(F.col("name"))).join(tokens, norm, "left")
    return found.withColumn("name", F.coalesce(token, "name")).drop(norm, token)


def author_cocitation(authors: DataFrame, links: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(a, b, weight): author pairs by the articles that cite works of both, among the ``top`` authors.

    Works count if cited twice or more. An article doesn't link two authors of whom it cites the
    same works only: each author of an article comes with the list of these works, so pairs meet their
    count alone, as numbers that stand for the names.
    """
    known = links.groupBy("target").agg(F.count("*").alias("n")).where("n >= 2").select("target")
    cited = links.join(known, "target", "left_semi").select("source", "target").distinct()
    numbers = cut(authors.select("name").where("name is not null").distinct().withColumn("k", F.monotonically_increasing_id()), "names")
    by = cited.join(authors.join(numbers, "name").select(F.col("id").alias("target"), "k").distinct(), "target").groupBy("source", "k").agg(F.sort_array(F.collect_list("target")).alias("works"))
    placed = in_blocks(by, "source", "k")
    left, right = (placed.select("source", *BLOCKS, F.col("k").alias(c), F.col("works").alias(f"w{c}"), F.col("block_own").alias(f"m{c}")) for c in "ij")
    pairs = left.join(right, ["source", *BLOCKS]).where("i < j and wi <> wj and (block_i = block_j or mi <> mj)")
    counts = cut(pairs.groupBy("i", "j").agg(F.count("*").alias("weight")).where(F.col("weight") >= least), "cocited")
    strength = counts.select(F.explode(F.array("i", "j")).alias("k"), "weight").groupBy("k").agg(F.sum("weight").alias("s")).join(numbers, "k").orderBy(F.desc("s"), "name").limit(top)
    x, y = (strength.select(F.col("k").alias(c), F.col("name").alias(f"n{c}")) for c in "ij")
    return counts.join(x, "i").join(y, "j").select(F.least("ni", "nj").alias("a"), F.greatest("ni", "nj").alias("b"), "weight")


def spans(works: DataFrame, work_authors: DataFrame, least: int = 2) -> DataFrame:
    """People with ``least`` or more works: first and last year, and the years between."""
    years = work_authors.select("work", "name").distinct().join(works.where("year is not null").select("work", "year"), "work")
    found = years.groupBy("name").agg(F.count("*").alias("works"), F.min("year").alias("first"), F.max("year").alias("last"))
    return found.where(F.col("works") >= least).withColumn("span", F.col("last") - F.col("first"))


def brokers(works: DataFrame, work_authors: DataFrame, least: int = 2) -> DataFrame:
    """Editors by the number of collections and of other people that their edited works bring together."""
    edited = work_authors.where("role = 'editor'").select("work", F.col("name").alias("editor")).distinct()
    people = edited.join(work_authors.select("work", "name").distinct(), "work").where("name <> editor")
    met = people.groupBy("editor").agg(F.countDistinct("name").alias("people"))
    held = edited.join(works.select("work", "parent"), "work").groupBy("editor").agg(F.countDistinct("parent").alias("collections"))
    return held.where(F.col("collections") >= least).join(met, "editor", "left").na.fill(0)

"""Queries of the index's upkeep, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewright.operators import upkeep as U
from citewright.operators.merging import upsert_fill
from citewright.plans.tables import with_sql
from citewright.session import expire, shared_path
from citewright.sources.stored import StoredTable

VOCABULARY = {"hard": ["bolt", "metal plate"], "soft": ["widget"], "urgent": ["1-urgent"], "never": ["nothing like this"]}


def _fetched(c):
    """References fetched again for orders of one status: half as many, under new dois."""
    mine = c.citations.join(c.articles.where("source = 'F'").select(F.col("id").alias("source")), "source", "left_semi")
    return mine.where("ord < 3").withColumn("doi", F.concat(F.lit("new:"), "doi"))


def _stubs(c):
    r = c.records.withColumn("abstract", F.when(F.col("year") == 1996, F.concat(F.when(F.col("source") == "O", "PREVIEW this Article: ").otherwise("Preview this article: "), "abstract")).otherwise(F.col("abstract")))
    return U.without_stubs(r.withColumn("work", F.when(F.col("source") != "P", F.col("url"))).withColumn("enriched_at", F.when(F.col("year") < 2000, F.col("fetched_at"))))


def _places(c):
    return c.table("nation").select(F.concat(F.lit("I"), "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("country"))


def _more_places(c):
    n = c.table("nation")
    known = n.where("n_regionkey = 1").select(F.concat(F.lit("I"), "n_nationkey").alias("key"), F.lower("n_name").alias("name"), F.lit("new").alias("country"))
    bare = n.where("n_regionkey < 3").select(F.lit(None).cast("string").alias("key"), "n_name", F.lit("bare"))
    return known.union(bare).union(n.where("n_regionkey = 2").select(F.concat(F.lit("J"), "n_nationkey"), "n_name", F.lit("J")))


def _stored(c):
    """Articles in a stored table; then those of one journal come again with abstracts, and some new ones."""
    path = shared_path(c.spark, "stored")
    table = StoredTable(c.spark, path, "id", 16)
    expire(c.spark, path)
    rows = c.records.select("id", "title", "abstract")
    merge = lambda old, new: upsert_fill(old, new, "id", ["abstract"])
    table.update(rows, merge)
    again = c.records.where("journal = 'BUILDING'").select("id", F.lit("new title").alias("title"), F.lit("new abstract").alias("abstract"))
    table.update(again.unionByName(again.withColumn("id", -F.col("id") - 1)), merge)
    return table.read()


QUERIES = {
    "stored_upsert": _stored,
    "retagged": lambda c: U.retag(c.records, VOCABULARY).groupBy("tags").agg(F.count("*").alias("n")),
    "known_tags": lambda c: c.tags.groupBy(U.known_tag(F.concat(F.lit(" "), F.upper(F.element_at(F.split("tag", " "), 1))), {"cold": [], "large": []}).alias("known")).agg(F.count("*").alias("n")),
    "replaced_references": lambda c: U.replace_references(c.citations, _fetched(c)).groupBy("source").agg(F.count("*").alias("n"), F.count("target").alias("resolved")),
    "deleted_references": lambda c: U.delete_references(c.citations, c.articles.where("source = 'F'").select(F.col("id").alias("source"))).groupBy("source").agg(F.count("*").alias("n"), F.count("target").alias("resolved")),
    "without_stubs": lambda c: _stubs(c).groupBy(F.col("abstract").isNull().alias("bare"), F.col("enriched_at").isNull().alias("again")).agg(F.count("*").alias("n")),
    "to_enrich": lambda c: U.to_enrich(_stubs(c)).select("id", "doi").limit(200),
    "changed_titles": lambda c: U.changed_titles(c.records, c.records.select(F.upper("doi").alias("doi"), F.when(F.col("year") > 1997, F.initcap("title")).otherwise(F.col("title")).alias("title")), "F"),
    "orphan_journals": lambda c: U.orphan_journals(c.records, c.records.where("journal < 'C'").select("journal").distinct(), "O"),
    "index_gaps": lambda c: U.gaps(c.table("customer").groupBy(F.col("c_mktsegment").alias("journal")).agg(F.when(F.min("c_mktsegment") != "BUILDING", F.count("*") * 10).alias("remote")), c.records),
    "work_places": lambda c: U.work_places(
        c.placed.select(F.concat(F.lit("10.1000/W"), "work").alias("work_doi"), "name", F.when(F.col("place").isNotNull(), F.concat(F.lit("Dept. of X, University "), "place")).alias("raw")),
        c.placed.where("role = 'editor'").select(F.concat(F.lit("10.1000/w"), "work").alias("doi"), F.upper("name").alias("name"), F.concat(F.lit("Press "), "work").alias("place"))).groupBy("place").agg(F.count("*").alias("n")),
    "upserted_places": lambda c: U.upsert_places(_places(c), _more_places(c)),
    "fresh_places": lambda c: U.is_fresh(c.affiliations, c.articles, 2005),
    "place_count": lambda c: c.affiliations.where("place = 7").agg(F.countDistinct("id").alias("n")),
    "short_journals": lambda c: c.table("documents").where("text is not null").select("doc_id", U.short_journal(F.col("text")).alias("label")),
}

_STUBS = """, s as (select *, case when year = 1996 then null else abstract end as abs, case when source <> 'P' then url end as work, case when year < 2000 then fetched_at end as looked from records),
    t as (select *, case when doi is not null and (work is null or abs is null) then null else looked end as enriched from s)"""

SQL = {
    "stored_upsert": with_sql("records", "select id, title, case when journal = 'BUILDING' then coalesce(abstract, 'new abstract') else abstract end as abstract from records union all select -id - 1, 'new title', 'new abstract' from records where journal = 'BUILDING'"),
    "retagged": with_sql("records", """, w as (select lower(concat_ws(' ', title, abstract)) as t from records), g as (select list_filter([case when contains(t, 'metal plate') or regexp_matches(t, '\\bbolt\\b') then 'hard' end,
        case when regexp_matches(t, '\\bwidget\\b') then 'soft' end, case when contains(t, '1-urgent') then 'urgent' end], lambda x: x is not null) as l from w)
        select case when len(l) > 0 then '|' || array_to_string(l, '|') || '|' end as tags, count(*) as n from g group by 1"""),
    "known_tags": with_sql("tags", "select split_part(tag, ' ', 1) in ('cold', 'large') as known, count(*) as n from tags group by 1"),
    "replaced_references": with_sql("articles citations", ", f as (select c.source, c.ord, c.target, a.id is not null as again from citations c left join articles a on a.id = c.source and a.source = 'F'), m as (select source from f where again group by 1 having min(ord) < 3) select source, count(*) filter (not (again and source in (from m)) or ord < 3) as n, count(target) filter (not (again and source in (from m)) or ord < 3) as resolved from f group by 1"),
    "deleted_references": with_sql("articles citations", "select source, count(*) as n, count(target) as resolved from citations where source not in (select id from articles where source = 'F') group by 1"),
    "without_stubs": with_sql("records", _STUBS + " select abs is null as bare, enriched is null as again, count(*) as n from t group by all"),
    "to_enrich": with_sql("records", _STUBS + " select id, doi from t where doi is not null and enriched is null order by pub_date desc, id limit 200"),
    "changed_titles": with_sql("records", "select id, title, upper(title[1]) || split_part(title[2:], ' ', 1) || ' ' || upper(split_part(title, ' ', 2)[1]) || split_part(title, ' ', 2)[2:] as new_title from records where source = 'F' and doi is not null and year > 1997 and title is not null"),
    "orphan_journals": with_sql("records", "select journal, count(*) as n from records where source = 'O' and journal >= 'C' group by 1"),
    "index_gaps": with_sql("records", ", e as (select c_mktsegment as journal, case when c_mktsegment <> 'BUILDING' then count(*) * 10 end as remote from customer group by 1), n as (select journal, count(*) as n from records group by 1) select journal, remote, coalesce(n, 0) as indexed, remote - coalesce(n, 0) as gap from e left join n using (journal)"),
    "work_places": with_sql("placed", ", e as (select distinct work, name from placed where role = 'editor') select case when e.work is not null then 'Press ' || p.work else 'University ' || place end as place, count(*) as n from placed p left join e on e.work = p.work and e.name = p.name group by 1"),
    "upserted_places": "select 'I' || n_nationkey as key, case when n_regionkey = 1 then lower(n_name) else n_name end as name, case when n_regionkey = 1 then 'new' else n_regionkey::varchar end as country from nation union all select 'J' || n_nationkey, n_name, 'J' from nation where n_regionkey = 2 union all select null, n_name, 'bare' from nation where n_regionkey = 1",
    "fresh_places": with_sql("articles affiliations", "select max(year) as last, max(year) >= 2000 as fresh from affiliations join articles using (id)"),
    "place_count": with_sql("affiliations", "select count(distinct id) as n from affiliations where place = 7"),
    "short_journals": "with s as (select doc_id, trim(split_part(text, ':', 1)) as s from documents where text is not null) select doc_id, case when len(s) <= 42 then s else s[1:40] || '…' end as label from s",
}

"""Queries of filtered listings, article, author and book pages, coverage and record updates, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewright.operators import citations as C
from citewright.operators import coverage as K
from citewright.operators import pages as P
from citewright.operators import records as R
from citewright.operators.filters import Filter, citations_within
from citewright.operators.search import matches
from citewright.plans.tables import CLUSTERS, with_sql

NAME = "Supplier#000000003"
_PAGE = Filter(query="widget co", journals=("BUILDING", "MACHINERY", "FURNITURE"), source="F", year_from=1996, year_to=2000)
_NUMBERS = Filter(cluster="makers", year_from=1994, year_to=1999, years="number")


def _approved(c):
    """Readers' tags that were approved: votes of 20 and more."""
    return c.votes.where("vote > 0").select("article", "tag").distinct()


def _inner(c, flt):
    """Articles and links that a filter leaves."""
    kept = flt.apply(c.records, clusters=CLUSTERS)
    return kept, citations_within(c.citations, kept)


def _doubled(c):
    """A harvest of books: the listed ones again with more citations, under their old and new dois."""
    again = c.books.where("record_type = 'book'").withColumn("cited_by", F.col("cited_by") + 1).withColumn("seq", F.lit(1))
    return again.unionByName(again.withColumn("doi", F.concat("doi", F.lit("x"))))


def _updated(c):
    """Articles with what a lookup found: links for all with a doi, abstracts where there is none."""
    changes = c.records.where("doi is not null").select("id", F.concat(F.lit("https://doi.org/"), "doi").alias("url"), F.lit("found").alias("abstract"), F.when(F.col("year") > 1996, F.lit("bronze")).alias("oa_status"))
    return P.update_fields(c.records, changes, "id", {"url": "set", "abstract": "keep", "oa_status": "new"})


def _network_nodes(pairs, top):
    """Nodes of a pair network by the sum of their links' weights, and the links among the strongest."""
    return C.strongest(pairs, top)


QUERIES = {
    "filtered_page": lambda c: _PAGE.apply(c.records).orderBy(F.desc("pub_date"), F.desc("fetched_at"), "id").select("id", "title", "pub_date", "journal", "source").offset(3).limit(50),
    "filtered_count": lambda c: _PAGE.apply(c.records).agg(F.count("*").alias("n")),
    "tag_filter": lambda c: Filter(tag="COLD widget").apply(c.records).select("id", "tags"),
    "approved_tag_filter": lambda c: Filter(tag="Click").apply(c.records, approved=_approved(c)).select("id", "journal"),
    "cluster_years": lambda c: _NUMBERS.apply(c.records, clusters=CLUSTERS).groupBy("journal", "year").agg(F.count("*").alias("n")),
    "search_structured": lambda c: c.table("documents").where(matches('"of the" AND th* NOT zz* OR "der"', F.col("text"))).select("doc_id"),
    "tags_of_journal": lambda c: R.tag_counts(c.tags.join(Filter(journals=("BUILDING",), source="O").apply(c.records).select("id"), "id", "left_semi")),
    "most_cited_filtered": lambda c: C.most_cited(Filter(query="widget", year_from=1995).apply(c.records), c.citations),
    "trends_of_journal": lambda c: C.trends(c.articles.where("journal = 'BUILDING'"), c.citations),
    "network_filtered": lambda c: C.network_links(*_inner(c, Filter(cluster="makers", year_from=1993, year_to=1999)), least=1, most=300),
    "cocitation_network": lambda c: _network_nodes(C.cocitation(_inner(c, Filter(year_from=2001, year_to=1992).ordered())[1], 1), 400),
    "coupling_network": lambda c: _network_nodes(C.coupling(_inner(c, Filter(journals=("BUILDING", "FURNITURE", "HOUSEHOLD")))[1], 1), 400),
    "article_by_id": lambda c: P.by_key(c.records, "id", 7).select("id", "title", "authors", "tags", "doi", "abstract"),
    "new_article_count": lambda c: P.newest(c.records, "1997-06-30 00:00:00", 30).agg(F.count("*").alias("n")),
    "author_articles": lambda c: P.articles_of(c.records, NAME.lower()).select("id", "title", "pub_date"),
    "author_books": lambda c: P.books_of(c.books, NAME).select("id", "title", "year"),
    "article_places": lambda c: P.places_of_article(c.affiliations, 7).select("name", F.array_join("places", ",").alias("places")),
    "author_by_name": lambda c: P.by_key(c.people, "name", NAME),
    "people_by_letter": lambda c: P.by_letter(c.people.where("institution is not null").select(F.concat_ws(" ", "name", "institution").alias("name")), c.people, "n").select("name", "last", "first", "orcid"),
    "authors_with_institutions": lambda c: P.with_institutions(c.authors, c.people),
    "author_places": lambda c: P.places_by_article(c.affiliations, NAME).select("id", F.array_join("places", ",").alias("places")),
    "article_citations": lambda c: c.citations.where("target = 7").select(F.col("source").alias("id")).join(c.articles, "id").select("id", "pub_date", "journal"),
    "article_references": lambda c: C.resolved(c.citations.where("source = 7")).select(F.col("target").alias("id")).join(c.articles, "id").select("id", "pub_date", "journal"),
    "books_page": lambda c: P.books_page(c.books, year_from=1993, year_to=1996, query="widget").orderBy(F.desc("year"), "title", "id").select("id", "title", "year", "publisher").limit(50),
    "book_count": lambda c: P.books_page(c.books, publisher="Brand#11").agg(F.count("*").alias("n")),
    "book_by_id": lambda c: P.by_key(c.books, "id", 7).select("id", "title", "record_type", "authors", "editors"),
    "book_by_doi": lambda c: P.by_key(c.books, "doi", "10.1000/W9").select("id", "title", "record_type", "publisher"),
    "book_chapters": lambda c: P.chapters_of(c.books, 7).select("id", "title", "record_type", "pages"),
    "book_publishers": lambda c: P.publishers(c.books),
    "upsert_books": lambda c: P.upsert_books(c.books, _doubled(c)).select("doi", "record_type", "cited_by"),
    "cull_books": lambda c: P.cull_books(c.books, "Brand#11", matches("widget", F.col("title"))).select("id", "record_type"),
    "books_fetch_log": lambda c: P.latest_rows(
        c.books.select(F.concat(F.lit(P.BOOK_LOG), "publisher").alias("journal")).distinct().withColumn("last", F.lit("1990")),
        c.books.where("year > 1995").groupBy(F.concat(F.lit(P.BOOK_LOG), "publisher").alias("journal")).agg(F.max("year").cast("string").alias("last")), "journal"),
    "update_records": lambda c: _updated(c).groupBy("url", "abstract", "oa_status").agg(F.count("*").alias("n")).where("n > 0").groupBy("abstract", "oa_status").agg(F.sum("n").alias("n")),
    "institution_links": lambda c: P.unique_links(c.placed.select("work", "name", "place"), c.placed.select("work", "name", F.when(F.col("role") == "author", F.col("place")).alias("place")), ["work", "name", "place"]).groupBy("place").agg(F.count("*").alias("n")),
    "next_to_fetch": lambda c: P.next_to_fetch(c.records, c.records.where("refs_at is not null").select("id"), 100).select("id", "pub_date"),
    "gold_access": lambda c: P.open_access(c.records.withColumn("oa_url", F.when(F.col("year") < 1995, F.col("url"))), ["BUILDING", "MACHINERY"]).groupBy("journal", "oa_status").agg(F.count("oa_url").alias("linked"), F.count("*").alias("n")),
    "journal_coverage": lambda c: K.per_journal(c.records, c.citations, 1993),
    "source_coverage": lambda c: K.by_source(c.records),
    "global_counts": lambda c: K.global_counts(c.records),
    "coverage_markdown": lambda c: K.markdown(c.records.groupBy("journal").agg(F.count("*").alias("articles"), F.count("doi").alias("with_doi")), ["journal", "articles", "with_doi"]),
    "sidebar": lambda c: P.sidebar(c.spark.createDataFrame([(k, p, j) for p, (k, js) in enumerate(CLUSTERS.items()) for j in js], "cluster string, place int, journal string"), c.records),
    "tag_status_counts": lambda c: _tag_states(c),
    "approved_tags": lambda c: _approved(c).where("article is not null").groupBy("article").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags")),
}


def _tag_states(c):
    from citewright.plans.people import _submitted

    return _submitted(c).groupBy("status").agg(F.count("*").alias("n"))


_FTS = "(' ' || array_to_string(regexp_extract_all(lower(concat_ws(' ', title, authors, abstract)), '[a-z0-9]+'), ' ') || ' ')"
_DOC = "(' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ')"
_KEPT = f"{_FTS} like '% widget%' and {_FTS} like '% co%' and journal in ('BUILDING', 'MACHINERY', 'FURNITURE') and source = 'F' and pub_date >= '1996-01-01' and pub_date <= '2000-12-31'"
_MAKERS = "journal in (" + ", ".join(f"'{j}'" for j in CLUSTERS["makers"]) + ")"
_LINKS = ", l as (select source, target from citations where target is not null and source in (from k) and target in (from k))"
_STRONG = ", s as (select n from (select a as n, weight from p union all select b, weight from p) group by 1 order by sum(weight) desc, n limit 400) select a, b, weight from p where a in (from s) and b in (from s)"

SQL = {
    "filtered_page": with_sql("records", f"select id, title, pub_date, journal, source from records where {_KEPT} order by pub_date desc, fetched_at desc, id limit 50 offset 3"),
    "filtered_count": with_sql("records", f"select count(*) as n from records where {_KEPT}"),
    "tag_filter": with_sql("records", "select id, tags from records where lower(tags) like '%|cold widget|%'"),
    "approved_tag_filter": with_sql("records votes", "select id, journal from records where coalesce(lower(tags) like '%|click|%', false) or id in (select article from votes where vote > 0 and tag = 'click')"),
    "cluster_years": with_sql("records", f"select journal, year, count(*) as n from records where {_MAKERS} and year between 1994 and 1999 group by all"),
    "search_structured": f"select doc_id from documents where ({_DOC} like '% of the %' and {_DOC} like '% th%' and {_DOC} not like '% zz%') or {_DOC} like '% der %'",
    "tags_of_journal": with_sql("tags records", "select tag, count(*) as n from tags where id in (select id from records where journal = 'BUILDING' and source = 'O') group by 1"),
    "most_cited_filtered": with_sql("records citations", f"select id, pub_date, journal, n_in from records join (select target, count(*) as n_in from citations where target is not null group by 1) on target = id where {_FTS} like '% widget%' and pub_date >= '1995-01-01' order by n_in desc, pub_date desc, id limit 50"),
    "trends_of_journal": with_sql("articles citations", "select year, round(avg(n), 2) as avg_refs, sum(n)::bigint as total_refs, count(*) as n from articles join (select source as k, count(*) as n from citations where target is not null group by 1) on k = id where journal = 'BUILDING' and year >= 1990 group by 1 having count(*) >= 2"),
    "network_filtered": with_sql("records citations", f", k as (select id from records where {_MAKERS} and pub_date >= '1993-01-01' and pub_date <= '1999-12-31'){_LINKS}, t as (select target from l group by 1 order by count(*) desc, target limit 300) select distinct source, target from l where source in (from t) and target in (from t)"),
    "cocitation_network": with_sql("records citations", f", k as (select id from records where pub_date >= '1992-01-01' and pub_date <= '2001-12-31'){_LINKS}, p as (select x.target as a, y.target as b, count(*) as weight from l x join l y on x.source = y.source and x.target < y.target group by all){_STRONG}"),
    "coupling_network": with_sql("records citations", f", k as (select id from records where journal in ('BUILDING', 'FURNITURE', 'HOUSEHOLD')){_LINKS}, p as (select x.source as a, y.source as b, count(*) as weight from l x join l y on x.target = y.target and x.source < y.source group by all){_STRONG}"),
    "article_by_id": with_sql("records", "select id, title, authors, tags, doi, abstract from records where id = 7"),
    "new_article_count": with_sql("records", "select count(*) as n from records where fetched_at >= timestamp '1997-05-31'"),
    "author_articles": with_sql("records", f"select id, title, pub_date from records where authors ilike '%{NAME}%'"),
    "author_books": with_sql("books", f"select id, title, year from books where record_type not in ('chapter', 'front-matter') and (authors like '%{NAME}%' or editors like '%{NAME}%')"),
    "article_places": with_sql("affiliations", "select name, array_to_string(list_sort(list(distinct place)), ',') as places from affiliations where id = 7 group by 1"),
    "author_by_name": with_sql("people", f"select * from people where name = '{NAME}'"),
    "people_by_letter": with_sql("people", """, n as (select name || ' ' || institution as name from people where institution is not null), w as (select name, string_split(name, ' ') as w from n)
        select w.name, upper(w[-1]) as last, upper(array_to_string(w[1:len(w) - 1], ' ')) as first, orcid from w left join people p on p.name = w.name where upper(w[-1]) like 'N%'"""),
    "authors_with_institutions": with_sql("authors people", "select a.name, n, institution, orcid from (select name, count(*) as n from authors group by 1 order by n desc, name limit 500) a left join people p on p.name = a.name"),
    "author_places": with_sql("affiliations", f"select id, array_to_string(list_sort(list(distinct place)), ',') as places from affiliations where name = '{NAME}' group by 1"),
    "article_citations": with_sql("articles citations", "select id, pub_date, journal from citations join articles a on id = citations.source where target = 7"),
    "article_references": with_sql("articles citations", "select id, pub_date, journal from citations join articles a on id = target where citations.source = 7"),
    "books_page": with_sql("books", "select id, title, year, publisher from books where record_type = 'book' and year between 1993 and 1996 and (title ilike '%widget%' or editors ilike '%widget%' or authors ilike '%widget%') order by year desc, title, id limit 50"),
    "book_count": with_sql("books", "select count(*) as n from books where record_type = 'book' and publisher = 'Brand#11'"),
    "book_by_id": with_sql("books", "select id, title, record_type, authors, editors from books where id = 7"),
    "book_by_doi": with_sql("books", "select id, title, record_type, publisher from books where doi = '10.1000/W9'"),
    "book_chapters": with_sql("books", "select id, title, record_type, pages from books where parent = 7"),
    "book_publishers": with_sql("books", "select publisher, count(*) filter (record_type = 'book') as books, count(*) filter (record_type <> 'book') as chapters from books where publisher is not null group by 1"),
    "upsert_books": with_sql("books", "select doi, record_type, cited_by + (record_type = 'book')::int as cited_by from books union all select doi || 'x', record_type, cited_by + 1 from books where record_type = 'book'"),
    "cull_books": with_sql("books", ", g as (select id from books where publisher = 'Brand#11' and record_type = 'book' and not ' ' || lower(title) like '% widget%') select id, record_type from books where id not in (from g) and parent not in (from g)"),
    "books_fetch_log": with_sql("books", "select 'books:' || publisher as journal, coalesce(max(year) filter (year > 1995)::varchar, '1990') as last from books group by 1"),
    "update_records": with_sql("records", "select case when doi is not null then coalesce(nullif(abstract, ''), 'found') else abstract end as abstract, case when doi is not null and year > 1996 then 'bronze' else oa_status end as oa_status, count(*) as n from records group by all"),
    "institution_links": with_sql("placed", ", x as (select work, name, place from placed), y as (select work, name, case when role = 'author' then place end as place from placed) select place, count(*) as n from (from x union all from y where place is null) group by 1"),
    "next_to_fetch": with_sql("records", "select id, pub_date from records where refs_at is null order by pub_date, id limit 100"),
    "gold_access": with_sql("records", """, r as (select *, case when year < 1995 then url end as oa_url, journal in ('BUILDING', 'MACHINERY') as g from records)
        select journal, case when g then 'gold' else oa_status end as oa_status, count(case when g and oa_status is distinct from 'gold' then coalesce(oa_url, doi, url) else oa_url end) as linked, count(*) as n from r group by all"""),
    "journal_coverage": with_sql("records citations", """, o as (select source, count(*) as raw, count(target) as links from citations group by 1), i as (select target, count(*) as links_in from citations where target is not null group by 1),
        s as (select c.source, count(*) as same from citations c join records a on a.id = c.source join records b on b.id = c.target where a.journal = b.journal group by 1),
        r as (select x.*, raw, links, links_in, same from records x left join o on o.source = id left join i on i.target = id left join s on s.source = id where pub_date >= '1993'),
        g as (select journal, count(*) as articles, min(substr(pub_date, 1, 4)) as first_year, max(substr(pub_date, 1, 4)) as last_year, count(doi) as with_doi, count(abstract) as with_abstract, count(refs_at) as refs_tried,
        count(*) filter (links > 0) as citing, coalesce(sum(raw), 0)::bigint as raw_out, coalesce(sum(links), 0)::bigint as resolved_out, count(links_in) as cited, coalesce(sum(links_in), 0)::bigint as n_in, coalesce(sum(same), 0)::bigint as to_itself, sum(cited_globally)::bigint as cited_globally,
        count(*) filter (raw is null and links_in is null) as isolates, count(*) filter (raw is not null and links_in is null) as pure_sources, count(*) filter (raw is null and links_in is not null) as pure_sinks, count(*) filter (raw is not null and links_in is not null) as hubs from r group by 1)
        select *, """ + ", ".join(f"case when {b} = 0 then 0 else round(100.0::double * {a} / {b}, 1) end as {n}" for n, a, b in (("doi_pct", "with_doi", "articles"), ("abstract_pct", "with_abstract", "articles"), ("tried_pct", "refs_tried", "articles"), ("yield_pct", "citing", "refs_tried"), ("resolved_pct", "resolved_out", "raw_out"), ("itself_pct", "to_itself", "resolved_out"))) + " from g"),
    "source_coverage": with_sql("records", "select journal, source, count(*) as n from records group by all"),
    "global_counts": with_sql("records", "select count(*) as articles, count(doi) as with_doi, count(cited_globally) as with_count, count(*) filter (cited_globally > 0) as cited, round(avg(cited_globally) filter (cited_globally > 0), 6) as mean, max(cited_globally) as most from records"),
    "coverage_markdown": with_sql("records", ", g as (select journal, count(*) as n, count(doi) as d from records group by 1) select 0 as line, '| journal | articles | with_doi |' as text union all select 1, '|---|---|---|' union all select row_number() over (order by n desc, journal) + 1, '| ' || journal || ' | ' || n || ' | ' || d || ' |' from g"),
    "sidebar": with_sql("records", ", k(cluster, place, journal) as (values " + ", ".join(f"('{k}', {p}, '{j}')" for p, (k, js) in enumerate(CLUSTERS.items()) for j in js) + ") select cluster, place, k.journal, count(id) as n from k left join records r on r.journal = k.journal group by all"),
    "approved_tags": with_sql("votes", "select article, array_to_string(list_sort(list(distinct tag)), ',') as tags from votes where vote > 0 and article is not null group by 1"),
}


def _states_sql():
    from citewright.plans.people import _TAGGED

    return with_sql("votes", _TAGGED + " select status, count(*) as n from j group by 1")


SQL["tag_status_counts"] = _states_sql()

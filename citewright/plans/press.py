"""Queries of the publisher's dashboard, with equivalent SQL."""

from __future__ import annotations

from citewright.operators import press as P
from citewright.plans.tables import with_sql

TERMS = ["blue", "re", "widget"]

QUERIES = {
    "press_most_cited": lambda c: P.most_cited(c.works, c.work_authors),
    "collection_chapters": lambda c: P.chapters(c.works, c.work_authors, 3),
    "collection_anatomy": lambda c: P.anatomy(c.works),
    "cross_format_authors": lambda c: P.cross_format_authors(c.works, c.work_authors),
    "copresence_links": lambda c: P.copresence(c.works, c.work_authors),
    "editor_network_links": lambda c: P.editor_network(c.works, c.work_authors),
    "press_coauthorship": lambda c: P.coauthorship(c.work_authors),
    "press_place_decades": lambda c: P.place_decades(c.works, c.placed),
    "press_place_journals": lambda c: P.place_journals(c.works, c.placed),
    "affiliation_coverage": lambda c: P.affiliation_coverage(c.works, c.placed),
    "topic_decades": lambda c: P.topic_decades(c.tags, c.articles),
    "press_team_decades": lambda c: P.team_decades(c.works, c.work_authors),
    "press_coauthorship_trend": lambda c: P.coauthorship_trend(c.works, c.work_authors),
    "journal_lifelines": lambda c: P.lifelines(c.works, 1996),
    "term_series": lambda c: P.term_series(c.works, TERMS),
    "journal_spotlight": lambda c: P.spotlight(c.works, "Brand#4"),
    "press_shares": lambda c: P.shares(c.works, "cited_by"),
}

_AUTHORS = ", au as (select distinct work, name from work_authors where role = 'author')"
_NAMES = "array_to_string(list_sort(list(name))[1:6], '; ') as authors"
_TOP_PLACES = ", t as (select place from placed where place is not null group by 1 order by count(distinct work) desc, place limit {})"

SQL = {
    "press_most_cited": with_sql("works work_authors", f"""{_AUTHORS}, b as (select * from works order by cited_by desc, work limit 40), n as (select work, {_NAMES} from au group by 1)
        select work, type, year, cited_by, authors from b left join n using (work)"""),
    "collection_chapters": with_sql("works work_authors", f"{_AUTHORS}, n as (select work, {_NAMES} from au group by 1) select work, title, year, cited_by, authors from works left join n using (work) where parent = 3"),
    "collection_anatomy": with_sql("works", ", p as (select count(*) as parts from works group by parent) select parts, count(*) as collections, (select median(parts)::double from p) as median_parts from p group by 1"),
    "cross_format_authors": with_sql("works work_authors", f"""{_AUTHORS} select name, count(distinct type) as formats, count(*) as works, sum(cited_by)::bigint as citations
        from au join works using (work) group by 1 having count(distinct type) >= 2 order by formats desc, works desc, name limit 40"""),
    "copresence_links": with_sql("works work_authors", f"""{_AUTHORS}, h as (select distinct parent, name from au join works using (work)), k as (select name from h group by 1 order by count(*) desc, name limit 180)
        select x.name as a, y.name as b, count(*) as weight from h x join h y on x.parent = y.parent and x.name < y.name where x.name in (from k) and y.name in (from k) group by all"""),
    "editor_network_links": with_sql("works work_authors", f"""{_AUTHORS}, h as (select distinct parent, name as author from au join works using (work)), l as (select distinct parent, name as editor from work_authors join works using (work) where role = 'editor'),
        p as (select editor, author, count(*) as weight from h join l using (parent) where editor <> author group by all), k as (select author from p group by 1 order by sum(weight) desc, author limit 220) select * from p where author in (from k) or author in (select editor from l)"""),
    "press_coauthorship": with_sql("work_authors", f"""{_AUTHORS}, k as (select name from au group by 1 having count(*) >= 2 order by count(*) desc, name limit 160), r as (select * from au where name in (from k))
        select x.name as a, y.name as b, count(*) as weight from r x join r y on x.work = y.work and x.name < y.name group by all"""),
    "press_place_decades": with_sql("works placed", _TOP_PLACES.format(8) + " select place, (year // 10 * 10)::int as decade, count(distinct work) as works from placed join works using (work) where year is not null and place in (from t) group by all"),
    "press_place_journals": with_sql("works placed", _TOP_PLACES.format(22) + " select place, journal, count(distinct work) as works from placed join works using (work) where place in (from t) group by all"),
    "affiliation_coverage": with_sql("works placed", """, r as (select type, (year // 10 * 10)::int as decade, place from placed join works using (work) where role = 'author' and year is not null)
        select type, decade, count(*) as n, count(place) as placed, round(100.0::double * count(place) / count(*), 1) as percent from r group by grouping sets ((type, decade), ())"""),
    "topic_decades": with_sql("articles tags", ", t as (select tag from tags group by 1 order by count(*) desc, tag limit 8) select tag, (year // 10 * 10)::int as decade, count(*) as n from tags join articles using (id) where tag in (from t) group by all"),
    "press_team_decades": with_sql("works work_authors", f"{_AUTHORS}, s as (select work, least(count(*), 4)::int as team from au group by 1) select (year // 10 * 10)::int as decade, team, count(*) as n from s join works using (work) where year is not null group by all"),
    "press_coauthorship_trend": with_sql("works work_authors", f"""{_AUTHORS}, s as (select work, count(*) as n from au group by 1)
        select year, count(*) as works, round(avg((n > 1)::int), 6) as multi_share, round(avg(n), 6) as mean_authors from s join works using (work) where year is not null group by 1"""),
    "journal_lifelines": with_sql("works", "select journal, count(*) as works, min(year) as first, max(year) as last, count(distinct year) as years, sum(cited_by)::bigint as citations, max(year) < 1996 as historical from works group by 1"),
    "term_series": with_sql("works", ", t as (select unnest(['blue', 're', 'widget']) as term) select year, term, count(*) filter (regexp_matches(title, '\\b' || term, 'i')) as n, round((count(*) filter (regexp_matches(title, '\\b' || term, 'i')))::double / count(*), 6) as share from works, t where year is not null group by year, term"),
    "journal_spotlight": with_sql("works", "select year, count(*) filter (journal = 'Brand#4') as works, round((count(*) filter (journal = 'Brand#4'))::double / count(*), 6) as share from works where year is not null group by 1 having count(*) filter (journal = 'Brand#4') > 0"),
    "press_shares": with_sql("works", """, r as (select cited_by as v, row_number() over (order by cited_by desc, work) as i, count(*) over () as n, sum(cited_by) over () as t from works)
        select round((sum(v) filter (i <= greatest(1, n // 100)))::double / max(t), 6) as top_1, round((sum(v) filter (i <= greatest(1, n // 10)))::double / max(t), 6) as top_10,
        round((sum(v) filter (i > n - n // 2))::double / max(t), 6) as bottom_half, max(n) as n from r"""),
}

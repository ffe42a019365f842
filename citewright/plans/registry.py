"""Registered queries of the scholarly operators, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.functions import cleaning as K
from citewright.functions import values as V
from citewright.operators import citations as C
from citewright.operators import communities as N
from citewright.operators import graphs as G
from citewright.operators import merging as M
from citewright.operators import records as R
from citewright.operators import statistics as T
from citewright.operators.components import connected_components
from citewright.plans import chapters, cleaning, pages, panes, paths, people, press, search, streams, upkeep
from citewright.plans.tables import GROUPS, Corpus, with_sql
from citewright.sources import exports as E
from citewright.sources import works as W
from citewright.sources.contents import Rule, contents_entries
from citewright.streaming import events as S

VOCABULARY = {"travel": ["on the", "road"], "science": ["tion"], "people": ["he", "she"], "place": ["where", "here"]}
NAME = "Supplier#000000003"

_queries: dict[str, Callable[[Corpus], DataFrame]] = {}
_sql: dict[str, str] = {}


def _add(name: str, run: Callable[[Corpus], DataFrame], tables: str | None = None, body: str = "", recursive: bool = False) -> None:
    _queries[name] = run
    if tables is not None:
        _sql[name] = with_sql(tables, body, recursive) if tables else body


def _edges(c: Corpus) -> DataFrame:
    return C.edge_table(c.articles, c.citations, GROUPS)


def _arcs(c: Corpus) -> DataFrame:
    return N.undirected(C.resolved(c.citations))


def _crossers(edges: DataFrame, top: int = 25) -> DataFrame:
    scores = G.undirected_betweenness(edges).select("id", F.round("score", 9).alias("score"))
    return scores.join(C.boundary_degrees(edges), "id").orderBy(F.desc("score"), F.desc("boundary"), "id").limit(top)


def _name(c: Corpus) -> str:
    return c.table("supplier").agg(F.max(F.struct("s_suppkey", "s_name"))["s_name"]).first()[0]


_ME = "(select max_by(s_name, s_suppkey) from supplier)"

# listings and facets
_add("article_page", lambda c: R.article_page(c.articles, year_from=1996, year_to=1998, journals=["BUILDING", "MACHINERY"], offset=10), "articles",
     "select id, pub_date, journal, source from articles where pub_date >= '1996-01-01' and pub_date <= '1998-12-31' and journal in ('BUILDING', 'MACHINERY') order by pub_date desc, id limit 50 offset 10")
_add("article_count", lambda c: C.by_year_text(c.articles, 1996, 1998).agg(F.count("*").alias("n")), "articles", "select count(*) as n from articles where pub_date >= '1996-01-01' and pub_date <= '1998-12-31'")
_add("facet_journal", lambda c: R.facet(c.articles), "articles", "select journal, count(*) as n, min(source) as source from articles group by 1")
_add("tag_counts", lambda c: R.tag_counts(c.tags), "tags", "select tag, count(*) as n from tags group by 1")
_add("year_range", lambda c: c.articles.agg(F.min("year").alias("first"), F.max("year").alias("last")), "articles", "select min(year) as first, max(year) as last from articles")
_add("timeline", lambda c: c.articles.where("year >= 1900").groupBy("year", "journal").agg(F.count("*").alias("n")), "articles", "select year, journal, count(*) as n from articles where year >= 1900 group by all")
_add("tag_cooccurrence", lambda c: R.tag_cooccurrence(c.tags), "tags", "select x.tag as a, y.tag as b, count(*) as weight from tags x join tags y on x.id = y.id and x.tag < y.tag group by all")
_add("related_articles", lambda c: R.related(c.tags, c.articles, 7), "articles tags",
     "select id, count(*) as shared, any_value(pub_date) as pub_date from tags join articles using (id) where id <> 7 and tag in (select tag from tags where id = 7) group by id order by shared desc, pub_date desc, id limit 5")
_add("search_prefix", lambda c: R.search(c.table("documents"), "th an").select("doc_id", "lang"), "",
     "select doc_id, lang from documents where len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: starts_with(x, 'th'))) > 0 and len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: starts_with(x, 'an'))) > 0")
_add("new_articles", lambda c: c.articles.where(F.col("pub_date") >= F.lit("2001-07-01")).select("id", "pub_date"), "articles", "select id, pub_date from articles where pub_date >= '2001-07-01'")
# people
_add("author_counts", lambda c: c.authors.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(500), "authors", "select name, count(*) as n from authors group by 1 order by n desc, name limit 500")
_add("author_network_links", lambda c: R.author_links(c.authors, 3, 150), "authors",
     """, best as (select name from authors group by 1 having count(*) >= 3 order by count(*) desc, name limit 150), k as (select id, name, pos from authors where name in (from best))
     select x.name as a, y.name as b, count(*) as weight from k x join k y on x.id = y.id and (x.name, x.pos) < (y.name, y.pos) group by all""")
_add("coauthors", lambda c: R.coauthors(c.authors, _name(c)), "authors",
     f""", p as (select distinct id, name from authors where id in (select id from authors where name = {_ME}) and name <> {_ME})
     select name, count(*) as shared, cast(list_sort(list(id))[1:5] as varchar) as first_ids from p group by 1""")
_add("author_topics", lambda c: c.tags.join(c.authors.where(F.col("name") == _name(c)).select("id").distinct(), "id", "left_semi").groupBy("tag").agg(F.count("*").alias("n")), "authors tags",
     f"select tag, count(*) as n from tags where id in (select id from authors where name = {_ME}) group by 1")
_add("authors_by_letter", lambda c: c.table("supplier").withColumn("last", F.element_at(F.split("s_name", "#"), -1)).where(F.col("last").endswith("7")).select("s_name", "last").orderBy("last", "s_name"), "",
     "select s_name, split_part(s_name, '#', -1) as last from supplier where split_part(s_name, '#', -1) like '%7'")
_add("citing_venues", lambda c: R.citing_venues(c.authors, _edges(c), _name(c)), "edges authors", f"select sj as journal, count(*) as n from edges where target in (select id from authors where name = {_ME}) group by 1")
_add("cocitation_partners", lambda c: R.cocitation_partners(c.authors, _edges(c), _name(c)), "edges authors",
     f""", w as (select distinct source, name from edges join authors on target = id)
     select name, count(*) as n from w where name <> {_ME} and source in (select source from w where name = {_ME}) group by 1 having count(*) >= 2 order by n desc, name limit 10""")
_add("partnerships", lambda c: R.partnerships(c.authors, c.articles, 2), "articles authors",
     """, o as (select distinct id, name from authors)
     select x.name as a, y.name as b, count(*) as n, max(year) - min(year) as span, count(distinct journal) as journals, case when count(*) = 1 then 'one_shot' when max(year) - min(year) < 3 then 'short_term' else 'persistent' end as kind
     from o x join o y on x.id = y.id and x.name < y.name join articles r on r.id = x.id group by 1, 2 having count(*) >= 2""")
_add("author_cocitation", lambda c: R.author_cocitation(c.authors, C.resolved(c.citations), 2), "citations authors",
     """, l as (select distinct source, target from citations where target in (select target from citations group by 1 having count(*) >= 2)), w as (select distinct source, target, name from l join authors on id = target),
     n as (select source, name, count(*) as n from w group by all), j as (select x.source, x.name as a, y.name as b, count(*) as k from w x join w y on x.source = y.source and x.target = y.target and x.name < y.name group by all),
     p as (select x.name as a, y.name as b, count(*) as weight from n x join n y on x.source = y.source and x.name < y.name left join j on j.source = x.source and a = x.name and b = y.name where k is null or x.n > k or y.n > k group by all having count(*) >= 2),
     t as (select v from (select a as v, weight from p union all select b, weight from p) group by 1 order by sum(weight) desc, v limit 200)
     select * from p where a in (from t) and b in (from t)""")
# citations
_add("degrees", lambda c: C.degrees(c.articles, c.citations), "degrees", "from degrees")
_add("most_cited", lambda c: C.most_cited(c.articles, c.citations), "articles citations", "select target as id, pub_date, journal, count(*) as n_in from citations join articles on id = target group by all order by n_in desc, pub_date desc, id limit 50")
_add("citation_network_links", lambda c: C.network_links(c.articles, c.citations), "degrees",
     ", k as (select id from degrees where n_in >= 5 order by n_in desc, id limit 500) select distinct source, target from citations where source in (from k) and target in (from k)")
_add("citation_trends", lambda c: C.trends(c.articles, c.citations), "degrees", "select year, round(avg(n_out), 2) as avg_refs, sum(n_out)::bigint as total_refs, count(*) as n from degrees join articles using (id) where n_out > 0 and year >= 1990 group by 1 having count(*) >= 2")
_add("cocitation_links", lambda c: C.cocitation(c.citations, 2), "citations", "select x.target as a, y.target as b, count(*) as weight from citations x join citations y on x.source = y.source and x.target < y.target group by all having count(*) >= 2")
_add("coupling_links", lambda c: C.coupling(c.citations, 2), "citations", "select x.source as a, y.source as b, count(*) as weight from citations x join citations y on x.target = y.target and x.source < y.source group by all having count(*) >= 2")
_add("ego_links", lambda c: C.ego_links(c.citations, 5), "citations",
     ", k as (select 5 as id union select target from citations where source = 5 and target is not null union select source from citations where target = 5) select distinct source, target from citations where source in (from k) and target in (from k)")
_add("all_references", lambda c: C.references_of(c.citations, c.articles, 5), "articles citations", "select ord, doi, target, pub_date, journal from citations left join articles on id = target where citations.source = 5")
_add("journal_flow", lambda c: C.journal_flow(_edges(c)), "edges", "select sj, tj, count(*) as n from edges group by all")
for _side, _key in (("sj", "half_life_citing"), ("tj", "half_life_cited")):
    _add(_key, lambda c, s=_side: C.half_life(_edges(c), s), "edges",
         f""", r as (select {_side} as journal, sy - ty as age, row_number() over (partition by {_side} order by sy - ty) as i, count(*) over (partition by {_side}) as n from edges where sy >= ty)
         select journal, min(age) filter (i >= n * 0.25) as q25, min(age) filter (i >= n * 0.5) as half_life, min(age) filter (i >= n * 0.75) as q75, max(n) as n from r group by 1""")
_BEAUTIES = """, y as (select target as id, ty, sy, count(*) as c from edges where sy >= ty group by all), m as (select target as id, count(*) as n_in from edges group by 1),
     s as (select id, ty, sum(c)::bigint as total, max(sy) as last from y group by all),
     g as (select u.id, u.ty, u.total, u.yr as sy, coalesce(y.c, 0) as c from (select id, ty, total, unnest(range(ty, last + 1))::int as yr from s) u left join y on y.id = u.id and y.sy = u.yr),
     h as (select *, lead(c, 1, 0) over (partition by id order by sy) as nx from g), p as (select id, arg_max(sy, (c, -sy)) as peak, max(c) as top from g group by 1),
     q as (select h.*, peak, top, avg(c) filter (sy < peak) over (partition by h.id) as mean from h join p using (id) where sy <= peak and peak > ty),
     z as (select id, ty, total, peak, sum(top::double * (sy - ty) / (peak - ty) - c) as b, coalesce(min(sy) filter (c >= greatest(1, mean + 0.2 * (top - mean)) and (sy = peak or nx >= greatest(1, mean + 0.2 * (top - mean)))), peak) as awakening from q group by id, ty, total, peak),
     beauties as (select id, n_in, total, peak, round(b * case when cited_globally > 3 * n_in then n_in::double / (n_in + cited_globally) else 1 end, 6) as beauty, awakening::int as awakening, (awakening - ty)::int as sleep_years
     from z join m using (id) join articles using (id))"""
_add("sleeping_beauties", lambda c: C.sleeping_beauties(c.articles, c.citations), "edges", _BEAUTIES + " select * from beauties where n_in >= 5 order by beauty desc, id limit 50")
_add("prince_network", lambda c: C.princes(C.sleeping_beauties(c.articles, c.citations, 10, 15), _edges(c), c.authors), "edges authors", _BEAUTIES
     + """, t as (select * from beauties where n_in >= 10 order by beauty desc, id limit 15), w as (select id as source, arg_min(name, pos) as first from authors group by 1),
     k as (select t.id, t.awakening, count(source) as n, count(distinct sj) as j, count(distinct first) as f from t left join (edges left join w using (source)) e on e.target = t.id and e.sy >= t.awakening - 1 group by all)
     select id, awakening, n as princes, j as journals, case when n = 0 then 'no_data' when n = 1 then 'single_catalyst' when j = 1 then 'journal_specific' when f = 1 then 'individual_rediscovery' when j >= 4 and n >= 8 then 'broad_trend' else 'subfield_revival' end as kind from k""")
_add("disciplinary_calendar", lambda c: C.calendar(C.sleeping_beauties(c.articles, c.citations, 5, 200), c.table("orders").where("o_orderstatus = 'P'").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("type")).distinct()), "edges", _BEAUTIES
     + """, t as (select awakening, count(*) as n from (select * from beauties where n_in >= 5 order by beauty desc, id limit 200) group by 1), e as (select distinct year(o_orderdate) as year, o_orderpriority as type from orders where o_orderstatus = 'P')
     select type, count(*) // 5 as events, round(sum(coalesce(n, 0)) / count(*), 2)::double as mean_awakenings from (select type, unnest(range(year, year + 5)) as y from e) left join t on awakening = y group by 1""")
# field groups
_add("braided_flow", lambda c: C.group_flow(_edges(c)), "edges", "select (sy // 10 * 10)::int as decade, sg, tg, count(*) as n from edges group by grouping sets ((1, sg, tg), (sg, tg))")
_add("delay_stats", lambda c: C.delays(_edges(c)), "edges",
     """, r as (select sg, tg, sy - ty as d, row_number() over (partition by sg, tg order by sy - ty) - 1 as i, count(*) over (partition by sg, tg) as n from edges where sy >= ty)
     select sg, tg, count(*) as n, round(avg(d), 6) as mean, max(d) filter (i = floor(n * 0.25)) as p25, max(d) filter (i = floor(n * 0.5)) as median, max(d) filter (i = floor(n * 0.75)) as p75, round(stddev_pop(d), 6) as sd, max(d) as longest from r group by sg, tg""")
_add("reciprocity", lambda c: C.reciprocity(_edges(c)), "edges",
     ", d as (select distinct source, target, sg, tg from edges where sg <> tg) select x.sg, x.tg, count(*) as links, count(y.source) as mutual from d x left join d y on y.source = x.target and y.target = x.source group by all")
_add("lorenz", lambda c: C.lorenz(C.degrees(c.articles, c.citations), "n_in"), "degrees",
     """, r as (select sum(n_in) over (order by n_in, id) as t, row_number() over (order by n_in, id) as i from degrees), z as (select count(*) as n, sum(n_in) as t from degrees)
     select s::int as step, round(r.t::double / z.t, 6) as share from (select unnest(range(1, 101)) as s), z, r where r.i = z.n * s // 100""")
_add("gini", lambda c: C.gini(C.degrees(c.articles, c.citations), "n_in"), "degrees",
     ", r as (select n_in, row_number() over (order by n_in, id) as i from degrees) select round(2.0::double * sum(i * n_in) / (count(*)::double * sum(n_in)) - (count(*) + 1)::double / count(*), 6) as gini, count(*) as n, sum(n_in)::bigint as total from r")
_add("reach_series", lambda c: C.reach(_edges(c), 2001), "edges",
     """, b as (select target, min(ty) as f from edges group by 1 order by count(*) desc, target limit 100), y as (select target, unnest(range(f, 2002))::int as sy from b),
     n as (select target, sy, count(*) as n from edges group by all)
     select target, sy, coalesce(n, 0) as n, (sum(coalesce(n, 0)) over (partition by target order by sy))::bigint as running from y left join n using (target, sy)""")
_add("unread_canon", lambda c: C.unread_canon(c.articles, c.citations), "degrees",
     "select id, cited_globally, n_in, round(cited_globally::double / (n_in + 1), 6) as ratio from degrees join articles using (id) where cited_globally >= 100 and n_in <= 2 order by ratio desc, id limit 200")
_add("coupling_asymmetry", lambda c: C.coupling_asymmetry(c.citations), "citations",
     """, r as (select distinct source, coalesce(target::varchar, doi) as ref from citations), s as (select source, count(*) as refs from r group by 1 having count(*) >= 3),
     h as (select ref from r group by 1 having count(*) between 2 and 200), u as (select * from r where ref in (from h) and source in (select source from s)),
     p as (select x.source as a, y.source as b, count(*) as weight from u x join u y on x.ref = y.ref and x.source < y.source group by all having count(*) >= 2)
     select a, b, weight, m.refs as refs_a, n.refs as refs_b, round(abs(weight::double / m.refs - weight::double / n.refs), 6) as gap from p join s m on m.source = a join s n on n.source = b order by gap desc, a, b limit 200""")
_add("coverage_by_journal", lambda c: C.coverage_by_journal(c.articles, c.citations), "articles citations",
     """, e as (select c.*, s.journal as sj, t.journal as tj from citations c join articles s on s.id = c.source left join articles t on t.id = c.target),
     o as (select sj as journal, count(*) as raw_out, count(target) as resolved_out, count(distinct source) filter (target is not null) as citing, sum(coalesce(sj = tj, false)::int)::bigint as to_itself from e group by 1),
     i as (select tj as journal, count(*) as n_in, count(distinct target) as cited from e where tj is not null group by 1)
     select journal, count(*) as articles, min(year) as first_year, max(year) as last_year, any_value(raw_out) as raw_out, any_value(resolved_out) as resolved_out, any_value(citing) as citing, any_value(to_itself) as to_itself, any_value(n_in) as n_in, any_value(cited) as cited
     from articles join o using (journal) join i using (journal) group by journal""")
_add("era_breakdown", lambda c: c.articles.groupBy("journal", F.when(F.col("year") < 1997, "early").when(F.col("year") < 2000, "middle").otherwise("late").alias("era")).agg(F.count("*").alias("n")), "articles",
     "select journal, case when year < 1997 then 'early' when year < 2000 then 'middle' else 'late' end as era, count(*) as n from articles group by all")
_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"
_add("spearman", lambda c: T.spearman(C.degrees(c.articles, c.citations).join(c.articles, "id"), "n_in", "cited_globally"), "degrees",
     f", r as (select {_RANK.format('n_in')} as x, {_RANK.format('cited_globally')} as y from degrees join articles using (id)) select count(*) as n, round(corr(x, y), 6) as rho from r")
_add("mann_whitney", lambda c: T.mann_whitney(_edges(c).where("sy >= ty").withColumn("age", F.col("sy") - F.col("ty")), "age", "sg", "TPC", "RHET_COMP"), "edges",
     f""", e as (select sy - ty as age, sg from edges where sy >= ty and sg in ('TPC', 'RHET_COMP')), r as (select *, {_RANK.format('age')} as r from e),
     s as (select count(*)::double as n, (count(*) filter (sg = 'TPC'))::double as a, (sum(r) filter (sg = 'TPC'))::double as w from r), t as (select sum(k ** 3 - k)::double as t from (select count(*)::double as k from e group by age)),
     u as (select a, n - a as b, w - a * (a + 1) / 2 as u, sqrt(a * (n - a) / 12 * (n + 1 - t / (n * (n - 1)))) as sd from s, t), z as (select *, (greatest(u, a * b - u) - a * b / 2 - 0.5) / sd as z from u), k as (select *, 1 / (1 + {T.ERF_P} * z / sqrt(2.0)) as k from z)
     select a::bigint as n_first, b::bigint as n_second, round(u, 1) as u, round(z, 6) as z, case when z > 0 then round(({' + '.join(f'({x}) * k ** {i + 1}' for i, x in enumerate(T.ERF_A))}) * exp(-z * z / 2), 6) else 1.0 end::double as p from k""")
_add("agreement", lambda c: T.agreement(c.articles, "journal", "source"), "articles",
     """, c as (select journal as a, source as b, count(*)::double as n from articles group by all), x as (select sum(n) as n from c group by a), y as (select sum(n) as n from c group by b),
     s as (select (select sum(n) from c) as n, (select sum(n * ln(n)) from c) as l, (select sum(n * (n - 1) / 2) from c) as c, (select sum(n * ln(n)) from x) as lx, (select sum(n * (n - 1) / 2) from x) as cx, (select sum(n * ln(n)) from y) as ly, (select sum(n * (n - 1) / 2) from y) as cy)
     select n::bigint as n, round(2 * (ln(n) - lx / n - ly / n + l / n) / (2 * ln(n) - lx / n - ly / n), 6) as nmi, round((c - cx * cy / (n * (n - 1) / 2)) / ((cx + cy) / 2 - cx * cy / (n * (n - 1) / 2)), 6) as ari from s""")
# publisher
_add("press_overview", lambda c: R.overview(c.works, c.work_authors), "works work_authors",
     "select type, count(*) as works, sum(cited_by)::bigint as citations, min(year) as first_year, max(year) as last_year, (select count(distinct name) from work_authors) as people from works group by 1")
_add("press_format_by_year", lambda c: c.works.where("year is not null").groupBy("year", "type").agg(F.count("*").alias("n")), "works", "select year, type, count(*) as n from works where year is not null group by all")
_add("house_authors", lambda c: R.house_authors(c.works, c.work_authors), "works work_authors",
     ", w as (select distinct work, name from work_authors where role = 'author') select name, count(*) as works, sum(cited_by)::bigint as citations, count(distinct type) as formats from w join works using (work) group by 1 order by works desc, name limit 30")
_add("editor_author_overlap", lambda c: R.editor_author_overlap(c.work_authors), "work_authors",
     ", n as (select name, bool_or(role = 'editor') as e, bool_or(role = 'author') as a from work_authors group by 1) select case when not e then 'author only' when not a then 'editor only' else 'both' end as kind, count(*) as n from n group by 1")
_add("collections", lambda c: R.collections(c.works, c.work_authors), "works work_authors",
     """, p as (select parent, count(distinct name) filter (role = 'author') as authors, count(distinct name) filter (role = 'editor') as editors from work_authors join works using (work) group by 1)
     select parent, count(*) as parts, sum(cited_by)::bigint as citations, coalesce(any_value(authors), 0) as authors, coalesce(any_value(editors), 0) as editors from works left join p using (parent) group by parent""")
_add("press_institutions", lambda c: R.institutions(c.work_authors), "work_authors", "select place, count(distinct work) as works, count(distinct name) as people from work_authors group by 1")
_add("title_terms", lambda c: R.title_terms(c.works, 1997), "works",
     ", t as (select work, year, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z]{3,}'))) as term from works) select term, count(*) as n, sum(coalesce(year >= 1997, false)::int)::bigint as late from t group by 1 order by n desc, term limit 60")
_add("crossover", lambda c: R.crossover(c.work_authors, c.works, "PROMO", "SMALL"), "works work_authors",
     """, k as (select name, bool_or(type = 'PROMO') as x, bool_or(type = 'SMALL') as y from work_authors join works using (work) group by 1)
     select case when x and y then 'both' when x then 'first only' when y then 'second only' else 'neither' end as kind, count(*) as n from k group by 1""")
_add("citations_by_age", lambda c: R.citations_by_age(c.works), "works",
     """, r as (select *, row_number() over (partition by year order by cited_by, work) - 1 as i, count(*) over (partition by year) as n from works where year is not null)
     select year, max(n) as n, max(cited_by) filter (i = n // 2) as median, round(avg(cited_by), 6) as mean from r group by 1""")
_add("press_gini", lambda c: C.gini(c.works, "cited_by"), "works",
     ", r as (select cited_by, row_number() over (order by cited_by, work) as i from works) select round(2.0::double * sum(i * cited_by) / (count(*)::double * sum(cited_by)) - (count(*) + 1)::double / count(*), 6) as gini, count(*) as n, sum(cited_by)::bigint as total from r")
_add("press_spans", lambda c: R.spans(c.works, c.work_authors), "works work_authors",
     ", w as (select distinct work, name from work_authors) select name, count(*) as works, min(year) as first, max(year) as last, max(year) - min(year) as span from w join works using (work) where year is not null group by 1 having count(*) >= 2")
_add("press_brokers", lambda c: R.brokers(c.works, c.work_authors), "works work_authors",
     """, e as (select distinct work, name as editor from work_authors where role = 'editor'), h as (select editor, count(distinct parent) as collections from e join works using (work) group by 1 having count(distinct parent) >= 2),
     m as (select editor, count(distinct name) as people from e join work_authors using (work) where name <> editor group by 1) select editor, collections, coalesce(people, 0) as people from h left join m using (editor)""")
_LISTED = """, listed as (select work, 'https://doi.example/' || work as url, '10.1000/W' || work as doi, title, journal, case when year is not null then year || '-01-01' end as pub_date, type, a.authors
     from works left join (select work, array_to_string(list_sort(list(distinct name)), '; ') as authors from work_authors group by 1) a using (work))"""
_add("bibtex", lambda c: c.listed.select("work", E.bibtex().alias("entry")), "works work_authors", _LISTED
     + """ select work, concat_ws(chr(10), '@article{' || case when authors is null then 'unknown' else regexp_replace(lower(split_part(split_part(authors, ';', 1), ' ', -1)), '[^a-z0-9]', '', 'g') end || coalesce(pub_date[1:4], '') || regexp_replace(split_part(title, ' ', 1), '[^a-z0-9]', '', 'g') || ',',
     '  author  = {' || replace(authors, '; ', ' and ') || '},', '  title   = {' || title || '},', '  journal = {' || journal || '},', '  year    = {' || pub_date[1:4] || '},', '  doi     = {' || doi || '},', '  url     = {' || url || '},', '}') as entry from listed""")
_add("ris", lambda c: c.listed.select("work", E.ris().alias("entry")), "works work_authors", _LISTED
     + " select work, concat_ws(chr(10), 'TY  - JOUR', 'AU  - ' || replace(authors, '; ', chr(10) || 'AU  - '), 'TI  - ' || title, 'JO  - ' || journal, 'PY  - ' || pub_date[1:4], 'DO  - ' || doi, 'UR  - ' || url, 'ER  - ') as entry from listed")
_add("deposited_works", lambda c: W.deposited_works(c.spark, c.deposit(), wrapped=False).drop("reference", "isbn"), "works work_authors", _LISTED
     + " select lower(doi) as doi, title, authors, null::varchar as abstract, pub_date, journal, url, type from listed")
_add("match_cascade", lambda c: M.match_cascade(c.titled, "src6"), "",
     r"""with d as (select doc_id as id, split_part(text, chr(10), 1) as title, (n_chars // 1000)::varchar as y, source, (lang <> '')::int as filled from documents where text is not null),
     k as (select id as canonical, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as t, y from d where source = 'src6'),
     o as (select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as t, regexp_replace(title, '^(book )?review( essay)?:?\s+', '', 'i') as bare from d where source is distinct from 'src6'),
     v as (select id, y, t, 0 as turn from o where t <> '' union all select id, y, trim(regexp_replace(lower(bare), '[^a-z0-9]+', ' ', 'g')), 1 from o where bare <> title and regexp_matches(lower(bare), '[a-z0-9]')),
     bk as (select t, y, min(canonical) as canonical from k group by all having count(*) = 1), bt as (select t, count(*) as n, min(canonical) as canonical, min(y) as cy from k group by 1),
     al as (select v.t, min(bt.t) as c from (select distinct t from v) v join bt on starts_with(bt.t, v.t || ' ') or starts_with(v.t, bt.t || ' ') group by 1 having count(*) = 1),
     f as (select id, canonical, turn * 4 + 1 as stage from v join bk using (t, y) union all select id, canonical, turn * 4 + 2 from v join bt using (t) where n = 1
     union all select id, canonical, turn * 4 + 3 from v join al using (t) join bt on bt.t = c where n = 1 and (least(length(v.t), length(c)) >= 25 or cy = y) union all select id, canonical, turn * 4 + 4 from v join al using (t) join bk on bk.t = c and bk.y = v.y),
     m as (select id, min((stage, canonical)) as m from f group by 1), r as (select * from o where id not in (select id from m)), g as (select t, y, arg_min(id, (-filled, id)) as canonical from r group by all having count(*) > 1)
     select m[2] as canonical, id as duplicate, m[1] as stage from m union all select canonical, id, 9 from r join g using (t, y) where id <> canonical""")
_add("decoded_abstract", lambda c: c.inverted.select("item_id", W.decoded_abstract(F.col("index")).alias("text")), "", r"select item_id, array_to_string(regexp_extract_all(text, '[^\s]+'), ' ') as text from benchmark")
# texts
_add("auto_tag", lambda c: c.table("documents").select("doc_id", K.vocabulary_tags(F.col("text"), VOCABULARY).alias("tags")), "",
     r"""select doc_id, case when len(t) > 0 then '|' || array_to_string(t, '|') || '|' end as tags from (select doc_id, list_filter([
     case when regexp_matches(lower(text), 'on the|(^|[^\p{L}\p{N}_])road($|[^\p{L}\p{N}_])') then 'travel' end, case when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])tion($|[^\p{L}\p{N}_])') then 'science' end,
     case when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])he($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])she($|[^\p{L}\p{N}_])') then 'people' end, case when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])where($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])here($|[^\p{L}\p{N}_])') then 'place' end], lambda x: x is not null) as t from documents)""")
_add("title_slug", lambda c: c.table("documents").select("doc_id", V.slug(F.col("text")).alias("slug")), "",
     "select doc_id, rtrim(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') as slug from documents")
_add("title_norm", lambda c: c.table("benchmark").select("item_id", V.norm_title(F.col("text")).alias("title")), "", "select item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as title from benchmark")
_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&"))  # those that the pages hold
_PLAIN = "regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
for _entity, _char in _ENTITIES:
    _PLAIN = f"regexp_replace({_PLAIN}, '&{_entity};?', '{_char}', 'g')"
_add("page_text", lambda c: c.table("pages").select("page_id", K.strip_tags(F.col("html")).alias("plain")), "", rf"select page_id, trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g')) as plain from pages")
_add("page_entries", lambda c: contents_entries(c.table("pages").select("page_id", "html"), Rule(skip=())), "",
     r"""with l as (select page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>') as x from pages), e as (select page_id, unnest(range(1, len(x) + 1)) as k, x from l),
     t as (select page_id, k, regexp_extract(x[k], '<a href="([^"]*)">', 1) as link, trim(regexp_replace(regexp_extract(x[k], '">([^<]*)</a>', 1), '\s+', ' ', 'g')) as title from e)
     select page_id, k::int as place, null::varchar as heading, replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title, replace(link, '&amp;', '&') as link, null::varchar as authors from t""")
_add("event_props", lambda c: c.table("events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n")), "", "select try_cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
_add("name_suppression", lambda c: R.suppress(c.authors, c.table("supplier").where("s_acctbal < 0").select(F.col("s_name").alias("name"), F.concat(F.lit("person-"), F.substring(F.sha2("s_name", 256), 1, 8)).alias("token"))).groupBy("name").agg(F.count("*").alias("n")), "authors",
     "select case when s_acctbal < 0 then 'person-' || substr(sha256(s_name), 1, 8) else name end as name, count(*) as n from authors join supplier on s_name = name group by 1")
_add("upsert_ignore", lambda c: R.upsert_ignore(c.table("customer").select("c_custkey", "c_name"), c.table("orders").select(F.col("o_orderkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_name")), "c_custkey", "c_name"), "",
     "select c_custkey, c_name from customer union all select o_orderkey, min(o_orderpriority) from orders where o_orderkey not in (select c_custkey from customer) group by 1")
# graphs
_add("pagerank", lambda c: G.pagerank(C.resolved(c.citations), 5).select("id", F.round("rank", 10).alias("rank")), "citations",
     ", e as (select distinct source, target from citations where target is not null), d as (select source as id, count(*) as d from e group by 1), n as (select id, d from (select source as id from e union select target from e) left join d using (id)), z as (select count(*)::double as z from n), r0 as (select id, d, 1 / z as r from n, z)"
     + "".join(f", l{k} as (select coalesce(sum(r), 0) as l from r{k - 1} where d is null), g{k} as (select target as id, sum(r / d) as g from e join r{k - 1} on id = source group by 1), r{k} as (select n.id, n.d, 0.15::double / z + 0.85::double * (coalesce(g, 0) + l / z) as r from n left join g{k} using (id), z, l{k})" for k in range(1, 6))
     + " select id, round(r, 10) as rank from r5")
_add("pagerank_converged", lambda c: G.pagerank(C.resolved(c.citations)).select("id", F.round("rank", 10).alias("rank")))
_add("components", lambda c: connected_components(C.coupling(c.citations, 2).select("a", "b")), "citations",
     """, p as (select x.source as a, y.source as b from citations x join citations y on x.target = y.target and x.source < y.source group by all having count(*) >= 2), e as (select a, b from p union all select b, a from p),
     r(node, seen) as (select a, a from e union select r.node, e.b from r join e on e.a = r.seen) select node, min(seen) as component from r group by 1""", recursive=True)
_add("transitivity", lambda c: G.transitivity(C.resolved(c.citations)), "citations",
     """, p as (select distinct least(source, target) as a, greatest(source, target) as b from citations where source <> target), d as (select v, count(*) as d from (select a as v from p union all select b from p) group by 1),
     t as (select count(*) as t from p x join p y on y.a = x.b join p z on z.a = x.a and z.b = y.b), s as (select (sum(d * (d - 1)) // 2)::bigint as s from d)
     select t as triangles, s as triples, round(3.0::double * t / s, 6) as transitivity from t, s""")
_add("window_metrics", lambda c: G.window_metrics(_edges(c)), "edges",
     """, d as (select distinct source, target, sy, ty from edges), n as (select source as id, sy as w from d union select target, ty from d), e as (select distinct sy as w, least(source, target) as a, greatest(source, target) as b from d where sy = ty and source <> target),
     g as (select w, v, count(*) as d from (select w, a as v from e union all select w, b from e) group by all), t as (select w, sum(d * (d - 1)) // 2 as t from g group by 1), q as (select p.w, count(*) as q from e p join e r on r.a = p.b join e s on s.a = p.a and s.b = r.b group by 1),
     u as (select a, b from e union all select b, a from e), r(node, seen) as (select a, a from u union select r.node, u.b from r join u on u.a = r.seen), c as (select node, min(seen) as c from r group by 1),
     k as (select w, count(*) as joined, sum(s) as within, max(s) as largest from (select w, c, count(*) as s from c join n on n.id = node group by all) group by 1), l as (select greatest(sy, ty) as w, count(*) as l from d group by 1),
     b as (select w, count(*) as n from n group by 1), m as (select w, count(*) as m from e group by 1)
     select w as window, n as nodes, coalesce(m, 0) as links, round(case when n > 1 then 2.0::double * coalesce(m, 0) / (n * (n - 1)) else 0 end, 9) as density, round(2.0::double * coalesce(m, 0) / n, 6) as mean_degree, round(case when t > 0 then 3.0::double * coalesce(q, 0) / t else 0 end, 6) as transitivity,
     (n - coalesce(within, 0) + coalesce(joined, 0))::bigint as components, greatest(coalesce(largest, 0), 1) as largest, (sum(n) over (order by w))::bigint as all_nodes, (sum(coalesce(l, 0)) over (order by w))::bigint as all_links
     from b left join m using (w) left join t using (w) left join q using (w) left join k using (w) left join l using (w)""", recursive=True)
_add("window_paths", lambda c: G.window_paths(_edges(c)), "edges",
     """, e as (select distinct sy as w, least(source, target) as a, greatest(source, target) as b from edges where sy = ty and source <> target), u as materialized (select w, a, b from e union select w, b, a from e),
     c(node, seen) as (select a, a from u union select c.node, u.b from c join u on u.a = c.seen), k as (select node, min(seen) as c from c group by 1), s as (select w, c, count(*) as size from (select distinct w, a from u) join k on node = a group by all),
     m as (select w, arg_min(c, (-size, c)) as c, max(size) as size from s group by 1 having max(size) >= 3), n as materialized (select w, a as id, size from (select distinct w, a from u) join k on node = a join m using (w, c)),
     r(p, n, d) using key (p, n) as (select id, id, 0 from n union select l.p, u.b, min(l.d) + 1 from r l join u on u.a = l.n left join recurring.r o on o.p = l.p and o.n = u.b where o.p is null group by all)
     select w as window, any_value(size) as largest, count(*) as pairs, round(sum(d)::double / count(*), 3) as mean_path from r join n on n.id = r.p where d > 0 group by w""", recursive=True)
_add("window_modularity", lambda c: G.window_modularity(_edges(c)))
_add("journal_topics", lambda c: N.topics(c.records.where("title is not null").select("id", F.col("journal").alias("c")), c.records.select("id", F.concat_ws(" ", "title", "abstract").alias("title"))), "records",
     """, l as (select id, journal as c, lower(concat_ws(' ', title, abstract)) as t from records where title is not null), k as (select c, word, count(*) as n from (select c, unnest(regexp_extract_all(t, '[a-z]{3,}')) as word from l) where word <> 'not' group by all),
     e as (select word, sum(n) as every from k group by 1), s as (select c, count(*) as size from l group by 1 having count(*) > 1), z as (select *, round(n::double / size * sqrt((select count(*) from l)::double / every::double), 6) as score from k join e using (word) join s using (c) where n >= 2)
     select c, place, word, score from (select *, row_number() over (partition by c order by score desc, word)::int as place from z) where place <= 5""")
_add("betweenness", lambda c: G.betweenness(C.network_links(c.articles, c.citations, 1, 600)).select("id", F.round("score", 9).alias("score")))
_add("betweenness_all", lambda c: G.undirected_betweenness(C.resolved(c.citations)).select("id", F.round("score", 9).alias("score")))
_add("border_crossers", lambda c: _crossers(_edges(c)))
_add("communities", lambda c: N.communities(_arcs(c)))
_add("walls_bridges", lambda c: N.walls_bridges(_arcs(c), N.communities(_arcs(c))))
_add("two_maps", lambda c: T.agreement(N.communities(_arcs(c)).join(N.communities(N.weighted(C.coupling(c.citations, 2))).withColumnRenamed("c", "k"), "id"), "c", "k"))
_add("communities_time", lambda c: N.over_decades(_edges(c), least=0.01, width=2))
# streams; append mode holds back what a later event could still change, update mode gives it as it is
_add("stream_tumbling", lambda c: S.drain(S.windowed(S.read_events(c.spark, c.sf_dir), "1 day"), "update", ["start", "event_type"]), "",
     "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
_add("stream_sliding", lambda c: S.drain(S.windowed(S.read_events(c.spark, c.sf_dir), "2 days", "1 day"), "update", ["start", "event_type"]), "",
     "select start, event_type, count(*) as n, round(sum(value), 4) as total from (select time_bucket(interval 1 day, ts) - interval (k) day as start, event_type, value from events, (select unnest([0, 1]) as k)) group by 1, 2")
_add("stream_latest", lambda c: S.drain(S.latest(S.read_events(c.spark, c.sf_dir)), "update", ["user_id", "event_type"]), "", "select user_id, event_type, arg_max(value, (ts, event_id)) as value, count(*) as n from events group by 1, 2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=run: run(Corpus(spark, sf_dir))) for name, run in (_queries | people.QUERIES | press.QUERIES | pages.QUERIES | chapters.QUERIES | cleaning.QUERIES | upkeep.QUERIES | search.QUERIES | paths.QUERIES | panes.QUERIES | streams.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return _sql | people.SQL | press.SQL | pages.SQL | chapters.SQL | cleaning.SQL | upkeep.SQL | search.SQL | paths.SQL | panes.SQL | streams.SQL

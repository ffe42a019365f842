"""Queries of the chapter tools' panes, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewright.operators import chapters as H
from citewright.operators import citations as C
from citewright.operators import communities as N
from citewright.operators import graphs as G
from citewright.operators import panes as P
from citewright.plans.chapters import lists
from citewright.plans.tables import GROUPS, with_sql


def _edges(c):
    return C.edge_table(c.articles, c.citations, GROUPS)


def _sizes(c):
    return c.authors.groupBy("id").agg(F.count("*").alias("size")).join(c.articles.select("id", "year"), "id").select("id", "year", "size")


def _degrees(c):
    return C.degrees(c.articles, c.citations)


def _mutual(c):
    return P.reciprocal_articles(_edges(c), "TPC", "RHET_COMP")


def _near(c):
    """The neighbourhood of the 25 articles with the most neighbours in other field groups."""
    seeds = C.boundary_degrees(_edges(c)).orderBy(F.desc("boundary"), "id").limit(25)
    return G.neighbourhood(_edges(c), seeds)


def _everyone(c):
    """All six tools of the master list; those that search networks, on the links among the 600 most cited articles."""
    edges = _edges(c)
    inner = C.induced(edges, C.top_nodes(c.articles, c.citations, 1, 600))
    arcs = N.undirected(inner)
    labels = N.communities(arcs)
    walls = N.walls_bridges(arcs, labels)
    tops = N.community_tops(labels.join(walls.select("c"), "c", "left_semi"), c.records, _degrees(c)).where("list = 'article'").select(F.col("what").cast("long").alias("id"))
    crossers = G.undirected_betweenness(inner).select("id", F.round("score", 9).alias("score")).join(C.boundary_degrees(inner), "id").orderBy(F.desc("score"), F.desc("boundary"), "id").limit(25)
    return H.master_list(lists(c) | {"Border Crossers": crossers, "Walls and Bridges": tops})


def _tops(c):
    return N.community_tops(c.records.where("journal is not null").select("id", F.col("source").alias("c")), c.records, _degrees(c))


QUERIES = {
    "border_subgraph": lambda c: _near(c)[1],
    "border_subgraph_nodes": lambda c: _near(c)[0],
    "community_tops": _tops,
    "master_list_all": _everyone,
    "delay_histogram": lambda c: P.delay_histogram(_edges(c).withColumn("sy", F.col("sy") + F.when(F.col("sg") == "TPC", 47).otherwise(0))),
    "delay_decades": lambda c: P.delay_decades(_edges(c)),
    "reciprocity_decades": lambda c: P.reciprocity_decades(_edges(c), "TPC", "RHET_COMP"),
    "article_reciprocity": lambda c: P.article_reciprocity(_mutual(c)),
    "most_reciprocal": lambda c: P.most_reciprocal(_mutual(c), "TPC"),
    "concentration": lambda c: P.concentration(_degrees(c), "n_in"),
    "citation_frequencies": lambda c: P.frequencies(_degrees(c), "n_in"),
    "rank_frequencies": lambda c: P.rank_frequencies(_degrees(c), "n_in"),
    "inside_outside": lambda c: P.inside_outside(c.articles, c.citations),
    "inside_outside_lists": lambda c: P.divergent(P.inside_outside(c.articles, c.citations)),
    "inside_outside_ranks": lambda c: P.rank_agreement(P.inside_outside(c.articles, c.citations)),
    "team_decades": lambda c: P.team_decades(H.team_years(_sizes(c))),
    "concordance": lambda c: P.concordance(c.articles, "journal", "source"),
    "reading_path": lambda c: P.reading_path(c.records, c.citations, 5),
}

_CROSS = ", x as (select * from edges where (sg = 'TPC' and tg = 'RHET_COMP') or (sg = 'RHET_COMP' and tg = 'TPC'))"
_MUTUAL = _CROSS + """, d as (select distinct source, target, sg, tg from x), p as (select a.source as id, a.sg as g, a.target as other, 1 as cites, (b.source is not null)::int as back from d a left join d b on b.source = a.target and b.target = a.source
    union select d.target, d.tg, d.source, 0, 0 from d left join d b on b.source = d.target and b.target = d.source where b.source is null),
    per as (select id, g, sum(cites)::bigint as cites, count(*) filter (cites = 0 or back = 1) as cited_by, count(*) filter (cites = 1 and back = 1) as partners from p group by all having sum(cites) > 0)"""
_QUADRANTS = """, n as (select a.id, d.n_in, coalesce(cited_globally, 0) as cited_globally from articles a join degrees d using (id) where n_in > 0 or cited_globally > 0),
    r as (select *, row_number() over (order by n_in desc, id) as internal_rank, row_number() over (order by cited_globally desc, id) as global_rank, greatest(50, count(*) over () // 50) as t from n),
    q as (select id, n_in, cited_globally, internal_rank, global_rank, case when internal_rank <= t and global_rank <= t then 'shared_canon' when internal_rank <= t then 'tpc_specific' when global_rank <= t then 'imported' else 'background' end as quadrant from r)"""
_SHARE = "round((sum(n_in) filter (i <= {}))::double / sum(n_in), 6)"

_NEAR = """, x as (select distinct least(source, target) as a, greatest(source, target) as b from edges where source <> target), en as (select source as id, sg as g, target as o, tg as og from edges where source <> target union select target, tg, source, sg from edges where source <> target),
    sd as (select id from en group by id, g order by count(*) filter (g <> og and g <> 'OTHER') desc, id limit 25), nb as (select id, true as seed from sd union select case when a in (from sd) then b else a end, false from x where (a in (from sd)) <> (b in (from sd))),
    nd as (select * from nb order by seed desc, id limit 300)"""

SQL = {
    "border_subgraph": with_sql("edges", _NEAR + " select a as source, b as target from x where a in (select id from nd) and b in (select id from nd)"),
    "border_subgraph_nodes": with_sql("edges", _NEAR + " from nd"),
    "community_tops": with_sql("records degrees", """, r as (select r.*, r.source as c, n_in from records r join degrees using (id)), e as (select c, 'article' as list, id::varchar as what, n_in as n, id as tie from r union all select c, 'journal', journal, count(*), 0 from r group by c, journal
        union all select c, 'tag', lower(tag), count(*), 0 from (select c, unnest(string_split(trim(tags, '|'), '|')) as tag from r where tags is not null) group by c, lower(tag))
        select c, list, place::int as place, what, n from (select *, row_number() over (partition by c, list order by n desc, tie, what) as place from e) where place <= 5"""),
    "delay_histogram": with_sql("edges", ", s as (select sg, tg, case when sg = 'TPC' then sy + 47 else sy end - ty as d from edges) select sg, tg, least(d, 50) as delay, count(*) as n from s where d >= 0 group by all"),
    "delay_decades": with_sql("edges", "select sg, tg, (sy // 10 * 10)::int as decade, round(avg(sy - ty), 2) as mean, count(*) as n from edges where sy >= ty group by all having count(*) >= 5"),
    "reciprocity_decades": with_sql("edges", _CROSS + """, e as (select distinct source, target from edges), m as (select (sy // 10 * 10)::int as decade, e.source is not null as back from x left join e on e.source = x.target and e.target = x.source)
        select decade, count(*) as links, count(*) filter (back) as returned, round((count(*) filter (back))::double / count(*), 6) as rate from m group by grouping sets ((decade), ())"""),
    "article_reciprocity": with_sql("edges", _MUTUAL + " select g, count(*) as citing, count(*) filter (cited_by > 0) as reciprocated, round((count(*) filter (cited_by > 0))::double / count(*), 6) as rate from per group by g"),
    "most_reciprocal": with_sql("edges", _MUTUAL + " select id, cites, cited_by, partners from per where g = 'TPC' and cited_by > 0 order by partners desc, cites + cited_by desc, id limit 25"),
    "concentration": with_sql("degrees", f", r as (select n_in, row_number() over (order by n_in desc, id) as i, count(*) over () as n from degrees) select count(*) as articles, count(*) filter (n_in = 0) as without, sum(n_in)::bigint as total, {_SHARE.format(10)} as top_10, {_SHARE.format(50)} as top_50, {_SHARE.format(100)} as top_100, {_SHARE.format('greatest(1, n // 100)')} as top_percent from r"),
    "citation_frequencies": with_sql("degrees", "select n_in as count, count(*) as articles from degrees where n_in > 0 group by 1 order by 1 limit 200"),
    "rank_frequencies": with_sql("degrees", "select row_number() over (order by n_in desc)::int as rank, n_in as count from degrees where n_in > 0 order by n_in desc limit 500"),
    "inside_outside": with_sql("degrees", _QUADRANTS + " from q"),
    "inside_outside_lists": with_sql("degrees", _QUADRANTS + """, l as (select quadrant as list, row_number() over (partition by quadrant order by case when quadrant = 'imported' then global_rank else internal_rank end) as place, id from q where quadrant in ('imported', 'tpc_specific'))
        select list, place::int as place, id from l where place <= 25"""),
    "inside_outside_ranks": with_sql("degrees", _QUADRANTS + """ select count(*) as n, count(*) filter (quadrant = 'shared_canon') as shared_canon, count(*) filter (quadrant = 'tpc_specific') as tpc_specific, count(*) filter (quadrant = 'imported') as imported,
        count(*) filter (quadrant = 'background') as background, round(corr(internal_rank, global_rank), 6) as rho from q"""),
    "team_decades": with_sql("articles authors", """, s as (select id, year, count(*) as size from authors join articles using (id) group by all), y as (select year, count(*) as n, round(avg(size), 2) as mean, count(*) filter (size = 1) as solo, max(size) as most from s group by 1)
        select (year // 10 * 10)::int as decade, sum(n)::bigint as articles, round(sum(solo)::double / sum(n)::double, 6) as solo_share, round(sum(mean * n) / sum(n)::double, 6) as mean_size, max(most) as largest from y group by 1"""),
    "concordance": with_sql("articles", """, p as (select journal as c, source as k, count(*) as n from articles group by all) select (select sum(n) from p)::bigint as n, sum(m)::bigint as concordant, count(*) as coupling_clusters, (select count(distinct c) from p) as citation_communities,
        round(sum(m)::double / (select sum(n) from p)::double, 6) as rate from (select k, max(n) as m from p group by 1)"""),
    "reading_path": with_sql("records citations", """, l as (select source, target from citations where target is not null), s as (select journal as j, tags as ts from records where id = 5),
        co as (select target as id, count(distinct source) as w from l where source in (select source from l where target = 5) and target <> 5 and target in (select id from records) group by 1 order by w desc, id limit 20),
        cu as (select source as id, count(distinct target) as w from l where target in (select target from l where source = 5) and source <> 5 and source in (select id from records) group by 1 order by w desc, id limit 20),
        e as (select target as id, 0 as o, 'cites' as kind, 2 as pts, 'Cited by this article' as why from l where source = 5 union all select source, 1, 'cited_by', 2, 'Cites this article' from l where target = 5
        union all select id, 2, 'cocited', least(w, 5), 'Co-cited ' || w || '×' from co union all select id, 3, 'coupled', least(w, 5), 'Shares ' || w || ' reference' || case when w = 1 then '' else 's' end from cu),
        g as (select id, sum(pts) as pts, array_to_string(list_sort(list(distinct kind)), ',') as relations, string_agg(why, '; ' order by o, why) as why from e where id <> 5 group by id),
        f as (select g.*, coalesce(len(list_intersect(string_split(trim(tags, '|'), '|'), string_split(trim(ts, '|'), '|'))) > 0, false) as topic, coalesce(journal, '') = coalesce(j, '') as same from g join records using (id), s)
        select id, (pts + topic::int + same::int)::bigint as score, relations, why || case when topic then '; shared topic' else '' end || case when same then '; same journal' else '' end as reason from f"""),
}

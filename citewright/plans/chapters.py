"""Queries of the chapter tools, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewright.operators import chapters as H
from citewright.operators import citations as C
from citewright.operators import communities as N
from citewright.operators import graphs as G
from citewright.plans.tables import CLUSTERS, GROUPS, with_sql

GENERATIONS = (("early", 0, 1997), ("middle", 1997, 1999), ("late", 1999, 2100))
AS_OF = 2003


def _edges(c):
    return C.edge_table(c.articles, c.citations, GROUPS)


def _roles(c):
    return H.origins(c.records, c.citations, 2000)


def _grouped(c):
    group = F.lit("OTHER")
    for journal, g in GROUPS.items():
        group = F.when(F.col("journal") == journal, g).otherwise(group)
    return c.articles.withColumn("g", group)


def _sizes(c):
    return c.authors.groupBy("id").agg(F.count("*").alias("size")).join(c.articles.select("id", "year"), "id").select("id", "year", "size")


def _scribes(c):
    """Parts as authors, who start in different years."""
    return c.table("lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("Part "), "l_partkey").alias("name"), F.col("l_linenumber").alias("pos"))


def lists(c):
    edges = _edges(c)
    canons, reach = H.shifting_canons(edges, GENERATIONS), H.reach_patterns(edges, AS_OF)
    return {"The Long Tail": H.long_tail(edges, c.authors), "The Fair Ranking": H.fair_ranking(c.articles, c.citations, AS_OF), "Shifting Canons": canons, "The Reach of a Citation": reach.where("total > 0")}


def _network(c):
    return C.network_links(c.articles, c.citations, 1, 600)


def _events(c):
    row = c.table("events").groupBy("event_type").agg(F.min(F.year("ts")).alias("year"))
    seed = row.select("year", F.col("event_type").alias("type"), F.upper("event_type").alias("title"))
    return H.known_events(seed, row.select("year", F.lit("extra").alias("type"), F.concat("event_type", F.lit(" "))  .alias("title")).union(row.select("year", F.lit("extra"), F.concat("event_type", F.lit(" again")))))


QUERIES = {
    "sources_sinks": lambda c: H.origin_rates(_roles(c)),
    "origins_by_year": lambda c: H.origin_years(_roles(c)),
    "notable_origins": lambda c: H.notable_origins(_roles(c)),
    "traditions": lambda c: H.traditions(_grouped(c)),
    "fair_ranking": lambda c: H.fair_ranking(c.articles, c.citations, AS_OF),
    "long_tail": lambda c: H.long_tail(_edges(c), c.authors),
    "shifting_canons": lambda c: H.shifting_canons(_edges(c), GENERATIONS),
    "reach_patterns": lambda c: H.reach_patterns(_edges(c), AS_OF),
    "team_sizes": lambda c: H.team_years(_sizes(c)),
    "team_milestones": lambda c: H.team_milestones(H.team_years(_sizes(c))),
    "largest_teams": lambda c: H.largest_teams(_sizes(c)),
    "lineages": lambda c: H.lineages(_scribes(c), c.articles, 1),
    "prolific_mentors": lambda c: H.prolific_mentors(H.lineages(_scribes(c), c.articles, 1)),
    "master_list": lambda c: H.master_list(lists(c)),
    "known_events": _events,
    "centrality_table": lambda c: H.centrality(G.pagerank(_network(c), None), G.betweenness(_network(c))),
    "community_profiles": lambda c: H.community_profiles(N.communities(N.undirected(_network(c))), c.articles, C.degrees(c.articles, c.citations)),
    "clusters": lambda c: c.articles.join(F.broadcast(c.spark.createDataFrame([(j, k) for k, js in CLUSTERS.items() for j in js], "journal string, cluster string")), "journal", "left").groupBy(F.coalesce("cluster", F.lit("Other / unclustered")).alias("cluster")).agg(F.count("*").alias("n")),  # the fixed list of journals
}

_ROLES = """, r as (select a.id, journal, year, pub_date, cited_globally, n_in = 0 as src, case when n_out = 0 then case when refs_at is null then 'data-gap' when year >= 2000 then 'frontier' else 'true' end end as sink from records a join degrees using (id))"""


_FAIR = """, f as (select id, year, n_in, round(n_in::double / greatest(1, 2003 - year), 3) as rate from degrees join articles using (id) where n_in > 0 and year <= 2001),
    q as (select *, row_number() over (order by n_in desc, id) as raw_rank, row_number() over (order by rate desc, id) as norm_rank from f), fair as (select *, raw_rank - norm_rank as rank_shift,
    case when raw_rank <= 50 and norm_rank <= 50 then 'stable_canon' when raw_rank <= 50 then 'age_advantage' else 'rising_fast' end as kind from q where raw_rank <= 50 or norm_rank <= 50)"""
_TAIL = """, tn as (select target, count(*) as n, count(*) filter (sj = tj) as own, count(distinct sj) as journals from edges group by 1 order by n desc, target limit 50),
    tp as (select target, name, count(*) as k from edges join authors on id = source where target in (select target from tn) group by all), ti as (select *, row_number() over (partition by target order by k, name) as i from tp),
    tg as (select target, count(*) as m, 2 * sum(i * k)::double / (count(*) * sum(k)) - (count(*) + 1)::double / count(*) as g, arg_min(name, (-k, name)) as who, max(k) as most from ti group by 1),
    tr as (select target, n, own::double / n as share, journals, coalesce(m, 0) as m, coalesce(g, 0) as g, who, coalesce(most, 0)::double / n as top_share from tn left join tg using (target)),
    tail as (select target as id, n, round(share, 6) as own_share, journals, m as citing_authors, round(g, 6) as author_gini, who as top_citer, round(top_share, 6) as top_share,
    case when (m >= 30)::int + (share < 0.3)::int + (g < 0.3)::int >= 2 then 'broadly_canonical' when (m < 15)::int + (share > 0.5)::int + (g > 0.5)::int >= 2 then 'narrowly_canonical' else 'mixed' end as breadth from tr)"""
_CANON = """, cg as (select case when sy < 1997 then 0 when sy < 1999 then 1 else 2 end as gen, target, count(*) as n from edges group by all), cr as (select *, row_number() over (partition by gen order by n desc, target) as rk from cg),
    cw as (select target as id, max(rk) filter (gen = 0) as rank_0, max(rk) filter (gen = 1) as rank_1, max(rk) filter (gen = 2) as rank_2, count(*) as generations from cr where rk <= 25 group by 1),
    canon as (select *, case when generations = 3 then 'enduring' when generations = 1 then 'generational_only' when rank_0 is null and rank_2 is not null then 'rising' when rank_0 is not null and rank_2 is null then 'fading' else 'intermittent' end as kind from cw)"""
_REACH = """, ra as (select target, count(*) as c, min(ty) as year from edges group by 1 order by c desc, target limit 100), rb as (select target, year, sy, count(*) as n from edges join ra using (target) where sy >= year and sy <= 2003 group by all),
    rs as (select target, sum(n) as total, arg_max(sy, (n, -sy)) as peak, max(n) as peak_n, coalesce(sum(n) filter (sy - year < 3), 0) as early from rb group by 1),
    rx as (select target as id, year, coalesce(total, 0)::bigint as total, coalesce(peak, year) as peak_year, coalesce(peak_n, 0) as peak_count, coalesce(early, 0) as early from ra left join rs using (target)),
    reach as (select id, year, total, peak_year, peak_count, case when total < 5 then 'too_few' when 2003 - year <= 4 then 'too_recent' when early >= 0.6::double * total then 'front_loaded'
    when peak_year - year >= 5 and peak_count * (2003 - year) >= 2 * total then 'late_bloomer' when 2 * peak_count >= total then 'one_wave' else 'steady_classic' end as pattern from rx)"""
_TEAMS = """, s as (select id, year, count(*) as size from authors join articles using (id) group by all), i as (select *, row_number() over (partition by year order by size) - 1 as k, count(*) over (partition by year) as n from s),
    t as (select year, count(*) as articles, round(avg(size), 6) as mean_size, max(size) filter (k = n // 2) as median_size, max(size) filter (k = (3 * n) // 4) as p75, max(size) as largest, round(count(*) filter (size = 1)::double / count(*), 6) as solo_share from i group by 1)"""
_LINEAGE = """, s as (select l_orderkey as id, concat('Part ', l_partkey) as name, l_linenumber as pos, year from lineitem join articles on id = l_orderkey), f as (select name, min(year) as f from s group by 1),
    p as (select x.name as a, y.name as b, count(*) as joint, min(x.year) as first_joint, max(x.year) as last_joint from s x join s y on x.id = y.id and x.name < y.name group by all),
    m as (select case when fa.f < fb.f then a else b end as mentor, case when fa.f < fb.f then b else a end as mentee, least(fa.f, fb.f) as mentor_first, greatest(fa.f, fb.f) as mentee_first, joint, first_joint, last_joint
    from p join f fa on fa.name = a join f fb on fb.name = b where abs(fa.f - fb.f) >= 1)"""

SQL = {
    "sources_sinks": with_sql("records degrees", _ROLES + """, g as (select journal, count(*) as articles, count(*) filter (src) as sources, count(*) filter (sink = 'true') as true_sinks, count(*) filter (sink = 'frontier') as frontier, count(*) filter (sink = 'data-gap') as data_gap from r group by 1)
        select *, round(sources::double / articles, 6) as source_rate, round(true_sinks::double / articles, 6) as sink_rate from g"""),
    "origins_by_year": with_sql("records degrees", _ROLES + " select year, count(*) filter (src) as sources, count(*) filter (not src and coalesce(sink = 'true', false)) as sinks, count(*) filter (not src and not coalesce(sink = 'true', false)) as other from r group by 1"),
    "notable_origins": with_sql("records degrees", _ROLES + """ select 'source' as list, id, pub_date, cited_globally from (from r where src and cited_globally >= 20 order by cited_globally desc, id limit 15)
        union all select 'true', id, pub_date, cited_globally from (from r where sink = 'true' order by pub_date, id limit 15) union all select 'frontier', id, pub_date, cited_globally from (from r where sink = 'frontier' order by pub_date desc, id limit 15)"""),
    "traditions": with_sql("grouped", "select grp as g, journal, count(*) as articles, min(year) as first_year, max(year) as last_year from grouped group by all"),
    "fair_ranking": with_sql("degrees", _FAIR + " from fair"),
    "long_tail": with_sql("edges authors", _TAIL + " from tail"),
    "shifting_canons": with_sql("edges", _CANON + " from canon"),
    "reach_patterns": with_sql("edges", _REACH + " from reach"),
    "team_sizes": with_sql("articles authors", _TEAMS + " from t"),
    "team_milestones": with_sql("articles authors", _TEAMS + " select min(year) filter (largest >= 5) as first_5, min(year) filter (largest >= 10) as first_10, min(year) filter (solo_share < 0.5) as crossover from t"),
    "largest_teams": with_sql("articles authors", _TEAMS + " select id, year, size from s where size >= 5 order by size desc, id limit 25"),
    "lineages": with_sql("articles", _LINEAGE + " from m"),
    "prolific_mentors": with_sql("articles", _LINEAGE + " select mentor, count(distinct mentee) as mentees from m group by 1 having count(distinct mentee) >= 3 order by mentees desc, mentor limit 30"),
    "master_list": with_sql("edges degrees authors", _FAIR + _TAIL + _CANON + _REACH + """, u as (select id, 'The Fair Ranking' as tool from fair union select id, 'The Long Tail' from tail union select id, 'Shifting Canons' from canon union select id, 'The Reach of a Citation' from reach where total > 0)
        select id, count(*) as n_tools, array_to_string(list_sort(list(tool)), ', ') as tools from u group by 1"""),
    "known_events": "with r as (select event_type, min(year(ts))::int as year from events group by 1) select year, event_type as type, upper(event_type) as title from r union all select year, 'extra', event_type || ' again' from r",
    "clusters": with_sql("articles", "select case when journal in ('AUTOMOBILE', 'MACHINERY') then 'makers' when journal in ('FURNITURE', 'HOUSEHOLD', 'GARDEN') then 'homes' when journal = 'BUILDING' then 'sites' else 'Other / unclustered' end as cluster, count(*) as n from articles group by 1"),
}

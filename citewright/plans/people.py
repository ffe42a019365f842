"""Queries of institutions, readers' tags, requests, upkeep and single values, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewright.functions import values as V
from citewright.operators import citations as C
from citewright.operators import institutions as I
from citewright.operators import moderation as D
from citewright.operators import records as R
from citewright.plans.tables import GROUPS, with_sql
from citewright.streaming import events as S


def _edges(c):
    return C.edge_table(c.articles, c.citations, GROUPS)


def _author(c):
    """The name of the last supplier, as a table of one row."""
    return c.table("supplier").agg(F.max_by("s_name", "s_suppkey").alias("name"))


def _office(c):
    """People of works by journal: PROMO works stand for books."""
    return c.placed.join(c.works.select("work", "journal", (F.col("type") == "PROMO").alias("book")), "work").select("name", "journal", "place", "book")


def submitted(c):
    """Readers' submissions on articles; known tags come from purchases, decisions from dear signups."""
    v = c.votes
    asked = v.where("tag <> 'purchase'").select("article", F.lower("tag").alias("tag"), F.col("voter").alias("client"), "at", "seq")
    known = v.where("tag = 'purchase' and vote > 0").select("article", F.lit("error").alias("tag"))
    decided = c.table("events").where("event_type = 'signup' and value > 60").select(
        F.get_json_object("props", "$.k").try_cast("long").alias("article"), F.lit("view").alias("tag"), F.when(F.col("value") > 80, "approved").otherwise("rejected").alias("status"), F.col("ts").alias("at"))
    return asked, known, decided


def _submitted(c):
    return D.submissions(*submitted(c))


def _decided(c):
    """The queue with decisions of users who bought or signed up: even ones approve, others reject or say nothing that counts."""
    by = c.votes.where("tag = 'purchase' or tag = 'signup'").select("article", F.lit("click").alias("tag"), F.when(F.col("voter") % 2 == 0, "approve").when(F.col("voter") % 3 == 0, "reject").otherwise("later").alias("decision"), F.col("voter").cast("string").alias("actor"), "at")
    return D.decide(D.queue(_submitted(c)), by)


def _audit(c):
    action = F.create_map(*(F.lit(x) for x in ("purchase", "verify", "signup", "approve", "error", "deny")))
    return c.table("events").select(F.concat_ws(":", "user_id", F.to_date("ts")).alias("request"), F.coalesce(action[F.col("event_type")], F.lit("note")).alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


QUERIES = {
    "top_institutions": lambda c: I.top_institutions(c.affiliations),
    "institution_years": lambda c: I.by_year(c.affiliations, c.articles),
    "institution_people": lambda c: I.top_people(c.affiliations, 7),
    "institution_articles": lambda c: I.articles_of(c.affiliations, c.articles, 7),
    "author_institutions": lambda c: c.affiliations.join(F.broadcast(_author(c)), "name", "left_semi").groupBy("place").agg(F.countDistinct("id").alias("articles")),  # one name
    "author_timeline": lambda c: c.articles.join(c.authors.join(F.broadcast(_author(c)), "name", "left_semi").select("id"), "id", "left_semi").groupBy("year", "journal").agg(F.count("*").alias("n")),  # one name
    "editorial_stamps": lambda c: I.editorial_stamps(_office(c), 5, 0.06),
    "tag_feedback": lambda c: D.tallies(c.votes),
    "tag_submissions": lambda c: _submitted(c).select("seq", "article", "tag", "status"),
    "known_tag_feedback": lambda c: D.tallies(c.votes, c.votes.where("vote > 0 and article < 30").select("article", "tag")),
    "decided_tags": lambda c: D.listed_queue(_decided(c)).select("article", "tag", "votes", "status", "decided_by"),
    "approved_queue": lambda c: D.listed_queue(_decided(c), "approved").select("article", "tag", "votes"),
    "tag_queue": lambda c: D.queue(_submitted(c)).select("article", "tag", "votes"),
    "request_states": lambda c: D.request_states(_audit(c)),
    "retained_backups": lambda c: D.retained(c.table("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at")), "2001-08-01 00:00:00"),
    "fetch_marks": lambda c: c.articles.groupBy("journal").agg(F.max("pub_date").alias("last_pub_date")),
    "autocomplete": lambda c: R.search(c.table("documents"), "th").orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "n_chars").limit(10),
    "half_life_series": lambda c: C.half_life_series(_edges(c), "sj"),
    "shared_foundations": lambda c: C.shared_foundations(c.citations, 2, 3),
    "outside_counts": lambda c: C.outside_counts(c.citations),
    "without_references": lambda c: C.without_references(c.articles, c.citations),
    "doi_map": lambda c: C.doi_map(c.citations.select(F.concat(F.lit(" "), F.upper("doi")).alias("doi"), F.col("source").alias("id"))),
    "corpus_totals": lambda c: C.corpus_totals(c.articles, c.citations),
    "reference_coverage": lambda c: C.reference_coverage(c.articles, c.citations),
    "period_labels": lambda c: c.articles.groupBy(V.period_label(F.col("pub_date")).alias("period")).agg(F.count("*").alias("n")),
    "normal_tags": lambda c: c.table("conversations").select("conv_id", "turn", V.normal_tag(F.col("text")).alias("tag")),
    "reference_keys": lambda c: c.table("documents").select("doc_id", V.reference_key(F.col("text")).alias("key"), V.raw_doi(F.col("text")).alias("doi")),
    "stream_once": lambda c: S.drain(S.once(S.read_events(c.spark, c.sf_dir).select("event_id", "ts", "event_type", "value"))).select("event_id", "event_type", "value"),
}

_ME = "(select max_by(s_name, s_suppkey) from supplier)"
_TAGGED = """, a as (select article, tag, voter as client, ts, seq from votes where tag <> 'purchase'), k as (select distinct article, 'error' as tag from votes where tag = 'purchase' and vote > 0),
    d as (select try_cast(json_extract_string(props, '$.k') as bigint) as article, 'view' as tag, min(ts) as since, arg_min(case when value > 80 then 'approved' else 'rejected' end, ts) as status from events where event_type = 'signup' and value > 60 group by 1),
    r as (select a.*, k.tag is not null as known, d.status as ruled, since, row_number() over w as n, lag(client) over w as before from a left join k using (article, tag) left join d using (article, tag) window w as (partition by article, tag order by ts, seq)),
    j as (select seq, article, tag, case when known then 'exists' when n > 1 and since < ts then ruled when n > 1 and client <> before then 'bumped' else 'pending' end as status from r)"""

_DECIDED = """, q as (select article, tag, least(1 + count(*) filter (status = 'bumped'), 50) as votes from j where status <> 'exists' group by all), db as (select article, 'click' as tag, case when voter % 2 = 0 then 'approve' when voter % 3 = 0 then 'reject' end as d, voter::varchar as actor, ts from votes where tag in ('purchase', 'signup')),
    dd as (select article, tag, arg_max(d, (ts, d, actor)) as d, arg_max(actor, (ts, d, actor)) as actor from db where d is not null group by all)"""

SQL = {
    "top_institutions": with_sql("affiliations", "select place, count(distinct id) as articles, count(distinct name) as people from affiliations group by 1 order by articles desc, place limit 25"),
    "institution_years": with_sql("articles affiliations", """, t as (select place from affiliations group by 1 order by count(distinct id) desc, place limit 10),
        n as (select place, year, count(distinct id) as n from affiliations join articles using (id) where place in (from t) and year >= 1990 group by all), y as (select unnest(range(min(year), max(year) + 1))::int as year from n)
        select place, year, coalesce(n, 0) as n from t cross join y left join n using (place, year)"""),
    "institution_people": with_sql("affiliations", "select name, count(distinct id) as articles from affiliations where place = 7 group by 1 order by articles desc, name limit 10"),
    "institution_articles": with_sql("articles affiliations", "select id, pub_date, journal from articles where id in (select id from affiliations where place = 7) order by pub_date desc, id limit 200"),
    "author_institutions": with_sql("affiliations", f"select place, count(distinct id) as articles from affiliations where name = {_ME} group by 1"),
    "author_timeline": with_sql("articles authors", f"select year, journal, count(*) as n from articles where id in (select id from authors where name = {_ME}) group by all"),
    "editorial_stamps": with_sql("works placed", """, r as (select name, journal, place, type = 'PROMO' as book from placed join works using (work) where place is not null), j as (select journal, count(distinct name) as t from r where not book group by 1 having count(distinct name) >= 5),
        p as (select journal, place from r join j using (journal) where not book group by all having count(distinct name) >= 0.06::double * any_value(t)),
        o as (select min(journal) filter (not book) as journal, place from r group by place having count(distinct name) >= 5 and count(distinct journal) filter (not book) = 1 and count(*) filter (book) = 0)
        select journal, place, max(reason) as reason from (select *, 'dominance' as reason from p union all select *, 'single-venue' from o) group by all"""),
    "tag_feedback": with_sql("votes", ", l as (select article, tag, arg_max(vote, (ts, seq)) as vote from votes group by article, tag, voter) select article, tag, count(*) filter (vote > 0) as up, count(*) filter (vote < 0) as down from l group by all"),
    "tag_submissions": with_sql("votes", _TAGGED + " from j"),
    "known_tag_feedback": with_sql("votes", ", k as (select distinct article, tag from votes where vote > 0 and article < 30), l as (select article, tag, arg_max(vote, (ts, seq)) as vote from votes join k using (article, tag) group by article, tag, voter) select article, tag, count(*) filter (vote > 0) as up, count(*) filter (vote < 0) as down from l group by all"),
    "decided_tags": with_sql("votes", _TAGGED + _DECIDED + " select article, tag, votes, case d when 'approve' then 'approved' when 'reject' then 'rejected' else 'pending' end as status, actor as decided_by from q left join dd using (article, tag)"),
    "approved_queue": with_sql("votes", _TAGGED + _DECIDED + " select article, tag, votes from q join dd using (article, tag) where d = 'approve'"),
    "tag_queue": with_sql("votes", _TAGGED + " select article, tag, least(1 + count(*) filter (status = 'bumped'), 50) as votes from j where status <> 'exists' group by all"),
    "request_states": """with a as (select user_id || ':' || cast(ts as date) as request, event_type as e, ts, event_id from events), v as (select request, min((ts, event_id)) filter (e = 'purchase') as v, count(*) as entries from a group by 1),
        d as (select request, arg_min(e, (ts, event_id)) as d from a join v using (request) where e in ('signup', 'error') and (ts, event_id) > v group by 1)
        select request, case when v is null then 'waiting' when d is null then 'verified' when d = 'signup' then 'approved' else 'denied' end as state, entries from v left join d using (request)""",
    "retained_backups": """with r as (select o_orderkey as key, o_orderdate as t, date_diff('day', o_orderdate, timestamp '2001-08-01') as age from orders), z as (select *, case when age <= 30 then 'daily' when age <= 182 then 'weekly' when age <= 360 then 'monthly' end as zone from r)
        select key, zone from (select *, row_number() over (partition by zone, case when zone = 'weekly' then isoyear(t) * 100 + week(t) else year(t) * 100 + month(t) end order by t desc, key) as i from z) where zone = 'daily' or (zone is not null and i = 1)""",
    "fetch_marks": with_sql("articles", "select journal, max(pub_date) as last_pub_date from articles group by 1"),
    "autocomplete": "select doc_id, n_chars from documents where len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: starts_with(x, 'th'))) > 0 order by n_chars desc, doc_id limit 10",
    "half_life_series": with_sql("edges", """, r as (select sj as journal, sy as year, sy - ty as age, row_number() over (partition by sj, sy order by sy - ty) as i, count(*) over (partition by sj, sy) as n from edges where sy >= ty)
        select journal, year, min(age) filter (2 * i >= n) as half_life, max(n) as n from r group by all having max(n) >= 10"""),
    "shared_foundations": with_sql("citations", """, r as (select distinct source, coalesce(target::varchar, doi) as ref from citations), s as (select source, count(*) as refs from r group by 1 having count(*) >= 3),
        h as (select ref from r group by 1 having count(*) between 2 and 200), u as (select * from r where ref in (from h) and source in (select source from s)),
        p as (select x.source as a, y.source as b, count(*) as weight from u x join u y on x.ref = y.ref and x.source < y.source group by all having count(*) >= 2),
        t as (select id from (select a as id, weight from p union all select b, weight from p) group by 1 order by sum(weight) desc, id limit 400), k as (select * from p where a in (from t) and b in (from t) order by weight desc, a, b limit 2000)
        select a, b, weight, round(weight::double / (m.refs + n.refs - weight), 6) as jaccard from k join s m on m.source = a join s n on n.source = b"""),
    "outside_counts": with_sql("citations", "select source, count(*) as n from citations where target is null group by 1"),
    "without_references": with_sql("articles citations", "select id, pub_date, journal from articles where id not in (select source from citations)"),
    "doi_map": with_sql("citations", "select lower(trim(' ' || upper(doi))) as doi, max(source) as id from citations group by 1"),
    "corpus_totals": with_sql("articles citations", """select (select count(*) from articles) as articles, (select count(distinct journal) from articles) as journals, count(*) as citations, count(target) as resolved,
        count(distinct source) as citing, count(distinct target) as cited, round(100.0::double * count(target) / count(*), 1) as percent from citations"""),
    "reference_coverage": with_sql("articles citations", ", k as (select distinct source as id, 1 as has from citations) select journal, count(*) as articles, count(has) as fetched, round(100.0::double * count(has) / count(*), 1) as percent from articles left join k using (id) group by 1"),
    "period_labels": with_sql("articles", "select strftime(cast(pub_date as date), '%B %Y') as period, count(*) as n from articles group by 1"),
    "normal_tags": r"select conv_id, turn, lower(trim(regexp_replace(regexp_replace(replace(text, '|', ' '), '[\x00-\x1f\x7f<>]', '', 'g'), ' +', ' ', 'g'))) as tag from conversations",
    "reference_keys": "select doc_id, 'ref:' || substr(md5(text), 1, 12) as key, 'raw:' || substr(sha256(text), 1, 16) as doi from documents",
    "stream_once": "select event_id, event_type, value from events",
}

"""Queries of cleaning rules, removal of names and payloads of other indexes, with equivalent SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.functions import cleaning as K
from citewright.operators import pages as P
from citewright.operators import removal as D
from citewright.operators.phrases import tag_texts
from citewright.plans.tables import with_sql
from citewright.session import expire, shared_path
from citewright.sources import works as W

SALT = "salt"


def _owing(c):
    return c.table("supplier").where("s_acctbal < 0").select(F.col("s_name").alias("name"))


def _ledger(c):
    """Names of those who owe money, with new tokens, their upper-case form as a variant."""
    none = c.spark.createDataFrame([], "token string, name string, variants string")
    return D.mint(_owing(c), none, SALT).withColumn("variants", F.to_json(F.array(F.upper("name"))))


def _references(c):
    """Free texts that name the authors of articles."""
    return c.records.where("authors is not null").select("id", F.concat_ws(" ", F.lit("See"), "authors", F.lit("1999.")).alias("raw_reference"))


def _tables(c):
    """The six tables that hold names."""
    places = c.affiliations.select(F.col("id").alias("article_id"), F.col("name").alias("author_name"), F.concat(F.lit("A"), "name").alias("openalex_author_id"), F.col("place").alias("institution_id"))
    return {
        "articles": c.records.select("id", "authors"), "books": c.books.select("id", "authors", "editors"), "authors": c.people.select("name", "orcid", F.col("institution").alias("institution_name")),
        "author_article_affiliations": places.drop("institution_id").distinct(), "article_author_institutions": places.distinct(), "citations": _references(c),
    }


def _swept(c):
    """How many rows of each table hold a token, and how many of those keep an identifier."""
    parts = []
    for table, rows in D.sweep(_tables(c), _ledger(c)).items():
        text = F.concat_ws(" ", *(F.col(x) for x in rows.columns))
        left = F.col("openalex_author_id") if "openalex_author_id" in rows.columns else F.col("orcid") if "orcid" in rows.columns else F.lit(None)
        token = F.contains(text, F.lit(D.PREFIX))
        parts.append(rows.agg(F.lit(table).alias("name"), F.count("*").alias("n"), F.count(F.when(token, 1)).alias("with_token"), F.count(F.when(token, left)).alias("identified")))
    return reduce(DataFrame.unionByName, parts)


def _undone(c):
    """Sweep, then undo for the names that end in 3."""
    ledger = _ledger(c)
    tables = D.sweep({k: t for k, t in _tables(c).items() if k in ("articles", "authors")}, ledger)
    return D.undo(tables, ledger, ledger.where(F.col("name").endswith("3")))[0]


def _exported(c):
    """The ledger through a file and back."""
    path = shared_path(c.spark, "ledger")
    D.export_ledger(_ledger(c), path, SALT)
    expire(c.spark, path)
    return D.import_ledger(c.spark.createDataFrame([], "token string, name string, variants string, name_hash string"), path)


def _phrase_tags(c):
    """Titles and abstracts by the names of parts, a tag for each brand: some thousand phrases."""
    pairs = c.table("part").select("p_brand", "p_name").distinct().orderBy("p_brand", "p_name").limit(100_000).collect()
    vocabulary = {}
    for brand, name in pairs:
        vocabulary.setdefault(brand, []).append(name)
    return tag_texts(c.records.select("id", "title", "abstract"), ("title", "abstract"), vocabulary).select("id", "tags")


def _requests(c):
    """Customers who ask for removal: by mail, or with an identifier; some secrets come back, some proofs arrive."""
    asked = c.table("customer").select(
        F.col("c_custkey").alias("request"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 3000, F.concat("c_name", F.lit("@x.example"))).alias("email"), F.lit(None).cast("string").alias("orcid"),
        F.when(F.col("c_acctbal") < 3000, "email").otherwise("orcid").alias("method"), F.concat(F.lit("secret"), "c_custkey").alias("secret"))
    none = c.spark.createDataFrame([], "request long, name string, email string, orcid string, method string, status string, token_hash string")
    opened = D.open_requests(none, asked)
    back = D.verify(opened, c.table("customer").where("c_acctbal < 1000").select(F.concat(F.lit("secret"), "c_custkey").alias("secret")))
    proofs = c.table("customer").where("c_acctbal >= 5000").select(F.col("c_custkey").alias("request"), F.concat(F.lit("id"), "c_custkey").alias("verified_orcid"), F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Dr "), F.upper("c_name"))).otherwise("Someone Else").alias("verified_name"))
    return D.attach(back, proofs)


def _open_index(c):
    """The articles with a doi as an open index's works, in the shared folder."""
    path = shared_path(c.spark, "open-index")
    people = c.authors.select("id", "name").distinct().join(c.people, "name").groupBy("id").agg(F.collect_list(F.struct(
        F.struct(F.concat(F.lit("A"), "orcid").alias("id"), F.upper("name").alias("display_name"), F.concat(F.lit("https://orcid.org/"), "orcid").alias("orcid")).alias("author"), F.lit("middle").alias("author_position"),
        F.when(F.col("institution").isNotNull(), F.array(F.struct(F.lit("I").alias("id"), F.lit(None).cast("string").alias("ror"), F.col("institution").alias("display_name")))).alias("institutions"))).alias("authorships"))
    rows = c.records.where("doi is not null").join(people, "id").select(
        F.concat(F.lit("W"), "id").alias("id"), F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.create_map(F.lit("text"), F.array(F.lit(1)), F.lit("found"), F.array(F.lit(0))).alias("abstract_inverted_index"),
        F.struct(F.when(F.col("year") > 1997, F.lit("green")).alias("oa_status")).alias("open_access"), F.struct(F.when(F.col("journal") == "BUILDING", F.col("url")).alias("pdf_url")).alias("best_oa_location"), "authorships")
    rows.write.json(path)
    expire(c.spark, path)
    return W.open_works(c.spark, path)


def _enriched(c):
    mine = c.records.withColumn("oa_url", F.lit(None).cast("string")).withColumn("doi", F.lower("doi"))
    return P.update_fields(mine, _open_index(c).select("doi", "abstract", "oa_status", "oa_url"), "doi", {"abstract": "keep", "oa_status": "new", "oa_url": "keep"})


def _authorships(c):
    found = W.authorships(_open_index(c)).join(c.records.select(F.lower("doi").alias("doi"), "authors"), "doi")
    return found.where(K.name_in_list(F.col("name"), F.col("authors"))).groupBy("place").agg(F.count("*").alias("n"), F.countDistinct("orcid").alias("people"))


def _season(c):
    name = F.when(F.month("fetched_at") < 4, "Winter").when(F.month("fetched_at") < 7, "Spring").when(F.month("fetched_at") < 10, "Summer").when(F.col("source") == "F", "Fall")
    label = F.concat_ws(" ", name, F.when(F.col("source") != "O", F.col("year").cast("string")))
    return c.records.groupBy(K.season_date(F.col("year") - 1980, label).alias("date")).agg(F.count("*").alias("n"))


def _next_part(c):
    part = c.table("part")
    later = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit(" "), "p_brand").alias("other"))
    return part.join(later, "p_partkey").select("p_partkey", F.round(K.title_overlap(F.col("p_name"), F.lower("other")), 6).alias("share"))


QUERIES = {
    "match_keys": lambda c: c.table("documents").where("text is not null").select("doc_id", F.md5(K.match_key(F.col("text"))).alias("key")),
    "institution_names": lambda c: c.table("nation").select(K.institution(F.concat(F.lit("Department of English,  The "), "n_name", F.lit(" Univ, Some Town, "), F.lit("Country"))).alias("place")),
    "listed_authors": lambda c: c.records.where("authors is not null").groupBy(K.listed_authors(F.concat(F.replace("authors", F.lit("; "), F.lit(" and ")), F.lit(", Editors"))).alias("authors")).agg(F.count("*").alias("n")),
    "inverted_authors": lambda c: c.people.where("institution is not null").select("name", K.inverted_authors(F.concat("institution", F.lit(", Ann B., and Roe C. Lee [review]. Then more"))).alias("authors")),
    "season_dates": _season,
    "field_titles": lambda c: c.table("part").where(K.in_field(F.replace("p_name", F.lit("widget"), F.lit("Writing")))).select("p_partkey", "p_name"),
    "page_links": lambda c: c.table("pages").select("page_id", K.absolute_url(F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1), F.concat(F.regexp_extract("url", "^(https?://[^/]+)/", 1), F.lit("/"))).alias("link")),
    "navigation_words": lambda c: c.table("conversations").where(~K.is_navigation(F.col("role"))).agg(F.count("*").alias("n")),
    "title_overlap": _next_part,
    "clamped_numbers": lambda c: c.table("events").groupBy(K.clamped(F.get_json_object("props", "$.k"), 7, 10, 50).alias("k"), K.clamped(F.col("event_type"), 0.5, kind="double").alias("none")).agg(F.count("*").alias("n")),
    "issue_urls": lambda c: c.records.where("title is not null").select("id", K.issue_url("jn", F.col("year").cast("string"), F.lit(" "), F.month("fetched_at").cast("string"), F.col("title"), K.first_surname(F.when(F.col("source") == "F", F.concat("journal", F.lit(", A. ; B"))))).alias("url")),
    "split_tags": lambda c: c.records.select(F.explode(K.split_tags(F.upper("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")),
    "minted_tokens": lambda c: _ledger(c).select("name", "token"),
    "removed_lists": lambda c: D.replace_in_lists(c.records.where("authors is not null"), "authors", _ledger(c)).select("id", "authors"),
    "removed_people": lambda c: D.replace_names(c.people, "name", _ledger(c), ("orcid", "institution"), ("name",)),
    "removed_affiliations": lambda c: D.replace_names(c.affiliations, "name", _ledger(c), (), ("id", "name", "place")).groupBy("name").agg(F.count("*").alias("n")),
    "shown_authors": lambda c: D.replace_in_lists(c.records.where("authors is not null"), "authors", _ledger(c)).select("id", D.shown(F.col("authors")).alias("authors")),
    "scrubbed_texts": lambda c: D.scrub(_references(c), "raw_reference", _ledger(c)).select("id", F.col("raw_reference").alias("text")),
    "restored_lists": lambda c: _undone(c)["articles"].select("id", "authors"),
    "restored_people": lambda c: _undone(c)["authors"],
    "swept_tables": _swept,
    "exported_ledger": _exported,
    "clashing_tokens": lambda c: D.mint(_owing(c), _owing(c).where(F.col("name").endswith("4") | F.col("name").endswith("8")).select(F.concat(F.lit(D.PREFIX), F.substring(D.name_hash(F.col("name"), SALT), 1, 6)).alias("token")), SALT),
    "books_intake": lambda c: P.upsert_books(c.books, c.books.where("record_type = 'book'").withColumn("doi", F.concat("doi", F.lit("x"))).withColumn("seq", F.lit(1)), _ledger(c)).where("doi like '%x'").select("id", "authors", "editors"),
    "phrase_tags": _phrase_tags,
    "merged_ledger": lambda c: D.listing(D.merge_ledger(_ledger(c).select("token", "name", F.lit("2020").alias("removed_at")), c.people.select(F.concat(F.lit("other "), "orcid").alias("token"), "name", F.lit("2021").alias("removed_at")))),
    "request_steps": lambda c: _requests(c).groupBy("method", "status", "agrees", F.col("token_hash").isNotNull().alias("waiting")).agg(F.count("*").alias("n"), F.count("orcid").alias("with_orcid")),
    "open_enriched": lambda c: _enriched(c).groupBy("abstract", "oa_status", F.col("oa_url").isNotNull().alias("linked")).agg(F.count("*").alias("n")),
    "open_authorships": _authorships,
}

_TOKENS = ", k as (select s_name as name, 'Redacted Author ' || substr(sha256(lower(s_name) || '|salt'), 1, 6) as token from supplier where s_acctbal < 0)"
_LISTS = "select l_orderkey as id, string_agg({}, '; ' order by l_linenumber, s_name) as authors from lineitem join supplier on l_suppkey = s_suppkey left join k on k.name = s_name where l_orderkey in (select o_orderkey from orders join customer on c_custkey = o_custkey) group by 1"

SQL = {
    "match_keys": "select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '<[^>]+>', '', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) as key from documents where text is not null",
    "institution_names": "select n_name || ' University' as place from nation",
    "listed_authors": with_sql("records", "select case when len(replace(authors, '; ', ' and ') || ', Editors') <= 300 then authors end as authors, count(*) as n from records where authors is not null group by 1"),
    "inverted_authors": with_sql("people", r"select name, regexp_replace('Ann B. ' || institution, '\d+$', '') || '; Roe C. Lee' as authors from people where institution is not null"),
    "season_dates": with_sql("records", """, s as (select source, year, case when month(fetched_at) < 4 then '01' when month(fetched_at) < 7 then '04' when month(fetched_at) < 10 then '06' when source = 'F' then '09' end as m from records)
        select (case when source <> 'O' then year else year - 4 + coalesce((m in ('04', '06'))::int, 0) end)::varchar || '-' || coalesce(m, '01') as date, count(*) as n from (select source, year, m from s) group by 1"""),
    "field_titles": rf"select p_partkey, p_name from part where regexp_matches(replace(p_name, 'widget', 'Writing'), '{K.FIELD}')",
    "page_links": "select page_id, case when regexp_matches(url, '^https?://[^/]+/') then url end as link from pages",
    "navigation_words": "select count(*) filter (length(role) >= 8) as n from conversations",
    "title_overlap": r"""with p as (select a.p_partkey, list_distinct(string_split(a.p_name, ' ')) as x, list_distinct(string_split(regexp_replace(lower(b.p_name || ' ' || b.p_brand), '[^a-z0-9 ]', '', 'g'), ' ')) as y from part a join part b on b.p_partkey = a.p_partkey + 1)
        select p_partkey, round(len(list_intersect(x, y))::double / len(x), 6) as share from p""",
    "clamped_numbers": "select case when k is null then 7 else greatest(10, least(50, k)) end as k, 0.5::double as none, count(*) as n from (select try_cast(json_extract_string(props, '$.k') as int) as k from events) group by 1",
    "issue_urls": with_sql("records", "select id, 'jn:v' || year || 'i?-p' || month(fetched_at) || case when source = 'F' then '-' || lower(journal) else '' end || '-' || trim(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40)) as url from records where title is not null"),
    "split_tags": with_sql("tags records", "select lower(tag) as tag, count(*) as n from tags where id in (select id from records) group by 1"),
    "minted_tokens": "with x as (select 1)" + _TOKENS + " from k",
    "removed_lists": "with x as (select 1)" + _TOKENS + " " + _LISTS.format("coalesce(token, s_name)"),
    "removed_people": with_sql("people", _TOKENS + " select coalesce(token, p.name) as name, case when token is null then institution end as institution, case when token is null then orcid end as orcid from people p left join k on k.name = p.name"),
    "removed_affiliations": with_sql("affiliations", _TOKENS + ", d as (select name, count(*) as n, count(distinct (id, place)) as d from affiliations group by 1) select coalesce(token, d.name) as name, case when token is null then n else d end as n from d left join k on k.name = d.name"),
    "shown_authors": "with x as (select 1)" + _TOKENS + " " + _LISTS.format("case when token is null then s_name else 'Name Redacted by Author Request' end"),
    "scrubbed_texts": "with x as (select 1)" + _TOKENS + ", l as (" + _LISTS.format("coalesce(token, s_name)") + ") select id, 'See ' || authors || ' 1999.' as text from l",
    "restored_lists": "with x as (select 1)" + _TOKENS + ", l as (" + _LISTS.format("case when s_name like '%3' then s_name else coalesce(token, s_name) end") + ") select o_orderkey as id, authors from orders join customer on c_custkey = o_custkey left join l on id = o_orderkey",
    "restored_people": with_sql("people", _TOKENS + " select case when token is null or p.name like '%3' then p.name else token end as name, case when token is null then orcid end as orcid, case when token is null then institution end as institution_name from people p left join k on k.name = p.name"),
    "swept_tables": with_sql("records books people affiliations", _TOKENS + """, o as (select l_orderkey as id from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal < 0), b as (select distinct l_partkey as id from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal < 0),
        a as (select distinct id, name from affiliations), p as (select distinct id, name, place from affiliations)
        select 'articles' as name, count(*) as n, count(*) filter (id in (from o)) as with_token, 0 as identified from records union all select 'books', count(*), count(*) filter (id in (from b)), 0 from books
        union all select 'authors', count(*), count(*) filter (name in (select name from k)), 0 from people union all select 'author_article_affiliations', count(*), count(*) filter (name in (select name from k)), 0 from a
        union all select 'article_author_institutions', count(*), count(*) filter (name in (select name from k)), 0 from p union all select 'citations', count(*), count(*) filter (id in (from o)), 0 from records where authors is not null"""),
    "exported_ledger": "select s_name as name, 'Redacted Author ' || substr(sha256(lower(s_name) || '|salt'), 1, 6) as token, '[\"' || upper(s_name) || '\"]' as variants, sha256(lower(s_name) || '|salt') as name_hash from supplier where s_acctbal < 0",
    "clashing_tokens": "select s_name as name, 'Redacted Author ' || substr(sha256(lower(s_name) || '|salt'), 1, case when s_name[-1] in ('4', '8') then 8 else 6 end) as token from supplier where s_acctbal < 0",
    "books_intake": with_sql("books", _TOKENS + ", m as (select map(list(name), list(token)) as m from k) select id, array_to_string(list_transform(string_split(authors, '; '), lambda x: coalesce(m[x], x)), '; ') as authors, array_to_string(list_transform(string_split(editors, '; '), lambda x: coalesce(m[x], x)), '; ') as editors from books, m where record_type = 'book'"),
    "phrase_tags": with_sql("records", """, v as (select distinct p_brand as tag, lower(p_name) as phrase from part), h as (select distinct id, tag from (select id, lower(concat(coalesce(title, ''), ' ', coalesce(abstract, ''))) as t from records) join v on contains(t, phrase))
        select r.id, case when count(tag) > 0 then '|' || string_agg(tag, '|' order by tag) || '|' end as tags from records r left join h using (id) group by r.id"""),
    "merged_ledger": with_sql("people", _TOKENS + " select token, name, '2020' as removed_at from k union all select 'other ' || orcid, name, '2021' from people"),
    "request_steps": """with r as (select case when c_acctbal < 3000 then 'email' else 'orcid' end as method, case when c_acctbal < 1000 or c_acctbal >= 5000 then 'verified' else 'pending' end as status, case when c_acctbal >= 5000 then c_mktsegment = 'BUILDING' end as agrees, c_acctbal >= 1000 and c_acctbal < 3000 as waiting, c_acctbal >= 5000 as o from customer)
        select method, status, agrees, waiting, count(*) as n, count(*) filter (o) as with_orcid from r group by all""",
    "open_enriched": with_sql("records", """, r as (select *, doi is not null and authors is not null as hit from records) select case when hit then coalesce(nullif(abstract, ''), 'found text') else abstract end as abstract,
        case when hit and year > 1997 then 'green' else oa_status end as oa_status, hit and journal = 'BUILDING' as linked, count(*) as n from r group by all"""),
    "open_authorships": with_sql("records authors people", "select institution as place, count(*) as n, count(distinct orcid) as people from (select distinct id, name from authors) a join records r using (id) join people p on p.name = a.name where r.doi is not null group by 1"),
}

"""The scholarly tables, derived from the driver's parquet tables (and as SQL for the oracle)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.session import expire, shared_path

GROUPS = {"AUTOMOBILE": "TPC", "BUILDING": "TPC", "FURNITURE": "RHET_COMP", "HOUSEHOLD": "RHET_COMP"}
#: Named groups of journals that filters may ask for, in the order of the side bar.
CLUSTERS = {"makers": ["AUTOMOBILE", "MACHINERY"], "homes": ["FURNITURE", "HOUSEHOLD", "GARDEN"], "sites": ["BUILDING"]}


@dataclass
class Corpus:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def articles(self) -> DataFrame:
        orders, customer = self.table("orders"), self.table("customer")
        return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
            F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"),
            F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("journal"), F.col("o_orderstatus").alias("source"),
            F.floor(F.col("o_totalprice") / 1000).cast("long").alias("cited_globally"),
        )

    @cached_property
    def citations(self) -> DataFrame:
        """source, target (null where unresolved), doi, ord."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("source"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("target"),
            F.concat(F.lit("ref:"), F.col("l_suppkey")).alias("doi"), F.col("l_linenumber").alias("ord"),
        )

    @cached_property
    def authors(self) -> DataFrame:
        items, suppliers = self.table("lineitem"), self.table("supplier")
        return items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"]).select(
            F.col("l_orderkey").alias("id"), F.col("s_name").alias("name"), F.col("l_linenumber").alias("pos")
        )

    @cached_property
    def affiliations(self) -> DataFrame:
        """id, name and place of each author of an article."""
        items, suppliers = self.table("lineitem"), self.table("supplier")
        return items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"]).select(F.col("l_orderkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("place"))

    @cached_property
    def tags(self) -> DataFrame:
        items, parts = self.table("lineitem"), self.table("part")
        return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("id"), F.col("p_name").alias("tag")).distinct()

    @cached_property
    def works(self) -> DataFrame:
        """Publisher's works: id, type, title, year, parent and citations."""
        items = self.table("lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("cited_by"), F.min(F.year("l_shipdate")).alias("year"))
        parts = self.table("part")
        return parts.join(items, parts["p_partkey"] == items["work"], "left").select(
            F.col("p_partkey").alias("work"), F.col("p_type").alias("type"), F.col("p_name").alias("title"), F.col("p_brand").alias("journal"),
            "year", (F.col("p_partkey") % 40).alias("parent"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"),
        )

    @cached_property
    def work_authors(self) -> DataFrame:
        """work, name, role: a line's number decides whether its supplier wrote or edited."""
        items, suppliers = self.table("lineitem"), self.table("supplier")
        role = F.when(F.col("l_linenumber") == 7, "editor").otherwise("author")
        return items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"]).select(F.col("l_partkey").alias("work"), F.col("s_name").alias("name"), role.alias("role"), F.col("s_nationkey").alias("place")).distinct()

    @cached_property
    def records(self) -> DataFrame:
        """Articles with all that listings show: title, authors, tags, identifiers, abstract, when fetched."""
        orders, customer, items = self.table("orders"), self.table("customer"), self.table("lineitem")
        parts, suppliers = self.table("part").select("p_partkey", "p_name"), self.table("supplier").select("s_suppkey", "s_name")
        lines = items.join(parts, items["l_partkey"] == parts["p_partkey"]).join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"])
        per = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
            F.min_by("p_name", F.struct("l_linenumber", "p_name")).alias("title"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "s_name"))), lambda x: x["s_name"]), "; ").alias("authors"),
            F.concat(F.lit("|"), F.array_join(F.sort_array(F.collect_set("p_name")), "|"), F.lit("|")).alias("tags"),
        )
        base = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
            F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"), F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("journal"),
            F.col("o_orderstatus").alias("source"), F.col("o_orderdate").alias("fetched_at"), F.when(F.col("o_totalprice") >= 50000, F.concat(F.lit("10.1000/A"), "o_orderkey")).alias("doi"),
            F.concat(F.lit("https://x.example/"), "o_orderkey").alias("url"), F.when(F.col("c_acctbal") >= 0, F.col("o_orderpriority")).alias("abstract"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("refs_at"), F.when(F.col("o_orderpriority") < "2", F.lit("gold")).alias("oa_status"),
            F.floor(F.col("o_totalprice") / 1000).cast("long").alias("cited_globally"),
        )
        return base.join(per, "id", "left")

    @cached_property
    def books(self) -> DataFrame:
        """Works as books, chapters and front matter by their size, with joined names."""
        names = lambda role: F.array_join(F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("name")))), "; ").alias(f"{role}s")
        people = self.work_authors.groupBy(F.col("work").alias("id")).agg(names("author"), names("editor"))
        kind = F.when(F.col("p_size") <= 20, "book").when(F.col("p_size") <= 45, "chapter").otherwise("front-matter")
        parts = self.table("part").select(F.col("p_partkey").alias("id"), kind.alias("record_type"), F.col("p_size").alias("pages"))
        works = self.works.select(F.col("work").alias("id"), "title", F.col("type").alias("book_type"), F.col("journal").alias("publisher"), "year", "parent", "cited_by", F.concat(F.lit("10.1000/W"), "work").alias("doi"))
        return works.join(parts, "id").join(people, "id", "left")

    @cached_property
    def people(self) -> DataFrame:
        """Suppliers as known people: name, institution (null where they owe money), orcid."""
        nation, supplier = self.table("nation"), self.table("supplier")
        return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
            F.col("s_name").alias("name"), F.when(F.col("s_acctbal") >= 0, F.col("n_name")).alias("institution"), F.concat(F.lit("0000-"), "s_suppkey").alias("orcid"))

    @cached_property
    def placed(self) -> DataFrame:
        """``work_authors`` whose place is unknown where the supplier owes money."""
        owing = self.table("supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("owing"))
        return self.work_authors.join(owing, "name").withColumn("place", F.when(~F.col("owing"), F.col("place"))).drop("owing")

    @cached_property
    def votes(self) -> DataFrame:
        """Events as votes of readers: article, tag, voter, vote, at, seq."""
        return self.table("events").select(
            F.get_json_object("props", "$.k").try_cast("long").alias("article"), F.col("event_type").alias("tag"), F.col("user_id").alias("voter"),
            F.when(F.col("value") >= 20, 1).otherwise(-1).alias("vote"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        )

    @cached_property
    def listed(self) -> DataFrame:
        """Works as bibliography entries: their names in order, a date where the year is known."""
        people = self.work_authors.groupBy("work").agg(F.array_join(F.sort_array(F.collect_set("name")), "; ").alias("authors"))
        return self.works.join(people, "work", "left").select(
            "work", F.concat(F.lit("https://doi.example/"), "work").alias("url"), F.concat(F.lit("10.1000/W"), "work").alias("doi"), "title", "journal",
            F.concat("year", F.lit("-01-01")).alias("pub_date"), "type", "authors",
        )

    def deposit(self) -> str:
        """The listed works as a registration agency's JSON lines, in the shared folder."""
        path = shared_path(self.spark, "deposit")
        name = F.transform(F.split("authors", "; "), lambda a: F.struct(F.lit(None).cast("string").alias("given"), a.alias("family")))
        date = F.struct(F.array(F.array(F.substring("pub_date", 1, 4).cast("int"))).alias("date-parts"))
        rows = self.listed.select(F.col("doi").alias("DOI"), F.col("url").alias("URL"), F.array("title").alias("title"), F.array("journal").alias("container-title"), "type", name.alias("author"), date.alias("issued"))
        rows.write.json(path)
        expire(self.spark, path)
        return path

    @cached_property
    def titled(self) -> DataFrame:
        """Documents as harvested records: the first line is the title, thousands of characters the year."""
        return self.table("documents").where("text is not null").select(
            F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.floor(F.col("n_chars") / 1000).alias("year"), "source",
            F.when(F.col("lang") != "", 1).otherwise(0).alias("filled"),
        )

    @cached_property
    def inverted(self) -> DataFrame:
        """Benchmark texts as inverted indexes: word to positions."""
        words = self.table("benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([^\s]+)"), F.lit(1))).alias("p", "w"))
        by = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps"))
        return by.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))


#: The same tables in SQL; a query's oracle starts with the ones it names.
SQL = {
    "articles": """articles as (select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as pub_date, year(o_orderdate)::int as year,
        c_mktsegment as journal, o_orderstatus as source, floor(o_totalprice / 1000)::bigint as cited_globally
        from orders join customer on o_custkey = c_custkey)""",
    "citations": """citations as (select l_orderkey as source, case when l_returnflag <> 'R' then l_partkey end as target,
        concat('ref:', l_suppkey) as doi, l_linenumber as ord from lineitem)""",
    "authors": "authors as (select l_orderkey as id, s_name as name, l_linenumber as pos from lineitem join supplier on l_suppkey = s_suppkey)",
    "affiliations": "affiliations as (select l_orderkey as id, s_name as name, s_nationkey as place from lineitem join supplier on l_suppkey = s_suppkey)",
    "placed": """placed as (select distinct l_partkey as work, s_name as name, case when l_linenumber = 7 then 'editor' else 'author' end as role,
        case when s_acctbal >= 0 then s_nationkey end as place from lineitem join supplier on l_suppkey = s_suppkey)""",
    "votes": """votes as (select try_cast(json_extract_string(props, '$.k') as bigint) as article, event_type as tag, user_id as voter,
        case when value >= 20 then 1 else -1 end as vote, ts, event_id as seq from events)""",
    "records": """records as (select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as pub_date, year(o_orderdate)::int as year, c_mktsegment as journal, o_orderstatus as source, o_orderdate as fetched_at,
        case when o_totalprice >= 50000 then concat('10.1000/A', o_orderkey) end as doi, concat('https://x.example/', o_orderkey) as url, case when c_acctbal >= 0 then o_orderpriority end as abstract,
        case when o_orderstatus <> 'O' then o_orderdate end as refs_at, case when o_orderpriority < '2' then 'gold' end as oa_status, floor(o_totalprice / 1000)::bigint as cited_globally, title, authors, tags
        from orders join customer on o_custkey = c_custkey left join (select l_orderkey as k, arg_min(p_name, (l_linenumber, p_name)) as title, string_agg(s_name, '; ' order by l_linenumber, s_name) as authors,
        '|' || array_to_string(list_sort(list(distinct p_name)), '|') || '|' as tags from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1) on k = o_orderkey)""",
    "books": """books as (select p_partkey as id, p_name as title, p_type as book_type, p_brand as publisher, y as year, p_partkey % 40 as parent, coalesce(n, 0) as cited_by, concat('10.1000/W', p_partkey) as doi,
        case when p_size <= 20 then 'book' when p_size <= 45 then 'chapter' else 'front-matter' end as record_type, p_size as pages, authors, editors from part left join
        (select l_partkey as k, count(*) as n, min(year(l_shipdate))::int as y, coalesce(array_to_string(list_sort(list(distinct s_name) filter (l_linenumber <> 7)), '; '), '') as authors,
        coalesce(array_to_string(list_sort(list(distinct s_name) filter (l_linenumber = 7)), '; '), '') as editors from lineitem join supplier on l_suppkey = s_suppkey group by 1) on k = p_partkey)""",
    "people": "people as (select s_name as name, case when s_acctbal >= 0 then n_name end as institution, concat('0000-', s_suppkey) as orcid from supplier join nation on s_nationkey = n_nationkey)",
    "tags": "tags as (select distinct l_orderkey as id, p_name as tag from lineitem join part on l_partkey = p_partkey)",
    "works": """works as (select p_partkey as work, p_type as type, p_name as title, p_brand as journal, y as year, p_partkey % 40 as parent, coalesce(n, 0) as cited_by
        from part left join (select l_partkey as k, count(*) as n, min(year(l_shipdate))::int as y from lineitem group by 1) on k = p_partkey)""",
    "work_authors": """work_authors as (select distinct l_partkey as work, s_name as name, case when l_linenumber = 7 then 'editor' else 'author' end as role,
        s_nationkey as place from lineitem join supplier on l_suppkey = s_suppkey)""",
    "grouped": """grouped as (select *, case when journal in ('AUTOMOBILE', 'BUILDING') then 'TPC' when journal in ('FURNITURE', 'HOUSEHOLD') then 'RHET_COMP' else 'OTHER' end as grp from articles)""",
    "edges": """edges as (select c.source, c.target, s.year as sy, t.year as ty, s.grp as sg, t.grp as tg, s.journal as sj, t.journal as tj
        from citations c join grouped s on s.id = c.source join grouped t on t.id = c.target)""",
    "degrees": """degrees as (select a.id, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out from articles a
        left join (select target as id, count(*) as n_in from citations where target is not null group by 1) using (id)
        left join (select source as id, count(*) as n_out from citations where target is not null group by 1) using (id))""",
}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    needs = names.split()
    if "edges" in needs:
        needs = ["articles", "citations", "grouped", *(n for n in needs if n not in ("articles", "citations", "grouped"))]
    elif "grouped" in needs and "articles" not in needs:
        needs = ["articles", *needs]
    if "degrees" in needs:
        needs = [n for n in needs if n not in ("articles", "citations", "degrees")]
        needs = ["articles", "citations", *[n for n in needs if n != "degrees"], "degrees"]
    return f"with {'recursive ' * recursive}" + ",\n".join(SQL[n] for n in dict.fromkeys(needs)) + f"\n{body.lstrip()}"

"""How complete the index is, journal by journal, and the reports of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.functions.values import percent


def _some(c: str) -> Column:
    return F.count(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1))


def per_journal(records: DataFrame, citations: DataFrame, year_min: int | None = None) -> DataFrame:
    """One row per journal: sources, identifiers, abstracts, fetched references, links both ways and
    what they come to in percent, and how articles sit in the network: isolates (no links at all, not
    even unresolved ones), pure sources (only citing), pure sinks (only cited), hubs.

    ``year_min`` limits the articles that count, not the links between them.
    """
    kept = records if year_min is None else records.where(F.substring("pub_date", 1, 4) >= str(year_min))
    home = records.select("id", "journal")
    own = kept.select("id", "journal")
    out = citations.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("raw"), F.count("target").alias("links"))
    into = citations.where("target is not null").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("links_in"))
    same = citations.join(home.select(F.col("id").alias("source"), F.col("journal").alias("sj")), "source").join(home.select(F.col("id").alias("target"), F.col("journal").alias("tj")), "target")
    same = same.where("sj = tj").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("same"))
    rows = kept.join(out, "id", "left").join(into, "id", "left").join(same, "id", "left")
    has_out, has_in = F.col("raw").isNotNull(), F.col("links_in").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = rows.groupBy("journal").agg(
        F.count("*").alias("articles"), F.min(F.substring("pub_date", 1, 4)).alias("first_year"), F.max(F.substring("pub_date", 1, 4)).alias("last_year"),
        _some("doi").alias("with_doi"), _some("abstract").alias("with_abstract"), F.count("refs_at").alias("refs_tried"), n(F.coalesce(F.col("links"), F.lit(0)) > 0).alias("citing"),
        total("raw").alias("raw_out"), total("links").alias("resolved_out"), n(has_in).alias("cited"), total("links_in").alias("n_in"), total("same").alias("to_itself"),
        total("cited_globally").alias("cited_globally"), n(~has_out & ~has_in).alias("isolates"), n(has_out & ~has_in).alias("pure_sources"), n(~has_out & has_in).alias("pure_sinks"), n(has_out & has_in).alias("hubs"),
    )
    shares = {"doi_pct": ("with_doi", "articles"), "abstract_pct": ("with_abstract", "articles"), "tried_pct": ("refs_tried", "articles"), "yield_pct": ("citing", "refs_tried"), "resolved_pct": ("resolved_out", "raw_out"), "itself_pct": ("to_itself", "resolved_out")}
    return found.select("*", *(percent(F.col(a), F.col(b)).alias(name) for name, (a, b) in shares.items()))


def by_source(records: DataFrame) -> DataFrame:
    """Articles per journal and source."""
    return records.groupBy("journal", "source").agg(F.count("*").alias("n"))


def global_counts(records: DataFrame) -> DataFrame:
    """One row: how many articles have a doi and citations elsewhere, their mean and the most."""
    known = F.when(F.col("cited_globally") > 0, F.col("cited_globally"))
    return records.agg(F.count("*").alias("articles"), _some("doi").alias("with_doi"), F.count("cited_globally").alias("with_count"), F.count(known).alias("cited"), F.round(F.avg(known), 6).alias("mean"), F.max("cited_globally").alias("most"))


def write_csv(report: DataFrame, path: str) -> None:
    """The report with a header; one row per journal, so one file."""
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(report: DataFrame, columns: list[str]) -> DataFrame:
    """The report as lines of a Markdown table, in the order of ``line``."""
    head = report.sparkSession.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, f"|{'---|' * len(columns)}")], "line long, text string")
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    order = F.row_number().over(_largest_first()) + 1
    return head.union(report.select(order.cast("long"), F.concat(F.lit("| "), F.array_join(F.array(*cell), " | "), F.lit(" |"))))


def _largest_first():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("articles"), "journal")  # a report's rows: one per journal

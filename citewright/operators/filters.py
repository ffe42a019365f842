"""One filter for listings, networks and chapter tools: words, journals, clusters, source, years, tag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.functions.names import unused
from citewright.functions.values import leading_int
from citewright.operators.search import matches


def has_tag(tags: Column, tag: str) -> Column:
    """Whether |a|b| holds a whole entry, in any case."""
    return F.coalesce(F.contains(F.lower(tags), F.lit(f"|{tag.lower()}|")), F.lit(False))


@dataclass(frozen=True)
class Filter:
    """What to keep; parts that are None keep everything.

    ``years`` says how dates compare: "text" compares date texts (a year alone comes before its first
    day), "number" the leading number, "digits" the first four characters. ``journals`` overrides
    ``cluster``, a name in the clusters that are handed over with the articles.
    """

    query: str | None = None
    journals: tuple[str, ...] | None = None
    cluster: str | None = None
    source: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    tag: str | None = None
    years: str = "text"

    def ordered(self) -> Filter:
        """The same with a reversed range of years put right."""
        if self.year_from is not None and self.year_to is not None and self.year_from > self.year_to:
            return Filter(self.query, self.journals, self.cluster, self.source, self.year_to, self.year_from, self.tag, self.years)
        return self

    def apply(self, articles: DataFrame, texts: tuple[str, ...] = ("title", "authors", "abstract"), clusters: dict[str, list[str]] | None = None, approved: DataFrame | None = None) -> DataFrame:
        """The rows of ``articles`` that pass; ``approved(article, tag)`` are readers' tags that count too."""
        if self.query:
            articles = articles.where(matches(self.query, **{t: F.col(t) for t in texts}))
        journals = self.journals or (tuple((clusters or {}).get(self.cluster, ())) if self.cluster else None)
        if journals is not None:
            articles = articles.where(F.col("journal").isin(list(journals)))
        if self.source:
            articles = articles.where(F.col("source") == self.source)
        date = F.col("pub_date")
        lower, upper, edge = {
            "text": (date, date, ("{}-01-01", "{}-12-31")),
            "number": (leading_int(date), leading_int(date), None),
            "digits": (F.substring(date, 1, 4), F.substring(date, 1, 4), ("{}", "{}")),
        }[self.years]
        if self.year_from is not None:
            articles = articles.where(lower >= F.lit(edge[0].format(self.year_from) if edge else self.year_from))
        if self.year_to is not None:
            articles = articles.where(upper <= F.lit(edge[1].format(self.year_to) if edge else self.year_to))
        if self.tag:
            own = has_tag(F.col("tags"), self.tag)
            if approved is None:
                articles = articles.where(own)
            else:
                (mark,) = unused(["approved_id"], articles)
                ids = approved.where(F.col("tag") == self.tag.lower()).select(F.col("article").alias(mark)).distinct()
                articles = articles.join(ids, F.col("id") == F.col(mark), "left").where(own | F.col(mark).isNotNull()).drop(mark)
        return articles


def citations_within(citations: DataFrame, articles: DataFrame, both: bool = True) -> DataFrame:
    """Resolved links whose citing article is in ``articles``, and the cited one too if ``both``."""
    ids = articles.select("id")
    links = citations.where("target is not null").join(ids, citations["source"] == ids["id"], "left_semi")
    return links.join(ids, links["target"] == ids["id"], "left_semi") if both else links

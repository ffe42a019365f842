"""Article rows as BibTeX and RIS entries, and as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.functions.values import split_list


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def _last_and_first() -> tuple[Column, Column]:
    """The last word of the first author and the first word of the title; their stand-ins if missing."""
    author = F.trim(F.element_at(F.split(_text("authors"), ";"), 1))
    named = F.when(author != "", _bare(F.element_at(F.split(author, r"\s+"), -1)))
    title = F.trim(_text("title"))
    worded = F.when(title != "", _bare(F.element_at(F.split(title, r"\s+"), 1)))
    return F.coalesce(named, F.lit("unknown")), F.coalesce(worded, F.lit("untitled"))


def bibtex_key() -> Column:
    last, word = _last_and_first()
    return F.concat(last, F.substring(_text("pub_date"), 1, 4), word)


def bibtex() -> Column:
    """An @article entry of the columns title, authors, pub_date, journal, doi and url; braces in
    titles are doubled, empty optional fields stay away."""
    field = lambda label, value: F.concat(F.lit(f"  {label:<7} = {{"), value, F.lit("},"))
    given = lambda label, value: F.when(value != "", field(label, value))
    title = F.regexp_replace(_text("title"), r"([{}])", "$1$1")
    authors = F.array_join(split_list(F.col("authors")), " and ")
    lines = [
        F.concat(F.lit("@article{"), bibtex_key(), F.lit(",")), given("author", authors), field("title", title), field("journal", _text("journal")),
        given("year", F.substring(_text("pub_date"), 1, 4)), given("doi", _text("doi")), given("url", _text("url")), F.lit("}"),
    ]
    return F.concat_ws("\n", *lines)


def ris() -> Column:
    tagged = lambda tag, value: F.concat(F.lit(f"{tag}  - "), value)
    given = lambda tag, value: F.when(value != "", tagged(tag, value))
    people = F.transform(split_list(F.col("authors")), lambda a: tagged("AU", a))
    lines = [
        F.lit("TY  - JOUR"), F.when(F.size(people) > 0, F.array_join(people, "\n")), tagged("TI", _text("title")), tagged("JO", _text("journal")),
        given("PY", F.substring(_text("pub_date"), 1, 4)), given("DO", _text("doi")), given("UR", _text("url")), F.lit("ER  - "),
    ]
    return F.concat_ws("\n", *lines)


def write_entries(articles: DataFrame, entry: Column, path: str) -> None:
    """One text file per partition, entries apart by an empty line."""
    articles.select(F.concat(entry, F.lit("\n"))).write.text(path)


def display_date(date: Column) -> Column:
    """'Mon yyyy' of a date with a month, the year alone otherwise, '' of nothing."""
    month = F.try_to_timestamp(F.concat(F.substring(date, 1, 7), F.lit("-01")), F.lit("yyyy-MM-dd"))
    return F.when(F.coalesce(date, F.lit("")) == "", "").otherwise(F.coalesce(F.date_format(month, "MMM yyyy"), F.element_at(F.split(date, "-"), 1)))

"""Value rules of the scholarly record: years, delimited lists, ranks and rounding."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def year_of(date: Column) -> Column:
    """The first four characters as a number, or null."""
    return F.substring(date, 1, 4).try_cast("int")


def leading_int(text: Column) -> Column:
    """The numeric prefix of a text, 0 if it has none; null stays null."""
    found = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.when(text.isNotNull(), F.coalesce(found, F.lit(0)))


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def split_list(text: Column, separator: str = ";") -> Column:
    """Trimmed, non-empty entries of a delimited text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def ordinal(*order: Column, by: tuple[str, ...] = ()) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100 * part / whole, 1))


def slug(text: Column, length: int = 40) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.rtrim(F.substring(F.trim(dashed, F.lit("-")), 1, length), F.lit("-"))


def norm_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def normal_tag(text: Column) -> Column:
    """A reader's tag: bars become spaces, control and angle characters go, single spaces, lower case."""
    plain = F.regexp_replace(F.translate(text, "|", " "), r"[\x00-\x1f\x7f<>]", "")  # fixed: the characters that tags never hold
    return F.lower(F.trim(F.regexp_replace(plain, " +", " ")))


def period_label(date: Column) -> Column:
    """2001-07-15 or 2001-07 as July 2001, a year alone as it is."""
    month = F.try_to_timestamp(F.concat(F.substring(date, 1, 7), F.lit("-01")), F.lit("yyyy-MM-dd"))
    return F.when(F.length(date) >= 7, F.coalesce(F.date_format(month, "MMMM yyyy"), date)).otherwise(date)


def reference_key(text: Column) -> Column:
    """A key for a reference without a doi."""
    return F.concat(F.lit("ref:"), F.substring(F.md5(text), 1, 12))


def raw_doi(text: Column) -> Column:
    """A stand-in doi for a raw reference."""
    return F.concat(F.lit("raw:"), F.substring(F.sha2(text, 256), 1, 16))

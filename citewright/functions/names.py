"""Names for helper columns that clash with none of a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(wanted: list[str], *tables: DataFrame) -> list[str]:
    """``wanted`` with underscores added until no table has a column of that name in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

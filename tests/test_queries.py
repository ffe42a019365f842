"""Every registered scholarly query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from citewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_slug_reads_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, "-" * 300 + " The Title")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["slug"] for r in registry.queries()["title_slug"](spark, str(tmp_path)).collect()] == ["the-title"]

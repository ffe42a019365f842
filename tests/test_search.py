import random
import sqlite3

import pytest

from citewright.operators.search import SearchIndex, matches, parse
from pyspark.sql import functions as F

COLUMNS = ("title", "authors", "abstract")
WORDS = ["genre", "genres", "pedagogy", "writing", "the", "of", "Theory", "naïve", "Ünder", "x", "y", "zebra", "1999", "co-op"]
QUERIES = [
    "genre", "gen peda", "writing the", "x-ray co-op", "nothing at all", "  ", '""', '"!!"', 'x "!!" AND y',
    "x AND (y OR zebra)", "x AND y OR zebra", "x OR y AND zebra", "x NOT y zebra", "x y NOT zebra", "x NOT y NOT zebra", "x AND y NOT zebra OR genre AND the ",
    '"x y"', '"writing the" OR "of x"', '"gen" *', "gen* AND zeb*", '"the gen"* OR x', "x + y", "writing + the + gen* OR zebra + x",
    "title : x AND x*", "title : (x OR y) NOT authors : zebra AND x*", "- title : x AND x*", "{title authors} : x AND y*", "- {title abstract} : (x OR y) AND x*", '"title" : "x y" OR y*', "title : x y* the",
    "title : (authors : x OR y*)", "^ x OR zebra*", "title : ^ genre OR zebra*", '^ "the genre"* OR zebra', "x ^ y AND y*",
    "NEAR(x y) AND x*", "NEAR(x y, 0) AND x*", "NEAR(x y zebra, 3) OR 1999", 'NEAR("x y" the, 2) OR 1999', "NEAR(x x, 1) AND x*", "title : NEAR(x y, 4) OR 1999", "NEAR AND x", "NEAR(x, 5) AND y*",
    "NAIVE OR under", 'title : "naive" OR "ÜNDER"', "TITLE : x AND y*", "x and y*",
]
WRONG = ['"', "x* AND ", "x AND (y OR z*", "nowhere : x*", "(x OR y) z*", "x (y) OR z", 'a - b "c"', "NEAR(x y, z) OR q*", "AND x*", "x OR OR y*", "* x", 'x " y', "x.y AND z*", "title : OR x", "- x*", "{title : x*", "x) OR y*"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)

    def text():
        return None if rng.random() < 0.1 else " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(rng.choice([0, 1, 2, 5, 12, 30])))

    return [(k, text(), text(), text()) for k in range(160)]


@pytest.fixture(scope="module")
def truth(rows):
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(title, authors, abstract)")
    base.executemany("insert into t (rowid, title, authors, abstract) values (?, ?, ?, ?)", rows)
    return base


def library(base, query):
    """What FTS5 finds, with the plain queries turned into prefixes."""
    query = query.strip()
    if not query:
        return set()
    if not any(m in query for m in ('"', "*", " AND ", " OR ", " NOT ")):
        query = " ".join(f'"{w}"*' for w in query.split())
    return {r[0] for r in base.execute("select rowid from t where t match ?", (query,))}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, authors string, abstract string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    made = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), COLUMNS)
    made.add(table(spark, rows).unionByName(table(spark, [(None, "x", "y", "zebra"), rows[3]])))
    return made


def test_index_equals_fts5(index, truth):
    for query in QUERIES:
        assert sorted(r["id"] for r in index.search(query).collect()) == sorted(library(truth, query)), query


def test_rows_equal_fts5(spark, rows, truth):
    own = table(spark, rows)
    asked = own.select("id", *(F.coalesce(matches(q, **{c: F.col(c) for c in COLUMNS}), F.lit(False)).alias(f"q{k}") for k, q in enumerate(QUERIES))).collect()
    for k, query in enumerate(QUERIES):
        assert {r["id"] for r in asked if r[f"q{k}"]} == library(truth, query), query


def test_wrong_queries_are_errors(truth):
    for query in WRONG:
        with pytest.raises(sqlite3.OperationalError):
            library(truth, query)
        with pytest.raises(ValueError):
            parse(query, COLUMNS)


def test_random_trees_equal_fts5(index, truth):
    rng = random.Random(9)

    def leaf():
        word = rng.choice(["x", "y", "the", "gen*", "zebra", '"of x"', "NEAR(x the, 3)", "title : y", "- authors : writing", "^ x"])
        return " ".join([word] * 1 + ([rng.choice(["y", "pedagogy", "the*"])] if rng.random() < 0.3 else []))

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return leaf()
        return f" {rng.choice(['AND', 'OR', 'NOT'])} ".join(f"({tree(depth - 1)})" if rng.random() < 0.4 else tree(depth - 1) for _ in range(rng.randint(2, 3)))

    for _ in range(12):
        query = tree(3) + " OR 1999*"
        assert {r["id"] for r in index.search(query).collect()} == library(truth, query), query


def test_batches_replace_and_forget(spark, rows, truth, tmp_path):
    index = SearchIndex(spark, str(tmp_path), COLUMNS)
    assert index.search("x").count() == 0
    index.add(table(spark, rows))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "postings/batch=0").iterdir()}
    changed = [(k, "fresh zebra", None, "x") for k in (1, 2, 500)]
    index.add(table(spark, changed), removed=table(spark, rows[10:12]))
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(title, authors, abstract)")
    now = {r[0]: r for r in rows if r[0] not in (10, 11)} | {r[0]: r for r in changed}
    base.executemany("insert into t (rowid, title, authors, abstract) values (?, ?, ?, ?)", now.values())
    for query in ("x", "zebra", '"fresh zebra"', "x NOT fresh"):
        assert {r["id"] for r in index.search(query).collect()} == library(base, query)
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "postings/batch=0").iterdir()}
    # A batch without its mark isn't there, and the next one takes its place.
    (tmp_path / "batches/1").unlink()
    assert {r["id"] for r in index.search("fresh").collect()} == set()
    index.add(table(spark, [(600, "late", None, None)]))
    assert {r["id"] for r in index.search("late OR fresh").collect()} == {600}


def test_scan_reads_only_the_asked_terms(index):
    plan = index.search("title : (x OR zeb*)")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,zeb)" in plan and "EqualTo(term,x)" in plan and plan.count("Exchange hashpartitioning") == 1

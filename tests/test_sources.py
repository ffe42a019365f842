"""Readers, exports and merging on small files and rows."""

import json

from pyspark.sql import functions as F

from citewright.functions import cleaning
from citewright.operators import coverage
from citewright.operators import merging as M
from citewright.sources import exports as E
from citewright.sources import works as W

ITEMS = [
    {"DOI": "10.1/A ", "title": ["Genre"], "subtitle": ["A <i>view</i>"], "author": [{"given": "Ann", "family": "Lee"}, {"family": "Roe"}], "published-print": {"date-parts": [[2014, 3]]}, "container-title": ["J"],
     "abstract": "<jats:p>Text &amp; more</jats:p>", "ISBN": ["1", "9780000000001"], "reference": [{"DOI": "10.2/X"}, {"unstructured": "Roe. see 10.3000/Yy."}, {"unstructured": "Roe, “A long enough title here”, 1999"}, {"key": "k"}]},
    {"DOI": "10.1/b", "title": ["Plain: a view"], "subtitle": ["A View"], "author": [], "issued": {"date-parts": [[None]]}},
]


def test_deposited_works(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps({"message": {"items": ITEMS}}, indent=1))
    works = W.deposited_works(spark, str(tmp_path))
    a, b = sorted(works.collect(), key=lambda r: r["doi"])
    assert (a["doi"], a["title"], a["authors"], a["abstract"], a["pub_date"], a["isbn"]) == ("10.1/a", "Genre: A view", "Ann Lee; Roe", "Text & more", "2014-03-01", "9780000000001")
    assert (b["title"], b["authors"], b["pub_date"]) == ("Plain: a view", None, None)
    refs = W.references(works).orderBy("ord").collect()
    assert [r["doi"] for r in refs[:2]] == ["10.2/x", "10.3000/yy"] and refs[2]["doi"].startswith("ref:") and refs[3]["doi"] is None
    articles = spark.createDataFrame([(1, "10.2/X", "t"), (2, None, "A long enough title: here")], "id long, doi string, title string")
    assert [r["target"] for r in W.resolve(W.references(works), articles).orderBy("ord").collect()] == [1, None, 2, None]


def test_feeds(spark, tmp_path):
    long = "word " * 500
    (tmp_path / "f.xml").write_text(
        '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>One</title><link> https://x/10.5/abc </link><pubDate>Mon, 03 Feb 2020 10:00:00 GMT</pubDate>'
        f"<dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator><description>&lt;p&gt;{long}&lt;/p&gt;</description></item><item><title>Two</title><description>short</description></item></channel></rss>"
    )
    one, two = sorted(W.feed_items(spark, str(tmp_path / "f.xml"), "J").collect(), key=lambda r: r["title"])
    assert (one["authors"], one["pub_date"], one["url"], two["abstract"], two["pub_date"]) == ("Ann; Bob", "2020-02-03", "https://x/10.5/abc", None, None)
    assert len(one["abstract"]) <= 2001 and one["abstract"].endswith("word…")
    (tmp_path / "o.xml").write_text(
        '<ListRecords><record><metadata><oai_dc:dc xmlns:oai_dc="a" xmlns:dc="b"><dc:title>T</dc:title><dc:creator>C, D</dc:creator><dc:date>2019</dc:date><dc:identifier>https://doi.org/10.1234/Q.</dc:identifier></oai_dc:dc></metadata></record>'
        '<record><metadata><oai_dc:dc xmlns:oai_dc="a" xmlns:dc="b"><dc:title>Cover</dc:title></oai_dc:dc></metadata></record></ListRecords>'
    )
    (row,) = W.oai_records(spark, str(tmp_path / "o.xml"), "J").collect()
    assert (row["title"], row["authors"], row["pub_date"], row["doi"]) == ("T", "C, D", "2019", "10.1234/q")


def test_table_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Title,Who\n"A ""b""",X\n,Y\n')
    (row,) = W.table_rows(spark, str(tmp_path / "t.csv"), {"title": "Title", "authors": "Who"}, "J").collect()
    assert (row["title"], row["authors"], row["journal"], row["doi"]) == ('A "b"', "X", "J", None)


def test_decoded_abstract(spark):
    row = spark.sql("select map('a', array(0, 2), 'b', array(1)) as m, cast(null as map<string, array<int>>) as n").select(W.decoded_abstract(F.col("m")), W.decoded_abstract(F.col("n"))).first()
    assert tuple(row) == ("a b a", None)


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("The {X}", "Ann Lee; Bob", "2014-01", "J", None, ""), (None, None, None, None, "d", "u")], "title string, authors string, pub_date string, journal string, doi string, url string")
    full, bare = (r[0] for r in rows.select(E.bibtex()).collect())
    assert full == "@article{lee2014the,\n  author  = {Ann Lee and Bob},\n  title   = {The {{X}}},\n  journal = {J},\n  year    = {2014},\n}"
    assert bare.startswith("@article{unknownuntitled,\n  title   = {},")
    assert rows.select(E.ris()).first()[0] == "TY  - JOUR\nAU  - Ann Lee\nAU  - Bob\nTI  - The {X}\nJO  - J\nPY  - 2014\nER  - "
    E.write_entries(rows, E.ris(), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value like 'ER%'").count() == 2
    dates = spark.createDataFrame([("2014-03-01",), ("2014",), (None,), ("2014-99",)], "d string")
    assert [r[0] for r in dates.select(E.display_date(F.col("d"))).collect()] == ["Mar 2014", "2014", "", "2014"]


def test_merging(spark):
    rows = spark.createDataFrame(
        [(1, "Genre Now", 2001, "crossref", 3), (2, "From the Editors", 2001, "crossref", 3), (3, "From the Editors", 2002, "crossref", 3), (4, "Rhetoric and its long tradition", 1999, "crossref", 3),
         (11, "genre now!", 2001, "rss", 1), (12, "Genre now", 1990, "rss", 1), (13, "From the editors", 2002, "rss", 1), (14, "From the editors", 2009, "rss", 1), (15, "Book Review: Genre Now", None, "rss", 1),
         (16, "Rhetoric and its long tradition: a view", 1980, "scrape", 1), (17, "Lone", 2000, "rss", 1), (18, "lone", 2000, "scrape", 2), (19, None, None, "rss", 0), (20, "Rhetoric", 1999, "rss", 0), (21, "Rhetoric", 1998, "rss", 0)],
        "id long, title string, year int, source string, filled int",
    )
    got = {r["duplicate"]: (r["canonical"], r["stage"]) for r in M.match_cascade(rows).collect()}
    assert got == {11: (1, 1), 12: (1, 2), 13: (3, 1), 15: (1, 6), 16: (4, 3), 17: (18, 9), 20: (4, 3)}
    people = spark.createDataFrame([(1, None, "a"), (2, "x", ""), (3, "y", "b")], "id long, doi string, note string")
    merges = spark.createDataFrame([(1, 2), (1, 3)], "canonical long, duplicate long")
    assert [tuple(r) for r in M.apply_merges(people, merges, ["doi", "note"]).collect()] == [(1, "x", "a")]
    links = M.repoint(spark.createDataFrame([(2, 9), (9, 3), (9, None)], "source long, target long"), merges)
    assert sorted(map(tuple, links.select("source", "target").collect()), key=str) == [(1, 9), (9, 1), (9, None)]
    old, new = spark.createDataFrame([(1, None, "a")], "id long, doi string, note string"), spark.createDataFrame([(1, "d", "z"), (5, "e", None)], "id long, doi string, note string")
    assert sorted(map(tuple, M.upsert_fill(old, new, "id", ["doi"]).collect())) == [(1, "d", "a"), (5, "e", None)]


def test_reports_and_kinds_of_books(spark, tmp_path):
    report = spark.createDataFrame([("B, C", 2, 0.5), ("A", 1, None)], "journal string, n int, share double").repartition(2)
    coverage.write_csv(report, str(tmp_path / "report"))
    coverage.write_csv(report, str(tmp_path / "report"))  # again, in its place
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "report"), header=True).collect()} == {("B, C", "2", "0.5"), ("A", "1", None)}
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1
    kinds = spark.createDataFrame([("edited-book", False), ("book", True), ("book", False), ("monograph", True), (None, False)], "t string, e boolean")
    assert [r[0] for r in kinds.select(cleaning.book_type(F.col("t"), F.col("e"))).collect()] == ["edited-collection", "edited-collection", "monograph", "monograph", "monograph"]


def test_long_titles_leave_their_task_as_keys(spark):
    words = [f"w{k}" for k in range(20_000)]  # a start for every word: 20,000 copies of 130 KB were one row each
    rows = spark.createDataFrame([(1, " ".join(words[:900]), 2001, "crossref", 1), (2, " ".join(words), 2001, "rss", 1), (3, "w0 w1", 1999, "rss", 1)], "id long, title string, year int, source string, filled int")
    got = M.match_cascade(rows)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 3)}
    pairs = M._extends(rows.where("id = 2").select("title"), rows.select(M._key(F.col("title")).alias("t")))
    assert pairs.count() == 2 and max(len(v) for r in pairs.collect() for v in r) == M.KEY

import random
import re

from pyspark.sql import functions as F

from citewright.operators import pages as P
from citewright.operators import phrases as H
from citewright.operators import removal as D

LEDGER = "token string, name string, variants string"


def test_names_without_case_and_blanks(spark):
    names = ["Jane Smith", " jane \t smith.;", "JANE SMITH", "Straße", "STRASSE", "ﬁnn", "Οδυσσεύς", "ΟΔΥΣΣΕΎΣ", "Jane　 Smith ,", "\x1cJane\x1fSmith", "", None, "İpek 𝒳"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    got = [r["n"] for r in rows.select("k", D.normal_name(F.col("n")).alias("n")).orderBy("k").collect()]
    assert got == [None if n is None else re.sub(r"\s+", " ", n).strip(" \t\r\n.,;").casefold() for n in names]


def test_removed_people_are_gone_whatever_blanks_they_have(spark):
    ledger = spark.createDataFrame([("Redacted Author aaaaaa", "Jane Smith", '["Groß, J."]')], LEDGER)
    rows = spark.createDataFrame([(1, "Jane Smith; Bo"), (2, "GROSS, J.;Al "), (3, "Al ;Bo")], "id int, authors string")
    got = {r["id"]: r["authors"] for r in D.replace_in_lists(rows, "authors", ledger).collect()}
    assert got == {1: "Redacted Author aaaaaa; Bo", 2: "Redacted Author aaaaaa; Al", 3: "Al ;Bo"}


def tables(spark):
    row = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "articles": row([(1, "Jane Smith; Bo"), (2, "Bo")], "id int, authors string"),
        "books": row([(1, "Bo", "Jane  Smith"), (2, None, None)], "id int, authors string, editors string"),
        "authors": row([("Jane Smith", "o", "x", "I"), ("Smith, J.", "p", None, None), ("Bo", "q", "y", "J")], "name string, orcid string, openalex_id string, institution_name string"),
        "author_article_affiliations": row([(1, "Jane Smith", "x"), (1, "Smith, J.", "x"), (1, "Bo", "y")], "article_id int, author_name string, openalex_author_id string"),
        "article_author_institutions": row([(1, "Jane Smith", "x", "I"), (1, "Smith, J.", "x", "J")], "article_id int, author_name string, openalex_author_id string, institution_id string"),
        "citations": row([(1, "See Jane Smith (1999) and Smith, J. et al; Jane Smithson"), (2, None)], "id int, raw_reference string"),
    }


def test_one_sweep_of_all_tables_and_back(spark):
    token, other = "Redacted Author aaaaaa", "Redacted Author aaaaaa11"
    ledger = spark.createDataFrame([(token, "Jane Smith", '["Smith, J."]'), (other, "Other One", None)], LEDGER)
    swept = D.sweep(tables(spark), ledger)
    rows = lambda name, tables=swept: sorted(map(tuple, tables[name].collect()), key=str)
    assert rows("articles") == [(1, f"{token}; Bo"), (2, "Bo")] and rows("books") == [(1, "Bo", token), (2, None, None)]
    assert rows("authors") == [("Bo", "q", "y", "J"), (token, None, None, None)]
    assert rows("author_article_affiliations") == [(1, "Bo", "y"), (1, token, None)]
    assert rows("article_author_institutions") == [(1, token, None, "I"), (1, token, None, "J")]
    assert rows("citations") == [(1, f"See {token} (1999) and Smith, J. et al; Jane Smithson"), (2, None)]
    for name, again in D.sweep(swept, ledger).items():
        assert sorted(map(tuple, again.collect()), key=str) == rows(name)
    for name in swept:
        assert "Jane Smith;" not in str(rows(name)) and "'Jane Smith'" not in str(rows(name))
    back, left = D.undo(swept, ledger, ledger.where(F.col("token") == token))
    assert rows("articles", back) == [(1, "Jane Smith; Bo"), (2, "Bo")] and rows("authors", back) == [("Bo", "q", "y", "J"), ("Jane Smith", None, None, None)]
    assert [r["token"] for r in left.collect()] == [other]


def test_longer_tokens_are_restored_first(spark):
    ledger = spark.createDataFrame([("Redacted Author aaaaaa", "Jane", None), ("Redacted Author aaaaaa11", "Ann", None)], LEDGER)
    rows = spark.createDataFrame([("Redacted Author aaaaaa11; Redacted Author aaaaaa",)], "authors string")
    assert D.restore(rows, "authors", ledger).first()["authors"] == "Ann; Jane"


def test_ledger_through_a_file(spark, tmp_path):
    ledger = spark.createDataFrame([("t1", "Jane", '["J"]'), ("t2", "Bo", None)], LEDGER)
    D.export_ledger(ledger, str(tmp_path / "ledger"), "s")
    got = D.import_ledger(ledger.where("token = 't2'"), str(tmp_path / "ledger"))
    assert {tuple(r) for r in got.collect()} == {("t1", "Jane", '["J"]'), ("t2", "Bo", None)}
    assert D.import_ledger(got, str(tmp_path / "ledger")).count() == 2


def test_intake_suppresses(spark):
    ledger = spark.createDataFrame([("Redacted Author aaaaaa", "Jane Smith", None)], LEDGER)
    books = spark.createDataFrame([(1, "d1", 1, "Bo", None, 0)], "id int, doi string, cited_by int, authors string, editors string, seq int")
    batch = spark.createDataFrame([(2, "d2", 1, "Jane Smith; Bo", "JANE SMITH", 1)], books.schema)
    assert {tuple(r)[3:5] for r in P.upsert_books(books, batch, ledger).collect()} == {("Bo", None), ("Redacted Author aaaaaa; Bo", "Redacted Author aaaaaa")}


def by_phrase(text, phrases):
    """One phrase after the other, each by its own pattern."""
    marks = {}
    for k, p in enumerate(phrases):
        pattern = re.escape(p.text)
        marks[chr(0xE000 + k)] = p.value
        text = re.sub(rf"\b{pattern}\b" if p.whole else pattern, chr(0xE000 + k), text)
    return "".join(marks.get(c, c) for c in text)


def test_machine_equals_each_phrase_on_its_own():
    rng = random.Random(2)
    words = ["ann", "lee", "lee-roy", "o'neil", "bo", "anna", "x", "de la cruz", "c++", "new york"]
    listed = [H.Phrase(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), f"<{k}>", rng.random() < 0.8) for k in range(1000)]
    machine = H.Machine(listed)
    for _ in range(60):
        text = rng.choice(["", "(", "…"]) + rng.choice([" ", ", ", "-", ""]).join(rng.choice(words) for _ in range(25))
        # Private characters that stand in for values are no word characters, so borders beside them may differ: only borders of words count.
        want = by_phrase(text, [p for p in listed if p.whole and re.fullmatch(r"\w.*\w|\w", p.text)])
        assert H.Machine([p for p in listed if p.whole and re.fullmatch(r"\w.*\w|\w", p.text)]).replaced(text) == want
        tags = [p.value for p in listed if re.search(rf"\b{re.escape(p.text)}\b" if p.whole else re.escape(p.text), text)]
        assert machine.values(text) == tags


def test_tags_of_texts(spark):
    rows = spark.createDataFrame([(1, "Use C++", "now, grammatical"), (2, None, None), (3, "The GRAMMAR", "of e-mails")], "id int, title string, tags string")
    words = {"net": ["e-mail"], "g": ["grammar", "black"], "lang": ["c++ now"], "none": []}
    got = {r["id"]: r["tags"] for r in H.tag_texts(rows.withColumnRenamed("tags", "abstract").withColumn("tags", F.lit("old")), ("title", "abstract"), words).collect()}
    assert got == {1: "|lang|", 2: None, 3: "|net|g|"}

"""Cases of institutions, moderation and single values that the tables don't hold."""

from datetime import datetime

from pyspark.sql import functions as F

from citewright.functions import values as V
from citewright.operators import institutions as I
from citewright.operators import moderation as D
from citewright.operators import press as P


def test_submissions(spark):
    asked = spark.createDataFrame([(1, "x", c, t, t) for t, c in enumerate(["a", "a", None, "b", "b", "a"])] + [(2, "x", None, 0, 9), (2, "x", "a", 1, 10), (3, "y", "a", 0, 11)], "article int, tag string, client string, at int, seq int")
    known = spark.createDataFrame([(3, "y"), (3, "y")], "article int, tag string")
    decided = spark.createDataFrame([(1, "x", "approved", 4)], "article int, tag string, status string, at int")
    judged = D.submissions(asked, known, decided)
    got = {r.seq: r.status for r in judged.collect()}
    assert got == {0: "pending", 1: "pending", 2: "pending", 3: "bumped", 4: "pending", 5: "approved", 9: "pending", 10: "bumped", 11: "exists"}
    assert {(r.article, r.tag): r.votes for r in D.queue(judged).collect()} == {(1, "x"): 2, (2, "x"): 2}
    assert D.queue(D.submissions(asked.limit(0), known, decided)).count() == 0


def test_requests(spark):
    rows = [("a", "note", 0), ("b", "approve", 0), ("b", "verify", 1), ("c", "verify", 0), ("c", "note", 1), ("c", "deny", 2), ("c", "approve", 3)]
    audit = spark.createDataFrame([(*r, r[2]) for r in rows], "request string, action string, at int, seq int")
    assert {r.request: r.state for r in D.request_states(audit).collect()} == {"a": "waiting", "b": "verified", "c": "denied"}


def test_retained(spark):
    at = [datetime(2024, 6, 30, 5), datetime(2024, 5, 1), datetime(2024, 5, 2), datetime(2024, 5, 2), datetime(2023, 12, 3), datetime(2023, 12, 4), datetime(2020, 1, 1)]
    kept = D.retained(spark.createDataFrame(list(enumerate(at)), "key int, at timestamp"), "2024-07-01 00:00:00").collect()
    assert {(r.key, r.zone) for r in kept} == {(0, "daily"), (2, "weekly"), (5, "monthly")}


def test_stamps(spark):
    people = [(f"p{i}", "J", 1 if i < 4 else 10 + i, False) for i in range(8)] + [(f"q{i}", "K", 2, False) for i in range(6)] + [("r", None, None, False), ("p0", None, 1, True)]
    rows = spark.createDataFrame(people, "name string, journal string, place int, book boolean")
    stamps = I.editorial_stamps(rows, 5, 0.5)
    assert {(r.journal, r.place, r.reason) for r in stamps.collect()} == {("J", 1, "dominance"), ("K", 2, "single-venue")}
    left = I.drop_stamps(rows, stamps)
    assert left.count() == rows.count() and left.where("place is not null").count() == 5


def test_editor_links_rank_before_pairs(spark):
    works = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "work int, parent int")
    people = spark.createDataFrame([(1, "e", "editor"), (1, "a", "author"), (2, "b", "author"), (3, "f", "editor"), (3, "a", "author"), (3, "f", "author")], "work int, name string, role string")
    assert {tuple(r) for r in P.editor_network(works, people).collect()} == {("e", "a", 1), ("e", "b", 1), ("f", "a", 1)}
    assert {r.author for r in P.editor_network(works, people, top=1).collect()} == {"a"}


def test_shares_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(v,) for v in [5] * 10 + [1] * 10], "v long")
    assert tuple(P.shares(rows, "v").first()) == (round(5 / 60, 6), round(10 / 60, 6), round(10 / 60, 6), 20)
    assert P.shares(rows.limit(0), "v").first()["n"] is None


def test_values(spark):
    rows = spark.createDataFrame([(" A|b\t <c> ",), (None,), ("2001-07-15",), ("2001",), ("2001-13",)], "t string")
    got = rows.select(V.normal_tag(F.col("t")), V.period_label(F.col("t"))).collect()
    assert [r[0] for r in got[:2]] == ["a b c", None]
    assert [r[1] for r in got[1:]] == [None, "July 2001", "2001", "2001-13"]


def test_decisions_and_votes_on_own_tags(spark):
    suggested = spark.createDataFrame([(1, "x", 2, 5), (1, "y", 1, 6), (2, "x", 1, 7)], "article int, tag string, votes int, first_at int")
    made = spark.createDataFrame([(1, "x", "approve", "ann", 1), (1, "x", "reject", "bo", 2), (1, "x", "maybe", "cy", 9), (1, "y", "approve", "bo", 3), (9, "z", "approve", "bo", 1)], "article int, tag string, decision string, actor string, at int")
    decided = D.decide(suggested, made)
    assert {(r.article, r.tag): (r.status, r.decided_by) for r in decided.collect()} == {(1, "x"): ("rejected", "bo"), (1, "y"): ("approved", "bo"), (2, "x"): ("pending", None)}
    assert [(r.article, r.tag) for r in D.listed_queue(decided).collect()] == [(2, "x"), (1, "y"), (1, "x")] and D.listed_queue(decided, "approved").count() == 1
    votes = spark.createDataFrame([(1, "x", "u", 1, 0, 0), (1, "x", "u", -1, 1, 1), (1, "x", "v", 7, 2, 2), (1, "nope", "v", 1, 3, 3)], "article int, tag string, voter string, vote int, at int, seq int")
    assert [tuple(r) for r in D.tallies(votes, suggested).collect()] == [(1, "x", 0, 1)]

import hashlib
import random
import re

from citewright.llm import pii

RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def slow(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found)


def test_base_spans_equal_the_rules():
    rng = random.Random(2)
    alphabet = "a.b_@-1234567890 +()%é\n"
    pieces = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "4111 1111 1111 1111", "255.256.1.1", "x@y@z.com", "@a.b", "..@..", "+12 ", "010.0.0.1"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) if rng.random() < 0.3 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 6)))
        assert pii.base_spans(text) == slow(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a." * 100_000 + "@", "+1" + " " * 200_000, "1 " * 100_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_detect_and_redact(spark, docs, empty):
    model = pii.fit(docs)
    rows = docs.collect()
    got = pii.detect(docs, model).collect()
    assert len(got) == len(rows)
    want = {r["doc_id"]: slow(r["text"] or "") for r in rows}
    for r in got:
        base = ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in want[r["doc_id"]])
        assert r["base"] == base and set(base.split(",")) - {""} <= set(r["spans"].split(","))
        assert r["n_email"] == sum(k == 0 for _, k, _ in want[r["doc_id"]])
    masked = pii.redact(docs, model)
    assert masked.columns == docs.columns
    out = [r["text"] for r in masked.collect() if r["text"] and "mail" in r["text"]]
    assert "[EMAIL]" in out[0] and "[CARD]" in out[0] and "[PHONE]" in out[0] and "[IP]" in out[0]
    assert pii.detect(empty, pii.fit(empty)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_trees_select_forms_they_learnt(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        number = "".join(rng.choice("0123456789") for _ in range(10))
        rows.append((i, f"call +1 ({number[:3]}) {number[3:6]}-{number[6:]} now, order 12-{number[:7]} of x{i}@mail.example.com at room {i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    assert model.trees and model.thresholds[0] <= 1
    assert model.added("write to ünal@mail.example.com today", []) or model.thresholds[0] > 0.5
    assert pii._threshold([(0, 50, 0), (25, 10, 5), (49, 100, 100)]) == 49 / 50


def test_forms_the_rules_do_not_know_get_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs)
    phone, mail = "(293) 555-9179", "jane.doe [at] mail4 [dot] example [dot] com"
    texts = [f"the phone {phone} is here", f"write to {mail} and wait", f"oner sh {phone} oned ha", "token 9807915762804490 and 2390409500648960 end", "oner 293-555-9179 oned", "on 2024-01-15 12:30 they met"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.detect(rows, model).collect()}
    for i, kind, form in ((0, "phone", phone), (1, "email", mail), (2, "phone", phone), (4, "phone", "293-555-9179")):
        at = texts[i].index(form)
        assert f"{kind}:{at}:{at + len(form)}" in got[i], (got, model.thresholds)
    assert got[3] == [""] and got[5] == [""], (got, model.thresholds)
    assert pii.redact_text(texts[0], model) == "the phone [PHONE] is here"


def test_learns_from_every_document(spark):
    """30,000 documents, personal data only in such as a sample of 20,000 by hash would leave out."""
    from pyspark.sql import functions as F

    n = F.lpad((F.col("doc_id") * 7919 % 10**7).cast("string"), 7, "0")
    text = F.concat(F.lit("call +1 (293) "), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 4), F.lit(" or x"), "doc_id", F.lit("@mail.example.com at room "), "doc_id")
    outside = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")), F.lit(1 << 62)) >= (20_000 * (1 << 62) // 30_000)
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id").withColumn("text", text)
    docs = docs.withColumn("text", F.when(outside & (F.col("doc_id") % 10 == 0), F.col("text")).otherwise(F.concat(F.lit("order 12-345678 of item "), "doc_id")))
    model = pii.fit(docs)
    assert model.trees and min(model.thresholds) <= 1


def test_overlaps_by_search_equal_all_pairs():
    rng = random.Random(3)
    for _ in range(200):
        base = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(100) for _ in range(rng.randint(0, 12)))]
        cover, taken = pii._Cover(base), []
        used = pii._Cover()
        for a, b in [(a, a + rng.randint(1, 9)) for a in (rng.randrange(110) for _ in range(30))]:
            assert cover.meets(a, b) == any(a < d and c < b for c, d in base)
            assert used.meets(a, b) == any(a < d and c < b for c, d in taken)
            if not used.meets(a, b):
                used.add(a, b)
                taken.append((a, b))

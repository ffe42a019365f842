import random
import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from citewright.llm import filter_audit

OWN = {
    "A": lambda t, w: len(w) < 200,
    "B": lambda t, w: 100 * len(set(w)) < 50 * len(w),
    "C": lambda t, w: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
    "D": lambda t, w: bool(re.search("[#$%&*|]", t)),
}


def plain(rows, labels):
    """Every order applied to every document, one after the other."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {f for f, test in OWN.items() if test(text, words)}
        if i is not None and i > first[text]:
            bad.add("E")
        docs.append((lang or "", bad, any(q == 1 for k, q, _ in labels if k == i and k is not None), any(x == 1 for k, _, x in labels if k == i and k is not None)))
    out = set()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        share, found = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                share[f] += len(gone)
                failing = sum(f in d[1] for d in own)
                alone = sum(d[1] == {f} for d in own)
                found.append(("".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out |= {(part, *x, share[x[0][x[1] - 1]]) for x in found}
    return out


def some_rows():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "A" * 300, "short text", "word " * 500, " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)) + " $", "été " * 210, "x" * 50_000]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(120)]
    rows += [rows[5], rows[5], rows[0], (None, "short text", "en"), (None, "short text", "en"), (None, "only here", None), (-4, "short text", "de")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_equals_every_order_applied_to_every_document(spark):
    rows, labels = some_rows()
    docs = spark.createDataFrame([(*r, 1, "k", "z", 2) for r in rows], "doc_id long, text string, lang string, n int, key string, failed string, v int")
    marks = spark.createDataFrame([(*r, "no", 3) for r in labels], "doc_id long, quality int, toxic int, key string, n int")
    got = filter_audit.audit(docs.repartition(5), marks)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 3 * 600 and set(found) == plain(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


def test_shares_are_shapley_values():
    for n in (2, 3, 5):
        weights = filter_audit.share_weights(n)
        for i in range(n):
            for s in range(1 << n):
                size = bin(s).count("1")
                # Every coalition's value counts for its members and against the others.
                inside = s >> i & 1
                want = Fraction(factorial(size - inside) * factorial(n - size - 1 + inside), factorial(n)) * (1 if inside else -1)
                assert weights[i][s] == (want if s else 0)  # nothing is removed by no filter

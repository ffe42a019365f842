import re
from collections import defaultdict

import pytest

from citewright.llm import mixing


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        weights = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / weights for s in order}
        above = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, None: 900}, {"x": 3, "y": 3, "z": 3, "zz": 10_000}, {"only": 7}, {"e": 0, "f": 50}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    want = slow_targets(sizes)
    assert got == pytest.approx(want)


def test_mix(docs, empty):
    rows = docs.collect()
    got = mixing.mix_words(docs).collect()
    assert len(got) == len(rows)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in got:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == sizes[source[i]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[source[i]] += r["taken"]
        target[source[i]] = r["target"]
    assert target == pytest.approx(slow_targets(sizes))
    for s in target:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s])
    again = sorted(map(tuple, mixing.mix_words(docs.repartition(5)).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)
    assert mixing.mix_words(empty).count() == 0


def test_slots_are_ranked_and_spread(spark):
    mix = mixing.targets(spark.createDataFrame([("a", 700), ("b", 700), ("c", 700)], "source string, source_size long"))
    rows = mixing.schedule(mix, 800).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["place"]].append(r["rank"])
    assert len(rows) == 800
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    for r in mix.collect():
        assert abs(len(by[r["place"]]) - 800 * r["target"] / 2100) <= 3


def test_documents_of_the_mix(plain):
    taken = {r["doc_id"]: r for r in mixing.mix_words(plain).collect()}
    out = mixing.mixed_documents(plain)
    assert out.columns == plain.columns
    copies = defaultdict(int)
    for r in out.collect():
        copies[r["doc_id"]] += 1
    for i, r in taken.items():
        if r["size"]:
            assert abs(copies[i] - r["taken"] / r["size"]) <= 0.5
        else:
            assert copies[i] == 1

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from citewright.llm import lexical


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def plain(docs, items, k):
    """All scores of all pairs, in Python's integers."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, text in dict.fromkeys(items):
        wanted.setdefault(i, []).extend(terms(text))
    out = set()
    for item, words in wanted.items():
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            score = 0
            for t in words:
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1)}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(12)
    vocab = [f"t{k}" for k in range(40)] + ["Été", "ÉTÉ", "x-ray", "日本", "a_b", "A", "Zebra"]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 20, 90])))) for k in range(150)]
    docs += [(200 + k, "zebra tie") for k in range(30)] + [(300, None), (301, ""), (302, " .,\x00\x7f"), (303, "zebra " * 5000), (None, "zebra tie"), (200, "zebra tie"), (-5, "zebra tie")]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12)))) for k in range(30)]
    items += [(50, "zebra zebra ZEBRA tie"), (51, None), (52, "nowhere"), (53, "!"), (0, "zebra"), (50, "zebra zebra ZEBRA tie"), (None, "tie"), (54, "tie " * 400)]
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, n int, item int, term string").repartition(4)
    i = spark.createDataFrame([(*r, 1, "y") for r in items], "item_id long, text string, score int, doc string").repartition(2)
    return docs, items, d, i


@pytest.mark.parametrize("k", [1, 10])
def test_equals_all_pairs(tables, k):
    docs, items, d, i = tables
    got = lexical.search(d, i, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(docs, items, k)


def test_small_tiles_planes_and_blocks_change_nothing(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(lexical, "TILE_ITEMS", 3)
    monkeypatch.setattr(lexical, "TILE_TERMS", 10)
    monkeypatch.setattr(lexical, "TILE_CELLS", 50)
    monkeypatch.setattr(lexical, "PLANE", 5000)
    assert {tuple(r) for r in lexical.search(d, i, 10, block_terms=60).collect()} == plain(docs, items, 10)


def test_partial_sums_are_exact_beyond_53_bits():
    weights = {0: {0: 3 * lexical.PLANE + 7, 1: 5, 4: lexical.PLANE - 1}, 1: {1: 2}}
    (tile,) = lexical.tiles(weights)
    assert max(p.sum(axis=1).max() for p in tile.planes) <= lexical.PLANE
    impacts = np.array([[lexical.IMPACT_LIMIT - 1, 1], [lexical.IMPACT_LIMIT - 1, 0], [999_983, 3]], dtype=float)
    want = [[sum(w * int(impacts[tile.columns.tolist().index(c)][j]) for c, w in weights[i].items()) for j in range(2)] for i in range(2)]
    assert tile.scores(impacts).tolist() == want


def test_empty_tables(tables):
    _, _, d, i = tables
    assert lexical.search(d.limit(0), i).count() == 0
    assert lexical.search(d, i.limit(0)).count() == 0

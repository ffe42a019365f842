import math

import numpy as np

from citewright.llm import embeddings


def brute(rows):
    ok = [(i, np.array(v, float) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) else None) for i, v in rows]
    n = len(ok)
    links = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            x, y = ok[a][1], ok[b][1]
            if a != b and x is not None and y is not None and len(x) == len(y):
                links[a, b] = x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.95
    label = list(range(n))
    for _ in range(n):
        for a in range(n):
            label[a] = min([label[a], *(label[b] for b in np.flatnonzero(links[a]))])
    ids = {}
    for a in range(n):
        ids.setdefault(label[a], []).append(ok[a][0])
    return sorted(((ok[a][0], int(links[a].sum()), min((i for i in ids[label[a]] if i is not None), default=None)) for a in range(n)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, node int, h int").repartition(3)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(30):
        c = rng.standard_normal(16)
        for _ in range(6):
            rows.append((len(rows), (c + rng.standard_normal(16) * 0.35).astype(np.float32).tolist()))
    hot = rng.standard_normal(16)
    rows += [(len(rows) + k, (hot + rng.standard_normal(16) * 0.1).astype(np.float32).tolist()) for k in range(90)]
    n = len(rows)
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [2 * x for x in rows[5][1]]), (n + 3, None), (n + 4, [0.0] * 16), (n + 5, [float("nan")] * 16), (n + 6, [float("inf")] + [1.0] * 15), (n + 7, [None] + [1.0] * 15), (n + 8, []), (n + 9, rows[1][1][:8]), (n + 10, [-0.0, *rows[3][1][1:]]), (None, rows[7][1])]
    rows.append(rows[8])
    want = brute(rows)
    for block in (1024, 16):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = embeddings.embedding_groups(table(spark, rows)).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = embeddings.units(rng.standard_normal((1, 64)))
    errors = []
    y = embeddings.units(x + rng.standard_normal((4000, 64)) * 0.05)
    every = np.concatenate([x, y])
    stored = embeddings.encode(every)
    assert stored["code"].map(len).eq(8).all()
    codes = embeddings.Codes(stored, 64, every)
    estimate = (codes.signs[1:] @ codes.rotated[0]) / codes.factor[1:] / 8
    errors = estimate - (y @ x[0])
    assert abs(errors.mean()) < 0.05
    assert (np.abs(errors) <= codes.error[1:]).all()


def test_differing_bits_of_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    dim, n = 64, 40_000
    x, z = embeddings.units(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    side = embeddings.units(z - np.einsum("ij,ij->i", z, x)[:, None] * x)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * side
    count = embeddings.SKETCH
    bits = (embeddings.sign_bits(x, count) != embeddings.sign_bits(y, count)).sum(axis=1)
    most = embeddings.differing_bits(count, 0.95)
    assert bits.max() <= most < 60 and abs(bits.mean() - count * math.acos(0.95) / math.pi) < 0.2
    dim = count
    assert (bits > embeddings.differing_bits(dim, 0.95, 1e-2)).mean() < 1e-2 < (bits > embeddings.differing_bits(dim, 0.95, 1e-2) - 2).mean()
    assert embeddings.differing_bits(4, 1.0) == 0 and embeddings.differing_bits(4, 0.95) == 4


def test_recall_at_the_threshold(spark):
    """A hot group around one direction whose cosines lie on both sides of 0.95, and strangers."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal(64) + 0.28 * rng.standard_normal((1500, 64)) * 0.95, rng.standard_normal((1000, 64))]).astype(np.float32)
    unit = embeddings.units(v.astype(np.float64))
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, 0)
    assert ((cosine >= 0.945) & (cosine < 0.955)).sum() > 10_000
    want = (cosine >= 0.95).sum(axis=1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_groups(rows).collect()}
    lost = int(want.sum() - sum(got.values()))
    print("links", int(want.sum()), "lost", lost)
    assert lost <= want.sum() * 1e-5 and all(got[i] <= n for i, n in enumerate(want))


def test_empty(spark):
    assert embeddings.embedding_groups(table(spark, [])).count() == 0
    assert embeddings.embedding_groups(table(spark, [(1, None)])).collect()[0]["component_id"] == 1

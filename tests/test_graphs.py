"""Measures that SQL can't express, against brute force on small graphs."""

import random
from collections import defaultdict, deque
from math import erfc, sqrt

import pytest
from pyspark.sql import functions as F

from citewright.operators import communities as N
from citewright.operators import graphs as G
from citewright.operators import statistics as T
from citewright.plans import registry

LINK = "source long, target long"


def shares(links):
    """Betweenness by counting shortest paths between all pairs."""
    nodes, out = sorted({v for e in links for v in e}), defaultdict(set)
    for s, t in links:
        if s != t:
            out[s].add(t)
    far, many = {}, {}
    for s in nodes:
        far[s], many[s], todo = {s: 0}, defaultdict(float, {s: 1.0}), deque([s])
        while todo:
            v = todo.popleft()
            for w in out[v]:
                if w not in far[s]:
                    far[s][w] = far[s][v] + 1
                    todo.append(w)
                if far[s][w] == far[s][v] + 1:
                    many[s][w] += many[s][v]
    n = len(nodes)
    return {
        v: sum(many[s][v] * many[v][t] / many[s][t] for s in nodes for t in far[s] if v not in (s, t) and v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t]) / ((n - 1) * (n - 2))
        for v in nodes
    }


def test_betweenness(spark):
    rng = random.Random(5)
    links = [(rng.randrange(14), rng.randrange(14)) for _ in range(34)] + [(1, 1), (3, 4), (3, 4)]
    got = {r["id"]: r["score"] for r in G.betweenness(spark.createDataFrame(links, LINK)).collect()}
    want = shares([e for e in links if e[0] != e[1]])
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    part = G.betweenness(spark.createDataFrame(links, LINK), pivots=5)
    assert part.count() == len(want) and part.where("score < 0").isEmpty()


def test_border_crossers(spark):
    rng = random.Random(8)
    group = {v: ("TPC", "RHET_COMP", "OTHER")[v % 3] for v in range(20)}
    links = [(rng.randrange(20), rng.randrange(20)) for _ in range(36)] + [(4, 4), (1, 2), (2, 1)]
    edges = spark.createDataFrame([(s, t, group[s], group[t]) for s, t in links], LINK + ", sg string, tg string")
    near = defaultdict(set)
    for s, t in links:
        if s != t:
            near[s].add(t)
            near[t].add(s)
    want = shares([(s, t) for s in near for t in near[s]])
    got = {r["id"]: r for r in registry._crossers(edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[v]["score"] - want[v]) < 1e-8 for v in want)
    assert all(got[v]["boundary"] == sum(group[v] not in ("OTHER", group[u]) for u in near[v]) for v in want)
    assert {"betweenness_all", "border_crossers"} <= registry.queries().keys()


def limit_ranks(links, damping):
    """PageRank by 500 plain updates."""
    links, nodes = set(links), sorted({v for e in links for v in e})
    n, out, rank = len(nodes), defaultdict(list), {v: 1 / len(nodes) for v in nodes}
    for s, t in links:
        out[s].append(t)
    for _ in range(500):
        new = dict.fromkeys(nodes, (1 - damping) / n + damping * sum(rank[v] for v in nodes if not out[v]) / n)
        for s in nodes:
            for t in out[s]:
                new[t] += damping * rank[s] / len(out[s])
        rank = new
    return rank


def test_pagerank_converges(spark):
    links = [(k, k + 1) for k in range(12)] + [(12, 9), (3, 0), (5, 20), (6, 20), (6, 20)]  # a long chain into a slow cycle, an end
    want = limit_ranks(links, 0.5)
    got = {r["id"]: r["rank"] for r in G.pagerank(spark.createDataFrame(links, LINK), damping=0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 5e-11 for v in want)
    five = {r["id"]: r["rank"] for r in G.pagerank(spark.createDataFrame(links, LINK), 5, 0.5).collect()}
    assert max(abs(five[v] - want[v]) for v in want) > 1e-4
    with pytest.raises(ValueError, match="still change"):
        G.pagerank(spark.createDataFrame(links, LINK), most=5)
    assert "pagerank_converged" in registry.queries()


def cliques(*groups, between=()):
    return [(a, b) for g in groups for a in g for b in g if a < b] + list(between)


def test_communities(spark):
    links = spark.createDataFrame(cliques(range(6), range(10, 16), range(20, 26), between=[(5, 10), (15, 20)]) + [(7, 7)], LINK)
    arcs = N.undirected(links)
    labels = N.communities(arcs)
    assert {r["id"]: r["c"] for r in labels.collect()} == {v: v // 10 * 10 for g in (range(6), range(10, 16), range(20, 26)) for v in g}
    assert abs(N.modularity(arcs, labels) - 0.6245) < 1e-3
    walls = {r["c"]: r for r in N.walls_bridges(arcs, labels).collect()}
    assert (walls[0]["inside"], walls[0]["outside"], walls[10]["outside"]) == (15, 1, 2)
    ratio = {c: round((15 / 15) / (walls[c]["outside"] / (6 * 12)), 2) for c in (0, 10, 20)}
    assert {c: r["insularity"] for c, r in walls.items()} == ratio
    assert {c: r["kind"] for c, r in walls.items()} == {0: "moderate", 10: "moderate" if ratio[10] >= sorted(ratio.values())[0] else "integrative", 20: "moderate"}
    records = spark.createDataFrame([(v, "J" if v % 2 else "K", "|t|u|" if v < 13 else None) for v in (*range(6), *range(10, 16), *range(20, 26))], "id long, journal string, tags string")
    tops = {(r["c"], r["list"], r["place"]): (r["what"], r["n"]) for r in N.community_tops(labels, records, records.selectExpr("id", "id as n_in")).collect()}
    assert tops[0, "article", 1] == ("5", 5) and tops[10, "journal", 1] == ("J", 3) and tops[10, "tag", 2] == ("u", 3) and (20, "tag", 1) not in tops
    later = spark.createDataFrame([(v, 3 if v < 13 else 14) for v in (*range(6), *range(10, 16))], "id long, c long")
    assert {(r["a"], r["b"]): r["shared"] for r in N.carried_over(labels, later).collect()} == {(0, 3): 6, (10, 3): 3, (10, 14): 3}
    assert N.communities(N.undirected(links.limit(0))).isEmpty()


def sequential(links):
    """Labels of the sequential multi-level search, nodes in order."""
    w = defaultdict(lambda: defaultdict(float))
    for a, b in links:
        w[a][b] += 1.0
        w[b][a] += 1.0
    member = {v: v for v in w}
    while True:
        k, label = {v: sum(w[v].values()) for v in w}, {v: v for v in w}
        total, whole, any_moved, moved = dict(k), sum(k.values()), False, True
        while moved:
            moved = False
            for v in sorted(w):
                near = defaultdict(float)
                for u, x in w[v].items():
                    if u != v:
                        near[label[u]] += x
                total[label[v]] -= k[v]
                best = max([label[v], *sorted(near)], key=lambda c: near.get(c, 0.0) - k[v] * total[c] / whole + 1e-9 * (c == label[v]))
                total[best] += k[v]
                moved, label[v] = moved or best != label[v], best
            any_moved = any_moved or moved or any(label[v] != v for v in w)
        if not any_moved:
            return member
        member = {v: label[c] for v, c in member.items()}
        up = defaultdict(lambda: defaultdict(float))
        for v in w:
            for u, x in w[v].items():
                up[label[v]][label[u]] += x
        w = up


def test_communities_end_by_convergence(spark):
    rng = random.Random(3)  # a ring of 60 groups of 8, some links between others
    links = [(a, b) for g in range(60) for a in range(8 * g, 8 * g + 8) for b in range(a + 1, 8 * g + 8) if rng.random() < 0.6]
    links += [(8 * g + 7, (8 * g + 8) % 480) for g in range(60)] + [(rng.randrange(480), rng.randrange(480)) for _ in range(150)]
    links = sorted({(min(e), max(e)) for e in links if e[0] != e[1]})
    arcs = N.undirected(spark.createDataFrame(links, LINK)).cache()
    one = N.modularity(arcs, spark.createDataFrame(list(sequential(links).items()), "id long, c long"))
    many = N.modularity(arcs, N.communities(arcs))
    print(f"modularity: sequential {one:.4f}, parallel {many:.4f}")
    assert many > one - 0.02
    with pytest.raises(ValueError, match="still rises"):
        N.communities(arcs, rounds=2)


def test_all_decades_are_compared(spark):
    one, two = cliques(range(6)), cliques(range(10, 16))
    rows = [(a, b, y) for y, links in ((1975, one), (1988, one), (2003, one + two), (2011, two)) for a, b in links] + [(1, 2, None)]
    edges = spark.createDataFrame(rows, LINK + ", sy int")
    assert {tuple(r) for r in N.over_decades(edges).collect()} == {(1970, 0, 0, 6, 1.0), (1980, 0, 0, 6, 1.0), (2000, 10, 10, 6, 1.0)}
    assert N.over_decades(edges.where("sy < 1980")).isEmpty()


def test_window_metrics(spark):
    rows = [(1, 2, 2000, 2000), (2, 3, 2000, 2000), (3, 1, 2000, 2000), (4, 1, 2000, 2000), (9, 1, 2003, 2000), (9, 1, 2003, 2000)]
    got = [tuple(r) for r in G.window_metrics(spark.createDataFrame(rows, LINK + ", sy int, ty int"), 2).orderBy("window").collect()]
    assert got == [(2000, 4, 4, 0.666666667, 2.0, 0.6, 1, 4, 4, 4), (2002, 1, 0, 0.0, 0.0, 0.0, 1, 1, 5, 5)]


def test_statistics(spark):
    rows = spark.createDataFrame([(1, 2, "x"), (2, 1, "x"), (3, 4, "y"), (4, 3, "y"), (5, 5, "y"), (None, 5, "x")], "a int, b int, g string")
    assert tuple(T.spearman(rows, "a", "b").first()) == (5, 0.8)
    r = T.mann_whitney(rows, "a", "g", "x", "y").first()
    assert (r["n_first"], r["n_second"], r["u"]) == (2, 3, 0.0)
    assert abs(r["z"] - 2.5 / sqrt(3.0)) < 1e-6 and abs(r["p"] - erfc(2.5 / sqrt(3.0) / sqrt(2))) < 2e-6
    same = T.agreement(rows.withColumn("h", F.upper("g")), "g", "h").first()
    assert (same["n"], same["nmi"], same["ari"]) == (6, 1.0, 1.0)
    assert T.spearman(rows.limit(0), "a", "b").first()["rho"] is None
    assert T.mann_whitney(rows.where("g = 'x'"), "a", "g", "x", "y").first()["p"] is None
    assert T.agreement(rows.limit(0), "g", "b").first()["nmi"] is None


def test_central_articles_and_profiles(spark):
    from citewright.operators import chapters as H

    ranks = spark.createDataFrame([(1, 0.2), (2, 0.8), (3, 0.4)], "id long, rank double")
    between = spark.createDataFrame([(1, 6.0), (2, 3.0)], "id long, score double")
    assert {tuple(r) for r in H.centrality(ranks, between).collect()} == {(1, 0.25, 1.0), (2, 1.0, 0.5), (3, 0.5, 0.0)}
    assert {r["betweenness"] for r in H.centrality(ranks, between.withColumn("score", F.lit(0.0))).collect()} == {0.0}
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, c long")
    articles = spark.createDataFrame([(1, "K"), (2, "J"), (3, "J"), (4, "J")], "id long, journal string")
    counts = spark.createDataFrame([(2, 5), (3, 5), (4, 9)], "id long, n_in long")
    assert [tuple(r) for r in H.community_profiles(members, articles, counts).collect()] == [(1, 3, "J", 2, 2)]


def test_parts_share_rounds_but_not_weight(spark):
    """Two networks of very different weight: each is found as if it were alone."""
    one = N.undirected(spark.createDataFrame(cliques(range(4), range(10, 14), between=[(3, 10)]), LINK))
    heavy = N.undirected(spark.createDataFrame(cliques(range(100, 130), range(200, 230), between=[(129, 200)]), LINK))
    both = one.withColumn("part", F.lit(1)).unionByName(heavy.withColumn("part", F.lit(2)))
    labels = N.communities(both)
    found = {r["id"]: r["c"] for r in labels.collect()}
    alone = {r["id"]: r["c"] for arcs in (one, heavy) for r in N.communities(arcs).collect()}
    assert found == alone and set(found.values()) == {0, 10, 100, 200}
    scores = {r["part"]: (r["communities"], r["modularity"]) for r in N.part_modularity(both, labels).collect()}
    for part, arcs in ((1, one), (2, heavy)):
        assert scores[part][0] == 2 and abs(scores[part][1] - N.modularity(arcs, labels)) < 1e-9


def test_paths_within_windows(spark):
    rng = random.Random(2)
    year = {v: 1990 + v % 3 for v in range(60)}
    links = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150))]
    edges = spark.createDataFrame([(a, b, year[a], year[b]) for a, b in links], "source long, target long, sy int, ty int")
    got = {r["window"]: (r["largest"], r["pairs"], r["mean_path"]) for r in G.window_paths(edges).collect()}
    for w in (1990, 1991, 1992):
        near = defaultdict(set)
        for a, b in links:
            if year[a] == year[b] == w and a != b:
                near[a].add(b)
                near[b].add(a)

        def far(start):
            at, todo = {start: 0}, [start]
            for v in todo:
                for u in near[v] - at.keys():
                    at[u] = at[v] + 1
                    todo.append(u)
            return at

        size, _, group = min((-len(far(v)), min(far(v)), tuple(sorted(far(v)))) for v in near)
        steps = [d for v in group for d in far(v).values() if d]
        assert got[w] == (-size, len(steps), round(sum(steps) / len(steps), 3))
    some = {r["window"]: r["pairs"] for r in G.window_paths(edges, exact=3, pivots=2).collect()}
    assert all(some[w] == 2 * (got[w][0] - 1) for w in some)


def test_topics_tell_communities_apart(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "id long, c long")
    titles = spark.createDataFrame([(1, "Genre of the Web"), (2, "genre and web texts"), (3, "Labor texts"), (4, "labor, labor!"), (5, "alone alone")], "id long, title string")
    got = {(r["c"], r["place"]): (r["word"], r["score"]) for r in N.topics(labels, titles).collect()}
    assert got == {(1, 1): ("genre", round(1 * (5 / 2) ** 0.5, 6)), (1, 2): ("web", round((5 / 2) ** 0.5, 6)), (3, 1): ("labor", round(1.5 * (5 / 3) ** 0.5, 6))}


def test_spans_are_searched_together(spark):
    links = [(a, b, 1991) for a, b in cliques(range(5), range(10, 15))] + [(a, b, 2001) for a, b in cliques(range(5), range(10, 15), between=[])] + [(a, b, 2015) for a, b in cliques(range(3, 8))]
    edges = spark.createDataFrame(links, "source long, target long, sy int")
    got = {tuple(r) for r in N.over_decades(edges).collect()}
    assert got == {(1990, 0, 0, 5, 1.0), (1990, 10, 10, 5, 1.0), (2000, 0, 3, 2, 0.25)}
    assert N.over_decades(edges.limit(0)).count() == 0

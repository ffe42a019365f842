"""Graph measures as DataFrame iterations: PageRank, triangles, betweenness, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewright.operators.communities import communities, part_modularity
from citewright.operators.components import connected_components
from citewright.session import Tables, cut


def pagerank(links: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-11, most: int = 500) -> DataFrame:
    """(id, rank) once the summed change of ranks in a round is below ``tolerance``, or after exactly
    ``rounds`` updates where given; nodes without links out spread their rank evenly.

    The link table with its out-degrees is written once; each round is a join and an aggregation
    that ends at a table, and gives the driver one row: the loose rank and the summed change. Ranks
    differ from the limit by at most damping / (1 - damping) of the last change in sum. Ranks that
    still change after ``most`` rounds are an error.
    """
    tables = Tables(links.sparkSession)
    edges = links.select("source", "target").distinct()
    out = edges.groupBy("source").agg(F.count("*").alias("degree"))
    edges = tables.put(edges.join(out, "source"), "edges")
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().join(out.withColumnRenamed("source", "id"), "id", "left")
    nodes = tables.put(nodes, "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    ranks, before = nodes.withColumn("rank", F.lit(1.0 / n)).withColumn("change", F.lit(0.0)), None
    lost = F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0))
    loose = ranks.agg(lost).first()[0]
    for _ in range(most if rounds is None else rounds):
        given = edges.join(ranks.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n))
        ranks = ranks.join(given, "id", "left").select("id", "degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        ranks = before = tables.put(ranks, "ranks", before)
        loose, change = ranks.agg(lost, F.sum("change")).first()
        if rounds is None and change < tolerance:
            break
    else:
        if rounds is None:
            raise ValueError(f"ranks still change by {change} after {most} rounds")
    return tables.keep(ranks.select("id", "rank"), "pagerank")


def transitivity(links: DataFrame) -> DataFrame:
    """One row: triangles, open and closed triples, and 3 triangles / triples of the simple graph.

    Edges point from the end of lower degree, so no node has more than about sqrt(2 m) edges out.
    """
    pairs = links.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    triples = degree.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0)).cast("long").alias("triples"))
    a, b = (degree.select(F.col("v").alias(c), F.struct("d", "v").alias(f"k{c}")) for c in "ab")
    ranked = pairs.join(a, "a").join(b, "b")
    low = F.col("ka") < F.col("kb")
    ranked = ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("hi"), F.greatest("ka", "kb").alias("khi"))
    wedge = ranked.alias("x").join(ranked.alias("y"), "lo").where("x.khi < y.khi").select(F.col("x.hi").alias("lo"), F.col("y.hi").alias("hi"))
    closed = wedge.join(ranked, ["lo", "hi"], "left_semi").agg(F.count("*").alias("triangles"))
    return closed.crossJoin(triples).select("triangles", "triples", F.when(F.col("triples") > 0, F.round(3 * F.col("triangles") / F.col("triples"), 6)).otherwise(0.0).alias("transitivity"))


def betweenness(links: DataFrame, pivots: int | None = None) -> DataFrame:
    """(id, score): the share of shortest directed paths that pass through each node.

    Searches from all nodes, or from ``pivots`` nodes chosen by hash, advance together one level at
    a time: a level is a table of (pivot, id, paths), so work is spread by node, and shares flow
    back along the same levels. Scores are over (n - 1)(n - 2), scaled up from pivots to all nodes.
    """
    tables = Tables(links.sparkSession)
    edges = tables.put(links.where("source <> target").select("source", "target").distinct(), "edges")
    nodes = tables.put(edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct(), "nodes")
    n = nodes.count()
    starts = nodes if pivots is None else nodes.orderBy(F.xxhash64("id"), "id").limit(pivots)
    levels = [tables.put(starts.select(F.col("id").alias("pivot"), "id", F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("pivot", "id")
    while True:
        ahead = levels[-1].join(edges.withColumnRenamed("source", "id"), "id").groupBy("pivot", F.col("target").alias("id")).agg(F.sum("paths").alias("paths"))
        ahead = tables.put(ahead.join(seen, ["pivot", "id"], "left_anti"), "level")
        if ahead.isEmpty():
            break
        levels.append(ahead)
        seen = seen.union(ahead.select("pivot", "id"))
    used = levels[0].count()
    through = levels[-1].withColumn("share", F.lit(0.0))
    found = through
    for level in reversed(levels[:-1]):
        given = through.select("pivot", F.col("id").alias("target"), ((1 + F.col("share")) / F.col("paths")).alias("g"))
        given = given.join(edges, "target").groupBy("pivot", F.col("source").alias("id")).agg(F.sum("g").alias("g"))
        through = tables.put(level.join(given, ["pivot", "id"], "left").select("pivot", "id", "paths", (F.col("paths") * F.coalesce("g", F.lit(0.0))).alias("share")), "share")
        found = found.unionByName(through)
    scale = n / used / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = found.where("pivot <> id").groupBy("id").agg(F.sum("share").alias("s"))
    return tables.keep(nodes.join(sums, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) * scale).alias("score")), "betweenness")


def undirected_betweenness(links: DataFrame, pivots: int = 256, exact: int = 512) -> DataFrame:
    """``betweenness`` over all links without direction: from all nodes of up to ``exact``, else from ``pivots`` chosen by hash."""
    both = links.select("source", "target").union(links.select("target", "source")).where("source <> target").distinct()
    both = cut(both, "both")
    n = both.select("source").distinct().count()
    return betweenness(both, None if n <= exact else pivots)


def window_metrics(edges: DataFrame, width: int = 1) -> DataFrame:
    """Measures of the network inside each window of publication years, and running totals.

    A node belongs to the window of its year, so windows share no nodes and one pass does for all.
    ``edges`` has source, target, sy and ty. Links count inside a window if both ends lie in it,
    once and without direction; running links count once by direction from the later window on.
    """
    window = lambda y: (F.floor(F.col(y) / width) * width).cast("int")
    placed = cut(edges.dropna(subset=["source", "target", "sy", "ty"]).select("source", "target", window("sy").alias("sw"), window("ty").alias("tw")).distinct(), "placed")
    nodes = placed.select(F.col("source").alias("id"), F.col("sw").alias("w")).union(placed.select("target", "tw")).distinct()
    inside = placed.where("sw = tw and source <> target").select(F.col("sw").alias("w"), F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inside = cut(inside, "inside")
    degree = inside.select("w", F.explode(F.array("a", "b")).alias("v")).groupBy("w", "v").agg(F.count("*").alias("d"))
    triples = degree.groupBy("w").agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("triples"))
    triangles = inside.join(closed_links(inside.select("a", "b")), ["a", "b"]).groupBy("w").agg(F.sum("thirds").alias("thirds"))
    parts = connected_components(inside.select("a", "b")).join(nodes.withColumnRenamed("id", "node"), "node").groupBy("w", "component").agg(F.count("*").alias("size"))
    parts = parts.groupBy("w").agg(F.count("*").alias("joined"), F.sum("size").alias("within"), F.max("size").alias("largest"))
    later = placed.groupBy(F.greatest("sw", "tw").alias("w")).agg(F.countDistinct("source", "target").alias("arrived"))
    base = nodes.groupBy("w").agg(F.count("*").alias("nodes")).join(inside.groupBy("w").agg(F.count("*").alias("links")), "w", "left")
    for other in (triples, triangles, parts, later):
        base = base.join(other, "w", "left")
    base = base.na.fill(0)
    n, m = F.col("nodes"), F.col("links")
    run = Window.orderBy("w")  # one row a window
    return base.select(
        F.col("w").alias("window"), "nodes", "links", F.round(F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0), 9).alias("density"), F.round(2 * m / n, 6).alias("mean_degree"),
        F.round(F.when(F.col("triples") > 0, F.col("thirds") / F.col("triples")).otherwise(0.0), 6).alias("transitivity"),
        (n - F.col("within") + F.col("joined")).alias("components"), F.greatest("largest", F.lit(1)).alias("largest"),
        F.sum("nodes").over(run).alias("all_nodes"), F.sum("arrived").over(run).alias("all_links"),
    )


def closed_links(pairs: DataFrame) -> DataFrame:
    """(a, b, thirds): for each link of a simple graph the triangles it closes as the link of their
    two nodes of highest degree, times 3; links that close none are absent."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    ka, kb = (degree.select(F.col("v").alias(c), F.struct("d", "v").alias(f"k{c}")) for c in "ab")
    ranked = pairs.join(ka, "a").join(kb, "b").select(F.least("ka", "kb")["v"].alias("lo"), F.greatest("ka", "kb").alias("hi"))
    wedge = ranked.alias("x").join(ranked.alias("y"), "lo").where("x.hi < y.hi").select(F.least("x.hi.v", "y.hi.v").alias("a"), F.greatest("x.hi.v", "y.hi.v").alias("b"))
    return wedge.groupBy("a", "b").agg((3 * F.count("*")).alias("thirds")).join(pairs, ["a", "b"], "left_semi")


def window_paths(edges: DataFrame, width: int = 1, exact: int = 1500, pivots: int = 256) -> DataFrame:
    """(window, largest, pairs, mean_path): mean shortest path within the largest component of each window.

    A node belongs to the window of its year, so windows share no nodes and all searches, from every node of
    every largest component, go level by level together: as many rounds as the widest component has
    levels. Of components with more than ``exact`` nodes ``pivots`` nodes, chosen by hash, start searches.
    Of components of equal size that with the smallest node counts; under 3 nodes there is no mean.
    """
    window = lambda y: (F.floor(F.col(y) / width) * width).cast("int")
    tables = Tables(edges.sparkSession)
    placed = edges.dropna(subset=["source", "target", "sy", "ty"]).select("source", "target", window("sy").alias("sw"), window("ty").alias("tw")).where("sw = tw and source <> target")
    inside = tables.put(placed.select("sw", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct(), "inside")
    parts = connected_components(inside.select("a", "b"))
    nodes = inside.select(F.col("sw").alias("w"), F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node")
    sizes = nodes.groupBy("w", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("w").agg(F.min(F.struct((-F.col("size")).alias("size"), "component")).alias("m")).select("w", "m.component", (-F.col("m.size")).alias("size")).where("size >= 3")
    own = tables.put(nodes.join(largest, ["w", "component"]).select("w", F.col("node").alias("id"), "size"), "largest")
    few = F.row_number().over(Window.partitionBy("w").orderBy(F.xxhash64("id"), "id")) <= pivots
    starts = own.where(F.col("size") <= exact).select("w", "id").union(own.where(F.col("size") > exact).withColumn("few", few).where("few").select("w", "id"))
    arcs = tables.put(inside.select(F.col("a").alias("id"), F.col("b").alias("to")).union(inside.select("b", "a")), "arcs")
    level = tables.put(starts.select("w", F.col("id").alias("pivot"), "id"), "level")
    seen, far, counts = level, 0, []
    while True:
        ahead = level.join(arcs, "id").select("w", "pivot", F.col("to").alias("id")).distinct()
        level = tables.put(ahead.join(seen, ["w", "pivot", "id"], "left_anti"), "level")
        far += 1
        found = level.groupBy("w").agg(F.count("*").alias("n")).collect()  # a row per window
        if not found:
            break
        counts += [(r["w"], far, r["n"]) for r in found]
        seen = seen.unionByName(level)
    sums = edges.sparkSession.createDataFrame(counts, "w int, far int, n long").groupBy("w").agg(F.sum("n").alias("pairs"), F.sum(F.col("far") * F.col("n")).alias("steps"))
    return tables.keep(largest.join(sums, "w").select(F.col("w").alias("window"), F.col("size").alias("largest"), "pairs", F.round(F.col("steps") / F.col("pairs"), 3).alias("mean_path")), "window-paths")


def window_arcs(edges: DataFrame, width: int = 1) -> DataFrame:
    """(part, a, b, w): the links inside each window once in both directions, for community search."""
    window = lambda y: (F.floor(F.col(y) / width) * width).cast("int")
    placed = edges.dropna(subset=["source", "target", "sy", "ty"]).select("source", "target", window("sy").alias("part"), window("ty").alias("tw")).where("part = tw and source <> target")
    pairs = placed.select("part", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().withColumn("w", F.lit(1.0))
    return pairs.unionByName(pairs.select("part", F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def window_modularity(edges: DataFrame, width: int = 1, nodes: int = 10, links: int = 5) -> DataFrame:
    """(window, communities, modularity) of each window's network, all searched together.

    Windows with fewer than ``nodes`` linked nodes or ``links`` links, or one community, are left out.
    """
    arcs = cut(window_arcs(edges, width), "arcs")
    enough = arcs.groupBy("part").agg(F.countDistinct("a").alias("n"), (F.count("*") / 2).alias("m")).where((F.col("n") >= nodes) & (F.col("m") >= links))
    kept = cut(arcs.join(enough.select("part"), "part", "left_semi"), "arcs")
    found = part_modularity(kept, communities(kept))
    return found.where("communities > 1").select(F.col("part").alias("window"), "communities", F.round("modularity", 4).alias("modularity"))


def neighbourhood(links: DataFrame, seeds: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """((id, seed), (source, target)): the seeds and their neighbours without direction, and the links among them.

    ``most`` nodes at most: seeds first, then by id. Links are kept once, the smaller id as source.
    """
    pairs = links.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    own = seeds.select("id").distinct()
    ends = pairs.select(F.col("source").alias("id"), F.col("target").alias("near")).union(pairs.select("target", "source"))
    near = ends.join(F.broadcast(own.limit(most)), "id", "left_semi").select(F.col("near").alias("id"))
    every = own.withColumn("seed", F.lit(True)).union(near.distinct().join(own, "id", "left_anti").withColumn("seed", F.lit(False)))
    nodes = every.orderBy(F.desc("seed"), "id").limit(most)
    ids = F.broadcast(nodes.select("id"))  # ``most`` rows
    inside = pairs.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, inside.select("source", "target")

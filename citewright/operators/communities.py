"""Communities of a weighted graph by modularity, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions.cleaning import split_tags
from citewright.functions.values import ordinal
from citewright.session import Tables, cut


def undirected(links: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(a, b, w) in both directions, w the number of rows between two nodes; loops and nulls go."""
    pairs = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def weighted(pairs: DataFrame) -> DataFrame:
    """Arcs of pairs (a, b, weight) that hold each link once."""
    one = pairs.select("a", "b", F.col("weight").cast("double").alias("w"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(arcs: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels(id, c)`` over ``arcs(a, b, w)``, each link in both directions."""
    x, y = labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    by = arcs.join(x, "a").join(y, "b").groupBy("ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("own"))
    own, square, all_ = by.agg(F.sum("own"), F.sum(F.col("k") * F.col("k")), F.sum("k")).first()
    return own / all_ - resolution * square / (all_ * all_) if all_ else 0.0


def _moves(arcs: DataFrame, resolution: float, rounds: int, rise: float) -> tuple[DataFrame, float, float]:
    """Labels after rounds in which half of the nodes, by hash, move to their best neighbour's label.

    Two rounds make a sweep that lets each node move once. The search ends when modularity, summed over the
    parts of the graph, rises by no more than ``rise`` in three rounds running, which hold a sweep; ``rounds``
    without that are an error. A round's table also holds what its starting labels' modularity needs, so that
    scoring them is a sum over that table. Superseded tables are deleted.
    """
    spark = arcs.sparkSession
    tables = Tables(spark)
    labels = tables.put(arcs.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"), F.max("whole").alias("whole")).withColumn("c", F.col("id")), "labels")
    loops = arcs.where("a = b").agg(F.coalesce(F.sum(F.col("w") / F.col("whole")), F.lit(0.0))).first()[0]
    across = arcs.where("a <> b").select("a", "b", "w")
    kept, kept_table, last, start, value, worse = labels, labels, labels, None, float("-inf"), 0
    for k in range(rounds):
        total = labels.groupBy("c").agg(F.sum("k").alias("t"), F.count("*").alias("size"))
        mine = labels.join(total.select("c", F.col("size").alias("own_size")), "c").select(F.col("id").alias("a"), F.col("c").alias("own"), "k", "whole", "own_size")
        near = across.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
        near = near.unionByName(labels.select(F.col("id").alias("a"), "c", F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
        seen = near.join(total, "c").join(mine, "a")
        same = F.col("c") == F.col("own")
        # two single nodes would swap for ever: only the one with the larger label moves
        seen = seen.where(same | (F.col("own_size") > 1) | (F.col("size") > 1) | (F.col("c") < F.col("own")))
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(same, F.col("k")).otherwise(0.0)) / F.col("whole"), 9)
        best = seen.groupBy("a", "own", "k", "whole").agg(
            F.min_by("c", F.struct((-gain).alias("loss"), (~same).alias("other"), F.col("c"))).alias("best"),
            F.max(F.when(same, F.col("w"))).alias("inside"), F.max(F.when(same, F.col("t"))).alias("t"),
        )
        turn = F.pmod(F.xxhash64("a", F.lit(k // 2)), F.lit(2)) == k % 2
        moved = tables.put(best.select(F.col("a").alias("id"), "k", "whole", "own", "inside", "t", F.when(turn, F.col("best")).otherwise(F.col("own")).alias("c")), "labels")
        inside, square = moved.agg(F.sum(F.col("inside") / F.col("whole")), F.sum(F.col("k") * F.col("t") / (F.col("whole") * F.col("whole")))).first()
        now = inside + loops - resolution * square if inside is not None else 0.0
        start = now if start is None else start
        worse = 0 if now > value + rise else worse + 1
        for old in {id(t): t for t in (last, kept_table) if t is not kept_table or now > value}.values():
            tables.drop(old)
        last = moved
        if now > value:
            kept, kept_table, value = moved.select("id", F.col("own").alias("c")), moved, now
        if worse == 3:
            break
        labels = moved.select("id", "k", "whole", "c")
    else:
        raise ValueError(f"modularity still rises after {rounds} rounds")
    return tables.keep(kept.select("id", "c"), "moves"), start, value


def communities(arcs: DataFrame, resolution: float = 1.0, rounds: int = 1000, levels: int = 100, rise: float = 1e-9) -> DataFrame:
    """(id, c) of ``arcs(a, b, w)``: labels of high modularity, c the smallest node of its community.

    Multi-level local moves: every round is joins and aggregations over links and labels, a level
    ends when modularity rises by no more than ``rise`` in three rounds running, then communities become the nodes of the
    next level, until a level adds no more than ``rise``. ``rounds`` and ``levels`` only bound the search: to reach one is
    an error. Deterministic; the best labels found count, so modularity never falls.

    Arcs with a column ``part``, of which no link joins two, are graphs of their own that share the rounds:
    each is searched by its own total weight. Nodes may be longs or structs such as (window, id).
    """
    if "part" in arcs.columns:
        totals = arcs.groupBy("part").agg(F.sum("w").alias("whole"))
        arcs = arcs.join(totals, "part").select("a", "b", "w", "whole")
    else:
        arcs = arcs.select("a", "b", "w").crossJoin(F.broadcast(arcs.agg(F.sum("w").alias("whole"))))  # one row
    arcs = cut(arcs, "arcs")
    member, level = arcs.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")), arcs
    for _ in range(levels):
        labels, before, after = _moves(level, resolution, rounds, rise)
        if after <= before + rise:
            break
        up = labels.select(F.col("id").alias("c"), F.col("c").alias("up"))
        member = cut(member.join(up, "c").select("id", F.col("up").alias("c")), "member")
        x, y = labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        level = cut(level.join(x, "a").join(y, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"), F.max("whole").alias("whole")), "level")
    name = member.groupBy("c").agg(F.min("id").alias("name"))
    return member.join(name, "c").select("id", F.col("name").alias("c"))


def part_modularity(arcs: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(part, communities, modularity) of ``labels(id, c)`` over ``arcs(part, a, b, w)``."""
    x, y = labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    by = arcs.join(x, "a").join(y, "b").groupBy("part", "ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("own"))
    sums = by.groupBy("part").agg(F.count("*").alias("communities"), F.sum("own").alias("own"), F.sum(F.col("k") * F.col("k")).alias("square"), F.sum("k").alias("whole"))
    return sums.select("part", "communities", (F.col("own") / F.col("whole") - resolution * F.col("square") / (F.col("whole") * F.col("whole"))).alias("modularity"))


STOP = ("the", "and", "for", "with", "from", "that", "this", "are", "was", "its", "into", "their", "our", "not", "but", "how", "what", "who", "why", "can", "all", "between", "through", "toward", "towards", "about", "using")


def topics(labels: DataFrame, titles: DataFrame, top: int = 5, least: int = 2, stop: tuple[str, ...] = STOP) -> DataFrame:
    """(c, place, word, score): the words that tell a community from the rest.

    Words have three letters or more; one counts if the titles of a community hold it ``least`` times. Its
    score is that count over the community's size, times the root of all titles over all counts of the word.
    Communities of one node have no topics; ties go by the word.
    """
    known = labels.join(titles.select("id", F.lower(F.coalesce("title", F.lit(""))).alias("t")), "id")
    words = known.select("c", F.explode(F.regexp_extract_all("t", F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).where(~F.col("word").isin(*stop))
    counts = words.groupBy("c", "word").agg(F.count("*").alias("n"))
    everywhere = counts.groupBy("word").agg(F.sum("n").alias("every"))
    size = labels.groupBy("c").agg(F.count("*").alias("size")).where("size > 1")
    docs = labels.agg(F.count("*").alias("docs"))  # one row
    scored = counts.where(F.col("n") >= least).join(everywhere, "word").join(size, "c").crossJoin(F.broadcast(docs))
    scored = scored.withColumn("score", F.round(F.col("n") / F.col("size") * F.sqrt(F.col("docs") / F.col("every")), 6))
    return scored.withColumn("place", ordinal(F.desc("score"), F.col("word"), by=("c",))).where(F.col("place") <= top).select("c", "place", "word", "score")


def walls_bridges(arcs: DataFrame, labels: DataFrame, top: int = 25, least: int = 5) -> DataFrame:
    """(c, nodes, inside, outside, inside_density, outside_density, insularity, kind) of the ``top`` largest communities of ``least`` nodes or more.

    Links count by their weight, once in both directions. Densities are over the pairs that could be linked, insularity
    is one over the other. Communities below the first quartile of insularity are integrative, above the third insular,
    the others moderate; quartiles are the values at a quarter and three quarters of the ordered list.
    """
    x, y = labels.select(F.col("id").alias("a"), "c"), labels.select(F.col("id").alias("b"), F.col("c").alias("other"))
    size = labels.groupBy("c").agg(F.count("*").alias("nodes")).where(F.col("nodes") >= least).orderBy(F.desc("nodes"), "c").limit(top)
    inner = F.col("c") == F.col("other")
    links = arcs.where("a <> b").join(x, "a").join(y, "b").groupBy("c").agg((F.sum(F.when(inner, F.col("w")).otherwise(0)) / 2).cast("long").alias("inside"), F.sum(F.when(~inner, F.col("w")).otherwise(0)).cast("long").alias("outside"))
    n, every = F.col("nodes"), labels.agg(F.count("*").alias("every"))
    found = size.join(links, "c", "left").na.fill(0, ["inside", "outside"]).crossJoin(F.broadcast(every))  # one row
    inside = F.col("inside") / F.greatest(F.lit(1), F.floor(n * (n - 1) / 2))
    outside = F.col("outside") / F.greatest(F.lit(1), n * (F.col("every") - n))
    found = found.select("c", "nodes", "inside", "outside", F.round(inside, 5).alias("inside_density"), F.round(outside, 5).alias("outside_density"), F.round(inside / F.greatest(outside, F.lit(1e-9)), 2).alias("insularity"))
    sorted_ = F.sort_array(F.collect_list("insularity"))  # at most ``top`` values
    k = F.size("all")
    cuts = found.agg(sorted_.alias("all")).select(F.get("all", F.floor(k / 4).cast("int")).alias("q1"), F.get("all", F.floor(3 * k / 4).cast("int")).alias("q3"))
    kind = F.when(F.col("insularity") < F.col("q1"), "integrative").when(F.col("insularity") > F.col("q3"), "insular").otherwise("moderate")
    return found.crossJoin(F.broadcast(cuts)).withColumn("kind", kind).drop("q1", "q3")


def community_tops(labels: DataFrame, records: DataFrame, counts: DataFrame, top: int = 5) -> DataFrame:
    """(c, list, place, what, n): each community's most cited articles, and its most frequent journals and tags.

    ``records`` has id, journal and tags as |a|b|, ``counts`` id and n_in; ties go by id or name.
    """
    rows = labels.join(records.select("id", "journal", "tags"), "id").join(counts.select("id", "n_in"), "id", "left").na.fill(0, ["n_in"])
    articles = rows.select("c", F.lit("article").alias("list"), F.col("n_in").cast("long").alias("n"), F.col("id").cast("string").alias("what"), F.col("id").alias("tie"))
    journals = rows.where("journal is not null and journal <> ''").groupBy("c", "journal").agg(F.count("*").alias("n")).select("c", F.lit("journal"), "n", "journal", F.lit(0).cast("long"))
    tags = rows.select("c", F.explode(split_tags(F.col("tags"))).alias("tag")).groupBy("c", "tag").agg(F.count("*").alias("n")).select("c", F.lit("tag"), "n", "tag", F.lit(0).cast("long"))
    every = articles.union(journals).union(tags)
    return every.withColumn("place", ordinal(F.desc("n"), F.col("tie"), F.col("what"), by=("c", "list"))).where(F.col("place") <= top).select("c", "list", "place", "what", "n")


def carried_over(before: DataFrame, after: DataFrame, shared: int = 2, least: float = 0.05) -> DataFrame:
    """(a, b, shared, jaccard) of communities of two maps that share members."""
    x, y = before.select("id", F.col("c").alias("a")), after.select("id", F.col("c").alias("b"))
    na, nb = x.groupBy("a").agg(F.count("*").alias("na")), y.groupBy("b").agg(F.count("*").alias("nb"))
    both = x.join(y, "id").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    found = both.join(na, "a").join(nb, "b").withColumn("jaccard", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6))
    return found.where(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")


def over_decades(edges: DataFrame, shared: int = 2, least: float = 0.05, width: int = 10) -> DataFrame:
    """(decade, a, b, shared, jaccard): ``carried_over`` from each decade of ``sy`` to the next one found, by the earlier decade.

    The networks of all decades, or spans of ``width`` years, are searched together.
    """
    placed = cut(edges.where("sy is not null").withColumn("part", (F.floor(F.col("sy") / width) * width).cast("long")).select("part", "source", "target"), "decades")
    node = lambda c: F.struct("part", F.col(c).alias("id"))
    arcs = undirected(placed.select(node("source").alias("source"), node("target").alias("target")))
    labels = cut(communities(arcs.withColumn("part", F.col("a.part"))), "maps")
    spans = placed.select("part").distinct()  # a row per span
    follows = spans.select("part", F.lead("part").over(Window.orderBy("part")).alias("next")).where("next is not null")
    own = labels.select(F.col("id.part").alias("part"), F.col("id.id").alias("id"), F.col("c.id").alias("c"))
    x = own.join(F.broadcast(follows), "part").select(F.col("part").alias("decade"), "next", "id", F.col("c").alias("a"))
    y = own.select(F.col("part").alias("next"), "id", F.col("c").alias("b"))
    na, nb = x.groupBy("decade", "a").agg(F.count("*").alias("na")), y.groupBy("next", "b").agg(F.count("*").alias("nb"))
    both = x.join(y, ["next", "id"]).groupBy("decade", "next", "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    found = both.join(na, ["decade", "a"]).join(nb, ["next", "b"]).withColumn("jaccard", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6))
    return found.where(F.col("jaccard") >= least).select("decade", "a", "b", "shared", "jaccard")

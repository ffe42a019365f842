"""Citation operators: degrees, networks, flows, ages, ranks and delayed recognition.

Inputs are the scholarly tables: articles(id, pub_date, year, journal, ..), citations(source,
target, doi, ord). Rows without a target are unresolved references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions.values import ordinal, percent
from citewright.session import cut


def resolved(citations: DataFrame) -> DataFrame:
    return citations.where(F.col("target").isNotNull()).select("source", "target")


def degrees(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, n_in, n_out) for every article, by two counts instead of lookups per row."""
    links = resolved(citations)
    n_in = links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
    n_out = links.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"))
    return articles.select("id").join(n_in, "id", "left").join(n_out, "id", "left").na.fill(0)


def most_cited(articles: DataFrame, citations: DataFrame, limit: int = 50, **ranges) -> DataFrame:
    counts = resolved(citations).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
    return by_year_text(articles, **ranges).join(counts, "id").select("id", "pub_date", "journal", "n_in").orderBy(F.desc("n_in"), F.desc("pub_date"), "id").limit(limit)


def by_year_text(articles: DataFrame, year_from: int | None = None, year_to: int | None = None, journals: list[str] | None = None) -> DataFrame:
    """Filter by date text: a date of a year alone sorts before that year's first day."""
    if year_from is not None:
        articles = articles.where(F.col("pub_date") >= f"{year_from}-01-01")
    if year_to is not None:
        articles = articles.where(F.col("pub_date") <= f"{year_to}-12-31")
    return articles.where(F.col("journal").isin(journals)) if journals else articles


def top_nodes(articles: DataFrame, citations: DataFrame, least: int, most: int) -> DataFrame:
    return degrees(articles, citations).where(F.col("n_in") >= least).orderBy(F.desc("n_in"), "id").limit(most).select("id", "n_in")


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return links.join(ids, links["source"] == ids["id"], "left_semi").join(ids, links["target"] == ids["id"], "left_semi")


def network_links(articles: DataFrame, citations: DataFrame, least: int = 5, most: int = 500) -> DataFrame:
    return induced(resolved(citations), top_nodes(articles, citations, least, most)).distinct()


BLOCK = 2000  #: rows of one key that are paired in one piece; larger keys go as pairs of blocks


def in_blocks(rows: DataFrame, within: str, item: str, block: int = BLOCK) -> DataFrame:
    """``rows`` of (within, item, ..) for pairing them within a key: each row once for each pair of blocks it is in.

    A key with more than ``block`` rows is cut into blocks by its items' hashes, and each pair of blocks is a key of
    its own (columns block_i and block_j), so that a key with very many rows is spread over as many tasks as it needs.
    Two rows are a pair if they share within, block_i and block_j, and the blocks are one or theirs (block_own) differ.
    """
    large = rows.groupBy(F.col(within).alias("block_key")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = rows.join(large, F.col(within) == F.col("block_key"), "left").withColumn("block_own", F.pmod(F.xxhash64(item), blocks).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.select(*rows.columns, "block_own", F.least("block_own", "o").alias("block_i"), F.greatest("block_own", "o").alias("block_j"))


BLOCKS = ("block_i", "block_j")


def pair_counts(rows: DataFrame, within: str, item: str, least: int, block: int = BLOCK) -> DataFrame:
    """(a, b, weight) of items that share ``within``, each pair once, counted by rows; large keys go as pairs of blocks."""
    rows = in_blocks(rows.select(F.col(within).alias("k"), F.col(item).alias("x")).where("k is not null and x is not null"), "k", "x", block)
    left, right = (rows.select("k", *BLOCKS, F.col("x").alias(c), F.col("block_own").alias(f"m{c}")) for c in "ab")
    pairs = left.join(right, ["k", *BLOCKS]).where("a < b and (block_i = block_j or ma <> mb)")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def strongest(pairs: DataFrame, top: int) -> DataFrame:
    """The pairs (a, b, weight) among the ``top`` items by the sum of their weights."""
    strength = pairs.select(F.explode(F.array("a", "b")).alias("n"), "weight").groupBy("n").agg(F.sum("weight").alias("s")).orderBy(F.desc("s"), "n").limit(top)
    return pairs.join(strength.select(F.col("n").alias("a")), "a", "left_semi").join(strength.select(F.col("n").alias("b")), "b", "left_semi")


def cocitation(citations: DataFrame, least: int = 3) -> DataFrame:
    return pair_counts(resolved(citations), "source", "target", least)


def coupling(citations: DataFrame, least: int = 3) -> DataFrame:
    return pair_counts(resolved(citations), "target", "source", least)


def ego_links(citations: DataFrame, article: int) -> DataFrame:
    """Links among an article and its direct neighbours."""
    links = resolved(citations)
    near = links.where(F.col("source") == article).select(F.col("target").alias("id"))
    near = near.union(links.where(F.col("target") == article).select("source")).union(links.sparkSession.range(article, article + 1)).distinct()
    return induced(links, near).distinct()


def references_of(citations: DataFrame, articles: DataFrame, article: int) -> DataFrame:
    own = citations.where(F.col("source") == article)
    found = own.join(articles, own["target"] == articles["id"], "left")
    return found.select("ord", "doi", "target", "pub_date", "journal").orderBy(F.col("ord").isNull(), "ord", "doi")


def trends(articles: DataFrame, citations: DataFrame) -> DataFrame:
    per = degrees(articles, citations).join(articles.select("id", "year"), "id").where("n_out > 0 and year >= 1990")
    return per.groupBy("year").agg(F.round(F.avg("n_out"), 2).alias("avg_refs"), F.sum("n_out").alias("total_refs"), F.count("*").alias("n")).where("n >= 2")


def edge_table(articles: DataFrame, citations: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """Resolved links with year, journal and field group of both ends."""
    journal = F.col("journal")
    group = F.lit("OTHER")
    for name, g in (groups or {}).items():
        group = F.when(journal == name, g).otherwise(group)
    both = articles.select("id", "year", "journal", group.alias("g"))
    s = both.select(F.col("id").alias("source"), F.col("year").alias("sy"), F.col("journal").alias("sj"), F.col("g").alias("sg"))
    t = both.select(F.col("id").alias("target"), F.col("year").alias("ty"), F.col("journal").alias("tj"), F.col("g").alias("tg"))
    return resolved(citations).join(s, "source").join(t, "target")


def boundary_degrees(edges: DataFrame) -> DataFrame:
    """(id, g, boundary): distinct neighbours in another field group, of nodes whose own group isn't OTHER; 0 for the others."""
    ends = edges.where("source <> target").select("source", "sg", "target", "tg")
    ends = ends.union(ends.select("target", "tg", "source", "sg")).toDF("id", "g", "other", "og").distinct()
    return ends.groupBy("id", "g").agg(F.count(F.when((F.col("g") != F.col("og")) & (F.col("g") != "OTHER"), 1)).alias("boundary"))


def journal_flow(edges: DataFrame, least: int = 1) -> DataFrame:
    return edges.groupBy("sj", "tj").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def weighted_percentiles(counts: DataFrame, by: str, value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """Lower weighted percentiles: the first value whose running weight reaches the share."""
    order = Window.partitionBy(by).orderBy(value)
    run = counts.withColumn("_run", F.sum(weight).over(order)).withColumn("_all", F.sum(weight).over(Window.partitionBy(by)))
    return run.groupBy(by).agg(*(F.min(F.when(F.col("_run") >= F.col("_all") * p, F.col(value))).alias(name) for name, p in shares.items()), F.max("_all").alias("n"))


def half_life(edges: DataFrame, side: str) -> DataFrame:
    """Quartiles of citation ages of each journal, on the citing (``sj``) or cited (``tj``) side."""
    ages = edges.withColumn("age", F.col("sy") - F.col("ty")).where("age >= 0").groupBy(side, "age").agg(F.count("*").alias("w"))
    return weighted_percentiles(ages, side, "age", "w", {"q25": 0.25, "half_life": 0.5, "q75": 0.75}).withColumnRenamed(side, "journal")


def half_life_series(edges: DataFrame, side: str, least: int = 10) -> DataFrame:
    """Half-life per journal and citing year with ``least`` or more links: the first age up to which half of them lie."""
    by = edges.where("sy >= ty").groupBy(F.col(side).alias("journal"), F.col("sy").alias("year"), (F.col("sy") - F.col("ty")).alias("age")).agg(F.count("*").alias("k"))
    at = Window.partitionBy("journal", "year")
    run = by.withColumn("upto", F.sum("k").over(at.orderBy("age"))).withColumn("n", F.sum("k").over(at)).where(F.col("n") >= least)
    return run.groupBy("journal", "year").agg(F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("age"))).alias("half_life"), F.max("n").alias("n"))


def sleeping_beauties(articles: DataFrame, citations: DataFrame, least: int = 5, limit: int = 50) -> DataFrame:
    """Articles by beauty coefficient: how far yearly citations lie below the line from nothing at
    publication to their peak. Articles whose global citations exceed three times their own here are
    scaled down by the share cited here (where ``articles`` has cited_globally).

    ``awakening`` is the first year that, like the next one, reaches max(1, a fifth of the way from
    the mean before the peak to the peak), else the peak. ``n_in`` counts all citations, ``total``
    those from publication on; articles never cited after publication are no candidates.
    """
    links = edge_table(articles, citations)
    n_in = links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in")).where(F.col("n_in") >= least)
    edges = links.where("sy >= ty").groupBy(F.col("target").alias("id"), "ty", "sy").agg(F.count("*").alias("c"))
    span = edges.groupBy("id", "ty").agg(F.sum("c").alias("total"), F.max("sy").alias("last")).join(n_in, "id")
    years = span.withColumn("sy", F.explode(F.sequence("ty", "last"))).join(edges, ["id", "ty", "sy"], "left").na.fill(0, ["c"])
    peak = years.groupBy("id").agg(F.max_by("sy", F.struct("c", -F.col("sy"))).alias("peak"), F.max("c").alias("top"))
    lined = years.withColumn("next", F.lead("c", 1, 0).over(Window.partitionBy("id").orderBy("sy"))).join(peak, "id").where("sy <= peak and peak > ty")
    mean = lined.where("sy < peak").groupBy("id").agg(F.avg("c").alias("mean"))
    lined = lined.join(mean, "id").withColumn("bar", F.greatest(F.lit(1.0), F.col("mean") + 0.2 * (F.col("top") - F.col("mean"))))
    line = F.col("top") * (F.col("sy") - F.col("ty")) / (F.col("peak") - F.col("ty"))
    woken = (F.col("c") >= F.col("bar")) & ((F.col("next") >= F.col("bar")) | (F.col("sy") == F.col("peak")))
    scored = lined.groupBy("id", "ty", "n_in", "total", "peak").agg(F.sum(line - F.col("c")).alias("beauty"), F.coalesce(F.min(F.when(woken, F.col("sy"))), F.first("peak")).alias("awakening"))
    if "cited_globally" in articles.columns:
        scored = scored.join(articles.select("id", "cited_globally"), "id")
        penalty = F.when(F.col("cited_globally") > 3 * F.col("n_in"), F.col("n_in") / (F.col("n_in") + F.col("cited_globally"))).otherwise(1.0)
    else:
        penalty = F.lit(1.0)
    scored = scored.select("id", "n_in", "total", "peak", F.round(F.col("beauty") * penalty, 6).alias("beauty"), "awakening", (F.col("awakening") - F.col("ty")).alias("sleep_years"))
    return scored.orderBy(F.desc("beauty"), "id").limit(limit)


def princes(beauties: DataFrame, edges: DataFrame, authors: DataFrame) -> DataFrame:
    """Citing articles of each beauty from the year before its awakening on, and what kind of
    awakening their journals and first authors make it."""
    first = authors.groupBy(F.col("id").alias("source")).agg(F.min_by("name", "pos").alias("first"))
    woke = beauties.select(F.col("id").alias("target"), "awakening")
    found = edges.join(woke, "target").where(F.col("sy") >= F.col("awakening") - 1).join(first, "source", "left")
    found = found.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("sj").alias("journals"), F.countDistinct("first").alias("firsts"))
    n, journals = F.coalesce("n", F.lit(0)), F.coalesce("journals", F.lit(0))
    # fixed: the kinds and their limits
    kind = (
        F.when(n == 0, "no_data").when(n == 1, "single_catalyst").when(journals == 1, "journal_specific").when(F.col("firsts") == 1, "individual_rediscovery")
        .when((journals >= 4) & (n >= 8), "broad_trend").otherwise("subfield_revival")
    )
    return woke.join(found, "target", "left").select(F.col("target").alias("id"), "awakening", n.alias("princes"), journals.alias("journals"), kind.alias("kind"))


def calendar(beauties: DataFrame, events: DataFrame, years: int = 5) -> DataFrame:
    """Mean number of awakenings a year in the ``years`` years from each event(year, type) on, by type."""
    woken = beauties.groupBy(F.col("awakening").alias("year")).agg(F.count("*").alias("woken"))
    spread = events.select("type", F.explode(F.sequence("year", F.col("year") + years - 1)).alias("year"))
    return spread.join(woken, "year", "left").groupBy("type").agg((F.count("*") / years).cast("long").alias("events"), F.round(F.sum(F.coalesce("woken", F.lit(0))) / F.count("*"), 2).alias("mean_awakenings"))


def group_flow(edges: DataFrame) -> DataFrame:
    """Links between field groups by citing decade, and over all decades, in one rollup."""
    decades = edges.withColumn("decade", (F.floor(F.col("sy") / 10) * 10).cast("int"))
    flow = decades.cube("decade", "sg", "tg").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return flow.where("gid in (0, 4)").select("decade", "sg", "tg", "n")


def delays(edges: DataFrame) -> DataFrame:
    """Delay statistics of each direction between groups; percentiles by index into the sorted ages.

    All of it comes from counts by age, a few rows for each direction.
    """
    by = edges.withColumn("d", F.col("sy") - F.col("ty")).where("d >= 0").groupBy("sg", "tg", "d").agg(F.count("*").alias("k"))
    w = Window.partitionBy("sg", "tg")
    at = by.withColumn("upto", F.sum("k").over(w.orderBy("d"))).withColumn("n", F.sum("k").over(w)).withColumn("mean", F.sum(F.col("k") * F.col("d")).over(w) / F.col("n"))
    pick = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("d")))
    spread = F.sqrt(F.sum(F.col("k") * F.pow(F.col("d") - F.col("mean"), 2)) / F.max("n"))
    return at.groupBy("sg", "tg").agg(F.max("n").alias("n"), F.round(F.max("mean"), 6).alias("mean"), pick(0.25).alias("p25"), pick(0.5).alias("median"), pick(0.75).alias("p75"), F.round(spread, 6).alias("sd"), F.max("d").alias("longest"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Distinct links across groups, and how many of them are returned."""
    across = edges.where("sg <> tg").select("source", "target", "sg", "tg").distinct()
    back = across.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("back"))
    return across.join(back, ["source", "target"], "left").groupBy("sg", "tg").agg(F.count("*").alias("links"), F.count("back").alias("mutual"))


def lorenz(counts: DataFrame, value: str, points: int = 100) -> DataFrame:
    """Cumulative share of the total at each of ``points`` population steps, lowest values first.

    Rows are first gathered by value, so the window runs over distinct values, not over rows.
    """
    by = counts.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    run = by.select("v", "n", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum(F.col("n") * F.col("v")).over(Window.orderBy("v")).alias("total"), F.sum("n").over(Window.partitionBy()).alias("rows"), F.sum(F.col("n") * F.col("v")).over(Window.partitionBy()).alias("whole"))
    steps = run.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("step"))
    at = F.floor(F.col("rows") * F.col("step") / points)
    inside = run.crossJoin(F.broadcast(steps)).where((at > F.col("upto") - F.col("n")) & (at <= F.col("upto")))  # steps: ``points`` rows
    return inside.select("step", F.round((F.col("total") - (F.col("upto") - at) * F.col("v")) / F.col("whole"), 6).alias("share"))


def gini(counts: DataFrame, value: str) -> DataFrame:
    """Gini coefficient from value frequencies: one row."""
    by = counts.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    run = by.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
    ranks = F.col("n") * (2 * F.col("upto") - F.col("n") + 1) / 2  # the sum of the ranks of equal values
    sums = run.agg(F.sum(ranks * F.col("v")).alias("s"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("t"))
    return sums.select(F.round(2 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n"), 6).alias("gini"), "n", F.col("t").alias("total"))


def reach(edges: DataFrame, until: int, top: int = 100) -> DataFrame:
    """Yearly and running citations of the most cited articles, with empty years filled."""
    best = edges.groupBy("target").agg(F.count("*").alias("all"), F.min("ty").alias("first")).orderBy(F.desc("all"), "target").limit(top)
    years = best.where(F.col("first") <= until).select("target", F.explode(F.sequence("first", F.lit(until))).alias("sy"))
    n = edges.join(best.select("target"), "target", "left_semi").groupBy("target", "sy").agg(F.count("*").alias("n"))
    return years.join(n, ["target", "sy"], "left").na.fill(0, ["n"]).withColumn("running", F.sum("n").over(Window.partitionBy("target").orderBy("sy")))


def unread_canon(articles: DataFrame, citations: DataFrame, globally: int = 100, here: int = 2, limit: int = 200) -> DataFrame:
    n = degrees(articles, citations).join(articles.select("id", "cited_globally"), "id").where((F.col("cited_globally") >= globally) & (F.col("n_in") <= here))
    ratio = F.round(F.col("cited_globally") / (F.col("n_in") + 1), 6)
    return n.select("id", "cited_globally", "n_in", ratio.alias("ratio")).orderBy(F.desc("ratio"), "id").limit(limit)


def _shared_references(citations: DataFrame, least: int, few: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, weight) by shared references, unresolved ones included, and (source, refs); references
    with more than ``most`` citers and sources with fewer than ``few`` references take no part."""
    refs = citations.select("source", F.coalesce(F.col("target").cast("string"), F.col("doi")).alias("ref")).repartition("source").distinct()
    size = refs.groupBy("source").agg(F.count("*").alias("refs")).where(F.col("refs") >= few)
    placed = refs.withColumn("refs", F.count("*").over(Window.partitionBy("source")))  # a source's own references
    hot = refs.groupBy("ref").agg(F.count("*").alias("citers")).where((F.col("citers") >= 2) & (F.col("citers") <= most))
    used = placed.where((F.col("refs") >= few) & F.col("source").isNotNull()).select("source", "ref").join(hot.select("ref"), "ref", "left_semi")
    return _listed_pairs(used, "ref", "source", least), size


def _listed_pairs(rows: DataFrame, within: str, item: str, least: int) -> DataFrame:
    """``pair_counts`` of distinct rows where a key has few items: an item goes to its count once a key, with the list
    of the items after it, so a pair costs one number there and no row."""
    lists = rows.groupBy(within).agg(F.sort_array(F.collect_list(item)).alias("all"))
    after = lists.select("all", F.posexplode("all").alias("at", "a")).select("a", F.slice("all", F.col("at") + 2, F.size("all")).alias("after"))
    pairs = after.where(F.size("after") > 0).repartition("a").select("a", F.explode("after").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def shared_foundations(citations: DataFrame, least: int = 3, few: int = 5, most: int = 200, top: int = 400, links: int = 2000) -> DataFrame:
    """The strongest pairs by shared references among the ``top`` articles by the sum of theirs, with their Jaccard index."""
    pairs, size = _shared_references(citations, least, few, most)
    pairs = cut(pairs, "shared")  # read three times
    strength = pairs.select(F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("s")).orderBy(F.desc("s"), "id").limit(top)
    kept = pairs.join(strength.select(F.col("id").alias("a")), "a", "left_semi").join(strength.select(F.col("id").alias("b")), "b", "left_semi")
    kept = kept.orderBy(F.desc("weight"), "a", "b").limit(links)
    a, b = (size.select(F.col("source").alias(c), F.col("refs").alias(f"refs_{c}")) for c in "ab")
    share = F.round(F.col("weight") / (F.col("refs_a") + F.col("refs_b") - F.col("weight")), 6)
    return kept.join(a, "a").join(b, "b").select("a", "b", "weight", share.alias("jaccard"))


def coupling_asymmetry(citations: DataFrame, least: int = 2, few: int = 3, most: int = 200, limit: int = 200) -> DataFrame:
    """Pairs that share references, by how unequal the shared part is."""
    pairs, size = _shared_references(citations, least, few, most)
    a = size.select(F.col("source").alias("a"), F.col("refs").alias("refs_a"))
    b = size.select(F.col("source").alias("b"), F.col("refs").alias("refs_b"))
    gap = F.round(F.abs(F.col("weight") / F.col("refs_a") - F.col("weight") / F.col("refs_b")), 6)
    return pairs.join(a, "a").join(b, "b").select("a", "b", "weight", "refs_a", "refs_b", gap.alias("gap")).orderBy(F.desc("gap"), "a", "b").limit(limit)


def coverage_by_journal(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """Per journal: articles, raw and resolved outbound links, inbound links, links to itself."""
    c = citations.join(articles.select(F.col("id").alias("source"), F.col("journal").alias("sj")), "source").join(articles.select(F.col("id").alias("target"), F.col("journal").alias("tj")), "target", "left")
    out = c.groupBy(F.col("sj").alias("journal")).agg(F.count("*").alias("raw_out"), F.count("target").alias("resolved_out"), F.countDistinct(F.when(F.col("target").isNotNull(), F.col("source"))).alias("citing"), F.sum(F.when(F.col("sj") == F.col("tj"), 1).otherwise(0)).alias("to_itself"))
    inbound = c.where("tj is not null").groupBy(F.col("tj").alias("journal")).agg(F.count("*").alias("n_in"), F.countDistinct("target").alias("cited"))
    base = articles.groupBy("journal").agg(F.count("*").alias("articles"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return base.join(out, "journal", "left").join(inbound, "journal", "left").na.fill(0)


def corpus_totals(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: articles, citation rows, resolved ones and their percentage, citing and cited articles."""
    n = articles.agg(F.count("*").alias("articles"), F.countDistinct("journal").alias("journals"))
    c = citations.agg(F.count("*").alias("citations"), F.count("target").alias("resolved"), F.countDistinct("source").alias("citing"), F.countDistinct("target").alias("cited"))
    return n.crossJoin(F.broadcast(c)).withColumn("percent", percent(F.col("resolved"), F.col("citations")))  # two rows of one


def reference_coverage(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """Per journal the articles with references and their percentage."""
    known = citations.select(F.col("source").alias("id"), F.lit(1).alias("has")).distinct()
    by = articles.join(known, "id", "left").groupBy("journal").agg(F.count("*").alias("articles"), F.count("has").alias("fetched"))
    return by.withColumn("percent", percent(F.col("fetched"), F.col("articles")))


def without_references(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """Articles whose references are still to be fetched, with their date."""
    return articles.join(citations.select(F.col("source").alias("id")), "id", "left_anti").select("id", "pub_date", "journal")


def outside_counts(citations: DataFrame) -> DataFrame:
    """Unresolved references per article that has any."""
    return citations.where("target is null").groupBy("source").agg(F.count("*").alias("n"))


def doi_map(rows: DataFrame) -> DataFrame:
    """(doi, id) by lower-case, trimmed doi; of several rows the last id."""
    return rows.where("doi is not null").groupBy(F.lower(F.trim("doi")).alias("doi")).agg(F.max("id").alias("id"))

"""Chapter tools: sources and sinks, canons, reach, ranking, the long tail, teams, lineages, master list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions.values import ordinal
from citewright.operators.citations import BLOCKS, degrees, in_blocks
from citewright.operators.dags import main_paths, path_counts, without_cycles

FRONTIER = 2021  # fixed: sinks from this year on may still get their references cited
# Fixed: generations of citing articles, and decades of main paths, from a first year to before a last one.
GENERATIONS = (("Pre-1995", 0, 1995), ("1995-2004", 1995, 2005), ("2005-2014", 2005, 2015), ("2015+", 2015, 2100))
DECADES = (("1970s-80s", 1970, 1990), ("1990s", 1990, 2000), ("2000s", 2000, 2010), ("2010s", 2010, 2020), ("2020s", 2020, 2100))


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def origins(records: DataFrame, citations: DataFrame, frontier: int = FRONTIER) -> DataFrame:
    """``records`` with degrees and roles: ``is_source`` (never cited) and, of those that cite nothing,
    ``sink``: data-gap where references were never fetched, frontier from year ``frontier`` on, else true."""
    n = degrees(records, citations).join(records.select("id", "journal", "year", "pub_date", "refs_at", "cited_globally"), "id")
    sink = F.when(F.col("refs_at").isNull(), "data-gap").when(F.col("year") >= frontier, "frontier").otherwise("true")
    return n.withColumn("is_source", F.col("n_in") == 0).withColumn("sink", F.when(F.col("n_out") == 0, sink))


def origin_rates(roles: DataFrame) -> DataFrame:
    """Per journal the sources and the sinks of each kind, and the shares of sources and of true sinks."""
    found = roles.where("journal is not null").groupBy("journal").agg(
        F.count("*").alias("articles"), _n(F.col("is_source")).alias("sources"), _n(F.col("sink") == "true").alias("true_sinks"),
        _n(F.col("sink") == "frontier").alias("frontier"), _n(F.col("sink") == "data-gap").alias("data_gap"),
    )
    return found.select("*", F.round(F.col("sources") / F.col("articles"), 6).alias("source_rate"), F.round(F.col("true_sinks") / F.col("articles"), 6).alias("sink_rate"))


def origin_years(roles: DataFrame) -> DataFrame:
    """Per year the sources, the true sinks that are no sources, and all others."""
    sink = ~F.col("is_source") & F.coalesce(F.col("sink") == "true", F.lit(False))
    return roles.where("year is not null").groupBy("year").agg(_n(F.col("is_source")).alias("sources"), _n(sink).alias("sinks"), _n(~F.col("is_source") & ~sink).alias("other"))


def notable_origins(roles: DataFrame, globally: int = 20, top: int = 15) -> DataFrame:
    """Three lists: sources most cited elsewhere, the oldest true sinks, the newest frontier."""
    lists = (
        ("source", roles.where(F.col("is_source") & (F.col("cited_globally") >= globally)).orderBy(F.desc("cited_globally"), "id")),
        ("true", roles.where("sink = 'true'").orderBy(F.asc_nulls_last("pub_date"), "id")),
        ("frontier", roles.where("sink = 'frontier'").orderBy(F.desc_nulls_last("pub_date"), "id")),
    )
    return reduce(DataFrame.union, (rows.limit(top).select(F.lit(name).alias("list"), "id", "pub_date", "cited_globally") for name, rows in lists))


def traditions(grouped: DataFrame) -> DataFrame:
    """Journals of each field group with articles and years; rows with ``g`` and a journal."""
    return grouped.where("journal is not null and journal <> ''").groupBy("g", "journal").agg(F.count("*").alias("articles"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def currents(edges: DataFrame, windows=DECADES) -> DataFrame:
    """The main path of each window from links whose both ends lie in it: (window, step, source, target, spc).

    Links run from the cited to the citing article. All windows, which may overlap, go through the same
    rounds: a node is a window and an id. Links without both years lie in no window.
    """
    inside = F.array_compact(F.array(*(F.when(F.col("sy").between(first, end - 1) & F.col("ty").between(first, end - 1), F.lit(label)) for label, first, end in windows)))
    placed = edges.select("source", "target", (F.col("ty") - F.col("sy")).alias("lag"), F.explode(inside).alias("w"))
    node = lambda c: F.struct(F.col("w").alias("window"), F.col(c).alias("id")).alias(c)
    kept = without_cycles(placed.where("source is not null and target is not null").select(node("source"), node("target"), "lag"))
    paths = main_paths(path_counts(kept.select(F.col("target").alias("source"), F.col("source").alias("target"))), F.col("source.window"))
    return paths.select(F.col("part").alias("window"), "step", F.col("source.id").alias("source"), F.col("target.id").alias("target"), "spc")


def persistent(paths: DataFrame) -> DataFrame:
    """Articles on the main paths with the windows that hold them."""
    on = paths.select("window", "source").union(paths.select("window", "target")).toDF("window", "id").distinct()
    return on.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("window")), ",").alias("windows"))


def _ranks(rows: DataFrame, value: str, some: DataFrame, name: str) -> DataFrame:
    """(id, ``name``): the ranks that the rows of ``some`` have among all by ``value``, larger first, then id.

    Counts by value and, inside one value, a join with the few asked rows take the place of an order of all.
    """
    by = rows.groupBy(value).agg(F.count("*").alias("n"))
    above = by.select(value, (F.sum("n").over(Window.orderBy(F.desc(value))) - F.col("n")).alias("above"))  # a row per distinct value
    asked = some.select(F.col("id").alias("asked"), value)
    same = rows.join(F.broadcast(asked), value).where("id <= asked").groupBy("asked", value).agg(F.count("*").alias("k"))  # two lists' rows
    return same.join(above, value).select(F.col("asked").alias("id"), (F.col("above") + F.col("k")).alias(name))


def fair_ranking(articles: DataFrame, citations: DataFrame, as_of: int, exclude: int = 2, top: int = 50) -> DataFrame:
    """Cited articles that lead by citations or by citations a year of life, with both ranks.

    Articles of the last ``exclude`` years don't count. stable_canon leads both ways, age_advantage by
    citations only, rising_fast by the yearly rate only; rank_shift is how far the rate lifts an article.
    """
    n = degrees(articles, citations).where("n_in > 0").join(articles.select("id", "year"), "id").where(F.col("year") <= as_of - exclude)
    n = n.select("id", "year", "n_in", F.round(F.col("n_in") / F.greatest(F.lit(1), as_of - F.col("year")), 3).alias("rate"))
    lead = n.orderBy(F.desc("n_in"), "id").limit(top).union(n.orderBy(F.desc("rate"), "id").limit(top)).distinct()
    ranked = lead.join(_ranks(n, "n_in", lead, "raw_rank"), "id").join(_ranks(n, "rate", lead, "norm_rank"), "id")
    kind = F.when((F.col("raw_rank") <= top) & (F.col("norm_rank") <= top), "stable_canon").when(F.col("raw_rank") <= top, "age_advantage").otherwise("rising_fast")
    return ranked.select("*", (F.col("raw_rank") - F.col("norm_rank")).alias("rank_shift"), kind.alias("kind"))


def long_tail(edges: DataFrame, authors: DataFrame, top: int = 50) -> DataFrame:
    """Most cited articles: share from their own journal, citing journals and authors, how unequally
    authors cite (Gini), the author who cites most with their share, and how broad the canon is.

    Broad or narrow is what two of three measures say: 30 or more authors against under 15, an own
    share under 0.3 against over 0.5, a Gini under 0.3 against over 0.5.
    """
    n = edges.groupBy("target").agg(F.count("*").alias("n"), F.count(F.when(F.col("sj") == F.col("tj"), 1)).alias("own"), F.countDistinct("sj").alias("journals"))
    best = n.orderBy(F.desc("n"), "target").limit(top)
    citing = edges.join(F.broadcast(best.select("target")), "target", "left_semi").select("target", F.col("source").alias("id"))  # ``top`` rows
    per = citing.join(authors.select("id", "name"), "id").groupBy("target", "name").agg(F.count("*").alias("k"))
    order = Window.partitionBy("target").orderBy("k", "name")
    ranked = per.withColumn("i", F.row_number().over(order))
    spread = ranked.groupBy("target").agg(
        F.count("*").alias("citing_authors"), F.sum("k").alias("t"), F.sum(F.col("i") * F.col("k")).alias("s"), F.min(F.struct(-F.col("k"), F.col("name"))).alias("most"))
    m = F.col("citing_authors")
    g = F.coalesce(2 * F.col("s") / (m * F.col("t")) - (m + 1) / m, F.lit(0.0))
    rows = best.join(spread, "target", "left").select("*", (F.col("own") / F.col("n")).alias("share"), g.alias("g"), F.coalesce(m, F.lit(0)).alias("people"))
    people, share, gini = F.col("people"), F.col("share"), F.col("g")
    # fixed: the limits of the three measures
    broad = [people >= 30, share < 0.3, gini < 0.3]
    narrow = [people < 15, share > 0.5, gini > 0.5]
    count = lambda tests: reduce(lambda a, b: a + b, (F.when(t, 1).otherwise(0) for t in tests))
    breadth = F.when(count(broad) >= 2, "broadly_canonical").when(count(narrow) >= 2, "narrowly_canonical").otherwise("mixed")
    return rows.select(
        F.col("target").alias("id"), "n", F.round("share", 6).alias("own_share"), "journals", people.alias("citing_authors"), F.round("g", 6).alias("author_gini"),
        F.col("most.name").alias("top_citer"), F.round(F.coalesce(-F.col("most.col1"), F.lit(0)) / F.col("n"), 6).alias("top_share"), breadth.alias("breadth"),
    )


def shifting_canons(edges: DataFrame, generations=GENERATIONS, top: int = 25) -> DataFrame:
    """Articles most cited by some generation of citing articles: their rank in each, and what becomes of them.

    enduring in all, generational_only in one, rising from out of the first into the last, fading the
    other way, else intermittent. A rank outside the top is null.
    """
    label = reduce(lambda w, g: F.when((F.col("sy") >= g[1]) & (F.col("sy") < g[2]), g[0]).otherwise(w), generations, F.lit(None).cast("string"))
    n = edges.select(label.alias("generation"), "target").where("generation is not null").groupBy("generation", "target").agg(F.count("*").alias("n"))
    best = n.withColumn("rank", ordinal(F.desc("n"), F.col("target"), by=("generation",))).where(F.col("rank") <= top)
    names = [g[0] for g in generations]
    wide = best.groupBy(F.col("target").alias("id")).agg(*(F.max(F.when(F.col("generation") == g, F.col("rank"))).alias(f"rank_{k}") for k, g in enumerate(names)), F.count("*").alias("generations"))
    first, last = F.col("rank_0"), F.col(f"rank_{len(names) - 1}")
    kind = (
        F.when(F.col("generations") == len(names), "enduring").when(F.col("generations") == 1, "generational_only")
        .when(first.isNull() & last.isNotNull(), "rising").when(first.isNotNull() & last.isNull(), "fading").otherwise("intermittent")
    )
    return wide.withColumn("kind", kind)


def reach_patterns(edges: DataFrame, as_of: int, top: int = 100) -> DataFrame:
    """How the citations of the most cited articles spread over their years: total from publication on,
    peak year (the first of equal ones) with its count, and the pattern.

    too_few under 5; too_recent within 4 years; front_loaded with 60 % in the first three years;
    late_bloomer with a peak from year 5 on at twice the mean rate; one_wave with half in one year; else steady_classic.
    """
    best = edges.groupBy("target").agg(F.count("*").alias("all"), F.min("ty").alias("year")).where("year is not null").orderBy(F.desc("all"), "target").limit(top)
    by = edges.join(F.broadcast(best), "target").where((F.col("sy") >= F.col("year")) & (F.col("sy") <= as_of)).groupBy("target", "sy").agg(F.count("*").alias("n"))  # ``top`` rows
    age = F.col("sy") - F.col("year")
    sums = by.join(best, "target").groupBy("target").agg(F.sum("n").alias("total"), F.max_by("sy", F.struct(F.col("n"), -F.col("sy"))).alias("peak"), F.max("n").alias("peak_n"), F.sum(F.when(age < 3, F.col("n")).otherwise(0)).alias("early"))
    rows = best.join(sums, "target", "left").select("target", "year", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("peak", "year").alias("peak_year"), F.coalesce("peak_n", F.lit(0)).alias("peak_count"), F.coalesce("early", F.lit(0)).alias("early"))
    # fixed: the patterns and their limits
    lived, total, peak = as_of - F.col("year"), F.col("total"), F.col("peak_count")
    pattern = (
        F.when(total < 5, "too_few").when(lived <= 4, "too_recent").when(F.col("early") >= 0.6 * total, "front_loaded")
        .when((F.col("peak_year") - F.col("year") >= 5) & (peak * lived >= total * 2), "late_bloomer").when(2 * peak >= total, "one_wave").otherwise("steady_classic")
    )
    return rows.select(F.col("target").alias("id"), "year", "total", "peak_year", "peak_count", pattern.alias("pattern"))


def team_years(sizes: DataFrame) -> DataFrame:
    """Per year of sizes(id, year, size): mean, upper median, upper quartile, largest team, share of single authors."""
    by = sizes.groupBy("year", "size").agg(F.count("*").alias("k"))
    at = Window.partitionBy("year")
    run = by.withColumn("upto", F.sum("k").over(at.orderBy("size"))).withColumn("n", F.sum("k").over(at))
    pick = lambda place: F.min(F.when(F.col("upto") > place, F.col("size")))
    n = F.col("n")
    return run.groupBy("year").agg(
        F.max("n").alias("articles"), F.round(F.sum(F.col("k") * F.col("size")) / F.max("n"), 6).alias("mean_size"), pick(F.floor(n / 2)).alias("median_size"), pick(F.floor(3 * n / 4)).alias("p75"),
        F.max("size").alias("largest"), F.round(F.sum(F.when(F.col("size") == 1, F.col("k")).otherwise(0)) / F.max("n"), 6).alias("solo_share"),
    )


def team_milestones(years: DataFrame) -> DataFrame:
    """First years with a team of 5 and of 10, and with single authors below half; one row."""
    first = lambda test: F.min(F.when(test, F.col("year")))
    return years.agg(first(F.col("largest") >= 5).alias("first_5"), first(F.col("largest") >= 10).alias("first_10"), first(F.col("solo_share") < 0.5).alias("crossover"))


def largest_teams(sizes: DataFrame, least: int = 5, top: int = 25) -> DataFrame:
    return sizes.where(F.col("size") >= least).orderBy(F.desc("size"), "id").limit(top)


def lineages(authors: DataFrame, articles: DataFrame, gap: int = 10) -> DataFrame:
    """Co-authors whose first years lie ``gap`` or more apart: the earlier one as mentor, with first years,
    joint articles (a pair of names counts as often as a list holds it) and their first and last year."""
    rows = authors.join(articles.where("year is not null").select("id", "year"), "id").select("id", "name", "year", "pos")
    first = rows.groupBy("name").agg(F.min("year").alias("first"))
    placed = in_blocks(rows, "id", "name")
    left, right = (placed.select("id", *BLOCKS, F.col("name").alias(c), F.col("block_own").alias(f"m{c}"), *(["year"] if c == "a" else [])) for c in "ab")
    met = left.join(right, ["id", *BLOCKS]).where("a < b and (block_i = block_j or ma <> mb)")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("joint"), F.min("year").alias("first_joint"), F.max("year").alias("last_joint"))
    a, b = (first.select(F.col("name").alias(c), F.col("first").alias(f"f{c}")) for c in "ab")
    found = pairs.join(a, "a").join(b, "b").where(F.abs(F.col("fa") - F.col("fb")) >= gap)
    older = F.col("fa") < F.col("fb")
    return found.select(
        F.when(older, F.col("a")).otherwise(F.col("b")).alias("mentor"), F.when(older, F.col("b")).otherwise(F.col("a")).alias("mentee"),
        F.least("fa", "fb").alias("mentor_first"), F.greatest("fa", "fb").alias("mentee_first"), "joint", "first_joint", "last_joint",
    )


def prolific_mentors(pairs: DataFrame, least: int = 3, top: int = 30) -> DataFrame:
    return pairs.groupBy("mentor").agg(F.countDistinct("mentee").alias("mentees")).where(F.col("mentees") >= least).orderBy(F.desc("mentees"), "mentor").limit(top)


def master_list(tools: dict[str, DataFrame]) -> DataFrame:
    """Articles by the number of tools whose lists hold them; each tool gives rows with an id."""
    every = reduce(DataFrame.union, (rows.select("id", F.lit(name).alias("tool")) for name, rows in tools.items())).distinct()
    return every.groupBy("id").agg(F.count("*").alias("n_tools"), F.array_join(F.sort_array(F.collect_list("tool")), ", ").alias("tools"))


def known_events(seed: DataFrame, more: DataFrame) -> DataFrame:
    """Events (year, type, title) of both tables, of equal year and title the seed's first; ``more`` needs both."""
    extra = more.where("year is not null and title is not null and title <> ''")
    every = seed.select("year", "type", "title", F.lit(0).alias("rank")).union(extra.select("year", "type", "title", F.lit(1)))
    every = every.withColumn("key", F.lower(F.trim(F.coalesce("title", F.lit("")))))
    return every.withColumn("k", ordinal(F.col("rank"), F.col("type"), F.col("title"), by=("year", "key"))).where("k = 1").select("year", "type", "title")


def centrality(ranks: DataFrame, between: DataFrame) -> DataFrame:
    """(id, pagerank, betweenness), each divided by its largest value and rounded to 6 digits."""
    top = ranks.agg(F.max("rank").alias("most_rank")).crossJoin(F.broadcast(between.agg(F.max("score").alias("most_score"))))  # one row each
    both = ranks.join(between, "id", "left").crossJoin(F.broadcast(top))  # one row
    share = lambda v, m: F.round(F.when(F.col(m) > 0, F.coalesce(v, F.lit(0.0)) / F.col(m)).otherwise(0.0), 6)
    return both.select("id", share("rank", "most_rank").alias("pagerank"), share("score", "most_score").alias("betweenness"))


def community_profiles(members: DataFrame, articles: DataFrame, counts: DataFrame, least: int = 3) -> DataFrame:
    """Per community of members(id, c) with ``least`` or more: size, most frequent journal with its count, most cited article."""
    rows = members.join(articles.select("id", "journal"), "id").join(counts.select("id", "n_in"), "id", "left").na.fill(0, ["n_in"])
    by = rows.groupBy("c", "journal").agg(F.count("*").alias("n")).groupBy("c").agg(F.min(F.struct(-F.col("n"), F.col("journal"))).alias("j"))
    top = rows.groupBy("c").agg(F.count("*").alias("size"), F.min(F.struct(-F.col("n_in"), F.col("id"))).alias("best")).where(F.col("size") >= least)
    return top.join(by, "c").select("c", "size", F.col("j.journal").alias("journal"), (-F.col("j.col1")).alias("in_journal"), F.col("best.id").alias("top_article"))

"""Readers' votes and tags, removal requests, and which backups stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_VOTES = 50  # fixed: a suggestion's badge ends here


def tallies(votes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Up and down votes per article and tag; of one voter's votes(article, tag, voter, vote, at, seq) the last counts.

    Votes other than 1 and -1 don't count, nor, where ``known(article, tag)`` is given, votes on tags that the
    article doesn't have. Votes without a voter are one voter's.
    """
    votes = votes.where("vote in (1, -1)")
    if known is not None:
        votes = votes.join(known.select("article", "tag").distinct(), ["article", "tag"], "left_semi")
    last = votes.groupBy("article", "tag", "voter").agg(F.max_by("vote", F.struct("at", "seq")).alias("vote"))
    return last.groupBy("article", "tag").agg(F.count(F.when(F.col("vote") > 0, 1)).alias("up"), F.count(F.when(F.col("vote") < 0, 1)).alias("down"))


def submissions(asked: DataFrame, known: DataFrame, decided: DataFrame) -> DataFrame:
    """``asked(article, tag, client, at, seq)`` with the status each submission meets.

    exists: the article has that tag in ``known(article, tag)``. approved or rejected: decided before
    in ``decided(article, tag, status, at)``. pending: the first one, one without a client, or the same
    client as recorded. bumped: another client. The recorded client is the last one not null. A
    window per article and tag in order of time; Spark spills its sorted rows.
    """
    order = Window.partitionBy("article", "tag").orderBy("at", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = asked.join(known.select("article", "tag", F.lit(True).alias("_known")).distinct(), ["article", "tag"], "left")
    first = decided.groupBy("article", "tag").agg(F.min_by("status", "at").alias("_status"), F.min("at").alias("_when"))
    rows = rows.join(first, ["article", "tag"], "left")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_last", F.last("client", ignorenulls=True).over(before))
    bumped = F.col("client").isNotNull() & (F.col("_last").isNull() | (F.col("_last") != F.col("client")))
    status = F.when(F.col("_known"), "exists").when((F.col("_n") > 1) & (F.col("_when") < F.col("at")), F.col("_status")).when((F.col("_n") > 1) & bumped, "bumped").otherwise("pending")
    return rows.withColumn("status", status).drop("_known", "_status", "_when", "_n", "_last")


def queue(judged: DataFrame) -> DataFrame:
    """Suggestions with their votes, from the rows of ``submissions``."""
    by = judged.where("status <> 'exists'").groupBy("article", "tag")
    return by.agg(F.least(F.lit(1) + F.count(F.when(F.col("status") == "bumped", 1)), F.lit(MAX_VOTES)).alias("votes"), F.min("at").alias("first_at"))


def decide(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """``suggestions(article, tag, ..)`` with status, decided_by and decided_at: pending until decided, by the last of
    decisions(article, tag, decision, actor, at), where approve and reject alone decide."""
    made = decisions.where("decision in ('approve', 'reject')").groupBy("article", "tag").agg(F.max_by(F.struct("decision", "actor", "at"), F.struct("at", "decision", "actor")).alias("_d"))
    status = F.when(F.col("_d").isNull(), "pending").when(F.col("_d.decision") == "approve", "approved").otherwise("rejected")
    return suggestions.join(made, ["article", "tag"], "left").select(*suggestions.columns, status.alias("status"), F.col("_d.actor").alias("decided_by"), F.col("_d.at").alias("decided_at"))


def listed_queue(decided: DataFrame, status: str | None = None) -> DataFrame:
    """Suggestions of one status, or all, the newest first."""
    rows = decided if status is None else decided.where(F.col("status") == status)
    return rows.orderBy(F.desc("first_at"), "article", "tag")


def request_states(audit: DataFrame) -> DataFrame:
    """State of each removal request from audit(request, action, at, seq).

    Requests wait until a ``verify`` row; the first ``approve`` or ``deny`` after it decides.
    """
    seen = audit.groupBy("request").agg(F.min(F.when(F.col("action") == "verify", F.struct("at", "seq"))).alias("v"), F.count("*").alias("entries"))
    after = audit.where("action in ('approve', 'deny')").join(seen.select("request", "v"), "request").where(F.struct("at", "seq") > F.col("v"))
    decided = after.groupBy("request").agg(F.min_by("action", F.struct("at", "seq")).alias("d"))
    state = F.when(F.col("v").isNull(), "waiting").when(F.col("d").isNull(), "verified").when(F.col("d") == "approve", "approved").otherwise("denied")
    return seen.join(decided, "request", "left").select("request", state.alias("state"), "entries")


def retained(backups: DataFrame, now: str, days: int = 30, weeks: int = 26, months: int = 12) -> DataFrame:
    """(key, zone) of backups(key, at) that stay: all of the last days, then the newest of each ISO
    week, then of each month; older ones go. Of equal times the smaller key stays."""
    ago = lambda n: F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(n))
    at = F.col("at").cast("timestamp")
    zone = F.when(at >= ago(days), "daily").when(at >= ago(7 * weeks), "weekly").when(at >= ago(30 * months), "monthly")
    rows = backups.select("key", at.alias("at"), zone.alias("zone")).where("zone is not null")
    period = F.when(F.col("zone") == "weekly", F.concat_ws("-", F.expr("extract(YEAROFWEEK FROM at)"), F.weekofyear("at"))).otherwise(F.date_format("at", "yyyy-MM"))
    newest = rows.where("zone <> 'daily'").groupBy("zone", period.alias("period")).agg(F.min_by("key", F.struct(-F.unix_micros("at"), F.col("key"))).alias("key"))
    return rows.where("zone = 'daily'").select("key", "zone").union(newest.select("key", "zone"))

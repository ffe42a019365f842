"""Event streams: windows, sessions, latest state and once-only intake, run to the end of the input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from citewright.session import expire, shared_path


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of its files."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def _folder(spark: SparkSession, sf_dir: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{sf_dir}/events.parquet" if fs.getFileStatus(where).isDirectory() else f"{sf_dir}/events*.parquet"


def drain(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run the stream over all that is there, into a table in the shared folder, and read that.

    append: rows that no later event can change. update: each batch's changed rows; of rows with equal
    ``keys`` the one of the last batch counts, and state that the watermark has passed is dropped.
    complete: all rows after each batch, state of everything stays. A batch that runs again writes the
    same part again.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, number: int) -> None:
            part = f"{out}/batch={number}" if mode == "update" else out
            batch.write.mode("overwrite").parquet(part)

        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    expire(spark, out)
    expire(spark, state)
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return last.select("row.*")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block and goes back after it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def in_parts(rows: DataFrame, slices: list[tuple[F.Column, str]], label: str) -> DataFrame:
    """``rows`` as a stream that gets a file at a time: a file for each (condition, name), in that order."""
    spark = rows.sparkSession
    path = shared_path(spark, label)
    for condition, name in slices:
        rows.where(condition).coalesce(1).write.parquet(f"{path}/{name}")
    expire(spark, path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    n = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return n.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    n = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def latest(events: DataFrame) -> DataFrame:
    """The last value of each user and kind of event: the newest by time, then by id."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events without repeats of ``key``; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])

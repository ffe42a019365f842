"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("citewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CITEWRIGHT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_stand_in: list[str] = []  # the folder of a local session without the setting


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (tests in local mode) a temporary folder stands in for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _stand_in:
        _stand_in.append(tempfile.mkdtemp(prefix="spark-"))
    return _stand_in[0]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut", compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The lineage ends at files every executor can read, so a lost executor costs a re-read, and
    nothing upstream is computed twice. The table goes when the application ends.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    expire(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop_path(spark: SparkSession, path: str) -> None:
    files, where = _located(spark, path)
    files.delete(where, True)


def expire(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver's JVM ends."""
    files, where = _located(spark, path)
    files.deleteOnExit(where)


class Tables:
    """Tables of one computation, each deleted when it is superseded and all of them when it ends."""

    def __init__(self, spark):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
        """``df`` written and read again; the table ``instead_of`` goes."""
        path = shared_path(self.spark, label)
        df.write.parquet(path)
        expire(self.spark, path)
        table = self.spark.read.schema(df.schema).parquet(path)
        if instead_of is not None:
            self.drop(instead_of)
        self.held.append((table, path))
        return table

    def drop(self, table: DataFrame) -> None:
        for path in [p for t, p in self.held if t is table]:
            drop_path(self.spark, path)
        self.held = [(t, p) for t, p in self.held if t is not table]

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` as the last table; all others go."""
        out = self.put(df, label)
        for _, path in self.held[:-1]:
            drop_path(self.spark, path)
        return out


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Rows that Spark hands to Python at a time: few where rows hold whole texts.

    A session that asks for fewer keeps its setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) not in range(1, rows + 1):
        spark.conf.set(name, str(rows))

"""Tables of which an update rewrites only the touched parts.

Rows lie in buckets by a hash of their key. An update writes the buckets of its keys anew, beside the old ones, and
then a list that says which version of each bucket counts; the list appears at once or not at all, so readers see the
old state or the new one, and a job that fails leaves files that no list names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.functions.names import unused
from citewright.session import drop_path


class StoredTable:
    """versions/version=N/<bucket>=K has Parquet files, lists/N which version of each bucket counts; <bucket> is a name that no column has."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        files, where = self._files(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []

    def _lists(self) -> list[int]:
        return sorted(int(name) for name in self._names("lists") if name.isdigit())

    def current(self) -> tuple[int, dict]:
        """The number of the last list and what it says: a schema, and versions by bucket."""
        found = self._lists()
        if not found:
            return -1, {"schema": None, "column": None, "buckets": {}}
        files, where = self._files(f"{self.path}/lists/{found[-1]}")
        stream = files.open(where)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return found[-1], json.loads(text)

    def _commit(self, number: int, state: dict) -> None:
        """The list under its final name, by a rename that fails if another writer was first."""
        files, draft = self._files(f"{self.path}/lists/_draft-{number}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._files(f"{self.path}/lists/{number}")[1]
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"another writer has committed version {number}")

    def _folders(self, state: dict, buckets: set[int] | None = None) -> list[str]:
        return [f"{self.path}/versions/version={v}/{state['column']}={b}" for b, v in state["buckets"].items() if buckets is None or int(b) in buckets]

    def read(self, buckets: set[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first write."""
        _, state = self.current()
        if state["schema"] is None:
            return None
        folders = self._folders(state, buckets)
        return self.spark.read.schema(state["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], state["schema"])

    def _bucketed(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def update(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """``merge(old, batch)`` for the buckets that the keys of ``batch`` fall in; gives those buckets.

        ``merge`` sees the rows of these buckets alone and must not make keys of others. Before the first update
        the old rows are none, with the columns of ``batch``. A batch without rows changes nothing.
        """
        number, state = self.current()
        name = state["column"] or unused(["bucket"], batch)[0]
        touched = {r[0] for r in self._bucketed(batch, name).select(name).distinct().collect()}  # at most ``buckets`` rows
        if not touched:
            return touched
        old = self.read(touched)
        new = merge(batch.limit(0) if old is None else old, batch)
        again = self._bucketed(new, name)
        stray = again.where(~F.col(name).isin(*touched))
        version = f"{number + 1}-{uuid.uuid4().hex}"  # of two writers each has its own
        path = f"{self.path}/versions/version={version}"
        again.repartition(name).write.mode("overwrite").partitionBy(name).parquet(path)
        if not stray.isEmpty():
            raise ValueError("merge has made keys of other buckets")
        written = {int(f.split("=")[1]) for f in self._names(path.removeprefix(f"{self.path}/")) if f.startswith(f"{name}=")}
        kept = {b: v for b, v in state["buckets"].items() if int(b) not in touched} | {str(b): version for b in sorted(written)}
        self._commit(number + 1, {"schema": state["schema"] or _ddl(new), "column": name, "buckets": kept})
        return touched

    def clear(self) -> None:
        """Delete what the last list doesn't name: older lists and versions, and rests of failed jobs."""
        number, state = self.current()
        keep = set(self._folders(state))
        for name in self._names("lists"):
            if name != str(number):
                drop_path(self.spark, f"{self.path}/lists/{name}")
        for version in self._names("versions"):
            for bucket in self._names(f"versions/{version}"):
                if f"{self.path}/versions/{version}/{bucket}" not in keep:
                    drop_path(self.spark, f"{self.path}/versions/{version}/{bucket}")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

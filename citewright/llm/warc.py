"""WARC archives as a Python data source: a writer and a reader.

Each record is a gzip member of its own, and the member's extra field says how long it is. The
reader plans one partition per archive file, takes predicates on the record type and other header
columns, unpacks a record's header first and seeks past the rest of records that the predicates
exclude, neither reading nor unpacking their blocks. Archives of others, as plain text or as gzip
without lengths, are read too. The writer bounds the bytes in a file, and so a reader's task.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

from citewright.session import batch_rows, cut, drop_path, shared_path

BATCH_ROWS = 1000
REVISIT_FROM = 100  #: payloads of at least so many bytes are stored once
SALTS = 64
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20  #: compressed bytes after which a task starts another file
CRLF = "\r\n"
_PREFIX = "urn:page:"


def member(record: bytes) -> bytes:
    """``record`` as a gzip member whose extra field ``sl`` holds its packed and plain lengths."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    # fixed: magic, deflate, a field follows, no time, no flags, unknown system; 12 bytes of field
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sH", 12, b"sl", 8)
    length = len(head) + 8 + len(body) + 8
    return head + struct.pack("<II", length % (1 << 32), len(record) % (1 << 32)) + body + struct.pack("<II", zlib.crc32(record), len(record) % (1 << 32))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record for each row: a response, or a revisit of the response with the same payload.

    Of rows with equal payloads of at least ``REVISIT_FROM`` bytes, the smallest id is the response;
    rows that repeat that id are responses too, since a record can't revisit itself. Null payloads
    are empty; null ids never serve others unless all are null; line breaks in URLs are escaped; very
    long payloads are one record each; an empty table gives no archive files.

    Equal payloads meet as digests only. The list of revisits, ids and no payloads, is joined back by
    id, so that copies of one page stay where they are.
    """
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        text.alias("payload"), F.octet_length(text).alias("n"), F.sha2(text.cast("binary"), 256).alias("digest"),
    )
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    known = cut(rows.where(F.col("n") >= REVISIT_FROM).select("id", "digest", salt), "digests")
    # a page with very many copies meets its response in as many tasks as it has salts
    salted = known.groupBy("digest", "salt").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    first = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("copies").alias("copies")).where("copies > 1").drop("copies")
    again = known.join(salted.select("digest", "salt").join(first, "digest"), ["digest", "salt"]).where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "digest").agg(F.min("first").alias("first"))
    again = again.select(F.col("id").alias("again"), F.col("digest").alias("of"), "first")
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("of")), "left")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n"), F.lit(CRLF * 2))
    common = [
        F.lit(f"WARC-Date: {DATE}{CRLF}WARC-Record-ID: <{_PREFIX}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f">{CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(f"{CRLF}X-Payload-Length: "), F.col("n"), F.lit(CRLF),
    ]
    full = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}"), *common, F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(http) + F.col("n"), F.lit(CRLF * 2), http, F.col("payload"), F.lit(CRLF * 2))
    short = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: revisit{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"), *common,
        F.lit(f"WARC-Refers-To: <{_PREFIX}"), F.col("first"), F.lit(f">{CRLF}Content-Length: 0{CRLF * 3}{CRLF}"),
    )
    batch_rows(pages.sparkSession, BATCH_ROWS)
    pages.sparkSession.dataSource.register(WarcDataSource)
    rows.select(F.when(F.col("first").isNotNull(), short).otherwise(full).alias("record")).write.format("warc").mode("append").save(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes files under names of their own; committing lists them, so leftovers of failed tasks are never read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _filesystem(self.path)
        store.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for record in batch.column(0):
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                    packed = member(record.as_py().encode("utf-8", "surrogatepass"))
                    out.write(packed)
                    size += len(packed)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _filesystem(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{_LIST}{uuid.uuid4().hex}") as out:
            out.write("\n".join(f for m in messages if m for f in m.files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _filesystem(self.path)
        for name in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{name}")


_LIST = "_files-"


class ArchiveFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


#: Header columns that predicates may name, and their header fields.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def records(stream: io.BufferedReader, wanted=lambda head: True, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header, block) of each record that ``wanted`` takes; other blocks are skipped undecoded."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts at {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head.get("content-length", 0))
        if wanted(head) and payloads:
            block = stream.read(n)
            if len(block) < n:
                raise ValueError("a record ends early")
            yield head, block
        else:
            if wanted(head):
                yield head, None
            stream.seek(n, io.SEEK_CUR)
        stream.readline(), stream.readline()


def packed_records(raw, wanted=lambda head: True, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Like ``records``, over gzip members that say how long they are; others' blocks are never read.

    Raises ValueError at a member without that field, or one that is cut or doesn't match its checksum.
    """
    at = 0
    while fixed := raw.read(24):
        if len(fixed) < 24 or fixed[:4] != b"\x1f\x8b\x08\x04" or fixed[12:14] != b"sl":
            raise ValueError(f"no member with its length at byte {at}")
        length = int.from_bytes(fixed[16:20], "little")
        head, unpack, left = b"", zlib.decompressobj(-15), length - 24
        while b"\r\n\r\n" not in head and left > 0 and not unpack.eof:
            part = raw.read(min(_HEAD, left))
            left -= len(part)
            head += unpack.decompress(part)
            if not part:
                raise ValueError("a record ends early")
        fields, gap, block = head.partition(b"\r\n\r\n")
        found = next(records(io.BytesIO(fields + gap), lambda _: True, False), (None,))[0]
        if found is None:
            raise ValueError(f"no record starts at byte {at}")
        if wanted(found):
            if payloads:
                rest = raw.read(left)
                block += unpack.decompress(rest) + unpack.flush()
                n = int(found.get("content-length", 0))
                if len(rest) < left or not unpack.eof or zlib.crc32(fields + gap + block) != int.from_bytes(unpack.unused_data[:4], "little"):
                    raise ValueError("a record ends early or was changed")
                yield found, block[:n]
            else:
                yield found, None
        at += length
        raw.seek(at)


_HEAD = 1024  # packed bytes read at a time until a header is whole


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "set", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = _filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        lists = [x.path for x in found if x.is_file and x.base_name.startswith(_LIST)]
        if lists:  # written here: what was committed, whatever else lies around
            names = {name for f in lists for name in store.open_input_stream(f).read().decode().split()}
            found = [x for x in found if x.base_name in names]
        return [ArchiveFile(x.path) for x in found if x.is_file and x.size and not x.base_name.startswith(("_", "."))] or [ArchiveFile("")]

    def _wanted(self, head: dict[str, str]) -> bool:
        for name, how, values in self.tests:
            got = _value(name, head)
            if got is None or how == "in" and got not in values or how == "starts" and not got.startswith(values[0]):
                return False
        return True

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = _filesystem(self.path)
        with store.open_input_file(partition.path) as raw:
            for head, block in self._records(raw, partition.path):
                payload = block
                if block is not None and head.get("content-type", "").startswith("application/http"):
                    payload = block.partition(b"\r\n\r\n")[2]
                length = int(head["x-payload-length"]) if "x-payload-length" in head else None
                yield (*(_value(name, head) for name in HEADERS), length, payload)

    def _records(self, raw, path: str) -> Iterator[tuple[dict[str, str], bytes | None]]:
        if not path.endswith(".gz"):
            return records(io.BufferedReader(raw, 1 << 20), self._wanted, self.payloads)
        lengths = raw.read(14)[12:14] == b"sl"
        raw.seek(0)
        if lengths:
            return packed_records(raw, self._wanted, self.payloads)
        return records(gzip.GzipFile(fileobj=raw), self._wanted, self.payloads)


def _value(name: str, head: dict[str, str]) -> str | None:
    value = head.get(HEADERS[name])
    return value.strip("<>") if value and name in ("record_id", "refers_to") else value


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payloads", "true").load(folder)`` and ``records.write.format("warc").save(folder)``.

    What is written is one text column of whole records.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{name} string" for name in HEADERS) + ", payload_length long, payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are written once; take a new folder or append")
        return WarcWriter(self.options["path"])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder: header columns, payload_length, payload.

    Absent headers are null; without ``payloads`` so is the payload. A folder without archives gives
    no rows; a cut or changed record is an error. Predicates reach the source only where Spark's own
    switch for that is on, so this turns it on for the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of ``pages`` as archives in the shared folder.

    Two reads, each with its predicate in the source: responses with their payloads, whose lengths and
    digests are those of the bytes read, and revisits by their headers alone. The archives are deleted
    once both are read. Odd input is treated as ``write_archives`` says.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    number = lambda c: F.expr(f"nullif(substr({c}, {len(_PREFIX) + 1}), '')").cast("long")
    stored = F.sha2("payload", 256)
    checked = F.when(F.concat(F.lit("sha256:"), stored) == F.col("payload_digest"), stored)
    full = read_archives(spark, path).where("record_type = 'response'").select(
        number("record_id").alias(id_col), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.coalesce(checked, F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    short = read_archives(spark, path, payloads=False).where("record_type = 'revisit'").select(
        number("record_id").alias(id_col), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )
    found = cut(full.unionByName(short), "records")
    drop_path(spark, path)
    return found

import hashlib

import pytest
from pyspark.sql import functions as F

from citewright.llm import warc
from citewright.session import shared_path

SCHEMA = "page_id long, url string, html string, digest string, id long, n int"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<html>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</html>"
    rows = [(i, f"http://h/{i}\r\nX: y", t, "d", 1, 2) for i, t in enumerate([None, "", "short", "short", long, long, "y" * 99, "y" * 99, "z" * 100, "z" * 100, long])]
    return spark.createDataFrame(rows + [(None, None, long, None, None, None)], SCHEMA).repartition(3)


def test_round_trip(pages, spark):
    texts = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        raw = t.encode()
        first = min(k for k, x in texts.items() if x == t and k is not None)
        revisit = len(raw) >= 100 and i != first
        assert tuple(got[i]) == (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    nothing = spark.createDataFrame([], SCHEMA)
    assert warc.archive_round_trip(nothing).count() == 0


def test_pushed_predicates_and_skipped_payloads(pages, spark):
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path)
    assert found.where("record_type = 'revisit'").count() == 4
    assert {r["refers_to"] for r in found.where("record_type = 'revisit'").collect()} == {"urn:page:4", "urn:page:8"}
    one = found.where(F.col("uri").startswith("http://h/10")).collect()
    assert len(one) == 1 and one[0]["uri"] == "http://h/10%0D%0AX: y"
    assert found.where(F.col("record_id").isin("urn:page:2", "urn:page:3")).count() == 2
    assert found.where("refers_to is null and record_type = 'response'").count() == 8
    bare = warc.read_archives(spark, path, payloads=False)
    assert bare.where("payload is not null").count() == 0 and bare.count() == 12
    reader = warc.WarcReader(path, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 5)])) == [GreaterThan(("payload_length",), 5)]
    assert reader._wanted({"warc-type": "response"}) and not reader._wanted({"warc-type": "revisit"})


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        import io

        self.file, self.bytes = io.BytesIO(data), 0

    def read(self, n):
        got = self.file.read(n)
        self.bytes += len(got)
        return got

    def seek(self, at):
        return self.file.seek(at)


def test_skipped_payloads_are_not_read():
    import os

    noise = [os.urandom(100_000).hex() for _ in range(3)]
    record = "WARC/1.1\r\nWARC-Type: {}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    data = b"".join(warc.member(record.format(t, len(x), x).encode()) for t, x in zip(["response", "revisit", "response"], noise))
    every, some, heads = Counted(data), Counted(data), Counted(data)
    assert [b.decode() for _, b in warc.packed_records(every)] == noise and every.bytes == len(data)
    assert [b.decode() for _, b in warc.packed_records(some, lambda h: h["warc-type"] == "revisit")] == noise[1:2]
    assert some.bytes < len(data) / 3 + 5000
    assert len(list(warc.packed_records(heads, payloads=False))) == 3 and heads.bytes < 5000
    import gzip
    import io

    assert gzip.decompress(data).decode() == "".join(record.format(t, len(x), x) for t, x in zip(["response", "revisit", "response"], noise))
    for broken in (data[:-40], data[:120_000] + b"x" + data[120_001:], data[7:]):
        with pytest.raises(Exception):
            list(warc.packed_records(io.BytesIO(broken)))
    assert list(warc.packed_records(io.BytesIO(b""))) == []


def test_only_committed_files_are_read(spark, pages):
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    store, folder = warc._filesystem(path)
    with store.open_output_stream(f"{folder}/part-of-a-lost-task.warc.gz", compression=None) as out:
        out.write(b"half a record")
    assert warc.read_archives(spark, path).count() == 12
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 12


def test_compressed_and_broken_archives(tmp_path):
    import gzip
    import io

    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    stream = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(record) + gzip.compress(record)))
    assert [b for _, b in warc.records(stream)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.records(io.BufferedReader(io.BytesIO(record[:-6]))))
    with pytest.raises(ValueError):
        list(warc.records(io.BufferedReader(io.BytesIO(b"nothing"))))

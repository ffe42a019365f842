import hashlib
import zlib

import pytest

from citewright.llm import media_ts as m


@pytest.mark.parametrize("n", [0, 1, 63, 64, 100, 161, 162, 163, 300, m.UNIT - 1, m.UNIT, m.UNIT + 1, m.UNIT * 8, m.UNIT * 17 + 345])
def test_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    for payload in (data, m.padded(data.decode("latin-1"))[1]):
        if payload:
            stream = m.mux(payload)
            got = m.demux(stream)
            assert got.payload == payload and got.continuity_errors == 0 and len(stream) % 188 == 0
            assert got.pts == [m.PTS_START + m.TICKS * k for k in range(got.pes)]
            assert got.random_access == list(range(0, got.pes, m.GROUP))


def test_every_short_tail():
    for n in range(1, 800):
        assert m.demux(m.mux(b"z" * n)).payload == b"z" * n


def test_lost_repeated_and_null_packets():
    stream = m.mux(bytes(range(256)) * 200)
    packets = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    assert m.demux(b"".join([*packets[:9], *packets[10:]])).continuity_errors == 1
    again = m.demux(b"".join([*packets[:9], packets[8], *packets[9:]]))
    assert again.continuity_errors == 0 and again.payload == bytes(range(256)) * 200
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + bytes(184)
    assert m.demux(b"".join([packets[0], null, *packets[1:]])).payload == bytes(range(256)) * 200
    with pytest.raises(ValueError):
        m.demux(stream[:-1])
    with pytest.raises(ValueError):
        m.demux(b"\0" * 188)
    assert m.demux(b"").payload == b""


def test_query_columns(docs, empty):
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = m.read_media(m.with_media(docs)).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw) % 64) if raw else 64)
        r = by_id[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert m.read_media(m.with_media(empty)).count() == 0

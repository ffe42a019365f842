"""Media columns as MPEG transport streams (188-byte packets).

``mux`` stores a byte payload in a program of one elementary stream: association and map tables
before each random-access point, packetised elementary packets with presentation times, a clock
reference and the random-access flag in adaptation fields. ``demux`` parses the tables, checks
continuity counters, reassembles the elementary packets and lists times and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.session import batch_rows

# Fixed values of the format and of this layout.
PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in elementary packets
PES_HEADER = 14
FIRST = PACKET - 4 - 8 - PES_HEADER  # data beside header, clock field and elementary header
FOLLOW = 22
UNIT = FIRST + FOLLOW * (PACKET - 4)  # data bytes of a whole access unit: no stuffing
GROUP = 8  # access units from one random-access point to the next
TICKS = 3600  # of the 90 kHz clock between access units
PTS_START = 90_000


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 4) >> 8, (len(body) + 4) & 0xFF]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    out = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(out.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0x00, bytes([0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))
_PMT = _table_packet(PMT_PID, _section(0x02, bytes([0, 1, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0])))


def _clock_bytes(pts: np.ndarray) -> np.ndarray:
    """Presentation time fields: 5 bytes with marker bits."""
    return np.stack([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE], axis=1).astype(np.uint8)


def _headers(packets: np.ndarray, units: np.ndarray, sizes: int) -> None:
    """Fill the first packets of access units: adaptation field with clock, elementary header."""
    pts = (PTS_START + units * TICKS) % (1 << 33)
    pcr = pts - TICKS
    packets[:, 4] = 7
    packets[:, 5] = np.where(units % GROUP == 0, 0x50, 0x10)
    for k, shift in enumerate((25, 17, 9, 1)):
        packets[:, 6 + k] = (pcr >> shift) & 0xFF
    packets[:, 10] = (pcr & 1) << 7 | 0x7E
    packets[:, 11] = 0
    length = sizes + 8
    packets[:, 12:21] = np.frombuffer(bytes([0, 0, 1, STREAM_ID, length >> 8, length & 0xFF, 0x80, 0x80, 5]), np.uint8)
    packets[:, 21:26] = _clock_bytes(pts)


def mux(payload: bytes) -> bytes:
    data = np.frombuffer(payload, np.uint8)
    whole, rest = divmod(len(data), UNIT)
    tail = -(-max(rest - FIRST, 0) // (PACKET - 4)) + 1 if rest else 0
    groups = -(-(whole + bool(rest)) // GROUP)
    per = FOLLOW + 1
    total = 2 * groups + whole * per + tail
    out = np.zeros((total, PACKET), np.uint8)
    first_of_group = np.arange(groups) * (GROUP * per + 2)
    for k, table in enumerate((_PAT, _PMT)):
        out[first_of_group + k] = table
        out[first_of_group + k, 3] = 0x10 | np.arange(groups) & 0x0F
    units = np.arange(whole)
    start = 2 * (units // GROUP + 1) + units * per
    if whole:
        body = data[: whole * UNIT].reshape(whole, UNIT)
        head = np.zeros((whole, PACKET), np.uint8)
        _headers(head, units, UNIT)
        head[:, 26:] = body[:, :FIRST]
        out[start] = head
        out[start, 3] = 0x30
        more = (start[:, None] + np.arange(1, per)).ravel()
        out[more, 4:] = body[:, FIRST:].reshape(-1, PACKET - 4)
        out[more, 3] = 0x10
    if rest:
        left = data[whole * UNIT :]
        at = 2 * groups + whole * per
        head = np.zeros((1, PACKET), np.uint8)
        _headers(head, np.array([whole]), rest)
        head[0, 3] = 0x30
        stuffed = max(FIRST - rest, 0)  # a short unit grows the adaptation field
        if stuffed:
            head[0, 12 + stuffed : 26 + stuffed] = head[0, 12:26].copy()
            head[0, 12 : 12 + stuffed] = 0xFF
            head[0, 4] = 7 + stuffed
        n = min(rest, FIRST)
        head[0, PACKET - n :] = left[:n]
        out[at] = head[0]
        for k in range(1, tail):
            part = left[FIRST + (k - 1) * (PACKET - 4) :][: PACKET - 4]
            pad = PACKET - 4 - len(part)
            out[at + k, 3] = 0x30 if pad else 0x10
            if pad:
                out[at + k, 4] = pad - 1
                if pad > 1:
                    out[at + k, 5] = 0
                    out[at + k, 6 : 4 + pad] = 0xFF
            out[at + k, 4 + pad :] = part
    out[:, 0] = SYNC
    es = np.ones(total, bool)
    es[first_of_group] = es[first_of_group + 1] = False
    out[es, 1:3] = ES_PID >> 8, ES_PID & 0xFF
    out[es, 3] |= (np.arange(es.sum()) & 0x0F).astype(np.uint8)
    opens = start.tolist() + ([2 * groups + whole * per] if rest else [])
    out[opens, 1] |= 0x40
    return out.tobytes()


@dataclass
class Stream:
    payload: bytes
    packets: int
    pes: int
    continuity_errors: int
    pts: list[int]
    random_access: list[int]  #: places in ``pts`` of units that start at a random-access point
    short: int = 0  #: elementary packets with another length than their header says

    def feature(self) -> str:
        span = f"{self.pts[0]}-{self.pts[-1]}" if self.pts else "none"
        return f"packets={self.packets};pes={self.pes};cc_errors={self.continuity_errors};pts={span};rap={len(self.random_access)};short={self.short}"


def _sections(packets: np.ndarray, pid: int) -> Iterator[bytes]:
    """Checked table sections of one packet each."""
    for p in packets[(packets[:, 1] & 0x40) > 0]:
        raw = p.tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        at += 1 + raw[at]
        section = raw[at : at + 3 + ((raw[at + 1] & 0x0F) << 8 | raw[at + 2])]
        if raw[3] & 0x10 and len(section) > 12:
            if section in _CHECKED or crc32_mpeg(section) == 0:
                yield section


_CHECKED = {_PAT.tobytes()[5 : 5 + 16], _PMT.tobytes()[5 : 5 + 21]}


def demux(stream: bytes) -> Stream:
    """The first elementary stream of the first program.

    Null packets, packets flagged as errors and single repeats of a packet are passed over. A jump
    in the continuity counter counts as an error unless the packet flags a discontinuity; so do
    elementary packets that lack data or have too much of it, by their own length, in ``short``. A
    stream without tables, or none at all, has an empty payload; a cut or unsynchronised one is refused.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    total = len(packets)
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    fine = ((packets[:, 1] & 0x80) == 0) & (pid != NULL_PID)
    program = next(((s[k + 2] & 0x1F) << 8 | s[k + 3] for s in _sections(packets[fine & (pid == PAT_PID)], PAT_PID) for k in range(8, len(s) - 4, 4) if s[k] or s[k + 1]), None)
    es_pid = None
    if program is not None:
        for s in _sections(packets[fine & (pid == program)], program):
            at = 12 + ((s[10] & 0x0F) << 8 | s[11])
            if at + 5 <= len(s) - 4:
                es_pid = (s[at + 1] & 0x1F) << 8 | s[at + 2]
                break
    if es_pid is None:
        return Stream(b"", total, 0, 0, [], [])
    es = packets[fine & (pid == es_pid)]
    control = (es[:, 3] >> 4) & 3
    es, control = es[control & 1 > 0], control[control & 1 > 0]
    counter = es[:, 3] & 0x0F
    field = np.where(control == 3, es[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(field > 1, es[:, 5], 0)
    errors = 0
    if len(es) > 1:
        step = (counter[1:].astype(np.int64) - counter[:-1]) % 16
        again = np.r_[False, (step == 0) & (es[1:, 4:] == es[:-1, 4:]).all(axis=1)]
        errors = int(((step != 1) & ~again[1:] & ((flags[1:] & 0x80) == 0)).sum())
        es, field, flags = es[~again], field[~again], flags[~again]
    start = (es[:, 1] & 0x40) > 0
    data_at = 4 + field
    opens = np.flatnonzero(start)
    pts, random_access, said = [], [], []
    for n, k in enumerate(opens.tolist()):
        raw, at = es[k].tobytes(), int(data_at[k])
        if raw[at : at + 3] != b"\0\0\1":
            raise ValueError("an elementary packet has no start code")
        if raw[at + 7] & 0x80:
            t = raw[at + 9 : at + 14]
            pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        if flags[k] & 0x40:
            random_access.append(n)
        data_at[k] = at + 9 + raw[at + 8]
        length = raw[at + 4] << 8 | raw[at + 5]  # 0: not given
        said.append(length - 3 - raw[at + 8] if length else -1)
    short = 0
    if len(opens):
        es, data_at = es[opens[0] :], data_at[opens[0] :]
        held = np.add.reduceat(np.maximum(PACKET - data_at, 0), opens - opens[0])
        short = int(((held != said) & (np.array(said) >= 0)).sum())
    keep = np.arange(PACKET) >= data_at[:, None]
    return Stream(es[keep].tobytes() if len(opens) else b"", total, len(opens), errors, pts, random_access, short)


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text's payload stored as a transport stream.

    Null texts count as empty; a very long text is one stream of as many packets as it needs; equal
    texts get equal media; null ids and repeated rows are kept; other columns, whatever their names,
    are ignored; an empty table gives no rows.
    """
    batch_rows(docs.sparkSession, 512)  # bounds the media that a batch holds
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stored = [(n, mux(b)) for n, b in map(padded, pdf["text"])]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [n for n, _ in stored], "media": [m for _, m in stored]})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, id_col: str = "doc_id", bytes_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """What the stored streams hold: payload digests, the stream's own, and its timing features.

    A null stream gives null for all that it would hold. A damaged one still gives what is left of
    its payload, and ``feature`` counts the lost packets (cc_errors) and the elementary packets
    without their whole length (short); one that is cut or out of step is an error. Repeated rows and
    null ids are kept; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    kind = media.schema[id_col].dataType.simpleString()
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, stored in zip(pdf["n_bytes"], pdf["media"]):
                if stored is None:
                    out.append((None if pd.isna(n) else int(n), *(None,) * 6))
                    continue
                s = demux(stored)
                out.append((n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), s.feature()))
            yield pd.concat([pdf[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    rows = media.select(F.col(id_col).alias("id"), F.col(bytes_col).alias("n_bytes"), F.col(media_col).alias("media"))
    return rows.mapInPandas(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)

"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` turns payload bytes into a stream of 188-byte packets: a program association
table, a program map table, then one elementary stream of private data in PES packets
with presentation timestamps.  ``demux`` parses the tables, checks continuity counters
and section checksums, reassembles PES packets and returns the payload with timestamps
and random-access points.  Both work on whole arrays of packets.

A PES packet carries ``UNIT`` payload bytes; every ``GOP``-th one opens with a
random-access flag.  Its last transport packet is filled up by adaptation-field stuffing.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET = 188
BODY = 184
UNIT = 48 * BODY - 14  # with its 14-byte header a PES packet fills 48 transport packets
GOP = 8
CLOCK_STEP = 3600  # 90 kHz ticks between units
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x0100, 0x0101
STREAM_ID, STREAM_TYPE, PROGRAM = 0xBD, 0x06, 1
BLOCK = 64
SLICE = 256


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, section: bytes) -> bytes:
    section += section_crc(section).to_bytes(4, "big")
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0x00])
    return (head + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255])
    es = bytes([STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])
    pmt = bytes([0x02, 0xB0, 13 + len(es), PROGRAM >> 8, PROGRAM & 255, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]) + es
    return _section_packet(PAT_PID, pat) + _section_packet(PMT_PID, pmt)


TABLES = _tables()


def _stamp(pts: np.ndarray) -> np.ndarray:
    """Five bytes of each 33-bit timestamp with marker bits."""
    return np.stack(
        [0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 1 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 1 | (pts << 1) & 0xFE], axis=1
    ).astype(np.uint8)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    data = np.frombuffer(payload, np.uint8)
    units = -(-len(data) // UNIT)
    if not units:
        return TABLES
    per = BODY * 48
    pes = np.zeros((units, per), np.uint8)
    pes[:, :3] = (0, 0, 1)
    pes[:, 3] = STREAM_ID
    held = np.full(units, UNIT)
    held[-1] = len(data) - (units - 1) * UNIT
    length = held + 8  # what follows the length field
    pes[:, 4], pes[:, 5] = length >> 8, length & 255
    pes[:, 6:9] = (0x80, 0x80, 5)
    pes[:, 9:14] = _stamp(np.arange(units, dtype=np.int64) * CLOCK_STEP % (1 << 33))
    body = pes[:, 14:]
    full = (units - 1) * UNIT
    body[:-1] = data[:full].reshape(units - 1, UNIT)
    body[-1, : held[-1]] = data[full:]

    # An adaptation field of 2 bytes (with the flag) opens each random-access unit, so that
    # such a unit's bytes lie 2 later and may need one packet more.
    random = np.arange(units) % GOP == 0
    n = 14 + held + 2 * random  # bytes to place
    packets = -(-n // BODY)
    total = int(packets.sum())
    out = np.zeros((total, PACKET), np.uint8)
    first = np.cumsum(packets) - packets
    out[:, 0] = 0x47
    out[:, 1] = ES_PID >> 8
    out[first, 1] |= 0x40
    out[:, 2] = ES_PID & 255
    cc = np.arange(total) & 15
    room = np.zeros(units, np.int64)  # stuffing of the last packet
    room[:] = packets * BODY - n
    last = first + packets - 1
    out[:, 3] = 0x10 | cc
    for u in range(units):
        a, k = int(first[u]), int(packets[u])
        raw = pes[u, : 14 + held[u]]
        if random[u]:
            raw = np.concatenate((np.array([1, 0x40], np.uint8), raw))
            out[a, 3] |= 0x20
        tail = len(raw) - (k - 1) * BODY
        if k > 1:
            out[a : a + k - 1, 4:] = raw[: (k - 1) * BODY].reshape(k - 1, BODY)
        z = int(last[u])
        if room[u] == 0:
            out[z, 4:] = raw[(k - 1) * BODY :]
        elif k == 1 and random[u]:
            # one field holds both the flag and the stuffing
            out[z, 4], out[z, 5] = 1 + room[u], 0x40
            out[z, 6 : 6 + room[u]] = 0xFF
            out[z, 6 + room[u] :] = raw[2:]
        else:
            out[z, 3] |= 0x20
            out[z, 4] = room[u] - 1
            if room[u] > 1:
                out[z, 5] = 0
                out[z, 6 : 4 + room[u]] = 0xFF
            out[z, PACKET - tail :] = raw[(k - 1) * BODY :]
    return TABLES + out.tobytes()


@dataclass
class Demuxed:
    payload: bytes
    pts: np.ndarray
    random_access: np.ndarray  # index of units that open with the flag
    packets: int
    stream_type: int


def _section(packet: np.ndarray, table_id: int) -> bytes:
    at = 5 + int(packet[4])
    n = 3 + ((int(packet[at + 1]) & 0x0F) << 8 | int(packet[at + 2]))
    data = packet[at : at + n].tobytes()
    if data[0] != table_id or section_crc(data) != 0:
        raise ValueError("damaged table section")
    return data


def demux(stream: bytes) -> Demuxed:
    """Payload, timestamps and random-access points; ValueError on any damage."""
    if len(stream) % PACKET or not stream:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any() or (p[:, 1] & 0x80).any():
        raise ValueError("lost synchronisation or damaged packet")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    pats = np.flatnonzero(pid == PAT_PID)
    if not len(pats):
        raise ValueError("no program association table")
    pat = _section(p[pats[0]], 0x00)
    pmt_pid = (pat[10] & 0x1F) << 8 | pat[11]
    pmts = np.flatnonzero(pid == pmt_pid)
    if not len(pmts):
        raise ValueError("no program map table")
    pmt = _section(p[pmts[0]], 0x02)
    info = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    kind, es_pid = pmt[info], (pmt[info + 1] & 0x1F) << 8 | pmt[info + 2]
    es = p[pid == es_pid]
    none = np.zeros(0, np.int64)
    if not len(es):
        return Demuxed(b"", none, none, len(p), kind)
    cc = es[:, 3] & 15
    if (((cc[:-1] + 1) & 15) != cc[1:]).any():
        raise ValueError("continuity counter jumps")
    field = (es[:, 3] & 0x20) > 0
    start = 4 + np.where(field, 1 + es[:, 4].astype(np.int64), 0)
    opens = (es[:, 1] & 0x40) > 0
    flags = np.where(field & (es[:, 4] > 0), es[:, 5], 0)
    if not opens[0]:
        raise ValueError("stream opens inside a unit")
    plain = start == 4
    pes = es[:, 4:][np.arange(BODY) >= (start - 4)[:, None]] if not plain.all() else es[:, 4:].reshape(-1)
    sizes = PACKET - start
    unit = np.cumsum(opens) - 1
    at = np.concatenate(([0], np.cumsum(np.bincount(unit, sizes))[:-1])).astype(np.int64)
    if (pes[at] != 0).any() or (pes[at + 1] != 0).any() or (pes[at + 2] != 1).any():
        raise ValueError("no packet start code")
    length = pes[at + 4].astype(np.int64) << 8 | pes[at + 5]
    if (length + 6 != np.diff(np.append(at, len(pes)))).any():
        raise ValueError("packet length does not match")
    t = pes[at[:, None] + np.arange(9, 14)].astype(np.int64)
    pts = (t[:, 0] & 0x0E) << 29 | t[:, 1] << 22 | (t[:, 2] & 0xFE) << 14 | t[:, 3] << 7 | t[:, 4] >> 1
    head = 9 + pes[at + 8].astype(np.int64)
    keep = np.ones(len(pes), bool)
    for k in range(int(head.max())):
        keep[(at + k)[k < head]] = False
    ra = unit[opens & ((flags & 0x40) > 0)]
    return Demuxed(pes[keep].tobytes(), pts, ra, len(p), kind)


def padded(text: str | None) -> bytes:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, pts array<long>, random_access array<int>"
)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text as a stored stream: (doc_id, n_bytes, media binary). Null texts are empty."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):  # a slice holds whole streams
                part = pdf.iloc[at : at + SLICE]
                texts = part["text"].tolist()
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else 0 for t in texts],
                        "media": [mux(padded(t)) for t in texts],
                    }
                )

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInPandas(run, "doc_id long, n_bytes long, media binary")


def features(d: Demuxed) -> str:
    """What reading a stream back shows, as text."""
    x = np.frombuffer(d.payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    p = hist[hist > 0] / max(len(x), 1)
    entropy = float(-(p * np.log2(p)).sum()) if len(x) else 0.0
    return (
        f"packets={d.packets};units={len(d.pts)};random_access={len(d.random_access)};"
        f"last_pts={int(d.pts[-1]) if len(d.pts) else -1};mean={x.mean() if len(x) else 0:.6f};entropy={entropy:.6f}"
    )


def read_media(media: DataFrame) -> DataFrame:
    """Digest, features, timestamps and random-access points of stored streams."""

    def run(batches):
        for pdf in batches:
            out = []
            for n, stream in zip(pdf["n_bytes"], pdf["media"]):
                d = demux(bytes(stream))
                out.append(
                    (
                        n,
                        len(d.payload),
                        hashlib.sha256(d.payload).hexdigest(),
                        zlib.crc32(d.payload[-BLOCK:]),
                        len(stream),
                        hashlib.sha256(stream).hexdigest(),
                        features(d),
                        d.pts,
                        d.random_access.astype(np.int32),
                    )
                )
            part = pd.DataFrame(
                out,
                columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access"],
            )
            part.insert(0, "doc_id", pdf["doc_id"].array)
            yield part

    return media.mapInPandas(run, SCHEMA)


def media_column(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a stream and read it back; one row for each input row.

    Null and empty texts store one block of zero bytes.  Repeated rows are stored each.
    """
    return read_media(to_media(docs, id_col, text_col))

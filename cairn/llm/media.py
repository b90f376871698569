"""Media columns as MPEG transport streams: written to and read from BINARY, many rows at a time."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_batches

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x0020, 0x0100, 1
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06
#: Samples of 8 bits at 8 kHz; the clock runs at 90 kHz.
RATE, CLOCK = 8000, 90_000
#: Samples in an access unit; a whole number of clock ticks long.
UNIT = 4096
#: Every so many access units one is a random-access point and carries the clock reference.
POINTS = 8
HEADER = 14
ALIGN = 64
#: Payload bytes that are handled at once (a longer row is handled alone).
TOGETHER = 4 << 20


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
            crc &= 0xFFFFFFFF
    return crc


def section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def table_packet(pid: int, data: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + data).ljust(PACKET, b"\xff")


PAT = table_packet(PAT_PID, section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
PMT = table_packet(
    PMT_PID,
    section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000)),
)


def first_of(counts: np.ndarray) -> np.ndarray:
    """Where each run begins."""
    return np.cumsum(counts) - counts


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... in each run."""
    return np.arange(counts.sum()) - np.repeat(first_of(counts), counts)


def stamp(ticks: np.ndarray) -> np.ndarray:
    """The five bytes of a presentation time, 33 bits with markers."""
    t = ticks.astype(np.int64)
    out = [0x21 | (t >> 29 & 0x0E), t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1]
    return np.stack(out, axis=1).astype(np.uint8)


def mux(payloads: list[bytes]) -> list[bytes]:
    """A transport stream for each payload: tables, then one elementary packet per access unit."""
    sizes = np.array([len(p) for p in payloads])
    units = -(-sizes // UNIT)
    doc, k = np.repeat(np.arange(len(sizes)), units), within(units)
    length = np.minimum(UNIT, sizes[doc] - k * UNIT)
    ticks = (k * UNIT * CLOCK // RATE) & (1 << 33) - 1
    # Elementary packets: header and data, one after the other.
    total = length + HEADER
    stream = np.empty(total.sum(), np.uint8)
    at = first_of(total)[:, None] + np.arange(HEADER)
    head = np.empty((len(k), HEADER), np.uint8)
    head[:, :9] = [0, 0, 1, PRIVATE_STREAM, 0, 0, 0x80, 0x80, 5]
    head[:, 4], head[:, 5] = (length + 8) >> 8, (length + 8) & 255
    head[:, 9:] = stamp(ticks)
    stream[at] = head
    data = np.ones(len(stream), bool)
    data[at] = False
    stream[data] = np.frombuffer(b"".join(payloads), np.uint8)
    # Transport packets: a clock reference takes 8 bytes of a random-access point's first packet.
    point = k % POINTS == 0
    field = np.where(point, 8, 0)
    packets = 1 + np.maximum(0, -(-(total - (184 - field)) // 184))
    unit, i = np.repeat(np.arange(len(k)), packets), within(packets)
    sent = np.where(i == 0, 0, 184 * i - field[unit])
    load = np.minimum(184 - np.where(i == 0, field[unit], 0), total[unit] - sent)
    of = doc[unit]
    per_doc = np.bincount(of, minlength=len(sizes))
    row = np.arange(len(unit)) + 2 * (of + 1)
    out = np.full((len(unit), PACKET), 0xFF, np.uint8)
    adapt = 184 - load
    out[:, 0], out[:, 1], out[:, 2] = SYNC, (i == 0) * 0x40 | DATA_PID >> 8, DATA_PID & 255
    out[:, 3] = np.where(adapt > 0, 0x30, 0x10) | within(per_doc) & 15
    out[adapt > 0, 4] = adapt[adapt > 0] - 1
    opens = (i == 0) & point[unit]
    out[adapt > 1, 5] = np.where(opens, 0x50, 0)[adapt > 1]
    base = ticks[unit[opens]]
    clock = [base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, base << 7 & 0x80 | 0x7E, base * 0]
    out[opens, 6:12] = np.stack(clock, axis=1)
    out[np.arange(PACKET) >= (PACKET - load)[:, None]] = stream
    whole = np.empty((len(unit) + 2 * len(sizes), PACKET), np.uint8)
    whole[row] = out
    tables = first_of(per_doc + 2)
    whole[tables], whole[tables + 1] = np.frombuffer(PAT, np.uint8), np.frombuffer(PMT, np.uint8)
    flat, ends = whole.tobytes(), np.cumsum(per_doc + 2) * PACKET
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


@lru_cache(64)
def parse_section(packet: bytes, table: int) -> bytes:
    """The body of the table section in a packet; its checksum must hold."""
    at = 4 + (packet[4] + 1 if packet[3] & 0x20 else 0)
    at += packet[at] + 1 if at < PACKET else 0
    size = struct.unpack_from(">H", packet, at + 1)[0] & 0xFFF if at + 3 <= PACKET else 0
    data = packet[at : at + 3 + size]
    if size < 9 or len(data) != 3 + size or data[0] != table or crc32_mpeg(data) != 0:
        raise ValueError("broken program table")
    return data[8:-4]


@lru_cache(64)
def programs(packet: bytes) -> dict[int, int]:
    body = parse_section(packet, 0x00)
    return {n: pid & 0x1FFF for n, pid in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]) if n}


@lru_cache(64)
def streams(packet: bytes) -> list[tuple[int, int]]:
    """(stream type, PID) of each elementary stream."""
    body, found = parse_section(packet, 0x02), []
    if len(body) < 4:
        raise ValueError("broken program table")
    at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
    while at + 5 <= len(body):
        kind, pid, info = struct.unpack_from(">BHH", body, at)
        found.append((kind, pid & 0x1FFF))
        at += 5 + (info & 0xFFF)
    return found


def data_pid(media: bytes, pids: np.ndarray) -> int:
    """The program tables name the elementary stream; the first of the first program is read."""
    pats = np.flatnonzero(pids == PAT_PID)
    if not len(pats):
        raise ValueError("no program association table")
    at = int(pats[0]) * PACKET
    named = programs(media[at : at + PACKET])
    if not named:
        raise ValueError("no program")
    maps = np.flatnonzero(pids == named[min(named)])
    if not len(maps):
        raise ValueError("no program map table")
    at = int(maps[0]) * PACKET
    found = streams(media[at : at + PACKET])
    if not found:
        raise ValueError("no elementary stream")
    return found[0][1]


def demux(media: list[bytes]) -> list[dict]:
    """Payload, presentation times, random-access points and continuity errors of each stream.

    A packet that repeats its predecessor's continuity counter is a duplicate and is skipped; any
    other step but one is an error and is counted. An elementary packet that is not as long as its
    header says, or no longer begins as one, raises.
    """
    rows = np.array([len(m) for m in media]) // PACKET
    if any(len(m) % PACKET or not m for m in media):
        raise ValueError("not a whole number of packets")
    if not media:
        return []
    p = np.frombuffer(b"".join(media), np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = first_of(rows)
    wanted = np.array([data_pid(m, pid[a : a + n]) for m, a, n in zip(media, starts, rows)])
    doc = np.repeat(np.arange(len(media)), rows)
    own = np.flatnonzero(pid == wanted[doc])
    p, doc = p[own], doc[own]
    if len(np.unique(doc)) < len(media):
        raise ValueError("no packet of the elementary stream")
    place = own - starts[doc]
    counter = p[:, 3].astype(np.int32) & 15
    same = np.r_[False, doc[1:] == doc[:-1]]
    step = np.r_[0, (counter[1:] - counter[:-1]) & 15]
    errors = np.bincount(doc[same & (step > 1)], minlength=len(media))
    if (same & (step == 0)).any():
        keep = ~(same & (step == 0))
        p, doc, place = p[keep], doc[keep], place[keep]
    adapt = np.where(p[:, 3] & 0x20, p[:, 4].astype(np.int32) + 1, 0)
    load = 184 - adapt
    begins = np.flatnonzero(p[:, 1] & 0x40)
    opened = np.r_[True, doc[1:] != doc[:-1]]
    if (load < 0).any() or not (p[opened, 1] & 0x40).all():
        raise ValueError("broken elementary packet")
    stream = p[np.arange(PACKET) >= (PACKET - load)[:, None]]
    at = first_of(load)[begins]
    size = np.diff(np.r_[at, len(stream)])
    s = stream.astype(np.int64, copy=False) if len(stream) < 1 << 16 else stream
    b = lambda i: s[at + i].astype(np.int64)
    if (size < HEADER).any():
        raise ValueError("broken elementary packet")
    if (b(0) | b(1)).any() or (b(2) != 1).any() or (b(4) * 256 + b(5) + 6 != size).any():
        raise ValueError("broken elementary packet")
    times = (b(9) & 0x0E) << 29 | b(10) << 22 | (b(11) & 0xFE) << 14 | b(12) << 7 | b(13) >> 1
    head = 9 + b(8)
    if (head > size).any():
        raise ValueError("broken elementary packet")
    edge = np.zeros(len(stream) + 1, np.int8)
    edge[at + head] += 1
    edge[np.r_[at[1:], len(stream)]] -= 1
    data = stream[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)].tobytes()
    sizes = np.bincount(doc[begins], size - head, minlength=len(media)).astype(np.int64)
    ends = np.cumsum(sizes).tolist()
    points = (adapt[begins] > 1) & (p[begins, 5] & 0x40 != 0)
    counts = np.bincount(doc[begins], minlength=len(media))
    cut = np.cumsum(counts)[:-1]
    out = []
    for i, (a, z, t, k, r) in enumerate(
        zip([0, *ends[:-1]], ends, np.split(times, cut), np.split(place[begins], cut), np.split(points, cut))
    ):
        out.append({"payload": data[a:z], "times": t, "packets": int(rows[i]), "errors": int(errors[i]), "points": k[r]})
    return out


def demuxed(media: list[bytes | None]) -> list[dict]:
    """The same, for each stream by itself where one of them is broken; that one has an ``error``."""
    try:
        if all(media):
            return [r | {"error": None} for r in demux(media)]
    except ValueError:
        pass
    out = []
    for m in media:
        try:
            out.append(demux([m or b""])[0] | {"error": None})
        except ValueError as e:
            none = np.empty(0, np.int64)
            packets = len(m or b"") // PACKET
            out.append({"payload": b"", "times": none, "packets": packets, "errors": 0, "points": none, "error": str(e)})
    return out


def pad(text: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return text.ljust(max(ALIGN, -(-len(text) // ALIGN) * ALIGN), b"\0")


def groups(values: list[bytes]) -> list[tuple[int, int]]:
    """Runs of rows of about ``TOGETHER`` bytes."""
    out, start, size = [], 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if size >= TOGETHER:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out + [(start, len(values))] * (start < len(values))


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each text's UTF-8 bytes, zero-padded, as a transport stream.

    Null text counts as empty and is stored as 64 zeros. Repeated rows stay; other columns are
    ignored; an empty table gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary())]
        media = [m for a, z in groups(texts) for m in mux([pad(t) for t in texts[a:z]])]
        cols = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "media"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(picked, one, f"id {kind}, n_bytes bigint, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Read ``(id, n_bytes, media)`` back.

    Gives the payload's and the media's digests, presentation times in 90 kHz ticks, the packet
    numbers of random-access points, and counts of packets and continuity errors. ``error`` says why
    a stream cannot be read, null where it can; its payload then counts as empty, and no other row is
    touched by it. Null media are such a stream. Ids are passed on as they are, null or repeated;
    other columns are ignored, whatever their names; an empty table gives no row.
    """
    kind = media.schema["id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        stored = [m.as_py() for m in batch.column(2)]
        read = [r for a, z in groups([m or b"" for m in stored]) for r in demuxed(stored[a:z])]
        stored = [m or b"" for m in stored]
        longs = pa.list_(pa.int64())
        cols = [
            batch.column(0),
            batch.column(1),
            pa.array([len(r["payload"]) for r in read], pa.int64()),
            pa.array([hashlib.sha256(r["payload"]).hexdigest() for r in read]),
            pa.array([zlib.crc32(r["payload"][-ALIGN:]) for r in read], pa.int64()),
            pa.array([len(m) for m in stored], pa.int64()),
            pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
            pa.array([r["times"] for r in read], longs),
            pa.array([r["points"] for r in read], longs),
            pa.array([r["packets"] for r in read], pa.int64()),
            pa.array([r["errors"] for r in read], pa.int64()),
            pa.array([r["error"] for r in read], pa.string()),
        ]
        names = "id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 times points packets errors error"
        return pa.RecordBatch.from_arrays(cols, names.split())

    schema = (
        f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint,"
        " media_sha256 string, times array<bigint>, points array<bigint>, packets bigint, errors bigint, error string"
    )
    return map_batches(media.select("id", "n_bytes", "media"), one, schema)

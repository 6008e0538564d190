"""Media columns as MPEG transport streams: payloads are muxed into packets, and streams are parsed back into payloads."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm import common

PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0, 0x1FFF
#: Where mux() puts the program's table and its only elementary stream, of private data.
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0101, 0x06, 0xBD
#: Bytes of a unit of payload, units of an access unit, access units from one random-access point to the next, and the
#: 90 kHz ticks of an access unit.
UNIT, UNITS, INTERVAL, TICKS = 576, 16, 8, 3600


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        table = np.where(table >> 31, (table << 1) ^ np.uint32(0x04C11DB7), table << 1).astype(np.uint32)
    return table


_CRC = [int(x) for x in _crc_table()]


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, which ends each section."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter, 0])
    return (head + data).ljust(PACKET, b"\xff")


_PAT = section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0")
#: Both tables, for each value of their packets' counters.
_TABLES = [table_packet(PAT_PID, _PAT, n) + table_packet(PMT_PID, _PMT, n) for n in range(16)]


def timestamp(ticks: int, prefix: int) -> bytes:
    """Five bytes of a 33-bit time with its marker bits."""
    t = ticks & (1 << 33) - 1
    return bytes([prefix << 4 | t >> 29 & 0xE | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream with one program and one stream; each access unit is an elementary packet with its time.

    The first of every INTERVAL access units is a random-access point: the tables come before it and its packet carries the
    flag, so a reader can begin there. Every access unit carries a clock reference. Any payload fits, the empty one too.
    """
    out = [] if payload else [_TABLES[0]]
    counter = 0
    for k, at in enumerate(range(0, len(payload), UNIT * UNITS)):
        unit = payload[at : at + UNIT * UNITS]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(k * TICKS, 2) + unit
        if k % INTERVAL == 0:
            out.append(_TABLES[k // INTERVAL % 16])
        adaptation = (b"\x10" if k % INTERVAL else b"\x50") + (k * TICKS << 15 & (1 << 48) - 1 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - (len(adaptation) + 1)
        full = max(0, (len(pes) - room) // (PACKET - 4))
        rest = len(pes) - room - full * (PACKET - 4)
        sizes = np.full(1 + full + (rest > 0), PACKET - 4, np.int64)
        sizes[0] = min(room, len(pes))
        if rest > 0:
            sizes[-1] = rest
        n = len(sizes)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = STREAM_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = STREAM_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        data = np.frombuffer(pes, np.uint8)
        for i in {0, n - 1}:
            gap = PACKET - 4 - int(sizes[i])
            if gap:
                own = adaptation if i == 0 else b""
                packets[i, 3] |= 0x20
                packets[i, 4] = gap - 1
                if gap > 1:
                    packets[i, 5 : 5 + max(len(own), 1)] = np.frombuffer(own or b"\0", np.uint8)
            packets[i, PACKET - int(sizes[i]) :] = data[: sizes[0]] if i == 0 else data[len(data) - int(sizes[-1]) :]
        if n > 2:
            packets[1:-1, 4:] = data[sizes[0] : sizes[0] + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
        counter = (counter + n) % 16
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its payload, and for each elementary packet its time (or None), size and random-access flag."""

    kind: int
    program: int
    payload: bytes = b""
    times: list[int | None] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    random: list[bool] = field(default_factory=list)
    gaps: int = 0
    repeats: int = 0


@dataclass
class Parsed:
    streams: dict[int, Stream]
    programs: dict[int, int]
    packets: int
    lost_bytes: int
    bad_sections: int


def _packets(data: bytes) -> tuple[np.ndarray, int]:
    """Packets as rows, and the bytes passed over to find sync again."""
    whole = np.frombuffer(data, np.uint8)
    n = len(whole) // PACKET
    rows = whole[: n * PACKET].reshape(n, PACKET)
    if n and (rows[:, 0] == SYNC).all() and n * PACKET == len(whole):
        return rows, 0
    found, at = [], 0
    while at + PACKET <= len(data):
        if data[at] == SYNC and (at + PACKET == len(data) or at + PACKET > len(data) - 1 or data[at + PACKET] == SYNC):
            found.append(whole[at : at + PACKET])
            at += PACKET
        else:
            at += 1
    return (np.stack(found) if found else np.zeros((0, PACKET), np.uint8)), len(data) - PACKET * len(found)


def _sections(rows: np.ndarray, begin: np.ndarray) -> Iterator[bytes]:
    """Sections of one table's packets, put together across packets."""
    rest = b""
    for row, b in zip(rows, begin.tolist(), strict=True):
        body = row[b:].tobytes()
        if row[1] & 0x40 and body:
            pointer = body[0]
            rest += body[1 : 1 + pointer]
            yield rest
            rest = body[1 + pointer :]
        else:
            rest += body
        while len(rest) > 3 and rest[0] != 0xFF and len(rest) >= (size := 3 + (int.from_bytes(rest[1:3], "big") & 0xFFF)):
            yield rest[:size]
            rest = rest[size:]


def demux(data: bytes) -> Parsed:
    """Parses the program tables, checks the counters and reassembles the elementary packets of every stream they list.

    A packet whose counter equals the last one's is a repeat and is left out; any other jump is counted as a gap, unless
    the packet says that it is discontinuous. Packets with the error flag, scrambled ones and those without payload give
    nothing. Sections with a wrong checksum are counted and ignored.
    """
    rows, lost = _packets(data)
    parsed = Parsed({}, {}, len(rows), lost, 0)
    if not len(rows):
        return parsed
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    has, fits = rows[:, 3] & 0x10 != 0, rows[:, 3] & 0x20 != 0
    begin = np.where(fits, 5 + rows[:, 4].astype(np.int64), 4)
    flags = np.where(fits & (rows[:, 4] > 0), rows[:, 5], 0)
    use = has & (rows[:, 1] & 0x80 == 0) & (rows[:, 3] & 0xC0 == 0) & (begin <= PACKET) & (pid != NULL_PID)

    def table(at: int, table_id: int) -> Iterator[bytes]:
        pick = np.flatnonzero(use & (pid == at))
        for s in _sections(rows[pick], begin[pick]):
            if len(s) < 12 or s[0] != table_id or len(s) != 3 + (int.from_bytes(s[1:3], "big") & 0xFFF):
                continue
            if crc_mpeg(s):
                parsed.bad_sections += 1
                continue
            yield s

    for s in dict.fromkeys(table(PAT_PID, 0)):  # tables are repeated
        for k in range(8, len(s) - 4, 4):
            number, at = int.from_bytes(s[k : k + 2], "big"), int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF
            if number:
                parsed.programs[number] = at
    for number, at in parsed.programs.items():
        for s in dict.fromkeys(table(at, 2)):
            k = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while k + 5 <= len(s) - 4:
                parsed.streams.setdefault(int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF, Stream(s[k], number))
                k += 5 + (int.from_bytes(s[k + 3 : k + 5], "big") & 0xFFF)
    for at, stream in parsed.streams.items():
        pick = np.flatnonzero(use & (pid == at))
        if len(pick):
            counter = rows[pick, 3].astype(np.int64) & 15
            step = np.diff(counter) % 16
            same = np.append(False, step == 0)
            stream.repeats = int(same.sum())
            stream.gaps = int(((step > 1) & (flags[pick][1:] & 0x80 == 0)).sum())
            _elementary(stream, rows, pick[~same], begin, flags)
    return parsed


def _elementary(stream: Stream, rows: np.ndarray, pick: np.ndarray, begin: np.ndarray, flags: np.ndarray) -> None:
    starts = np.flatnonzero(rows[pick, 1] & 0x40)
    body = [rows[i, b:] if b > 4 else rows[i, 4:] for i, b in zip(pick.tolist(), begin[pick].tolist(), strict=True)] if len(pick) < 4 else None
    parts = []
    for a, b in zip(starts, np.append(starts[1:], len(pick)), strict=True):
        own = pick[a:b]
        inner = own[1:-1]
        if body is not None:
            pes = b"".join(x.tobytes() for x in body[a:b])
        elif len(inner) and (begin[inner] == 4).all():
            pes = rows[own[0], begin[own[0]] :].tobytes() + rows[own[1] : own[-1], 4:].tobytes() if own[-1] - own[0] == len(own) - 1 else rows[own[0], begin[own[0]] :].tobytes() + rows[inner, 4:].tobytes()
            pes += rows[own[-1], begin[own[-1]] :].tobytes()
        else:
            pes = b"".join(rows[i, begin[i] :].tobytes() for i in own)
        if pes[:3] != b"\0\0\1" or len(pes) < 9:
            continue
        length = int.from_bytes(pes[4:6], "big")
        time = None
        if pes[7] & 0x80 and len(pes) >= 14:
            t = pes[9:14]
            time = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        unit = pes[9 + pes[8] : 6 + length if length else len(pes)]
        parts.append(unit)
        stream.times.append(time)
        stream.sizes.append(len(unit))
        stream.random.append(bool(flags[own[0]] & 0x40))
    stream.payload = b"".join(parts)


def features(parsed: Parsed) -> str:
    """What a stream is made of, in one line: counts, faults, first and last time, random-access points and their times."""
    out = [f"packets={parsed.packets} programs={len(parsed.programs)} lost={parsed.lost_bytes} bad={parsed.bad_sections}"]
    for at, s in sorted(parsed.streams.items()):
        times = [t for t in s.times if t is not None]
        points = [t for t, r in zip(s.times, s.random, strict=True) if r and t is not None]
        digest = zlib.crc32(np.asarray(points, "<i8").tobytes())
        out.append(f"pid={at} type={s.kind} units={len(s.sizes)} gaps={s.gaps} repeats={s.repeats} pts={min(times, default=-1)}..{max(times, default=-1)} points={len(points)} points_crc={digest}")
    return "; ".join(out)


def unit_bytes(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of the text and bytes of 255 up to a positive multiple of UNIT; and the count of the former."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


def store(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Each text as a transport stream, and what reading the stream back gives. One pass without a shuffle.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and times and
    random_access: the timestamps of all access units, and of those where decoding can begin. with_media adds the stream.

    A null text is empty and gives one unit of padding; null ids stay null; repeated rows give equal rows; an empty table
    gives no rows; further columns are ignored. A stream that doesn't give its payload back stops the job.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, random_access array<long>"
    schema += ", media binary" if with_media else ""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                payload, n = unit_bytes(text)
                media = mux(payload)
                parsed = demux(media)
                stream = parsed.streams[STREAM_PID]
                back = stream.payload
                if back != payload or stream.gaps:
                    raise ValueError("a transport stream didn't give its payload back")
                points = [t for t, r in zip(stream.times, stream.random, strict=True) if r]
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(parsed), stream.times, points, media)
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=False))], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.arrow_map(rows, run, schema)

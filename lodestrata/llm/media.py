"""Media columns: byte payloads in MPEG transport streams.

write() puts a payload into a transport stream of one program: a program association table, a program map table and
one private elementary stream, whose access units travel in PES packets with presentation times.  Every
RAP_EVERY-th unit starts a random-access point with a clock reference.  read() parses any such stream: it checks the
tables' checksums and each PID's continuity counter, reassembles the elementary packets and lists units with their times and
random-access flags.  Both work on one payload at a time; a row's memory is a few times its bytes.

Defined cases: a null or empty text is 64 bytes 0; equal texts give equal streams, as nothing else goes into them; an empty
table gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, utf8

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PRIVATE = 0x1000, 0x0100, 0x06
#: Bytes in an access unit, 90 kHz ticks between units, units between random-access points.
UNIT, TICKS, RAP_EVERY = 16384, 3600, 4


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(PMT_PID,
    _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2,
    "big") + b"\xf0\x00"))
#: Packet headers of the elementary stream by counter: a unit's first packet and others, with payload alone or an adaptation field too.
HEADS = {(first, field): [bytes([SYNC]) + (first << 14 | ES_PID).to_bytes(2, "big") + bytes([0x10 | field << 5 | cc])
    for cc in range(16)] for first in (0, 1) for field in (0, 1)}


def _time(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1
        & 0xFE])


def _reference(ticks: int) -> bytes:
    return (ticks << 15 | 0x3F << 9).to_bytes(6, "big")


def write(payload: bytes) -> bytes:
    """The transport stream that carries payload."""
    out, cc = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = k * TICKS & 0x1FFFFFFFF
        pes = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(pts) + unit
        start, first = 0, 1
        while start < len(pes):
            field = b"\x07\x50" + _reference(pts) if first and k % RAP_EVERY == 0 else b""
            room = PACKET - 4 - len(field)
            part = pes[start : start + room]
            if (gap := room - len(part)) > 0:  # stuffing goes into the adaptation field
                if field:
                    field = bytes([7 + gap]) + field[1:] + b"\xff" * gap
                else:
                    field = bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"")
            out += (HEADS[first, 1 if field else 0][cc], field, part)
            start, first, cc = start + len(part), 0, cc + 1 & 15
    return b"".join(out)


class _Sections:
    """Gathers a PID's sections, which may span packets or share one; gives those with a right checksum."""

    def __init__(self):
        self.held: bytes | None = None

    def add(self, begins: bool, payload: bytes) -> list[bytes]:
        """The sections that this packet's payload completes; begins: it holds the start of one, after a pointer."""
        out: list[bytes] = []
        if begins:
            pointer = payload[0] if payload else 0
            if self.held is not None:
                self.held += payload[1 : 1 + pointer]
                self._take(out)
            self.held = payload[1 + pointer :]
        elif self.held is not None:
            self.held += payload
        self._take(out)
        return out

    def _take(self, out: list[bytes]) -> None:
        while self.held and len(self.held) >= 3 and self.held[0] != 0xFF:  # 0xFF: stuffing up to the packet's end
            n = 3 + (int.from_bytes(self.held[1:3], "big") & 0x0FFF)
            if len(self.held) < n:
                return
            section, self.held = self.held[:n], self.held[n:]
            if n >= 12 and section[1] & 0x80 and crc32_mpeg(section) == 0:
                out.append(section)


def read(stream: bytes) -> dict:
    """What a transport stream holds: its programs, units as (pts, random_access, payload), and counts of faults.

    A packet that does not start with the sync byte, one that says it has an error, and a jump of the counter are counted; a repeated
    packet is skipped.  A unit that lost a packet is dropped and counted."""
    programs: dict[int, dict[int, int]] = {}
    maps: dict[int, int] = {}
    last: dict[int, int] = {}
    open_units: dict[int, list] = {}
    units, faults = [], {"sync": 0, "transport": 0, "continuity": 0, "duplicate": 0, "broken_unit": 0}
    packets = 0

    def close(pid: int) -> None:
        u = open_units.pop(pid, None)
        if not u:
            return
        rap, broken, parts = u
        pes = b"".join(parts)
        size = int.from_bytes(pes[4:6], "big")
        if broken or len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or (size and size + 6 != len(pes)):
            faults["broken_unit"] += 1
            return
        t, pts = pes[9:14], None
        if len(pes) < 9 + pes[8] or pes[7] & 0x80 and pes[8] < 5:  # cut within its own header
            faults["broken_unit"] += 1
            return
        if pes[7] & 0x80:
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        units.append((pid, pts, rap, pes[9 + pes[8] :]))

    streams: set[int] = set()
    tables: dict[int, _Sections] = {}
    for at in range(0, len(stream) - PACKET + 1, PACKET):
        packets += 1
        if stream[at] != SYNC:
            faults["sync"] += 1
            continue
        b1, b3 = stream[at + 1], stream[at + 3]
        if b1 & 0x80:
            faults["transport"] += 1
            continue
        pid = (b1 & 0x1F) << 8 | stream[at + 2]
        begin, rap = at + 4, False
        if b3 & 0x20:
            size = stream[begin]
            rap = bool(size and stream[begin + 1] & 0x40)
            begin += 1 + size
            if begin > at + PACKET:
                faults["transport"] += 1
                continue
        if not b3 & 0x10 or pid == 0x1FFF:
            continue
        cc, before = b3 & 15, last.get(pid)
        if before is not None and cc != before + 1 & 15:
            if cc == before:
                faults["duplicate"] += 1
                continue
            faults["continuity"] += 1
            tables.pop(pid, None)
            if pid in open_units:
                open_units[pid][1] = True
        last[pid] = cc
        if pid in streams:
            if b1 & 0x40:
                close(pid)
                open_units[pid] = [rap, False, []]
            if pid in open_units:
                open_units[pid][2].append(stream[begin : at + PACKET])
        elif pid == 0:
            for s in tables.setdefault(pid, _Sections()).add(bool(b1 & 0x40), stream[begin : at + PACKET]):
                for i in range(8, len(s) - 4, 4):
                    if number := int.from_bytes(s[i : i + 2], "big"):
                        maps[int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF] = number
        elif pid in maps:
            for s in tables.setdefault(pid, _Sections()).add(bool(b1 & 0x40), stream[begin : at + PACKET]):
                i, found = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF), {}
                while i + 5 <= len(s) - 4:
                    found[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)
                programs[maps[pid]] = found
                streams |= found.keys()
    for pid in list(open_units):
        close(pid)
    return {"packets": packets, "programs": programs, "units": units, "faults": faults}


def padded(text: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return text + b"\x00" * (-len(text) % 64 if text else 64)


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(text: bytes, with_stream: bool = False) -> tuple:
    """Stores a text's payload as a stream, reads it back, and gives what the stream holds: digests, a summary, and its units, each with its time, whether
    it is a random-access point, and its bytes; with_stream: the stream too."""
    media = write(padded(text))
    got = read(media)
    payload = b"".join(u[3] for u in got["units"])
    raps = [u[1] for u in got["units"] if u[2]]
    feature = f"programs={len(got['programs'])};streams={sum(map(len, got['programs'].values()))};packets={got['packets']};faults={sum(got['faults'].values())};units={len(got['units'])};pts={got['units'][0][1]}-{got['units'][-1][1]};raps={len(raps)};last_rap={raps[-1]}"
    row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
        hashlib.sha256(media).hexdigest(), feature)
    row = (*row, [{"pts": u[1], "random_access": u[2], "bytes": len(u[3])} for u in got["units"]])
    return (*row, media) if with_stream else row


def media_columns(docs: DataFrame, streams: bool = False) -> DataFrame:
    """Per row: doc_id, what describe() gives and the units with their times (units); with streams also the stored bytes (media)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    unit = pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.int64())])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}, units array<struct<pts:long,random_access:boolean,bytes:long>>"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(unit),
        pa.binary()]
    names = [*(x.split()[0] for x in SCHEMA.split(", ")), "units", "media"]

    def work(part: pa.RecordBatch):
        rows = list(zip(*(describe(t, streams) for t in utf8(part.column("text"))), strict=True))
        arrays = [pa.array(x, t) for x, t in zip(rows, types, strict=False)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *names[: len(rows)]])

    return mapped(docs, work, schema + ", media binary" * streams)

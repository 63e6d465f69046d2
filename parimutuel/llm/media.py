"""Media columns (operator 5): MPEG transport streams.

``mux`` writes a payload as the private-data elementary stream of a transport
stream: program tables first, then packetized units with timestamps, each starting
with a random-access point and a clock reference. ``demux`` knows nothing of the
writer: it follows the program tables, which may take several packets, checks
continuity counters, reassembles the elementary packets and returns the samples with
the timestamps, clock references and random-access points. As the standard has it,
packets without payload don't count, and a packet sent twice is taken once.

Defined results: a null or empty text is one block of 192 blanks; any byte string
round-trips; equal texts give equal streams; a damaged stream is reported through
``errors`` (lost or damaged packets) or ValueError (no usable program).
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

PACKET, BLOCK = 188, 192
PMT_PID, ES_PID = 0x1000, 0x0100
#: Payload bytes of one elementary packet, and its duration in ticks of 90 kHz.
UNIT, TICKS = 64 * BLOCK, 3600
HEAD = 14


@lru_cache(1024)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, no reflection, no final exclusive or."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(body: bytes) -> bytes:
    return body + crc32_mpeg(body).to_bytes(4, "big")


def table_packet(pid: int, body: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section(body)).ljust(PACKET, b"\xff")


PAT = table_packet(0, bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
PMT = table_packet(PMT_PID, bytes([0x02, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, 0x06, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
TABLES = np.frombuffer(PAT + PMT, np.uint8).reshape(2, PACKET)


def stamp(pts: int) -> bytes:
    """A presentation timestamp in the five bytes of the header; 33 bits."""
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def clock(pcr: int) -> bytes:
    """A program clock reference of 90 kHz ticks, its extension of 27 MHz ticks nought."""
    pcr &= (1 << 33) - 1
    return bytes([pcr >> 25, pcr >> 17 & 255, pcr >> 9 & 255, pcr >> 1 & 255, (pcr & 1) << 7 | 0x7E, 0])


#: Adaptation field of a unit's first packet: length, flags for random access and clock, the clock.
FIELD = 8
ROOM = PACKET - 4 - FIELD


def mux(payload: bytes) -> bytes:
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pes = b"\0\0\1\xbd" + (len(data) + HEAD - 6).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(k * TICKS) + data
        n = 1 + -(-max(0, len(pes) - ROOM) // 184)
        packets = np.full((n, PACKET), 255, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        packets[:, 3] = 0x10 | np.arange(counter, counter + n) & 15
        counter += n
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        raw = np.frombuffer(pes, np.uint8)
        head = raw[:ROOM]
        # What a last packet lacks is stuffed in its adaptation field.
        packets[0, 4] = PACKET - 5 - len(head)
        packets[0, 5] = 0x50
        packets[0, 6:12] = np.frombuffer(clock(k * TICKS), np.uint8)
        packets[0, PACKET - len(head) :] = head
        if n > 1:
            packets[1:-1, 4:] = raw[ROOM : ROOM + 184 * (n - 2)].reshape(n - 2, 184)
            tail = raw[ROOM + 184 * (n - 2) :]
            if len(tail) < 184:
                packets[-1, 3] |= 0x20
                packets[-1, 4] = 183 - len(tail)
                if len(tail) < 183:
                    packets[-1, 5] = 0
            packets[-1, PACKET - len(tail) :] = tail
        out.append(packets)
    return np.concatenate(out).tobytes()


class Stream(NamedTuple):
    samples: bytes
    packets: int
    timestamps: list[int]
    random_access: list[int]  # sample offsets
    clocks: list[int]
    errors: int


@lru_cache(64)
def tables(body: bytes, kind: int) -> dict[int, int]:
    """Of a program association (0): program to PID; of a program map (2): PID to stream type."""
    length = (body[1] & 15) << 8 | body[2]
    if body[0] != kind or crc32_mpeg(body[: length - 1]) != int.from_bytes(body[length - 1 : length + 3], "big"):
        raise ValueError("damaged program table")
    if kind == 0:
        return {body[i] << 8 | body[i + 1]: (body[i + 2] & 31) << 8 | body[i + 3] for i in range(8, length - 1, 4)}
    found, i = {}, 12 + ((body[10] & 15) << 8 | body[11])
    while i < length - 1:
        found[(body[i + 1] & 31) << 8 | body[i + 2]] = body[i]
        i += 5 + ((body[i + 3] & 15) << 8 | body[i + 4])
    return found


class Packets(NamedTuple):
    """Packets of one PID that carry payload, each once."""

    rows: np.ndarray
    offset: np.ndarray  # of the payload
    starts: np.ndarray  # whether a unit or section begins in it
    flags: np.ndarray  # of the adaptation field
    errors: int

    @classmethod
    def of(cls, p: np.ndarray, pid: int) -> Packets:
        own = p[(((p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]) == pid) & (p[:, 3] & 0x10 != 0)]
        adapted = own[:, 3] & 0x20 != 0
        offset = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
        flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
        step = np.diff(own[:, 3].astype(np.int16) & 15) & 15
        again = np.concatenate([[False], step == 0]) & (flags & 0x80 == 0) if len(own) else np.zeros(0, bool)
        for i in np.flatnonzero(again):  # the same counter is a packet sent twice only if all but its clock is the same
            skip = 12 if flags[i] & 0x10 else 4
            again[i] = (own[i, skip:] == own[i - 1, skip:]).all() and (own[i, :6] == own[i - 1, :6]).all() and not again[i - 1]
        own, offset, flags = own[~again], offset[~again], flags[~again]
        jumps = (np.diff(own[:, 3].astype(np.int16) & 15) - 1 & 15 != 0) & (flags[1:] & 0x80 == 0)
        return cls(own, offset, own[:, 1] & 0x40 != 0, flags, int(jumps.sum()) + int((own[:, 1] & 0x80 != 0).sum()) + int((offset > PACKET).sum()))


def section_of(p: np.ndarray, pid: int) -> bytes:
    """The first whole section of a PID, from as many packets as it takes."""
    own, body, size = Packets.of(p, pid), None, 3
    for row, at, start in zip(own.rows, own.offset, own.starts):
        data = row[at:].tobytes()
        if start and data:
            before, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if body is not None:  # what stands before the pointed place ends the section before
                body += before
                break
            body = data
        elif body is not None:
            body += data
        if body is not None and len(body) >= 3:
            size = 3 + ((body[1] & 15) << 8 | body[2])
            if len(body) >= size:
                break
    if body is None or len(body) < size:
        raise ValueError(f"no whole table in PID {pid}")
    return body[:size]


def demux(media: bytes) -> Stream:
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronization")
    program = min(x for x in tables(section_of(p, 0), 0).items() if x[0])
    own = Packets.of(p, min(tables(section_of(p, program[1]), 2)))
    errors = own.errors
    begins = np.flatnonzero(own.starts)
    samples, timestamps, points, clocks, n = [], [], [], [], 0
    for a, b in zip(begins, [*begins[1:], len(own.rows)]):
        rows, skip = own.rows[a:b], own.offset[a:b]
        if (skip[1:-1] == 4).all() and b - a > 1:
            pes = rows[0, skip[0] :].tobytes() + rows[1:-1, 4:].tobytes() + rows[-1, skip[-1] :].tobytes()
        else:
            pes = b"".join(r[s:].tobytes() for r, s in zip(rows, skip))
        if pes[:3] != b"\0\0\1" or len(pes) < 9:
            errors += 1
            continue
        if own.flags[a] & 0x40:
            points.append(n)
        if own.flags[a] & 0x10:
            c = rows[0, 6:11].tolist()
            clocks.append(c[0] << 25 | c[1] << 17 | c[2] << 9 | c[3] << 1 | c[4] >> 7)
        if pes[7] & 0x80:
            timestamps.append((pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1)
        size = pes[4] << 8 | pes[5]
        data = pes[9 + pes[8] : 6 + size if size else None]
        errors += bool(size and len(pes) < 6 + size and not own.errors)
        samples.append(data)
        n += len(data)
    return Stream(b"".join(samples), len(p), timestamps, points, clocks, errors)


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" "), len(raw)


def feature(samples: bytes) -> str:
    """Mean, deviation and an eight-bin histogram of the samples, and where they are random-accessible."""
    a = np.frombuffer(samples, np.uint8)
    bins = np.bincount(a >> 5, minlength=8)
    return f"{a.mean():.4f} {a.std():.4f} " + ",".join(map(str, bins.tolist()))


def digest(text: str) -> tuple:
    payload, n = payload_of(text)
    media = mux(payload)
    back = demux(media)
    return (n, len(back.samples), hashlib.sha256(back.samples).hexdigest(), zlib.crc32(back.samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back.samples), back.packets, back.errors, back.timestamps, back.random_access)


MEDIA = "doc_id long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, continuity_errors long, timestamps array<long>, random_access array<long>"


def to_media(docs: DataFrame) -> DataFrame:
    """A transport stream per document."""
    return map_texts(docs, lambda ids, texts: [ids, [mux(payload_of(t)[0]) for t in texts]], MEDIA)


def media_digests(docs: DataFrame) -> DataFrame:
    """Write each document as a transport stream, read it back and compute its features."""
    return map_texts(docs, lambda ids, texts: [ids, *zip(*map(digest, texts))], SCHEMA)

"""Ogg media columns: write and read Ogg physical streams.

A reader verifies each page's checksum, finds the next page after damage, splits the multiplexed pages by
serial number into logical streams, joins packets from lacing values over page ends, and derives times
from granule positions. The writer makes what the reader reads; 8-bit samples are stored losslessly.

Defined cases: null bytes read as an empty stream; bytes that are no page are skipped and counted; a page
whose checksum fails is dropped and counted, and a packet that it had part of is dropped; a granule
position of -1 gives no time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc, per_text

RATE = 8000
PACKET_SAMPLES = 4080
_HEAD = struct.Struct("<4sBBqIIIB")
#: Each byte with its bits in reverse: Ogg's checksum is the CRC-32 polynomial taken from the high bit.
_REVERSE = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
MAGIC = b"\x80smp8"
INDEX_MAGIC = b"\x80index"


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, initial 0, high bit first, no final xor."""
    low_first = zlib.crc32(page.translate(_REVERSE), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(_REVERSE), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    sum_ = page_crc(b"".join((head, lacing, body)))
    return b"".join((head[:22], sum_.to_bytes(4, "little"), head[26:], lacing, body))


def logical_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream. packets: (bytes, granule position at its end). The first packet has a page of its own.

    A page holds up to 255 lacing values; a packet that is longer goes on in the next page.
    """
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), [], -1, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule
        flags = continued | 2 * (not pages) | 4 * last
        pages.append(_page(flags, granule, serial, len(pages), bytes(lacing), b"".join(body)))
        lacing, body, granule = bytearray(), [], -1

    for i, (data, end) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while at < len(values):
            take = min(255 - len(lacing), len(values) - at)
            lacing += values[at : at + take]
            body.append(data[255 * at : 255 * (at + take)])
            at += take
            if at == len(values):
                granule = end
            if len(lacing) == 255 or i == 0 and at == len(values):
                last = i == len(packets) - 1 and at == len(values)
                flush(last)
                continued = at < len(values)
    if lacing or not pages:
        flush(True)
    return pages


def mux(streams: list[list[bytes]]) -> bytes:
    """One physical stream: all first pages, then the streams' other pages in turn."""
    out = [s[0] for s in streams]
    for k in range(1, max(map(len, streams), default=0)):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


@dataclass
class Logical:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _open: list[bytes] | None = None
    _next: int | None = None


def demux(data: bytes | None) -> tuple[dict[int, Logical], dict[str, int]]:
    """Logical streams by serial number, and counts of bad pages and skipped bytes."""
    streams: dict[int, Logical] = {}
    counts = {"pages": 0, "bad_pages": 0, "skipped_bytes": 0}
    data, at = data or b"", 0
    while at < len(data):
        found = data.find(b"OggS", at)
        if found < 0:
            counts["skipped_bytes"] += len(data) - at
            break
        counts["skipped_bytes"] += found - at
        at = found
        if at + 27 > len(data):
            counts["skipped_bytes"] += len(data) - at
            break
        _, version, flags, granule, serial, number, sum_, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if version or len(lacing) < n or len(page) < size or page_crc(b"".join((page[:22], b"\0\0\0\0", page[26:]))) != sum_:
            counts["bad_pages"] += 1
            counts["skipped_bytes"] += 4
            at += 4  # look for the next page inside
            continue
        at += size
        counts["pages"] += 1
        s = streams.setdefault(serial, Logical(serial))
        s.pages += 1
        if s._next is not None and number != s._next:
            s.gaps += 1
            s._open = None
        s._next = number + 1
        parts = s._open if flags & 1 else None
        dropping = bool(flags & 1) and parts is None  # the packet's start was lost
        parts = parts or []
        body, done = 27 + n, 0
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                if not dropping:
                    s.packets.append(b"".join((*parts, page[body : body + run])))
                    done += 1
                body, run, parts, dropping = body + run, 0, [], False
        s._open = None
        if n and lacing[-1] == 255:
            s._open = None if dropping else [*parts, page[body : body + run]]
        s.granules += [-1] * (done - 1) + ([granule] if done else [])
        s.ended |= bool(flags & 4)
    return streams, counts


def seconds(granule: int, rate: int) -> float | None:
    return granule / rate if granule >= 0 and rate > 0 else None


def write_samples(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit samples as Ogg: a stream of samples, and beside it a stream with an index of (granule, byte) by packet."""
    serial = crc(samples)
    packets, index, end = [(MAGIC + struct.pack("<IQ", rate, len(samples)), 0)], [], 0
    for a in range(0, len(samples), PACKET_SAMPLES):
        part = samples[a : a + PACKET_SAMPLES]
        end += len(part)
        packets.append((part, end))
        index.append(struct.pack("<QQ", end, a))
    other = serial ^ 0x5A5A5A5A
    return mux([logical_pages(serial, packets), logical_pages(other, [(INDEX_MAGIC + struct.pack("<I", serial), 0), (b"".join(index), end)])])


def read_samples(media: bytes | None) -> dict:
    """The stored samples with what the container says of them: rate, duration, pages, packets, streams, whether all is whole."""
    streams, counts = demux(media)
    out = {"samples": b"", "rate": 0, "duration": 0.0, "streams": len(streams), "packets": 0, "whole": False, **counts}
    for s in streams.values():
        if s.packets and s.packets[0].startswith(MAGIC):
            rate, n = struct.unpack_from("<IQ", s.packets[0], len(MAGIC))
            data = b"".join(s.packets[1:])
            end = max([0, *s.granules])
            out |= {"samples": data, "rate": rate, "duration": seconds(end, rate) or 0.0, "packets": len(s.packets), "whole": len(data) == n == end and s.ended and not s.gaps and not counts["bad_pages"] and not counts["skipped_bytes"]}
    return out


def feature(read: dict) -> str:
    x = np.frombuffer(read["samples"], np.uint8)
    if len(x):
        counts = np.bincount(x, minlength=256).astype(np.int64)
        mean = int(counts @ np.arange(256)) / len(x)
        p = counts[counts > 0] / len(x)
        entropy = float(-(p * np.log2(p)).sum())
        crossings = int(np.count_nonzero(np.diff((x > 127).view(np.int8))))
    else:
        mean = entropy = 0.0
        crossings = 0
    return f"ogg rate={read['rate']} s={read['duration']:.6f} streams={read['streams']} pages={read['pages']} packets={read['packets']} mean={mean:.4f} entropy={entropy:.4f} crossings={crossings} whole={read['whole']}"


def padded(data: bytes, unit: int = 64) -> bytes:
    """data with bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(max(1, -(-len(data) // unit)) * unit - len(data))


def read_streams(media: DataFrame, keep: list[str], media_col: str) -> DataFrame:
    """For a column of Ogg bytes: a row for each logical stream with its packets, their end times' granules and the counts of damage."""
    schema = T.ArrayType(T.StructType([T.StructField("serial", T.LongType()), T.StructField("pages", T.LongType()), T.StructField("gaps", T.LongType()), T.StructField("packets", T.ArrayType(T.BinaryType())), T.StructField("granules", T.ArrayType(T.LongType()))]))
    kind = pa.list_(pa.struct([("serial", pa.int64()), ("pages", pa.int64()), ("gaps", pa.int64()), ("packets", pa.list_(pa.binary())), ("granules", pa.list_(pa.int64()))]))

    def make():
        def work(blobs: list[bytes]) -> list:
            rows, bad, skipped = [], [], []
            for b in blobs:
                streams, counts = demux(b)
                rows.append([{"serial": s.serial, "pages": s.pages, "gaps": s.gaps, "packets": s.packets, "granules": s.granules} for s in streams.values()])
                bad.append(counts["bad_pages"])
                skipped.append(counts["skipped_bytes"])
            return [rows, bad, skipped]

        return work

    out = per_text(media, keep, media_col, [("streams", schema, kind), ("bad_pages", T.LongType(), pa.int64()), ("skipped_bytes", T.LongType(), pa.int64())], make)
    return out.select(*keep, "bad_pages", "skipped_bytes", F.inline_outer("streams"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as Ogg, read back and described; see the module for the format."""
    long, text = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
    fields = [("n_bytes", *long), ("payload_bytes", *long), ("payload_sha256", *text), ("tail_crc32", *long), ("media_bytes", *long), ("media_sha256", *text), ("feature", *text)]

    def make():
        def work(texts: list[bytes]) -> list:
            out: list[list] = [[] for _ in fields]
            for t in texts:
                media = write_samples(padded(t))
                read = read_samples(media)
                back = read["samples"]
                for column, value in zip(out, (len(t), len(back), hashlib.sha256(back).hexdigest(), crc(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(read)), strict=True):
                    column.append(value)
            return out

        return work

    return per_text(docs, [id_col], text_col, fields, make).withColumnRenamed(id_col, "doc_id")

"""Ogg media columns: write and read the page format, check it, take streams apart.

A page is "OggS", version, flags (1 continued packet, 2 first page, 4 last page), granule
position, stream serial, page number, checksum, and up to 255 lacing values; a packet is the
bytes of lacing values up to and including the first below 255, over pages if need be. The
checksum is CRC-32 with polynomial 0x04C11DB7, most significant bit first, starting from 0:
the usual reflected CRC-32 of the bit-reversed bytes, which zlib computes, bit-reversed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

CONTINUED, FIRST, LAST = 1, 2, 4
UNIT = 576
PACKET = 8 * UNIT
RATE = 8000
SAMPLES_MAGIC, NOTE_MAGIC = b"vspcm-u8", b"vsnote-1"
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def paginate(packets: list[bytes], granules: list[int], serial: int, first_page: int, flags: int) -> list[bytes]:
    """Pages that hold the packets; granules[i] is the position after packet i."""
    laces, done_at = bytearray(), []
    for p in packets:
        laces += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        done_at.append(len(laces))
    data, pages, at, k = b"".join(packets), [], 0, 0
    for i in range(0, len(laces), 255):
        part = bytes(laces[i : i + 255])
        continued = CONTINUED if i and laces[i - 1] == 255 else 0
        last = i + 255 >= len(laces)
        while k < len(done_at) and done_at[k] <= i + len(part):
            k += 1
        granule = granules[k - 1] if k and done_at[k - 1] > i else -1
        size = sum(part)
        kind = continued | (flags & FIRST if not i else 0) | (flags & LAST if last else 0)
        head = [b"OggS", 0, kind, granule, serial, first_page + len(pages), 0, len(part)]
        body = part + data[at : at + size]
        head[6] = page_checksum(_HEAD.pack(*head) + body)
        pages.append(_HEAD.pack(*head) + body)
        at += size
    return pages


def mux_samples(samples: bytes, note: bytes) -> bytes:
    """Unsigned 8-bit mono samples and a note as two interleaved logical streams."""
    serial = zlib.crc32(samples)
    other = serial ^ 0xA5A5A5A5
    head = SAMPLES_MAGIC + struct.pack("<IBQ", RATE, 1, len(samples))
    packets = [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
    ends = [min(len(samples), i + PACKET) for i in range(0, len(samples), PACKET)]
    a = paginate([head], [0], serial, 0, FIRST)
    b = paginate([NOTE_MAGIC], [0], other, 0, FIRST) + paginate([note], [1], other, 1, LAST)
    a += paginate(packets, ends, serial, 1, LAST) if packets else []
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of each packet, -1 where it cannot be told.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    first: bool = False
    last: bool = False
    _open: bytearray | None = None
    _next: int | None = None

    def units(self, packet: bytes) -> int | None:
        """How far a packet moves the granule position: a sample for each byte, or one for a note."""
        return len(packet) if self.rate else 1 if self.packets[0] == NOTE_MAGIC else None

    def settle(self, n: int, granule: int) -> None:
        """Positions of the n packets that ended on a page: the page's own belongs to the last
        of them, and the others are counted back from it."""
        at: int | None = granule if granule >= 0 else None
        ends = []
        for p in self.packets[len(self.packets) - n :][::-1]:
            ends.append(-1 if at is None else at)
            step = self.units(p)
            at = None if at is None or step is None else at - step
        self.granules += ends[::-1]

    @property
    def rate(self) -> int:
        head = self.packets[0] if self.packets else b""
        return struct.unpack_from("<I", head, 8)[0] if head[:8] == SAMPLES_MAGIC and len(head) >= 12 else 0


def demux(data: bytes) -> tuple[list[Stream], int]:
    """Logical streams in order of appearance, and the number of damaged pages.

    A page that fails its checksum, or is cut short, is left out and reading resumes at the
    next capture pattern; a packet that lost a page is dropped and counted in its stream's gaps.
    """
    streams: dict[int, Stream] = {}
    at, bad = 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if len(data) - at < 27:
            bad += 1
            break
        _, version, flags, granule, serial, number, checksum, n = _HEAD.unpack_from(data, at)
        laces = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(laces)
        page = data[at : at + size]
        if version or len(page) < size or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            bad, at = bad + 1, at + 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        s.pages += 1
        s.first |= bool(flags & FIRST)
        s.last |= bool(flags & LAST)
        if s._next is not None and number != s._next:
            s.gaps, s._open = s.gaps + 1, None
        elif s._open is not None and not flags & CONTINUED:
            s.gaps, s._open = s.gaps + 1, None
        s._next = number + 1
        lost = bool(flags & CONTINUED) and s._open is None
        pos, run, before = 27 + n, 0, len(s.packets)
        for lace in laces:
            run += lace
            if lace == 255:
                continue
            piece = page[pos : pos + run]
            pos, run = pos + run, 0
            if lost:
                lost = False
                continue
            s.packets.append(bytes(s._open) + piece if s._open is not None else piece)
            s._open = None
        if n and laces[-1] == 255 and not lost:
            s._open = (s._open or bytearray()) + page[pos : pos + run]
        s.settle(len(s.packets) - before, granule)
        at += size
    return list(streams.values()), bad


def samples_of(streams: list[Stream]) -> bytes | None:
    for s in streams:
        if s.packets and s.packets[0][:8] == SAMPLES_MAGIC:
            return b"".join(s.packets[1:])
    return None


def feature(streams: list[Stream], bad: int) -> str:
    """What the container and its samples say, as text: streams, packets, pages, time, signal,
    and a checksum of every packet's position in time."""
    parts = [f"streams={len(streams)}", f"bad_pages={bad}"]
    for s in streams:
        rate, last = s.rate, max(s.granules, default=0)
        if rate:
            parts.append(f"pages={s.pages};packets={len(s.packets)};gaps={s.gaps};ms={last * 1000 // rate};ends={zlib.crc32(np.array(s.granules, '<i8').tobytes())}")
    x = np.frombuffer(samples_of(streams) or b"", np.uint8)
    if len(x):
        up = x >= 128
        parts.append(f"mean={int(x.sum(dtype=np.int64)) * 100 // len(x)};low={int(x.min())};high={int(x.max())};crossings={int(np.count_nonzero(up[1:] != up[:-1]))}")
    return "|".join(parts)


def text_payload(text: bytes) -> bytes:
    """UTF-8 text with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def with_media(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """docs with an Ogg file in out_col that holds each text (null: empty) as 8-bit samples.

    Other columns stay, but a column named out_col is replaced. Equal texts give equal files.
    """
    tune(docs.sparkSession)

    @F.arrow_udf("binary")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([mux_samples(text_payload(t or b""), b"n_bytes=%d" % len(t or b"")) for t in text.cast(pa.binary()).to_pylist()], pa.binary())

    return docs.withColumn(out_col, run(F.col(text_col)))


def media_packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id_col, serial, packet (from 0), granule, seconds, data.

    granule is the position at the packet's end: the page's own for the last packet that ends on
    it, counted back by the packets' samples for those before, -1 where that cannot be told.
    seconds is null where the stream has no rate or there is no position. Null media and bytes
    without a sound page give no rows.
    """
    tune(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in demux(m or b"")[0]:
                    rate = s.rate
                    rows += [(i, s.serial, k, g, g / rate if rate and g >= 0 else None, p) for k, (p, g) in enumerate(zip(s.packets, s.granules))]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [id_col, "serial", "packet", "granule", "seconds", "data"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInArrow(run, f"{id_col} {kind}, serial bigint, packet int, granule bigint, seconds double, data binary")


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per input row: what the stored bytes hold, and digests of it.

    n_bytes is what the note stream says (null if it says nothing); payload columns are null
    where no sample stream can be read; null media is read as no bytes.
    """
    tune(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1).to_pylist():
                m = m or b""
                streams, bad = demux(m)
                x = samples_of(streams)
                notes = [p for s in streams if s.packets and s.packets[0] == NOTE_MAGIC for p in s.packets[1:2]]
                n = int(notes[0].partition(b"=")[2]) if notes else None
                own = (None, None, None) if x is None else (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]))
                rows.append((n, *own, len(m), hashlib.sha256(m).hexdigest(), feature(streams, bad)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [id_col, *names])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")

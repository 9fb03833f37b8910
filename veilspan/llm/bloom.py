"""Bloom filters over 64-bit hashes, built in segments and never larger than they are told.

Each task sends the positions it set, a segment adds them up, and the segments of one filter
are broadcast. A `repeat` filter keeps the positions that were set at least twice, so a hash
whose positions are not all kept occurs once for certain; a `member` filter keeps all set ones.
A filter that has fewer bits than asked for passes more hashes that it need not, and never
stops one that it should pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collected, packed

SEGMENT_BITS = 17
MOST_PROBES = 4
#: Bytes of one filter, unless the caller says otherwise.
FILTER_BYTES = 64 << 20


def positions(h: np.ndarray, n_segments: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash and its bit positions in that segment."""
    u = h.astype(np.int64, copy=False).view(np.uint64)
    x = (u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    seg = ((x >> np.uint64(33)) % np.uint64(n_segments)).astype(np.int64)
    y = x * np.uint64(0xBF58476D1CE4E5B9)
    a, b = y >> np.uint64(40), (y >> np.uint64(8) & np.uint64(0xFFFFFF)) | np.uint64(1)
    steps = np.arange(probes, dtype=np.uint64)
    return seg, ((a[:, None] + steps * b[:, None]) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)


def _build(n_segments: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs = [np.asarray(b.column(0)) for b in batches if b.num_rows]
        if not hs:
            return
        seg, pos = positions(np.concatenate(hs), n_segments, probes)
        flat, n = np.unique((seg[:, None] << SEGMENT_BITS | pos).ravel(), return_counts=True)
        at = np.searchsorted(flat >> SEGMENT_BITS, np.arange(n_segments + 1))
        low = (flat & ((1 << SEGMENT_BITS) - 1)).astype("<i4")
        rows = [(s, low[i:j][n[i:j] == 1].tobytes(), low[i:j][n[i:j] > 1].tobytes()) for s, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j]
        for k in range(0, len(rows), 256):
            s, once, twice = zip(*rows[k : k + 256])
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])

    return run


def _merge(least: int):
    def run(table: pa.Table) -> pa.Table:
        n = np.zeros(1 << SEGMENT_BITS, np.int64)
        for name, by in (("once", 1), ("twice", 2)):
            for raw in table.column(name).to_pylist():
                n += by * np.bincount(np.frombuffer(raw, "<i4"), minlength=len(n))
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(n >= least).tobytes()], pa.binary())})

    return run


class Filter:
    """A broadcast filter over the one column of `hashes`; `destroy` it once its results are staged."""

    def __init__(self, hashes: DataFrame, n: int, bits_per_row: int, max_bytes: int, least: int):
        bits = max(1, min(n * bits_per_row, max_bytes * 8))
        self.probes = max(1, min(MOST_PROBES, round(0.7 * bits / max(1, n))))
        self.n_segments = -(-bits >> SEGMENT_BITS)
        merged = (
            hashes.mapInArrow(_build(self.n_segments, self.probes), "segment int, once binary, twice binary")
            .groupBy("segment").applyInArrow(_merge(least), "segment int, bits binary")
        )
        table = np.zeros((self.n_segments, (1 << SEGMENT_BITS) // 8), np.uint8)
        for row in collected(merged):  # n_segments rows, max_bytes in all
            table[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
        self.shared = hashes.sparkSession.sparkContext.broadcast(table)

    def probe(self):
        """hashes -> booleans, for use in workers."""
        n_segments, probes, shared = self.n_segments, self.probes, self.shared

        def test(h: np.ndarray) -> np.ndarray:
            seg, pos = positions(h, n_segments, probes)
            return ((shared.value[seg[:, None], pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=1)

        return test

    def maybe(self, h: Column) -> Column:
        """The test of a hash column."""
        test = self.probe()

        @F.arrow_udf("boolean")
        def run(h: pa.Array) -> pa.Array:
            return pa.array(test(np.asarray(h)))

        return run(h)

    def destroy(self) -> None:
        self.shared.destroy()


def repeats(hashes: DataFrame, n: int, bits_per_row: int = 8, max_bytes: int = FILTER_BYTES) -> Filter:
    """True for every hash that occurs twice, and for few others."""
    return Filter(hashes, n, bits_per_row, max_bytes, 2)


def members(hashes: DataFrame, n: int, bits_per_row: int = 10, max_bytes: int = FILTER_BYTES) -> Filter:
    """True for every hash of `hashes`, and for few others (the more, the fewer bits are left for each)."""
    return Filter(hashes, n, bits_per_row, max_bytes, 1)


def split(rows: DataFrame, h: Column, keys: DataFrame, n: int, max_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """rows whose hash is surely not among keys (one column, n rows), and the others.

    The first never leave the scan's own tasks, wide columns and all.
    """
    marked = packed(rows, _maybe=members(keys, n, max_bytes=max_bytes).maybe(h))
    return marked.filter(~F.col("_maybe")).select("_row.*"), marked.filter("_maybe").select("_row.*")

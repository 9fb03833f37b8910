"""Corpus-wide lookups of per-document items without a row per item.

Documents are gathered into blocks of bounded size. A block keeps one list of its distinct
items (words, n-grams) and sends each item once, packed by hash part; the owner of a part sees
every block's items of that part, works each distinct item out once, and replies to each block
in the order it asked. A block and its replies then meet on the block id, and each document's
items are filled in by position. What is shuffled is compressed and grows with the distinct
items of the blocks; no key is hot, since a block asks for an item once however often it
occurs. Blocks are staged before use, so a retried task cannot renumber them.

Blocks and parts both grow with the input. A block therefore asks MOST_ASKS parts at most: where
there are more, they are parts of parts, and between two levels stand relays. A relay takes one
part's asks of a group of blocks, tells their items apart once more, and asks the part's own
parts as a block would. There are about as many relays at a level as blocks, and each sends
MOST_ASKS messages at most, so their number is bounded by the blocks, not by blocks times parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import give_back, stage, unstage

#: Text bytes after which a block is closed; one longer document is a block of its own. Larger
#: blocks shuffle less and take more of a worker's memory.
BLOCK_BYTES = 20 << 20

BLOCK_SCHEMA = "block bigint, part int, payload binary, kind int"
REPLY_SCHEMA = "block bigint, part int, reply binary"

#: Parts that a block or a relay asks, at most.
MOST_ASKS = 4096
#: Tasks of one shuffle, at most; past that a task takes several blocks or parts, one after another.
MOST_TASKS = 50_000


class Protocol(NamedTuple):
    """What an operator says at each place. Leaves are numbered; a part is a range of them.

    make(ids, texts) -> own bytes and one ask (or None) per part of the first level
    split(asks, stride, fan) -> own bytes and one ask (or None) for each of fan parts, each of
        which has stride leaves
    join(own, replies by part) -> one reply per ask of that split
    answer(asks) -> one reply per ask and a list of numbers, for a leaf
    fill(own, sums of those numbers over all leaves, replies by part) -> a table
    """

    make: Callable
    split: Callable
    join: Callable
    answer: Callable
    fill: Callable


def fans_for(n_parts: int) -> list[int]:
    """How many parts are asked at each level; their product is at least n_parts."""
    levels = 1
    while MOST_ASKS**levels < n_parts:
        levels += 1
    fan = max(1, int(n_parts ** (1 / levels)))
    while fan**levels < n_parts:
        fan += 1
    return [fan] * levels


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays or bytes as one compressed value; numbers of four bytes or more go byte plane by
    byte plane."""
    parts, head = [], bytearray([len(arrays)])
    for a in arrays:
        if isinstance(a, bytes):
            kind, raw = b"S", a
        else:
            a = np.ascontiguousarray(a)
            kind, raw = a.dtype.str.encode(), (a.view(np.uint8).reshape(-1, a.itemsize).T if a.itemsize > 2 else a).tobytes()
        head += kind.ljust(4) + len(raw).to_bytes(8, "little")
        parts.append(raw)
    return zstandard.compress(bytes(head) + b"".join(parts), 9)


def unpack(data: bytes) -> list:
    raw, out = zstandard.decompress(data), []
    at = 1 + 12 * raw[0]
    for k in range(1, at, 12):
        kind, size = raw[k : k + 4].strip(), int.from_bytes(raw[k + 4 : k + 12], "little")
        if kind == b"S":
            out.append(raw[at : at + size])
        else:
            dtype = np.dtype(kind.decode())
            if dtype.itemsize > 2:
                planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, -1)
                out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
            else:
                out.append(np.frombuffer(raw, dtype, size // dtype.itemsize, at))
        at += size
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else "u1")


def _message_rows(sender: int, own: bytes, asks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    parts, payloads = zip((-1, own), *asks)
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array([sender] * n, pa.int64()), pa.array(parts, pa.int32()), pa.array(payloads, pa.binary()), pa.array([0] + [1] * (n - 1), pa.int32())], ["block", "part", "payload", "kind"])


def _blocks(make: Callable, arrow_id: pa.DataType, block_bytes: int, keep: Callable | None):
    """mapInArrow body over (id, text), by Protocol.make, which may empty the list of texts as it goes.

    Only rows whose id keep(ids) is true for are taken, if there is a keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, k = [], [], 0, TaskContext.get().partitionId() << 32

        def close():
            own, asks = make(pa.array(ids, arrow_id), texts)
            return _message_rows(k, own, [(p, a) for p, a in enumerate(asks) if a is not None])

        for b in batches:
            if keep is not None:
                b = b.filter(pa.array(keep(b.column(0))))
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                t = t or b""
                if texts and size + len(t) > block_bytes:
                    yield close()
                    ids, texts, size, k = [], [], 0, k + 1
                ids.append(i)
                texts.append(t)
                size += len(t) + 64
        if texts:
            yield close()
        ids, texts = [], []
        give_back()

    return run


def ids_to_bytes(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    return sink.getvalue().to_pybytes()


def ids_from_bytes(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks()


def _spread(df: DataFrame, n: int, key: str):
    return df.repartition(max(1, min(n, MOST_TASKS)), key).groupBy(key)


def _replies(table: pa.Table, fan: int) -> dict[int, bytes]:
    return dict(zip((p % fan for p in table.column("part").to_pylist()), table.column("reply").to_pylist()))


def _ask(asks: DataFrame, n_asking: int, n_parts: int, fans: list[int], says: Protocol, totals: bool, name: str) -> tuple[DataFrame, list[int]]:
    """Replies to asks (block, part, payload), staged, and the leaves' totals.

    n_parts parts are asked by about n_asking blocks each; fans are the levels below.
    """
    if not fans:
        return _answered(asks, n_parts, says, totals, name)
    fan, stride = fans[0], prod(fans[1:])
    groups = max(1, -(-n_asking // fan))

    def relay(table: pa.Table) -> pa.Table:
        sender, part = table.column("relay")[0].as_py(), table.column("part")[0].as_py()
        own, kids = says.split(table.column("payload").to_pylist(), stride, fan)
        whose = pack(np.asarray(table.column("block"), "<i8"), np.array([part], "<i8"), own)
        give_back()
        return pa.Table.from_batches([_message_rows(sender, whose, [(part * fan + c, a) for c, a in enumerate(kids) if a is not None])])

    def back(own: pa.Table, replies: pa.Table) -> pa.Table:
        blocks, part, raw = unpack(own.column("payload")[0].as_py())
        out = says.join(raw, _replies(replies, fan))
        give_back()
        return pa.table({"block": pa.array(blocks, pa.int64()), "part": pa.array(np.repeat(part, len(blocks)), pa.int32()), "reply": pa.array(out, pa.binary())})

    grouped = asks.withColumn("relay", F.pmod(F.xxhash64("block"), F.lit(groups)) * n_parts + F.col("part"))
    relays = stage(_spread(grouped, groups * n_parts, "relay").applyInArrow(relay, BLOCK_SCHEMA), f"{name}-relays", ["kind"], codec="none")
    inner, made = _ask(relays.filter("kind = 1").select("block", "part", "payload"), groups, n_parts * fan, fans[1:], says, totals, name)
    own = relays.filter("kind = 0").select("block", "payload")
    served = stage(_spread(own, groups * n_parts, "block").cogroup(_spread(inner, groups * n_parts, "block")).applyInArrow(back, REPLY_SCHEMA), f"{name}-replies", codec="none")
    unstage(relays, inner)
    return served, made


def _answered(asks: DataFrame, n_parts: int, says: Protocol, totals: bool, name: str) -> tuple[DataFrame, list[int]]:
    def serve(table: pa.Table) -> pa.Table:
        replies, said = says.answer(table.column("payload").to_pylist())
        n = len(replies)
        give_back()
        return pa.table({"block": table.column("block"), "part": table.column("part"), "reply": pa.array(replies, pa.binary()), "said": pa.array([said] + [None] * (n - 1), pa.list_(pa.int64()))})

    served = stage(_spread(asks, n_parts, "part").applyInArrow(serve, f"{REPLY_SCHEMA}, said array<bigint>"), f"{name}-answers", codec="none")
    made = []
    if totals:  # a row for each number
        sums = served.select(F.posexplode("said")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        made = [r["n"] for r in sorted(sums)]
    replies = served.select("block", "part", "reply")
    replies._veilspan_path = served._veilspan_path
    return replies, made


def exchange(docs: DataFrame, fans: list[int], says: Protocol, fill_schema: str, name: str, totals: bool = False, block_bytes: int = BLOCK_BYTES, keep: Callable | None = None) -> DataFrame:
    """docs (id, text) through blocks, levels of parts, and back: fill's rows.

    keep(ids) -> booleans, the rows to take; it is told here so that a task needs no second
    Python worker. fans is fans_for of the parts wanted; a leaf may have a task of its own.
    """
    blocks = stage(docs.mapInArrow(_blocks(says.make, to_arrow_type(docs.schema[0].dataType), block_bytes, keep), BLOCK_SCHEMA), f"{name}-blocks", ["kind"], codec="none")
    own = blocks.filter("kind = 0").select("block", "payload")
    n_blocks = own.count()
    served, made = _ask(blocks.filter("kind = 1").select("block", "part", "payload"), n_blocks, fans[0], fans[1:], says, totals, name)
    unstage(blocks, part="kind=1")

    def join(own: pa.Table, replies: pa.Table) -> pa.Table:
        by_part = _replies(replies, fans[0])
        give_back()  # what the last block left
        return says.fill(own.column("payload")[0].as_py(), made, by_part)

    return _spread(own, n_blocks, "block").cogroup(_spread(served, n_blocks, "block")).applyInArrow(join, fill_schema)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated slices [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


"""SimHash near-duplicates by anchor points of a covering code.

Anchors are the 2^57 codewords of the Hamming code over the lower 63 fingerprint bits, a
perfect code of covering radius 1: every 63-bit word has exactly one codeword within 1. Two
fingerprints that differ in at most 2 bits have a word half-way, within 1 of both, and that
word's codeword is within 2 of both. So each distinct fingerprint is copied to every anchor
within covering radius + ceil(threshold/2) = 2 (32 of them), and all linked pairs meet. The
plain reach of covering radius + threshold = 3 finds the same links with 652 copies each.

At most 2 * (1 + 63 + 1953) = 4034 distinct fingerprints lie within 2 of an anchor, so no
anchor's group grows with the data, and exact copies are one fingerprint. Each anchor's group
is compared in full, but leaves only a tree for each of its linked classes, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import attach, give_back, packed, stage, tune, unstage

SEED = 42
SHINGLE = 3
MAX_BITS = 2
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles; fewer words give one shingle, no words give zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    h, bits, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    done = 0
    while done < n:
        k = min(_CHUNK, n - done)
        part = np.fromiter((h(s, SEED) for s, _ in zip(shingles, range(k))), "<u8", k)
        bits += np.unpackbits(part.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += k
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprint_udf(width: int = SHINGLE):
    @F.arrow_udf("bigint")
    def run(text: pa.Array) -> pa.Array:
        fps = [fingerprint(t, width) for t in text.cast(pa.binary()).to_pylist()]
        give_back()
        return pa.array(np.array(fps, np.uint64).view(np.int64))

    return run


def _digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _anchor_masks() -> np.ndarray:
    """Row s: what to flip in a word of syndrome s to reach each codeword within distance 2."""
    bit = lambda i: 1 << (i - 1)  # noqa: E731  position i of 1..63
    rows = [[0] * 32]
    for s in range(1, 64):
        rows.append([bit(s)] + [bit(i) | bit(i ^ s) for i in range(1, 64) if i < i ^ s])
    return np.array(rows, np.uint64)


_MASKS = _anchor_masks()
_CHECKS = np.array([sum(1 << (i - 1) for i in range(1, 64) if i >> k & 1) for k in range(6)], np.uint64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of its fingerprint), every codeword within 2 of each fingerprint's lower 63 bits."""
    low = fps & np.uint64((1 << 63) - 1)
    parity = np.bitwise_count(low[:, None] & _CHECKS) & 1
    syndrome = parity @ (1 << np.arange(6))
    at = low[:, None] ^ _MASKS[syndrome]
    use = np.ones(at.shape, bool)
    use[syndrome == 0, 1:] = False  # a codeword's own: the others are 3 or more away
    return at[use], np.nonzero(use)[0]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.asarray(b.column(0)).view(np.uint64)
        at, which = anchors(fps)
        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fps[which].view(np.int64))], ["anchor", "fp"])


def linked_classes(fps: np.ndarray, most: int = MAX_BITS) -> list[np.ndarray]:
    """Classes of two or more fingerprints joined by chains of links."""
    left, out = np.sort(fps), []
    while len(left):
        members, left = [left[:1]], left[1:]
        todo = list(members[0])
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= most
            if near.any():
                members.append(left[near])
                todo.extend(left[near])
                left = left[~near]
        if len(members) > 1:
            out.append(np.sort(np.concatenate(members)))
    return out


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, ends = b.column(0), []
            flat, off = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
            for i, j in zip(off[:-1], off[1:]):
                for c in linked_classes(flat[i:j], most):
                    k = np.arange(1, len(c))
                    ends.append((c[k], c[(k - 1) // 8]))  # an 8-ary tree: few edges at any node
            if ends:
                a, z = (np.concatenate(x).view(np.int64) for x in zip(*ends))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the smallest node reachable.

    Alternating stars: each node's larger neighbours move to the smallest node it knows (itself
    included), then each node's smaller neighbours and itself move to the smallest of them, until
    nothing changes. Every component is then a star around its smallest node. The number of
    rounds grows with the square of the logarithm of the nodes at most, whatever the shape.
    Nodes of many edges meet their smallest neighbour by broadcast (`attach`); all state is
    staged, and only a row count and a sum of hashes come to the driver.
    """
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, _mark_of(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("deg"))
        large = attach(both.filter("b > a"), low, ["a"], "deg", 2 * now[0], how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "edges")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("deg")), "least")
        moved = attach(large, low, ["a"], "deg", now[0], how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = stage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        unstage(edges, large, low)
        edges, before, now = small, now, _mark_of(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark_of(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id.

    Links join fingerprints that differ in at most max_bits (0 to 2) bits; component_id is the
    smallest id reachable over links, the row's own included (null ids are passed over). Null
    texts count as empty; texts without words all have fingerprint zero. Rows that repeat are
    one class. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = _classes(docs, id_col, text_col, shingle, max_bits)
    return rows.select(F.col("_id").alias(id_col), _digits(F.col("fp")).alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(_id, fp, root, component_id) of each row; root is the least fingerprint of its class."""
    if not 0 <= max_bits <= 2:
        raise ValueError("anchors within 2 find links of at most 2 bits")
    tune(docs.sparkSession)
    rows = stage(docs.select(F.col(id_col).alias("_id"), fingerprint_udf(shingle)(F.col(text_col)).alias("fp")), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    near = nodes.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint")
    met = near.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    roots = components(met.mapInArrow(_compare(max_bits), "a bigint, b bigint"))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    stats = stage(rooted.join(least, "root").select("fp", "n", "root", "component_id"), "classes")
    unstage(nodes, rooted)
    return attach(rows, stats, ["fp"], "n", rows.count())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_filter_bytes: int = bloom.FILTER_BYTES, **options) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the smallest id. All columns stay.

    Rows with a null id stay; rows of one class that repeat the id that stays are one row. A row
    is told by its id and fingerprint. Rows whose id is surely not among those that go or repeat
    pass a Bloom filter in the scan's own tasks; only the others work out their fingerprint again
    and meet those pairs in a join. The filter is never larger than max_filter_bytes; past ten
    bits an id it holds back more rows than it need, and the result is the same.
    """
    groups = stage(_classes(docs, id_col, text_col, **options).filter("_id is not null"), "near")
    stay, own = groups.filter("_id = component_id"), [F.col("_id").alias("_judged_id"), F.col("fp").alias("_judged"), "root"]
    again = stay.groupBy(F.col("root").alias("_again")).count().filter("count > 1").select("_again")
    gone = groups.filter("_id <> component_id").select(*own, F.lit(True).alias("_goes"))
    tops = stay.join(again, F.col("root") == F.col("_again")).select(*own, F.lit(False).alias("_goes"))
    judged = stage(gone.unionByName(tops).distinct(), "judged")
    unstage(groups)
    test, width = bloom.members(judged.select(F.xxhash64("_judged_id")), judged.count(), max_bytes=max_filter_bytes).probe(), options.get("shingle", SHINGLE)

    @F.arrow_udf("bigint")
    def held_back(text: pa.Array, ids: pa.Array) -> pa.Array:
        """The fingerprint of a row that may be judged, null for the others: filter and
        fingerprint in one worker, since two in a row would take the memory of both."""
        maybe = test(np.asarray(ids))
        fps = np.zeros(len(maybe), np.uint64)
        at = np.nonzero(maybe)[0]
        fps[at] = [fingerprint(t, width) for t in text.take(pa.array(at)).cast(pa.binary()).to_pylist()]
        give_back()
        return pa.array(fps.view(np.int64), mask=~maybe)

    marked = packed(docs, _id=F.col(id_col), _fp=held_back(F.col(text_col), F.xxhash64(id_col)))
    once, some = marked.filter("_fp is null").select("_row.*"), marked.filter("_fp is not null")
    met = some.join(judged, (F.col("_id") == F.col("_judged_id")) & (F.col("_fp") == F.col("_judged")), "left")
    free = met.filter(F.col("_goes").isNull()).select("_row.*")
    return once.unionByName(free).unionByName(met.filter(~F.col("_goes")).dropDuplicates(["root"]).select("_row.*"))

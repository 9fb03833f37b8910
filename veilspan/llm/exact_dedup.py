"""Exact deduplication: a two-pass Bloom filter finds rows that may repeat; only those shuffle.

Pass one reads whole texts once and leaves a 32-byte digest per row, in order of hash within
each task's file. A counting Bloom filter over the hashes (each position counts to two) is built
in segments. A digest that occurs twice has all its positions at two, so a row with a position
below two is unique for certain and passes straight through. Pass two tests every row; the few
that may repeat are grouped by the full digest.

A filter is at most `max_filter_bytes`. Beyond that the hash space is cut into ranges, one after
the other: a range's filter is built, its rows are tested and staged, and its filter is
destroyed before the next. As files are in order of hash, a range reads its own pages only, so
ranges do not multiply what is read. No row is skipped, and the plan is the same at every size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import attach, give_back, packed, scratch_path, stage, tune, unstage


def _digests(text: pa.Array) -> list[bytes]:
    """SHA-256 of each text with A-Z lower-cased, in UTF-8; null counts as empty."""
    sha = hashlib.sha256
    return [sha((t or b"").lower()).digest() for t in text.cast(pa.binary()).to_pylist()]


def _hashes(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def digest_udf():
    """struct<digest, h> of a text."""

    @F.arrow_udf("digest binary, h bigint")
    def run(text: pa.Array) -> pa.Array:
        d = _digests(text)
        out = pa.StructArray.from_arrays([pa.array(d, pa.binary()), pa.array(_hashes(d))], ["digest", "h"])
        give_back()
        return out

    return run


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged (_id, _digest, _h) of every row: the one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("_id"), digest_udf()(F.col(text_col)).alias("_d"))
    rows = rows.select("_id", F.col("_d.digest").alias("_digest"), F.col("_d.h").alias("_h"))
    return stage(rows.sortWithinPartitions("_h"), "digests")


def _in_range(r: int, rounds: int) -> Column:
    """Whether _h is in the r-th of so many equal ranges."""
    edge = [-(1 << 63) + (k << 64) // rounds for k in (r, r + 1)]
    return (F.col("_h") >= edge[0]) & (F.col("_h") <= edge[1] - 1)


def _marked(keys: DataFrame, n: int, bits_per_row: int, max_filter_bytes: int) -> DataFrame:
    """Staged (_id, _digest, _maybe): _maybe is false only where the digest occurs once. keys are used up."""
    rounds = max(1, -(-n * bits_per_row // (8 * max_filter_bytes)))
    path = scratch_path(keys.sparkSession, "marked")
    for r in range(rounds):
        own = keys.filter(_in_range(r, rounds))
        repeated = bloom.repeats(own.select("_h"), -(-n // rounds), bits_per_row, max_filter_bytes)
        out = stage(own.withColumn("_maybe", repeated.maybe(F.col("_h"))).drop("_h"), "marked", into=path)
        repeated.destroy()
    unstage(keys)
    return out


def _counted(marked: DataFrame) -> DataFrame:
    """Rows that may repeat, those of one id and text counted first, so that ties need no window."""
    return marked.filter("_maybe").groupBy("_digest", "_id").agg(F.count(F.lit(1)).alias("_rows"))


def _groups(counted: DataFrame) -> DataFrame:
    """Per digest among rows that may repeat: the id that stays and the number of rows."""
    return stage(counted.groupBy("_digest").agg(F.max("_id").alias("keep_id"), F.sum("_rows").alias("group_size")), "groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = 8, max_filter_bytes: int = bloom.FILTER_BYTES) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest id stays (null ids count as smallest); where that id itself
    repeats with the same text, exactly one of its rows stays. An empty table gives no rows.
    Other columns of docs are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    keys = _keys(docs, id_col, text_col)
    n = keys.count()
    marked = _marked(keys, n, bits_per_row, max_filter_bytes)
    counted = _counted(marked)
    found = attach(counted, _groups(counted), ["_digest"], "group_size", n)
    again = found.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    kept = (F.col("_nth") == 1) & F.col("_id").eqNullSafe(F.col("keep_id"))
    out = again.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "_digest")
    once = marked.filter(~F.col("_maybe")).select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_digest")
    return once.unionByName(out).withColumn("text_sha256", F.lower(F.hex("_digest"))).drop("_digest")


def _pair(digests: list[bytes], ids: pa.Array) -> np.ndarray:
    """One hash of each digest and hashed id."""
    return _hashes(digests) ^ (np.asarray(ids).astype(np.int64) << 1)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = 8, max_filter_bytes: int = bloom.FILTER_BYTES) -> DataFrame:
    """docs without the rows that exact_dedup does not keep; all columns stay.

    What goes is settled on digests alone, as in exact_dedup. A second pass over the texts
    meets a Bloom filter of the (id, digest) pairs that go or repeat: all other rows pass in the
    scan's own tasks. Only rows it holds back shuffle, and meet those pairs in a join. The filter
    is never larger than max_filter_bytes; past ten bits a pair it holds back more rows than it
    need, and the result is the same.
    """
    tune(docs.sparkSession)
    keys = _keys(docs, id_col, text_col)
    n = keys.count()
    marked = _marked(keys, n, bits_per_row, max_filter_bytes)
    counted = _counted(marked)
    groups = _groups(counted)
    found = attach(counted, groups, ["_digest"], "group_size", n)
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))

    @F.arrow_udf("bigint")
    def pair(digest: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array(_pair(digest.to_pylist(), ids))

    judged = found.filter(~stays | (F.col("_rows") > 1)).select(F.col("_id").alias("_judged_id"), F.col("_digest").alias("_judged"), (~stays).alias("_goes"), pair(F.col("_digest"), F.xxhash64("_id")).alias("_pair"))
    judged = stage(judged, "judged")
    unstage(marked, groups)
    held = bloom.members(judged.select("_pair"), judged.count(), max_bytes=max_filter_bytes)
    test = held.probe()

    @F.arrow_udf("digest binary, maybe boolean")
    def meet(text: pa.Array, ids: pa.Array) -> pa.Array:
        d = _digests(text)
        out = pa.StructArray.from_arrays([pa.array(d, pa.binary()), pa.array(test(_pair(d, ids)))], ["digest", "maybe"])
        give_back()
        return out

    full = packed(docs, _id=F.col(id_col), _d=meet(F.col(text_col), F.xxhash64(id_col)))
    once, some = full.filter(~F.col("_d.maybe")), full.filter("_d.maybe").select("_row", "_id", F.col("_d.digest").alias("_digest"))
    met = some.join(judged.drop("_pair"), (F.col("_digest") == F.col("_judged")) & F.col("_id").eqNullSafe(F.col("_judged_id")), "left")
    one_each = met.filter(~F.col("_goes")).dropDuplicates(["_digest", "_id"])
    parts = [x.select("_row.*") for x in (once, met.filter(F.col("_goes").isNull()), one_each)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

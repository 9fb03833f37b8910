"""Substring dedup by sliding sentence spans.

Every run of RUN consecutive sentences of every document, however short, is hashed (128 bits of
its lower-cased words); all runs meet by hash over the whole corpus, and the sentences under any
run that is not the first of its kind (by document id, then place) are removed; the rest of a
text stays as it was. Longer repeats need no runs of their own: each of their runs of RUN
sentences repeats too, and together those cover it. What goes at a place is always such a
covered stretch as a whole, and it must have LEAST_WORDS words, or it is a stock phrase and stays.

A sentence ends at . ! ? before white space, or at a line break. One of more than LONG_WORDS
words is cut further, so that prose without marks cannot hide a passage: before each word whose
pair with the word before it has a lesser hash than the NEAR pairs on either side in the
sentence. Equal words are so cut alike wherever they stand, but for the first and last few.
Three sentences of LONG_WORDS words, less one, hold two whole ones at least, so a repeated
passage of over 50 words holds a whole run however it is cut out of its own sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import attach, give_back, packed, stage, tune, unstage

RUN, LEAST_WORDS, LONG_WORDS, NEAR = 2, 12, 17, 3
_END = re.compile(r"(?<=[.!?])\s+|\n\s*")
_WORD = re.compile(r"\S+")


class Cut:
    """A text in sentences: word i starts at starts[i]; sentence k has words bounds[k] up to bounds[k + 1]."""

    def __init__(self, text: str):
        self.text, self.words = text, [w.encode() for w in text.lower().split()]
        n = len(self.words)
        self.starts = np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64, n)
        opens = np.zeros(n + 1, bool)
        opens[np.searchsorted(self.starts, np.fromiter((m.end() for m in _END.finditer(text)), np.int64))] = True
        opens[[0, n]] = True
        if n > LONG_WORDS:
            opens[:n] |= self._chosen(opens[:n])
        self.bounds = np.nonzero(opens)[0].tolist()

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def _chosen(self, opens: np.ndarray) -> np.ndarray:
        """Words of long sentences that are cut before, too."""
        own = np.cumsum(opens)
        long = np.bincount(own)[own] > LONG_WORDS
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(opens))
        pair = (np.roll(h, 1) * np.uint64(0x9E3779B97F4A7C15)) ^ h
        pair *= np.uint64(0xBF58476D1CE4E5B9)
        pair ^= pair >> np.uint64(31)
        least = long & ~opens
        pair[opens] = np.iinfo(np.uint64).max
        for d in range(1, NEAR + 1):  # only words of the same sentence are compared
            apart, less = own[d:] != own[:-d], pair[:-d] < pair[d:]
            least[:-d] &= apart | less
            least[d:] &= apart | ~less
        return least

    def pieces(self) -> list[str]:
        """The sentences as they stand, with the white space after them; together they are the text."""
        at = [0, *self.starts[self.bounds[1:-1]].tolist(), len(self.text)]
        return [self.text[a:b] for a, b in zip(at, at[1:])]


def runs(text: str, run: int = RUN) -> list[bytes]:
    """128-bit hashes of the runs that start at each sentence, in order."""
    cut, h = Cut(text), xxhash.xxh3_128_digest
    joined = [b" ".join(cut.words[i:j]) for i, j in zip(cut.bounds, cut.bounds[1:])]
    return [h(b"\n".join(joined[i : i + run])) for i in range(len(joined) - run + 1)]


def _emit(run: int):
    """Each row's runs; `later` ones repeat an earlier run of the same text."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, at, starts, later = [], [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                own = runs(t, run)
                seen = set()
                hs += own
                at += [k] * len(own)
                starts += range(len(own))
                if len(set(own)) == len(own):
                    later += [False] * len(own)
                else:
                    for h in own:
                        later.append(h in seen)
                        seen.add(h)
            halves = np.frombuffer(b"".join(hs), "<i8").reshape(-1, 2)
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), b.column(1).take(pick), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(starts, pa.int32()), pa.array(later, pa.bool_())],
                ["id", "t", "h", "l", "i", "later"],
            )
        give_back()

    return body


def cleaned(text: str, starts: list[int] | None, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[str, int, int]:
    """text without the sentences under the runs from `starts`, its number of sentences, and of those removed."""
    cut = Cut(text)
    if not starts:
        return text, len(cut), 0
    gone = sorted({k for i in starts for k in range(i, i + run)})
    stretches, first = [], gone[0]
    for k, after in zip(gone, [*gone[1:], None]):
        if after != k + 1:
            stretches.append((first, k + 1))
            first = after
    gone = {k for i, j in stretches if cut.bounds[j] - cut.bounds[i] >= least_words for k in range(i, j)}
    return "".join(p for k, p in enumerate(cut.pieces()) if k not in gone), len(cut), len(gone)


def _clean_udf(run: int, least_words: int):
    @F.arrow_udf("text string, n_sentences bigint, n_removed bigint")
    def clean(text: pa.Array, drop: pa.Array) -> pa.Array:
        out = [cleaned(t, starts, run, least_words) for t, starts in zip(text.to_pylist(), drop.to_pylist())]
        names = ["text", "n_sentences", "n_removed"]
        return pa.array([dict(zip(names, x)) for x in out], pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())]))

    return clean


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, run: int = RUN, least_words: int = LEAST_WORDS, max_filter_bytes: int = bloom.FILTER_BYTES) -> DataFrame:
    """One row per input row: id_col, n_sentences, n_removed, text (what stays).

    Of equal runs the one of the smallest id (null ids first), then text hash, then place stays.
    Rows that repeat both id and text are one document: they are treated alike. A text of fewer
    than `run` sentences has no run and stays as it is. Null text counts as empty and gives an
    empty text; an empty table gives no rows; other columns are ignored.

    Runs are counted by hash first; only repeated ones look for their first place, and only
    texts that lose something (and few others, by a Bloom filter of at most max_filter_bytes)
    shuffle at the end.
    """
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    found = stage(rows.mapInArrow(_emit(run), f"id {kind}, t bigint, h bigint, l bigint, i int, later boolean"), "runs")
    firsts = found.filter("not later").drop("later")
    # n rows of which the last in order of id is `most`: a run of one document only has one of each.
    groups = firsts.groupBy("h", "l").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.count("id").alias("ids"))
    groups = groups.filter("n > 1").select("h", "l", "n", F.when(F.col("n") == F.col("ids"), F.col("least")).alias("least"))
    hits = stage(attach(firsts, stage(groups, "repeated"), ["h", "l"], "n", firsts.count(), how="inner"), "hits")
    own = F.col("id").eqNullSafe(F.col("least"))
    tied = hits.filter(own).groupBy("h", "l").agg(F.min("t").alias("top"), F.max("t").alias("last")).filter("top < last").select(F.col("h").alias("th"), F.col("l").alias("tl"), "top")
    after = hits.filter(own).join(tied, (F.col("h") == F.col("th")) & (F.col("l") == F.col("tl"))).filter("t > top")
    place = ["id", "t", "i"]
    again = hits.filter(~own).select(place).unionByName(after.select(place)).unionByName(found.filter("later").select(place))
    drop = again.groupBy("id", "t").agg(F.collect_set("i").alias("drop")).select(F.col("id").alias("_lost_id"), F.col("t").alias("_lost_t"), "drop")
    drop = stage(drop, "lost")
    unstage(found, hits)

    key = F.xxhash64("_lost_id", "_lost_t").alias("key")
    whole, some = bloom.split(rows, F.xxhash64("id", "t"), drop.select(key), drop.count(), max_filter_bytes)
    met = some.join(drop, F.col("id").eqNullSafe(F.col("_lost_id")) & (F.col("t") == F.col("_lost_t")), "left")
    clean = _clean_udf(run, least_words)
    none = F.lit(None).cast("array<int>")
    out = whole.select("id", clean(F.col("text"), none).alias("x")).unionByName(met.select("id", clean(F.col("text"), F.col("drop")).alias("x")))
    return out.select(F.col("id").alias(id_col), "x.n_sentences", "x.n_removed", "x.text")

"""Cross-entropy difference: how much better a target model predicts a text than the corpus.

Two interpolated bigram models of the same order, smoothing and vocabulary (every word of the
corpus): the background is counted over all documents, the target over all those marked as such.

    p(w)     = (count(w) + BETA) / (tokens + BETA * vocabulary)
    p(w | v) = (count(v, w) + ALPHA * p(w)) / (count(v) + ALPHA)

A document starts from a start mark. A token's loss is -ln p(w | v); a document's score is the
mean over its tokens of target loss less background loss, so lower is closer to the target.

Counts are over whole texts, and approximate in one way. They meet by hash parts of the
vocabulary: within a part, n-grams are told apart by KEY_BITS bits, so about two n-grams in a
million share one count (with parts of some million n-grams, at any size of the corpus). A
document of 1,000 tokens has such a token with a chance of 0.2 %; its loss is then off by what
the other n-gram's count adds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import count
from math import prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .blocks import Protocol, exchange, fans_for, ids_from_bytes, ids_to_bytes, narrow, pack, unpack
from .common import parts_for, stage, tune

ALPHA, BETA = 10.0, 1.0
KEY_BITS = 40
PART_BYTES = 16 << 20
_START = 0  # slot of the start mark in every block


class _Block:
    """Tokens of a block's documents and its distinct words and bigrams, in order of part and key."""

    def __init__(self, texts: list[bytes], n_parts: int):
        slots: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        seqs = [np.fromiter(map(slots.__getitem__, t.lower().split()), np.int64) for t in texts]
        self.lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
        self.tokens = np.concatenate(seqs)
        first = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate([[_START], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        before[first[self.lengths > 0]] = _START
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in slots), np.uint64, len(slots))
        h = np.concatenate([np.array([0x9E3779B97F4A7C15], np.uint64), h])
        size = len(h)
        pairs, self.pair_of = np.unique(before * size + self.tokens, return_inverse=True)
        a, b = pairs // size, pairs % size
        mixed = (h[a] ^ (h[a] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[b]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.word_place, self.word_part, self.word_key = self._order(h[1:], n_parts)
        self.pair_place, self.pair_part, self.pair_key = self._order(mixed ^ (mixed >> np.uint64(32)), n_parts)
        self.first_word, self.second_word = a, b

    @staticmethod
    def _order(h: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each item stands by (part, key), and parts and keys in that order."""
        part, key = (h % np.uint64(n_parts)).astype(np.int64), h >> np.uint64(64 - KEY_BITS)
        order = np.lexsort((key, part))
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        return place, part[order], key[order]


def _bounds(part: np.ndarray, n_parts: int) -> np.ndarray:
    return np.searchsorted(part, np.arange(n_parts + 1))


def _deltas(keys: np.ndarray) -> np.ndarray:
    return narrow(np.diff(keys, prepend=np.uint64(0)))


def _leaf_keys(leaf: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys that ascend with (leaf, key), for leaves numbered within a part."""
    return (leaf.astype(np.uint64) << np.uint64(KEY_BITS)) | key


def _make(n_leaves: int, n_parts: int):
    stride = n_leaves // n_parts

    def make(ids: pa.Array, texts: list[bytes]) -> tuple[bytes, list[bytes | None]]:
        b = _Block(texts, n_leaves)
        in_target = ids.field("target").to_numpy(zero_copy_only=False).astype(bool)
        of_target = np.repeat(in_target, b.lengths)
        word, pair = b.word_place[b.tokens - 1], b.pair_place[b.pair_of]
        counts = [(np.bincount(x, minlength=n), np.bincount(x[of_target], minlength=n)) for x, n in ((word, len(b.word_place)), (pair, len(b.pair_place)))]
        some = b.lengths > 0
        starts = np.array([some.sum(), (some & in_target).sum()], "<i8")
        keys = [_leaf_keys(leaf % stride, key) for leaf, key in ((b.word_part, b.word_key), (b.pair_part, b.pair_key))]
        bounds = [_bounds(leaf // stride, n_parts) for leaf in (b.word_part, b.pair_part)]
        # The texts themselves are smaller than their token numbers; they are split again later.
        return pack(ids_to_bytes(ids.field("id")), np.fromiter(map(len, texts), "<i8", len(texts)), b"".join(texts)), _asks(starts, keys, counts, bounds)

    return make


def _asks(starts: np.ndarray, keys: list[np.ndarray], counts: list, bounds: list[np.ndarray]) -> list[bytes | None]:
    """Each part's starts (the first part has them all), word and bigram keys and counts, or None."""
    asks: list[bytes | None] = []
    for p in range(len(bounds[0]) - 1):
        cuts = [slice(x[p], x[p + 1]) for x in bounds]
        if all(c.start == c.stop for c in cuts) and not (p == 0 and starts.any()):
            asks.append(None)
            continue
        asks.append(pack(starts if not p else starts * 0, *(_deltas(k[c]) for k, c in zip(keys, cuts)), *(narrow(n[c]) for c, s in zip(cuts, counts) for n in s)))
    return asks


def _merged(raw: list[list], k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys of asks, words (k = 0) or bigrams (1), their two totals, and where each ask's are."""
    keys = [np.cumsum(r[1 + k].astype(np.uint64), dtype=np.uint64) for r in raw]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = [np.bincount(at, np.concatenate([r[3 + 2 * k + m] for r in raw]).astype(np.float64), len(distinct)).astype(np.int64) for m in (0, 1)]
    return distinct, totals, np.split(at, np.cumsum([len(x) for x in keys])[:-1])


def _split(asks: list[bytes], stride: int, fan: int) -> tuple[bytes, list[bytes | None]]:
    raw = [unpack(a) for a in asks]
    keys, counts, bounds, places = [], [], [], []
    for k in (0, 1):
        distinct, totals, at = _merged(raw, k)
        leaf = (distinct >> np.uint64(KEY_BITS)).astype(np.int64)
        keys.append(_leaf_keys(leaf % stride, distinct & np.uint64((1 << KEY_BITS) - 1)))
        bounds.append(_bounds(leaf // stride, fan))
        counts.append(totals)
        places += [np.fromiter(map(len, at), "<u4", len(at)), narrow(np.concatenate(at))]
    return pack(*places), _asks(sum(r[0] for r in raw), keys, counts, bounds)


def _join(own: bytes, replies: dict[int, bytes]) -> list[bytes]:
    got = [unpack(replies[c]) for c in sorted(replies)]
    raw, out = unpack(own), []
    for k in (0, 1):
        totals = [np.concatenate([r[2 * k + m] for r in got]) for m in (0, 1)]
        out.append([[narrow(t[at]) for t in totals] for at in np.split(raw[2 * k + 1], np.cumsum(raw[2 * k])[:-1])])
    return [pack(*w, *p) for w, p in zip(*out)]


def _answer(asks: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Replies, and of this leaf: vocabulary, background and target tokens, background and target
    documents with tokens."""
    raw = [unpack(a) for a in asks]
    replies: list[list] = [[] for _ in asks]
    said = []
    for k in (0, 1):
        distinct, totals, places = _merged(raw, k)
        for reply, at in zip(replies, places):
            reply += [narrow(t[at]) for t in totals]
        if k == 0:
            said = [len(distinct), *(int(t.sum()) for t in totals)]
    return [pack(*r) for r in replies], [*said, *(int(x) for x in sum(r[0] for r in raw))]


def _fill(n_parts: int):
    def fill(own: bytes, made: list[int], replies: dict[int, bytes]) -> pa.Table:
        raw_ids, sizes, text = unpack(own)
        ends = np.cumsum(sizes)
        b = _Block([text[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())], n_parts)
        got = [unpack(replies[p]) for p in sorted(replies)]
        vocabulary, *totals = made or [0] * 5
        losses = []
        for m in (0, 1):
            word = np.concatenate([r[m] for r in got]).astype(np.float64) if got else np.zeros(0)
            pair = np.concatenate([r[2 + m] for r in got]).astype(np.float64) if got else np.zeros(0)
            word = np.concatenate([[totals[2 + m]], word[b.word_place]])  # the start mark's count first
            p_word = (word + BETA) / (totals[m] + BETA * vocabulary)
            p = (pair[b.pair_place] + ALPHA * p_word[b.second_word]) / (word[b.first_word] + ALPHA)
            losses.append(-np.log(p)[b.pair_of])
        sums = [np.diff(np.concatenate([[0.0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(b.lengths)])]) for x in losses]
        n = b.lengths
        with np.errstate(invalid="ignore", divide="ignore"):
            background, target = (pa.array(x / n, mask=n == 0) for x in sums)
            score = pa.array((sums[1] - sums[0]) / n, mask=n == 0)
        return pa.table({"id": ids_from_bytes(raw_ids), "n_tokens": pa.array(n), "target_loss": target, "background_loss": background, "score": score})

    return fill


def _surely_other(may_be_target: Callable):
    def keep(ids: pa.StructArray) -> np.ndarray:
        h = ids.field("h")
        return np.asarray(h.is_null()) | ~may_be_target(np.asarray(h.fill_null(0)))

    return keep


def score(docs: DataFrame, targets: DataFrame | Iterable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens, target_loss, background_loss, score.

    Tokens are white-space separated, A-Z lower-cased. targets (a table whose first column has
    ids, of any size, or a few ids) names the documents of the target model; every row of such
    an id counts, a null id is none. Null texts count as empty; losses and score of a text
    without tokens are null. Repeated rows each count and each get a row; an empty table gives
    none; other columns are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fans = fans_for(parts_for(docs, PART_BYTES))
    kind = rows.schema["id"].dataType.simpleString()
    if not isinstance(targets, DataFrame):
        targets = docs.sparkSession.createDataFrame([(i,) for i in targets], f"target {kind}")
    named = targets.select(F.col(targets.columns[0]).alias("_target")).distinct()
    named = stage(named.filter(F.col("_target").isNotNull()), "targets")
    # Only rows that may be targets meet the ids in a join, staged first; the other texts stay
    # where they are, and the worker that makes blocks tells them, by a hash that the staged rows
    # lack. So no task has two Python workers.
    held = bloom.members(named.select(F.xxhash64("_target")), named.count())
    some = stage(rows.filter(held.maybe(F.xxhash64("id"))).join(named, F.col("id") == F.col("_target"), "left"), "may-be-targets")
    flagged = lambda df, is_target, h: df.select(F.struct("id", is_target.alias("target"), h.alias("h")).alias("id"), "text")
    marked = flagged(rows, F.lit(False), F.xxhash64("id")).unionByName(flagged(some, F.col("_target").isNotNull(), F.lit(None).cast("long")))
    schema = f"id {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    says = Protocol(_make(prod(fans), fans[0]), _split, _join, _answer, _fill(prod(fans)))
    out = exchange(marked, fans, says, schema, "lm", totals=True, keep=_surely_other(held.probe()))
    return out.withColumnRenamed("id", id_col)


def quality_targets(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled of quality."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()

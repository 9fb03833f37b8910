"""Calls matched in Arrow workers, a batch at a time: what matching.settled says of one call.

The columns there are interpreted by Spark, some 70 microseconds a call of ten golds. Here a batch
of calls is cleaned, paired within call and group, ordered and gone through as arrays; whether one
text holds another is asked pair by pair, where their adjacent bytes do not rule it out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..session import ship
from .textwise import BATCH_BYTES

# The runs that matching.cleaned turns into one space; in ASCII texts the classes of ASCII say the same, faster.
_BREAKS = r"[\t-\r .,!?;:\-]+"
_EVERY_BREAK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000.,!?;:\-]+")
# Letters of Unicode 16, which Spark knows and Python may not.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {x: x + 32 for x in range(0x10D50, 0x10D66)}
_UPPER = {low: up for up, low in _LOWER.items()}
_GROUPS = {x[1]: x[4] for x in X.LABELS} | {name: group for group, names in X.GROUP_SYNONYMS.items() for name in names}
#: Stands for a null number; numbers have 32 bits.
_NONE = -(1 << 40)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Pairs of one call and group that are looked at together; of these only matches are kept.
PAIRS_AT_ONCE = 1 << 20
#: Rounds of the greedy pass that look at a whole batch.
ROUNDS = 8


def cleaned(texts: pa.Array) -> pa.Array:
    """As matching.cleaned; bytes that are no UTF-8 become the replacement character, as there."""
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return pc.ascii_lower(pc.utf8_trim(pc.replace_substring_regex(texts, _BREAKS, " "), " "))
    whole = (None if t is None else t.decode("utf-8", "replace") for t in pc.cast(texts, pa.binary()).to_pylist())
    return pa.array([None if t is None else _EVERY_BREAK.sub(" ", t).strip(" ").translate(_LOWER).lower() for t in whole], pa.string())


def match_group(label: str) -> str:
    up = label.translate(_UPPER).upper()
    return _GROUPS.get(up, up)


@dataclass
class Side:
    """Items of a batch of calls, flat: call, number (null: _NONE), place of the text and of the
    label among the batch's (null: -1), and a key that items of one call and number share."""

    call: np.ndarray
    n: np.ndarray
    text: np.ndarray
    label: np.ndarray
    key: np.ndarray

    def left(self, kept: np.ndarray) -> np.ndarray:
        """Places of items whose number no kept item of their call has; a null number is never taken."""
        taken = np.zeros(len(self.n), bool)
        taken[self.key[kept]] = True
        return np.flatnonzero(~taken[self.key] | (self.n == _NONE))


@dataclass
class Texts:
    """Distinct cleaned texts: their bytes one after another, where each begins and ends, its
    characters, and its adjacent bytes as bits of a hash: what a text holds has no bits that it
    has not."""

    data: bytes
    first: np.ndarray
    end: np.ndarray
    chars: np.ndarray
    bits: np.ndarray


@dataclass
class Settled:
    """Of a batch: both sides, the distinct labels, and possible pairs by their items' places, best
    first within a call, with minus the quality and whether they are kept."""

    preds: Side
    golds: Side
    labels: pa.Array
    k: np.ndarray
    pi: np.ndarray
    gi: np.ndarray
    kept: np.ndarray

    def fp(self) -> np.ndarray:
        return self.preds.left(self.pi[self.kept])

    def fn(self) -> np.ndarray:
        return self.golds.left(self.gi[self.kept])


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones (null: -1), and those."""
    e = pc.dictionary_encode(values)
    return np.asarray(pc.fill_null(pc.cast(e.indices, pa.int64()), -1)), e.dictionary


def _texts(values: pa.Array) -> tuple[np.ndarray, Texts]:
    """Each is cleaned once, however often it is there."""
    raw, distinct = _encoded(values)
    own, texts = _encoded(cleaned(distinct))
    size = np.asarray(pc.binary_length(texts), np.int64)
    end = np.cumsum(size)
    data = b"".join(pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], pc.cast(texts, pa.binary())), b"").to_pylist())
    at, bits = np.frombuffer(data, np.uint8), np.zeros(len(texts), np.uint64)
    if len(at) > 1:
        pair = np.append(_BIT[(at[:-1] * np.uint8(31) + at[1:] * np.uint8(101)) >> np.uint8(2)], np.uint64(0))
        pair[end[size > 0] - 1] = 0  # the last byte of a text and the first of the next
        bits[size > 0] = np.bitwise_or.reduceat(pair, (end - size)[size > 0])
    return np.append(own, -1)[raw], Texts(data, end - size, end, np.asarray(pc.utf8_length(texts), np.int64), bits)


def _sides(pred_lists: pa.Array, gold_lists: pa.Array) -> tuple[Side, Side, Texts, pa.Array]:
    lists = (pred_lists, gold_lists)
    items = [x.flatten() for x in lists]
    field = lambda name: pa.concat_arrays([pc.struct_field(x, name) for x in items])
    text, texts = _texts(field("text"))
    label, labels = _encoded(field("label"))
    at, out = 0, []
    for x, own, n in zip(lists, items, ("i", "j")):
        call = np.repeat(np.arange(len(x)), np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64))
        number = np.asarray(pc.fill_null(pc.cast(pc.struct_field(own, n), pa.int64()), _NONE))
        key, end = (call << 33) + number, at + len(own)
        if (number == _NONE).any() or (key[1:] <= key[:-1]).any():
            key = np.unique(np.where(number == _NONE, -1 - np.arange(len(own)) - (1 << 62), key), return_inverse=True)[1]
        else:
            key = np.arange(len(own))
        out.append(Side(call, number, text[at:end], label[at:end], key))
        at = end
    return out[0], out[1], texts, labels


def _pairs(preds: Side, golds: Side, texts: Texts, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of items of one call and group where one text, not empty, holds the other."""
    chars = np.append(texts.chars, 0)
    key = lambda side: side.call * (len(groups) + 1) + groups[side.label]
    p, g = (np.flatnonzero((side.label >= 0) & (chars[side.text] > 0)) for side in (preds, golds))
    g = g[np.argsort(key(golds)[g], kind="stable")]
    first, end = (np.searchsorted(key(golds)[g], key(preds)[p], side) for side in ("left", "right"))
    ends, out, a = np.cumsum(end - first), [(np.zeros(0, np.int64),) * 2], 0
    while a < len(p):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        n = (end - first)[a:b]
        pi = np.repeat(p[a:b], n)
        gi = g[np.arange(len(pi)) + np.repeat(first[a:b] - (ends[a:b] - n - done), n)]
        x, y = preds.text[pi], golds.text[gi]
        swap = chars[x] > chars[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        near = x == y
        ask = np.flatnonzero(~near & (chars[x] < chars[y]) & (texts.bits[x] & ~texts.bits[y] == 0))
        spots = (c[t[ask]].tolist() for t in (x, y) for c in (texts.first, texts.end))
        near[ask] = [texts.data.find(texts.data[s:e], f, t) >= 0 for s, e, f, t in zip(*spots)]
        out.append((pi[near], gi[near]))
        a = b
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _greedy(i: np.ndarray, j: np.ndarray, free_i: np.ndarray, free_j: np.ndarray) -> np.ndarray:
    """Which pairs (keys of either side, best first) stay; a free key is never taken.

    A pair that is the first of those left on both sides stays, whatever else does: a few rounds
    of that settle most batches, and the rest is gone through one by one.
    """
    kept, left = np.zeros(len(i), bool), np.arange(len(i))
    taken = [np.zeros(x.max() + 1 if len(x) else 0, bool) for x in (i, j)]
    for _ in range(ROUNDS):
        if not len(left):
            return kept
        stays = np.ones(len(left), bool)
        for key, free, held in ((i, free_i, taken[0]), (j, free_j, taken[1])):
            first = np.empty(len(held), np.int64)
            first[key[left[::-1]]] = left[::-1]
            stays &= free[left] | (first[key[left]] == left)
        kept[left[stays]] = True
        taken[0][i[left[stays]]] = True
        taken[1][j[left[stays]]] = True
        open_i, open_j = ~taken[0][i[left]] | free_i[left], ~taken[1][j[left]] | free_j[left]
        left = left[~stays & open_i & open_j]
    ti, tj = set(), set()
    for at, x, y, fx, fy in zip(left.tolist(), i[left].tolist(), j[left].tolist(), free_i[left].tolist(), free_j[left].tolist()):
        if (fx or x not in ti) and (fy or y not in tj):
            kept[at] = True
            ti.add(x)
            tj.add(y)
    return kept


def settle(pred_lists: pa.Array, gold_lists: pa.Array) -> Settled:
    """Predictions (i, text, label) and gold (j, text, label) of a batch of calls."""
    preds, golds, texts, labels = _sides(pred_lists, gold_lists)
    names, own = pc.cast(labels, pa.binary()).to_pylist(), {}
    groups = np.array([*(own.setdefault(match_group(x.decode("utf-8", "replace")), len(own)) for x in names), -1], np.int64)
    rank = np.zeros(len(names) + 1, np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    pi, gi = _pairs(preds, golds, texts, groups)
    n, m = texts.chars[preds.text[pi]], texts.chars[golds.text[gi]]
    k = np.where(n == m, -2.0, -(np.minimum(n, m) / np.maximum(n, m)))
    order = np.lexsort((rank[golds.label[gi]], rank[preds.label[pi]], golds.n[gi], preds.n[pi], k, preds.call[pi]))
    pi, gi, k = pi[order], gi[order], k[order]
    kept = _greedy(preds.key[pi], golds.key[gi], preds.n[pi] == _NONE, golds.n[gi] == _NONE)
    return Settled(preds, golds, labels, k, pi, gi, kept)


def counted(s: Settled) -> pa.RecordBatch:
    """label, tp, fp, fn of a batch: hits and misses by gold label, false alarms by predicted label."""
    count = lambda label: np.bincount(label + 1, minlength=len(s.labels) + 1)
    counts = [count(s.golds.label[s.gi[s.kept]]), count(s.preds.label[s.fp()]), count(s.golds.label[s.fn()])]
    there = np.flatnonzero(np.sum(counts, axis=0))
    label = s.labels.take(pa.array(there - 1, mask=there == 0))
    return pa.RecordBatch.from_arrays([label, *(pa.array(c[there], pa.int64()) for c in counts)], ["label", "tp", "fp", "fn"])


def _listed(size: int, call: np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
    ends = np.cumsum(np.bincount(call, minlength=size)) if size else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def told(s: Settled, size: int) -> pa.Array:
    """The out of matching.outcomes, of a batch of so many calls."""
    number = lambda x: pa.array(np.where(x == _NONE, 0, x).astype(np.int32), mask=x == _NONE)
    label = lambda x: s.labels.take(pa.array(x, mask=x < 0))
    out = {}
    for name, at in (("pairs", slice(None)), ("hits", s.kept)):
        pi, gi = s.pi[at], s.gi[at]
        columns = {"k": pa.array(s.k[at]), "i": number(s.preds.n[pi]), "j": number(s.golds.n[gi]), "pred_label": label(s.preds.label[pi]), "gold_label": label(s.golds.label[gi])}
        out[name] = _listed(size, s.preds.call[pi], columns)
    for name, n, side, at in (("fp", "i", s.preds, s.fp()), ("fn", "j", s.golds, s.fn())):
        out[name] = _listed(size, side.call[at], {n: number(side.n[at]), "label": label(side.label[at])})
    return pa.StructArray.from_arrays(list(out.values()), names=list(out))


# Columns and tables


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def settled_column(spark: SparkSession, preds: Column, golds: Column) -> Column:
    """The out of matching.outcomes, from both sides of a call; not deterministic to Spark, so that
    nothing above it copies it."""
    _ready(spark)
    pair = "struct<k:double,i:int,j:int,pred_label:string,gold_label:string>"

    @F.arrow_udf(f"struct<pairs:array<{pair}>,hits:array<{pair}>,fp:array<struct<i:int,label:string>>,fn:array<struct<j:int,label:string>>>")
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        from veilspan.operators import matchwise  # the worker's own module, not a copy sent along

        return matchwise.told(matchwise.settle(p, g), len(p))

    return run.asNondeterministic()(preds, golds)


def counts(calls: DataFrame, preds: Column, golds: Column) -> DataFrame:
    """label, tp, fp, fn of each batch of calls."""
    _ready(calls.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veilspan.operators import matchwise

        for b in batches:
            yield matchwise.counted(matchwise.settle(b.column(0), b.column(1)))

    return calls.select(preds.alias("p"), golds.alias("g")).mapInArrow(run, "label string, tp long, fp long, fn long")

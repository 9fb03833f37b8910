"""Language identification by mixtures: each document is a blend of per-language n-gram models.

Character trigrams (letters lower-cased, everything else one gap) are hashed into BUCKETS;
a language's model is its smoothed bucket distribution. Expectation-maximisation finds the
proportions that make a document's trigrams most likely; languages are then taken in order of
proportion as long as the likelihood gained exceeds a penalty that grows with log length.

The models are fitted on a bounded sample: about `train_docs` documents for each language,
chosen by a hash of the id. Every document is scored over its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, tune

BUCKETS = 1 << 15
UNKNOWN = "und"
_CHUNK = 1 << 18
_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the text's letter trigrams, words padded by gaps."""
    total: np.ndarray | None = None
    end = 0
    while end < len(text):  # a chunk ends between words, so no trigram spans two
        start, end = end, end + _CHUNK
        while end < len(text) and text[end - 1] not in " \t\n\r":
            end += 1
        c = np.frombuffer(text[start:end].lower().encode("utf-32-le", "replace"), "<u4")
        c = np.where(_LETTER[np.minimum(c, 0x2FFF)] | (c >= 0x3000), c, 0)
        c = np.concatenate([[0], c, [0]]).astype(np.uint64)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        if len(c) < 3:
            continue
        a, b, d = c[:-2], c[1:-1], c[2:]
        keep = b != 0
        h = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA6B) + d * np.uint64(0xC2B2AE35)) & np.uint64(0xFFFFFFFF)
        h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)
        n = np.bincount((h[keep] >> np.uint64(17)).astype(np.int64), minlength=BUCKETS)
        total = n if total is None else total + n
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.nonzero(total)[0]
    return at, total[at]


@dataclass
class Model:
    langs: list[str]
    #: likelihood of each bucket under each language
    table: np.ndarray
    penalty: float = 3.0
    rounds: int = 12


def fit(counts: dict[str, np.ndarray], smoothing: float = 0.5) -> Model:
    langs = sorted(counts)
    table = np.stack([counts[k] + smoothing for k in langs]) if langs else np.zeros((0, BUCKETS))
    return Model(langs, table / table.sum(axis=1, keepdims=True))


def _em(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the rows of p and the log likelihood of counts n under them."""
    total, theta = n.sum(), np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        new = theta * (p @ (n / (theta @ p))) / total
        done = np.abs(new - theta).max() < 1e-4
        theta = new
        if done:
            break
    return theta, float(n @ np.log(theta @ p))


def mixture(model: Model, text: str | None) -> list[tuple[str, float]]:
    """(language, proportion), largest first; empty if the text is null or has no letter."""
    if not text or not model.langs or not any(map(str.isalpha, text)):
        return []
    at, n = gram_counts(text)
    if not len(at):
        return []
    p = model.table[:, at]
    theta, _ = _em(p, n, model.rounds)
    order = np.argsort(-theta, kind="stable")
    best, cost = None, model.penalty * np.log(n.sum() + 1.0)
    for k in range(1, len(order) + 1):
        some, ll = _em(p[order[:k]], n, model.rounds) if k > 1 else (np.ones(1), float(n @ np.log(p[order[0]])))
        if best is not None and ll - best[1] <= cost:
            break
        best = (some, ll, order[:k])
    shares = sorted(zip(best[0], (model.langs[i] for i in best[2])), key=lambda x: (-x[0], x[1]))
    return [(lang, float(s)) for s, lang in shares]


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves no remainder by 5; null ids are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 2000) -> Model:
    """Fit on about train_docs documents of each non-null language among those not held out."""
    tune(docs.sparkSession)
    own = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in own.groupBy(lang_col).count().collect()}  # one row per language
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, int(min(1.0, train_docs / n) * 1_000_000)).otherwise(share)
    sample = own.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = gram_counts(text)
                np.add.at(sums.setdefault(lang, np.zeros(BUCKETS, np.int64)), at, n)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["lang", "n"])

    def merge(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in t.column("n").to_pylist())
        return pa.table({"lang": t.column("lang").slice(0, 1), "n": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = sample.select(lang_col, text_col).mapInArrow(count, "lang string, n binary").groupBy("lang").applyInArrow(merge, "lang string, n binary")
    return fit({r["lang"]: np.frombuffer(zlib.decompress(r["n"]), np.int64) for r in rows.collect()})


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and mixture (array of language and share).

    lang_pred is the language of the largest share and score that share; text that is null or
    has no letter gives `und`, 0 and an empty mixture. Columns of those names are replaced.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    @F.arrow_udf("lang_pred string, score double, mixture array<struct<lang string, share double>>")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            mix = mixture(shared.value, t)
            top, score = mix[0] if mix else (UNKNOWN, 0.0)
            out.append({"lang_pred": top, "score": min(1.0, max(0.0, score)), "mixture": [{"lang": a, "share": b} for a, b in mix]})
        give_back()
        return pa.array(out, kind)

    new = ("lang_pred", "score", "mixture")
    rows = docs.drop(*new).withColumn("_mix", run(F.col(text_col)))
    return rows.select("*", *(F.col("_mix")[c].alias(c) for c in new)).drop("_mix")

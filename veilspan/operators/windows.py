"""Overlapping text windows, detection in each, and one set of spans for the document."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import around, clean_marks, cut, found, let, overlaps, spans_of, standalone, strip
from ..session import ship
from .normalize import normalized, to_original
from .predicates import address_words, context_ok, least_confidence, phone_ok, postal_context_ok, propagates, slice_of_number, valid

SPAN = "struct<s:int,e:int,label:string,conf:double>"
SPANS = f"array<{SPAN}>"

#: A detector as a column: (chunk, offset of the chunk, its end) to an array of SPAN in the chunk.
ColumnDetector = Callable[[Column, Column, Column], Column]


def span(s: Column, e: Column, label: Column, conf: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), label.alias("label"), conf.cast("double").alias("conf"))


def windows(text: Column, size: int = X.WINDOW_CHARS, overlap: int = X.WINDOW_OVERLAP) -> Column:
    """array<struct<off,end,n>>: one window if the text fits, else every size - overlap
    characters until one reaches the end."""
    n, step = F.length(text), max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("off"), F.least(i * step + size, n).alias("end"), n.alias("n")))


def margin(s: Column, e: Column, window: Column) -> Column:
    """Distance to the nearest edge that cuts the text; document edges are infinitely far."""
    far = F.lit(float("inf"))
    left = F.when(window["off"] == 0, far).otherwise((s - window["off"]).cast("double"))
    right = F.when(window["end"] == window["n"], far).otherwise((window["end"] - e).cast("double"))
    return F.least(left, right)


def _covered(s: Column, e: Column, spans: Column) -> Column:
    return F.exists(spans, lambda k: (k["s"] <= s) & (e <= k["e"]))


def boosted_postal(text: Column, spans: Column) -> Column:
    ok = lambda m: ~_covered(m["s"], m["e"], spans) & ~slice_of_number(text, m["s"], m["e"]) & address_words(around(text, m["s"], m["e"], 80))
    return _boost(F.filter(spans_of(text, X.POSTAL), ok), "SG_POSTAL_CODE")


def boosted_nric(text: Column, spans: Column) -> Column:
    def ok(m: Column) -> Column:
        before = cut(text, F.greatest(F.lit(0), m["s"] - 40), m["s"])
        return ~_covered(m["s"], m["e"], spans) & (found(around(text, m["s"], m["e"], 80), X.NRIC_WORDS, True) | found(before, X.NAME_BEFORE))

    return _boost(F.filter(spans_of(text, X.NRIC_BOOST), ok), "SG_NRIC_FIN")


def boosted_email(text: Column, spans: Column) -> Column:
    hits = spans_of(text, X.EMAIL_BOOST, replacement="$1\u0001$2\u0002")
    ok = lambda m: ~_covered(m["s"], m["e"], spans) & ~found(cut(text, m["s"], m["e"]), X.COMPANY_DOMAIN, True)
    return _boost(F.filter(hits, ok), "EMAIL_ADDRESS")


def _boost(hits: Column, label: str) -> Column:
    return F.transform(hits, lambda m: span(m["s"], m["e"], F.lit(label), F.lit(1.0)))


def filtered(text: Column, spans: Column, threshold: float = X.THRESHOLD) -> Column:
    """Detections of one chunk after thresholds, validity and context, boosters added.

    Context looks at the chunk alone, and at the addresses that passed validity. Boosters look
    at what passed context, and do not suppress one another.
    """

    def first(m: Column) -> Column:
        enough = m["conf"] >= least_confidence(m["label"], threshold)
        return enough & let(strip(cut(text, m["s"], m["e"])), lambda value: (F.length(value) > 0) & valid(value, m["label"]))

    def in_context(m: Column, addresses: Column) -> Column:
        return let(strip(cut(text, m["s"], m["e"])), lambda value: context_ok(value, m["label"], m["s"], m["e"], text, addresses))

    def boosted(kept: Column) -> Column:
        return F.concat(kept, boosted_postal(text, kept), boosted_nric(text, kept), boosted_email(text, kept))

    def with_addresses(sound: Column) -> Column:
        return let(F.filter(sound, lambda m: m["label"] == "SG_ADDRESS"), lambda a: let(F.filter(sound, lambda m: in_context(m, a)), boosted))

    return let(F.filter(spans, first), with_addresses)


def candidates(text: Column, detect: ColumnDetector, threshold: float = X.THRESHOLD, size: int = X.WINDOW_CHARS, overlap: int = X.WINDOW_OVERLAP) -> Column:
    """array<struct<s,e,label,conf,margin>> of all windows, in the document's characters."""

    def one(w: Column) -> Column:
        def lifted(m: Column) -> Column:
            s, e = m["s"] + w["off"], m["e"] + w["off"]
            return F.struct(s.alias("s"), e.alias("e"), m["label"].alias("label"), m["conf"].alias("conf"), margin(s, e, w).alias("margin"))

        return F.transform(let(cut(text, w["off"], w["end"]), lambda chunk: filtered(chunk, detect(chunk, w["off"], w["end"]), threshold)), lifted)

    return F.flatten(F.transform(windows(text, size, overlap), one))


def reconcile(cands: Column) -> Column:
    """Candidates accepted best first: by margin, confidence, length, then place and label.

    One that overlaps an accepted span goes if the label is the same, or if they share half of
    their joint extent; others nest.
    """

    def order(a: Column, b: Column) -> Column:
        keys = [(b["margin"], a["margin"]), (b["conf"], a["conf"]), (b["e"] - b["s"], a["e"] - a["s"]), (a["s"], b["s"]), (a["label"], b["label"])]
        out = F.lit(0)
        for x, y in reversed(keys):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    def step(kept: Column, c: Column) -> Column:
        def clash(k: Column) -> Column:
            shared = F.least(c["e"], k["e"]) - F.greatest(c["s"], k["s"])
            extent = F.greatest(c["e"], k["e"]) - F.least(c["s"], k["s"])
            return (shared > 0) & ((c["label"] == k["label"]) | (shared * 2 >= extent))

        return F.when(F.exists(kept, clash), kept).otherwise(F.array_append(kept, span(c["s"], c["e"], c["label"], c["conf"])))

    return F.aggregate(F.array_sort(cands, order), F.array().cast(SPANS), step)


def propagated(text: Column, accepted: Column) -> Column:
    """New spans for other exact occurrences of accepted values, in order of acceptance.

    Values must be distinctive; an occurrence must not overlap anything taken so far, and
    phones and postal codes pass their gates again. New spans are not propagated themselves.
    """
    def with_addresses(addresses: Column) -> Column:
        return F.aggregate(accepted, F.array().cast(SPANS), lambda new, a: _propagate_one(text, accepted, addresses, new, a))

    return let(F.filter(accepted, lambda a: a["label"] == "SG_ADDRESS"), with_addresses)


def _propagate_one(text: Column, accepted: Column, addresses: Column, new: Column, a: Column) -> Column:
    def spread(value: Column) -> Column:
        hits = F.when((F.length(value) > 0) & propagates(value, a["label"]), spans_of(text, standalone(value))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))

        def add(acc: Column, m: Column) -> Column:
            taken = F.exists(accepted, lambda k: overlaps(m, k)) | F.exists(acc, lambda k: overlaps(m, k))
            gate = F.when(a["label"] == "SG_PHONE_NUMBER", phone_ok(value)).when(a["label"] == "SG_POSTAL_CODE", postal_context_ok(value, m["s"], m["e"], text, addresses)).otherwise(True)
            return F.when(~taken & gate, F.array_append(acc, span(m["s"], m["e"], a["label"], F.lit(1.0)))).otherwise(acc)

        return F.aggregate(hits, new, add)

    return let(strip(cut(text, a["s"], a["e"])), spread)


def chain(text: Column, detect: ColumnDetector, threshold: float = X.THRESHOLD, size: int = X.WINDOW_CHARS, overlap: int = X.WINDOW_OVERLAP) -> Column:
    """array<struct<text,label,s,e,conf>> of a text: spoken digits to digits, windows,
    detection, filters, boosters, reconciliation, propagation, original characters.

    One column, each step bound to a variable: as columns of their own the steps would be
    copied into one another wherever Spark merges projections or pushes a filter down.
    """

    def back(norm: Column, every: Column) -> Column:
        def named(m: Column, o: Column) -> Column:
            return F.struct(strip(cut(text, o["s"], o["e"])).alias("text"), m["label"].alias("label"), o["s"].alias("s"), o["e"].alias("e"), m["conf"].alias("conf"))

        ordered = F.array_sort(F.transform(every, lambda m, i: F.struct(m["s"].alias("s"), m["e"].alias("e"), i.alias("i"), m["label"].alias("label"), m["conf"].alias("conf"))))
        mapped = F.transform(ordered, lambda m: let(to_original(m["s"], m["e"], norm["segments"]), lambda o: named(m, o)))
        return F.filter(mapped, lambda m: F.length(m["text"]) > 0)

    def steps(norm: Column) -> Column:
        found_here = reconcile(candidates(norm["text"], detect, threshold, size, overlap))
        return let(found_here, lambda accepted: back(norm, F.concat(accepted, propagated(norm["text"], accepted))))

    return let(normalized(text), steps)


def document_spans(df: DataFrame, detect: ColumnDetector, text_col: str = "text", out_col: str = "spans", threshold: float = X.THRESHOLD, size: int = X.WINDOW_CHARS, overlap: int = X.WINDOW_OVERLAP) -> DataFrame:
    """df with the chain's spans of its text in out_col; null text counts as empty. The rule
    detector goes text by text in Arrow workers, any other one is a column."""
    if rules := getattr(detect, "rules", None):
        from .textwise import chain_column

        return df.withColumn(out_col, chain_column(df.sparkSession, F.col(text_col), *rules, threshold, size, overlap))
    text = clean_marks(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn(out_col, let(text, lambda t: chain(t, detect, threshold, size, overlap)))


def rules_detector(entities: list[str] | None = None, threshold: float = X.RULE_THRESHOLD) -> ColumnDetector:
    """The rule recognizers as a detector of canonical labels."""
    from .recognizers import ENTITIES, rule_spans
    from .vocab import canon_of_rule

    def detect(chunk: Column, off: Column, end: Column) -> Column:
        return F.transform(rule_spans(chunk, entities or ENTITIES, threshold), lambda m: span(m["s"], m["e"], canon_of_rule(m["label"]), m["score"]))

    detect.rules = (entities or ENTITIES, threshold)
    return detect


def replay_detector(predictions: Column) -> ColumnDetector:
    """Stored predictions, array of SPAN over the normalized text: a window sees those inside it."""

    def detect(chunk: Column, off: Column, end: Column) -> Column:
        inside = F.filter(predictions, lambda m: (m["s"] >= off) & (m["e"] <= end))
        return F.transform(inside, lambda m: span(m["s"] - off, m["e"] - off, m["label"], m["conf"]))

    return detect


class Detector(Protocol):
    """A model: texts to lists of (label, start, end, confidence), loaded on the worker."""

    def extract(self, texts: list[str], labels: list[str], threshold: float) -> list[list[tuple[str, int, int, float]]]: ...


_MODELS: dict[str, Detector] = {}


def loaded(name: str, load: Callable[[], Detector]) -> Detector:
    """The model of that name in this worker process; it is loaded for the first task that asks."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def model_spans(df: DataFrame, load: Callable[[], Detector], labels: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = X.THRESHOLD, size: int = X.WINDOW_CHARS, overlap: int = X.WINDOW_OVERLAP) -> DataFrame:
    """(id, predictions) of a model run over every window in Arrow batches.

    load is called once in each worker process, whatever tasks it runs. Predictions are canonical spans over the normalized
    text, fit for replay_detector; a label the vocabulary does not know is an error.
    """
    ship(df.sparkSession)
    names, name = {x[0]: x[1] for x in X.LABELS}, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veilspan.operators.windows import loaded as shared  # the worker's own module, not a copy sent along

        model = shared(name, load)
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.string()), ("conf", pa.float64())]))
        for b in batches:
            texts, offs = b.column(1).to_pylist(), b.column(2).to_pylist()
            chunks = [t[o["off"] : o["end"]] for t, ws in zip(texts, offs) for o in ws]
            found_spans = iter(model.extract(chunks, labels, threshold))
            rows = [[{"s": o["off"] + s, "e": o["off"] + e, "label": names[k], "conf": c} for o in ws for k, s, e, c in next(found_spans)] for ws in offs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], [id_col, "predictions"])

    norm = normalized(clean_marks(F.coalesce(F.col(text_col), F.lit(""))))["text"]
    rows = df.select(id_col, norm.alias("_t")).withColumn("_w", windows(F.col("_t"), size, overlap))
    return rows.mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, predictions {SPANS}")


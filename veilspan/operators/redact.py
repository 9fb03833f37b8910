"""Spans to text: tagged, blanked, or span lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut, overlaps


def outermost(spans: Column) -> Column:
    """Longest first (ties as they come), without any that overlaps a kept one."""
    numbered = F.transform(spans, lambda m, i: F.struct((m["s"] - m["e"]).alias("k"), i.alias("i"), m.alias("m")))
    empty = F.filter(spans, lambda m: F.lit(False))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(x["m"], k)), kept).otherwise(F.array_append(kept, x["m"]))
    return F.aggregate(F.array_sort(numbered, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)), empty, step)


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with each of its outermost spans replaced by by(span)."""
    ordered = F.array_sort(outermost(spans), lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, m: F.struct(m["e"].alias("at"), F.concat(acc["out"], cut(text, acc["at"], m["s"]), by(m)).alias("out"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], cut(text, acc["at"], F.length(text))))


def tagged(text: Column, spans: Column, with_confidence: bool = False) -> Column:
    """<LABEL> or <LABEL:0.97> in place of each outermost span."""
    if with_confidence:
        return replaced(text, spans, lambda m: F.concat(F.lit("<"), m["label"], F.lit(":"), F.format_string("%.2f", m["conf"]), F.lit(">")))
    return replaced(text, spans, lambda m: F.concat(F.lit("<"), m["label"], F.lit(">")))


def blanked(text: Column, spans: Column, replacements: Mapping[str, str] | None = None, default: str = "") -> Column:
    """A replacement for each label, the default for the rest. Across labels the outermost
    span wins; a library decides that elsewhere, this is our choice."""

    def by(m: Column) -> Column:
        out = F.lit(default)
        for k, v in (replacements or {}).items():
            out = F.when(m["label"] == k, v).otherwise(out)
        return out

    return replaced(text, spans, by)


def redact(df: DataFrame, fmt: str = "tagged", text_col: str = "text", spans_col: str = "spans", out_col: str = "redacted", with_confidence: bool = False) -> DataFrame:
    """df with out_col: `raw` (text, label, s, e, conf rounded to 3), `spans` (text, label
    pairs), `tagged` or `blank` text."""
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.col(spans_col)
    if fmt == "raw":
        out = F.transform(spans, lambda m: F.struct(m["text"].alias("text"), m["label"].alias("label"), m["s"].alias("s"), m["e"].alias("e"), F.bround(m["conf"], 3).alias("conf")))
    elif fmt == "spans":
        out = F.transform(spans, lambda m: F.struct(m["text"].alias("text"), m["label"].alias("label")))
    elif fmt == "tagged":
        out = tagged(text, spans, with_confidence)
    elif fmt == "blank":
        out = blanked(text, spans)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return df.withColumn(out_col, out)

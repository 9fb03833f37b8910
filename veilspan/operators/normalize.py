"""Spoken digits to digits, with the map back to the original characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import cut, spans_of

_WORD = "(?:" + "|".join([*X.DIGIT_WORDS, *X.REPEAT_WORDS]) + ")"
RUN = rf"\b{_WORD}(?:[\s,\-]+{_WORD})*\b"
SEGMENT = "struct<ns:int,ne:int,os:int,oe:int,is_number:boolean>"


def run_digits(run: Column) -> Column:
    """Digits of a run of digit words; double and triple repeat the next digit, and are lost
    where none follows."""
    words = F.regexp_extract_all(F.lower(run), F.lit(_WORD), F.lit(0))
    digit, repeat = F.lit(None).cast("string"), F.lit(1)
    start = F.struct(F.lit(1).alias("times"), F.lit("").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        d, r = digit, repeat
        for k, v in X.DIGIT_WORDS.items():
            d = F.when(w == k, v).otherwise(d)
        for k, v in X.REPEAT_WORDS.items():
            r = F.when(w == k, v).otherwise(r)
        return F.struct(r.alias("times"), F.when(d.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.repeat(d, acc["times"]))).alias("out"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def normalized(text: Column) -> Column:
    """struct<text, segments>: runs of two or more digits replaced, segments covering it all."""
    runs = F.transform(spans_of(text, RUN, True), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), run_digits(cut(text, r["s"], r["e"])).alias("d")))
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("npos"), F.lit("").alias("text"), F.array().cast(f"array<{SEGMENT}>").alias("segments"))

    def seg(ns: Column, n: Column, os: Column, oe: Column, number: Column) -> Column:
        return F.struct(ns.alias("ns"), (ns + n).alias("ne"), os.alias("os"), oe.alias("oe"), number.alias("is_number"))

    def step(acc: Column, r: Column) -> Column:
        gap = r["s"] - acc["pos"]
        number = F.length(r["d"]) >= 2
        piece = F.when(number, r["d"]).otherwise(cut(text, r["s"], r["e"]))
        at = acc["npos"] + gap
        both = F.array(seg(acc["npos"], gap, acc["pos"], r["s"], F.lit(False)), seg(at, F.length(piece), r["s"], r["e"], number))
        return F.struct(
            r["e"].alias("pos"), (at + F.length(piece)).alias("npos"),
            F.concat(acc["text"], cut(text, acc["pos"], r["s"]), piece).alias("text"),
            F.concat(acc["segments"], both).alias("segments"),
        )

    def finish(acc: Column) -> Column:
        n = F.length(text)
        last = seg(acc["npos"], n - acc["pos"], acc["pos"], n, F.lit(False))
        return F.struct(F.concat(acc["text"], cut(text, acc["pos"], n)).alias("text"), F.array_append(acc["segments"], last).alias("segments"))

    return F.aggregate(runs, start, step, finish)


def to_original(ns: Column, ne: Column, segments: Column) -> Column:
    """struct<s,e> in the original text: touched numbers count whole, other text by character."""
    touched = F.filter(segments, lambda g: (g["ne"] > ns) & (g["ns"] < ne))
    low = F.array_min(F.transform(touched, lambda g: F.when(g["is_number"], g["os"]).otherwise(g["os"] + F.greatest(ns, g["ns"]) - g["ns"])))
    high = F.array_max(F.transform(touched, lambda g: F.when(g["is_number"], g["oe"]).otherwise(g["os"] + F.least(ne, g["ne"]) - g["ns"])))
    return F.struct(F.coalesce(low, ns).alias("s"), F.coalesce(high, ne).alias("e"))

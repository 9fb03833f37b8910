"""Column helpers for character spans. Offsets are code points, from 0, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"
SPAN = "array<struct<s:int,e:int>>"


def uni(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with Unicode classes, as Python's engine reads it."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def clean_marks(text: Column) -> Column:
    """The text with the two characters that mark spans turned into spaces."""
    return F.translate(text, OPEN + CLOSE, "  ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it.

    Inside array functions a column that is named twice is evaluated twice; a bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(uni(pattern, ignore_case))


def spans_of(text: Column, pattern: str | Column, ignore_case: bool = False, replacement: str = f"{OPEN}$0{CLOSE}") -> Column:
    """array<struct<s,e>> of the pattern's matches, left to right.

    Matches are marked in one pass (so look-around sees the text as it is), the marked text is
    cut at the marks, and lengths are added up; every second piece is a match.
    """
    pat = F.lit(uni(pattern, ignore_case)) if isinstance(pattern, str) else pattern
    parts = F.split(F.regexp_replace(text, pat, F.lit(replacement)), f"[{OPEN}{CLOSE}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        out = F.when(acc["inside"], F.array_append(acc["out"], F.struct(acc["at"].alias("s"), end.alias("e")))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), out.alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def cut(text: Column, s: Column, e: Column) -> Column:
    return F.substring(text, s + 1, e - s)


def around(text: Column, s: Column, e: Column, reach: int) -> Column:
    """The text from reach characters before the span to reach characters after it."""
    left = F.greatest(F.lit(0), s - reach)
    return cut(text, left, e + reach)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def quoted(value: Column) -> Column:
    r"""The value as a literal pattern; \E inside it is escaped."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def standalone(value: Column) -> Column:
    """A pattern for the value where no letter or digit touches it."""
    return F.concat(F.lit("(?<![A-Za-z0-9])"), quoted(value), F.lit("(?![A-Za-z0-9])"))

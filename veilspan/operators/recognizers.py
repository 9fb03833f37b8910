"""Rule recognizers: text to spans (s, e, label, score), one projection over one scan.

A recognizer is a row of data (pattern, label, score) with an optional context rule; those of
labels that are not asked for never enter the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import around, cut, found, let, spans_of

RULE_SPAN = "array<struct<s:int,e:int,label:string,score:double>>"
AREA = r"\b(?:" + "|".join(sorted(X.AREAS, key=len, reverse=True)) + r")\b"
SUFFIX = r"\b(?:" + "|".join(X.SUFFIXES) + r")\b"


def _plain(score: float) -> Callable[[Column, Column], Column]:
    return lambda text, m: F.lit(score)


def _postal_score(text: Column, m: Column) -> Column:
    near = let(around(text, m["s"], m["e"], 80), _address_signal)
    return F.when(near, X.POSTAL_HIGH).otherwise(X.POSTAL_LOW)


def _address_signal(w: Column) -> Column:
    return found(w, X.SINGAPORE, True) | found(w, X.POSTAL_WORDS, True) | found(w, X.UNIT) | found(w, X.BLOCK, True) | found(w, SUFFIX, True) | found(w, AREA, True)


def _unit_score(text: Column, m: Column) -> Column:
    """Null rejects: measures and cards nearby, chains of hyphens, the shop name 7-11."""
    s, e = m["s"], m["e"]
    # The run of such characters before the span is what trimming them off takes away.
    head = cut(text, F.lit(0), s)
    left = F.substring(head, F.length(F.rtrim(head, F.lit("0123456789- #"))) + 1, F.lit(1 << 30))
    right = F.regexp_extract(F.substring(text, e + 1, F.lit(1 << 30)), r"^[0-9\- #]*", 0)
    hyphens = F.length(F.regexp_replace(F.concat(left, cut(text, s, e), right), "[^-]", ""))
    before = cut(text, F.greatest(F.lit(0), s - 3), s)
    shop = found(cut(text, s, e), r"^7\s*-\s*11$") & ~found(before, r"#\s*$")
    return F.when(~found(around(text, s, e, 20), X.UNIT_EXCLUDED, True) & (hyphens <= 1) & ~shop, X.HIGH)


@dataclass(frozen=True)
class Recognizer:
    label: str
    pattern: str
    score: Callable[[Column, Column], Column]
    ignore_case: bool = False

    def spans(self, text: Column) -> Column:
        hits = F.transform(
            spans_of(text, self.pattern, self.ignore_case),
            lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(self.label).alias("label"), self.score(text, m).cast("double").alias("score")),
        )
        return F.filter(hits, lambda m: m["score"].isNotNull())


def _token_run(tokens: Column, most: int, ok: Callable[[Column], Column]) -> Column:
    """How many leading tokens are ok, at most `most`."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(acc: Column, t: Column) -> Column:
        go = acc["on"] & ok(t) & (acc["n"] < most)
        return F.struct((acc["n"] + go.cast("int")).alias("n"), go.alias("on"))

    return F.aggregate(tokens, start, step, lambda acc: acc["n"])


TOKEN = r"\n|\w+|[^\w\s]"
REACH = 160


class StreetRecognizer(Recognizer):
    """A street around a suffix word: up to four words before it (two after a lead-in), two
    after it and road numbers behind those, not past punctuation, line ends or stop words.

    Words are runs of word characters, other characters stand alone. First the neighbourhood of
    a suffix is cut into words; where long words leave fewer than seven whole ones before it, all
    the text before. A street has at most 90 characters, so REACH is enough behind it.
    """

    def spans(self, text: Column) -> Column:
        def boundary(t: Column) -> Column:
            return ~found(t, r"^\w")

        def stops(t: Column) -> Column:
            return F.lower(t).isin(X.STREET_STOPS)

        def words(t: Column) -> Column:
            return let(t, lambda x: F.transform(spans_of(x, TOKEN), lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), cut(x, w["s"], w["e"]).alias("t"))))

        def street(m: Column) -> Column:
            base = F.greatest(F.lit(0), m["s"] - REACH)
            near = F.struct(base.alias("base"), F.reverse(words(cut(text, base, m["s"]))).alias("w"))
            return let(let(near, lambda x: seven(m, x)), lambda b: let(words(cut(text, m["e"], m["e"] + REACH)), lambda after: extent(m, b["base"], b["w"], after)))

        def seven(m: Column, x: Column) -> Column:
            # Eight words near by hold seven whole ones; where there are fewer, all that is before counts.
            every = F.struct(F.lit(0).alias("base"), F.reverse(words(cut(text, F.lit(0), m["s"]))).alias("w"))
            return F.when((x["base"] == 0) | (F.size(x["w"]) > 7), x).otherwise(every)

        def extent(m: Column, base: Column, before: Column, after: Column) -> Column:
            open7 = F.slice(before, 1, _token_run(F.slice(before, 1, 7), 7, lambda w: ~boundary(w["t"])))
            most = F.when(F.exists(open7, lambda w: stops(w["t"])), 2).otherwise(4)
            n_left = F.least(most, _token_run(before, 4, lambda w: ~boundary(w["t"]) & ~stops(w["t"])))
            n_base = _token_run(after, 2, lambda w: ~boundary(w["t"]))
            numbers = lambda n: n + _token_run(F.slice(after, n + 1, F.lit(64)), 64, lambda w: found(w["t"], r"^\d{1,4}[A-Za-z]?$"))
            s = let(n_left, lambda n: F.when(n > 0, base + F.get(before, n - 1)["s"]).otherwise(m["s"]))
            e = let(let(n_base, numbers), lambda n: F.when(n > 0, m["e"] + F.get(after, n - 1)["e"]).otherwise(m["e"]))
            return let(F.struct(s.alias("s"), e.alias("e")), lambda x: scored(x["s"], F.least(x["e"], x["s"] + 90)))

        def scored(s: Column, e: Column) -> Column:
            score = F.when(found(around(text, s, e, 40), AREA, True), X.MODERATE + 0.15).otherwise(X.MODERATE)
            return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(self.label).alias("label"), score.cast("double").alias("score"))

        return F.filter(F.transform(spans_of(text, self.pattern, True), street), lambda x: x["e"] - x["s"] >= 8)


REGISTRY: list[Recognizer] = [
    Recognizer("SG_PHONE_NUMBER", X.PHONE, _plain(1.0)),
    Recognizer("ACCOUNT_NUMBER", X.ACCOUNT, _plain(1.0)),
    Recognizer("SG_NRIC_FIN", X.NRIC_RULE, _plain(1.0)),
    Recognizer("EMAIL_ADDRESS", X.EMAIL_RULE, _plain(1.0)),
    Recognizer("PERSON", X.PERSON_RULE, _plain(X.HIGH)),
    Recognizer("SG_POSTAL_CODE", X.POSTAL, _postal_score),
    Recognizer("SG_UNIT_NUMBER", X.UNIT, _unit_score),
    Recognizer("SG_ADDRESS_BLOCK_NUMBER", X.BLOCK, _plain(X.HIGH), True),
    StreetRecognizer("SG_ADDRESS", SUFFIX, _plain(X.MODERATE), True),
    Recognizer("SG_ADDRESS", AREA, _plain(X.HIGH), True),
]
ENTITIES = list(dict.fromkeys(r.label for r in REGISTRY))
#: Names by capitals alone, for callers without a name model: REGISTRY + [CAPITALISED_NAME]. It
#: also takes other runs of capitalised words, so it is not in the registry itself.
CAPITALISED_NAME = Recognizer("PERSON", X.PERSON_CAPITALISED, _plain(X.MODERATE))
#: Overlaps of one type are resolved among these; pattern recognizers report every match.
ADDRESS_ENTITIES = ["SG_POSTAL_CODE", "SG_UNIT_NUMBER", "SG_ADDRESS_BLOCK_NUMBER", "SG_ADDRESS"]


def resolve_same_type(spans: Column) -> Column:
    """Spans of one type: by start, score and length, each against the first kept span that it
    overlaps, which it replaces if its score is higher, or equal with more length.

    Only that first one is compared, so a result may still overlap a second kept span.
    """

    def order(a: Column, b: Column) -> Column:
        keys = [(a["s"], b["s"]), (b["score"], a["score"]), (b["e"] - b["s"], a["e"] - a["s"])]
        out = F.lit(0)
        for x, y in reversed(keys):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    def step(kept: Column, r: Column) -> Column:
        clash = F.transform(kept, lambda k: (r["s"] < k["e"]) & (k["s"] < r["e"]))
        return let(F.array_position(clash, True).cast("int"), lambda at: placed(kept, r, at))  # from 1; 0 where there is none

    def placed(kept: Column, r: Column, at: Column) -> Column:
        k = F.get(kept, at - 1)
        better = (r["score"] > k["score"]) | ((r["score"] == k["score"]) & (r["e"] - r["s"] > k["e"] - k["s"]))
        swapped = F.transform(kept, lambda x, i: F.when(i == at - 1, r).otherwise(x))
        return F.when(at == 0, F.array_append(kept, r)).when(better, swapped).otherwise(kept)

    return F.aggregate(F.array_sort(spans, order), F.array().cast(RULE_SPAN), step)


def _known(entities: Sequence[str], registry: Sequence[Recognizer]) -> list[str]:
    """The registry's labels; an entity that is none of them is an error."""
    known = list(dict.fromkeys(r.label for r in registry))
    unknown = set(entities) - set(known)
    if unknown:
        raise ValueError(f"no recognizer for {sorted(unknown)}")
    return known


def rule_spans(text: Column, entities: Sequence[str] = ENTITIES, threshold: float = X.RULE_THRESHOLD, registry: Sequence[Recognizer] | None = None) -> Column:
    """Rule spans of a text column, in order of start and end; only asked-for entities are run.

    registry takes the place of REGISTRY: own recognizers, of known or new entities.
    """
    own = REGISTRY if registry is None else registry
    known = _known(entities, own)
    by_label: list[Column] = []
    for label in (x for x in known if x in entities):
        spans = F.concat(*(r.spans(text) for r in own if r.label == label))
        by_label.append(resolve_same_type(spans) if label in ADDRESS_ENTITIES else spans)
    every = F.filter(F.concat(*by_label), lambda m: m["score"] >= threshold)
    return F.array_sort(every, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["e"] < b["e"], -1).when(a["e"] > b["e"], 1).otherwise(0))


def with_rule_spans(df: DataFrame, text_col: str = "text", entities: Sequence[str] = ENTITIES, threshold: float = X.RULE_THRESHOLD, out_col: str = "spans") -> DataFrame:
    """df with the rule spans of its text; the span marks' two characters count as spaces."""
    from .textwise import rule_column

    _known(entities, REGISTRY)
    return df.withColumn(out_col, rule_column(df.sparkSession, F.col(text_col), entities, threshold))


def rule_predictions(df: DataFrame, text_col: str = "text", entities: Sequence[str] = ENTITIES, threshold: float = X.RULE_THRESHOLD) -> DataFrame:
    """df with predictions array<struct<text,label,s,e,score>>: canonical labels, stripped
    values, without empty ones and speaker labels taken for names."""
    from .textwise import prediction_column

    _known(entities, REGISTRY)
    return df.withColumn("predictions", prediction_column(df.sparkSession, F.col(text_col), entities, threshold))


def model_recognizer(text: Column, spans: Column, entities: Sequence[str] = ENTITIES, names: dict[str, str] = X.MODEL_SYNONYMS) -> Column:
    """A model's raw spans, array<struct<s,e,label,conf>> in its own label names, as rule spans.

    A label that names does not hold, or whose entity is not asked for, is dropped, and so is a
    value that only says its label, a generic word, or one that cannot be of its entity. Order
    stays. Null spans give null, an empty array an empty one.
    """
    from .predicates import generic_words, implausible, label_literal

    entity = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def named(m: Column) -> Column:
        return F.struct(m["s"].cast("int").alias("s"), m["e"].cast("int").alias("e"), F.try_element_at(entity, m["label"]).alias("label"), m["conf"].cast("double").alias("score"), m["label"].alias("own"))

    def sound(m: Column) -> Column:
        bad = lambda v: label_literal(v, m["own"]) | generic_words(v, m["label"]) | implausible(v, m["label"])
        return m["label"].isin(list(entities)) & ~let(cut(text, m["s"], m["e"]), bad)

    return F.transform(F.filter(F.transform(spans, named), sound), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["label"].alias("label"), m["score"].alias("score")))

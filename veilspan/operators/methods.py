"""Detection methods by name, each with the two label sets it is run with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recognizers import rule_predictions
from .redact import tagged
from .vocab import BASE, CANON
from .windows import ColumnDetector, document_spans, replay_detector

#: text column in, `predictions` array<struct<text,label,s,e,...>> out
Predictor = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Method:
    name: str
    predict: Predictor

    def account_spans(self, df: DataFrame) -> DataFrame:
        """df with `spans` of the base seven labels."""
        return self.predict(df).withColumn("spans", F.filter("predictions", lambda p: p["label"].isin(BASE))).drop("predictions")

    def leak_tagged(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """df with `redacted`: all nine labels in tags."""
        df = self.predict(df).withColumn("_s", F.filter("predictions", lambda p: p["label"].isin(CANON)))
        return df.withColumn("redacted", tagged(F.coalesce(F.col(text_col), F.lit("")), F.col("_s"))).drop("predictions", "_s")


def windowed(detect: ColumnDetector, **options) -> Predictor:
    return lambda df: document_spans(df, detect, out_col="predictions", **options)


def replayed(column: str = "model_spans", **options) -> Predictor:
    """A model's stored predictions, through the whole chain."""
    return lambda df: document_spans(df, replay_detector(F.col(column)), out_col="predictions", **options)


_METHODS: dict[str, Method] = {}


def register(name: str, predict: Predictor) -> Method:
    _METHODS[name] = Method(name, predict)
    return _METHODS[name]


def method(name: str) -> Method:
    if name not in _METHODS:
        raise ValueError(f"unknown method {name!r}; there are {sorted(_METHODS)}")
    return _METHODS[name]


register("rulebased", rule_predictions)
register("baseline", replayed("baseline_spans"))
register("finetuned", replayed("finetuned_spans"))

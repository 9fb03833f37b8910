"""The label dimension and lookups into it, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

CANON = [x[1] for x in fixed.LABELS]
BASE = [x[1] for x in fixed.LABELS if x[5]]
COLUMNS = "model_label string, canon string, filter_key string, rule_entity string, match_group string, base boolean"


def labels(spark: SparkSession) -> DataFrame:
    """One row per label: nine rows, so joins with it are broadcast."""
    return spark.createDataFrame(fixed.LABELS, COLUMNS)


def lookup(key: Column, frm: int, to: int) -> Column:
    """Another name of a label; null where the label is unknown."""
    out = F.lit(None).cast("string")
    for row in fixed.LABELS:
        out = F.when(key == row[frm], row[to]).otherwise(out)
    return out


def canon_of_model(label: Column) -> Column:
    """Canonical name of a model label. An unknown one is an error, as a lookup failure is."""
    name = lookup(label, 0, 1)
    return F.when(name.isNull(), F.raise_error(F.concat(F.lit("unknown model label: "), F.coalesce(label, F.lit("null"))))).otherwise(name)


def canon_of_rule(entity: Column) -> Column:
    """Canonical name of a rule entity; unknown entities give null and are dropped by callers."""
    return lookup(entity, 3, 1)


def match_group(label: Column) -> Column:
    """The group within which two labels match; a label outside all groups is its own."""
    groups = {x[1]: x[4] for x in fixed.LABELS} | {name: group for group, names in fixed.GROUP_SYNONYMS.items() for name in names}
    known = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    return F.coalesce(known[F.upper(label)], F.upper(label))

"""What redaction leaves: account survival, residual identifiers, roll-ups by file and customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from . import textwise


def account_survival(calls: DataFrame, key: str = "doc_id", text_col: str = "text", accounts_col: str = "accounts", spans_col: str = "spans") -> DataFrame:
    """One row per call and distinct account value that occurs: value, digits, total and
    redacted occurrences (plain substrings, not overlapping one another), labels histogram.

    The occurrences meet the call's spans by interval overlap.
    """
    found = textwise.survival_column(calls.sparkSession, F.col(text_col), F.col(accounts_col), F.col(spans_col))
    return calls.select(key, found.alias("_v")).select(key, F.explode("_v").alias("v")).select(key, "v.*")


def recoverable(survival: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per call: whether an account can still be told, because some value of at least eight
    digits survives somewhere, or every value does."""
    left = F.col("redacted") < F.col("total")
    return survival.groupBy(key).agg((F.coalesce(F.bool_or(left & (F.col("digits") >= X.COMPLETE_DIGITS)), F.lit(False)) | F.bool_and(left)).alias("recoverable"))


def unrecoverable_rate(calls: DataFrame, survival: DataFrame, key: str = "doc_id", accounts_col: str = "accounts") -> DataFrame:
    """n_calls with accounts, n_bad of them unrecoverable, and the rate. A call whose values
    never occur counts as a call and cannot be bad."""
    own = calls.filter(F.size(accounts_col) > 0).select(key)
    df = own.join(recoverable(survival, key), key, "left")
    bad = F.count_if(~F.coalesce("recoverable", F.lit(True)))
    return df.agg(F.count(F.lit(1)).alias("n_calls"), bad.alias("n_bad")).withColumn("rate", F.col("n_bad") / F.greatest(F.lit(1), F.col("n_calls")).cast("double"))


def residual_leaks(redacted: DataFrame, key: str = "line", text_col: str = "redacted") -> DataFrame:
    """key, type, value of full identifiers left as plain text.

    A deterministic stand-in for a judge: tags are cut out, then whole national ids, mobile or
    international numbers (toll-free ones excepted), and an address counts when block or unit,
    street or area, and postal code all stand in the text.
    """
    df = redacted.select(key, textwise.leak_column(redacted.sparkSession, F.col(text_col)).alias("_x"))
    return df.select(key, F.posexplode("_x").alias("n", "x")).select(key, "n", "x.type", "x.value")


def leak_items(leaks: DataFrame, key: str = "line") -> DataFrame:
    """One row per leaking line with its items in order."""
    return leaks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "type", "value"))).alias("items"))


def customer_of(name: Column) -> Column:
    """The second-last part of a file's name; null for `(unmatched)` or shorter names."""
    return F.when(name != "(unmatched)", F.try_element_at(F.split(name, "_"), F.lit(-2)))


def file_names(lines: DataFrame, files: DataFrame, missing: str = "(unmatched)") -> DataFrame:
    """lines (line, input) with the file whose input is the same text, or `missing`. Of several
    files with that text the last by name counts, so each line stays one row."""
    own = files.groupBy(F.xxhash64("input").alias("_h"), F.col("input").alias("_in")).agg(F.max("file").alias("file"))
    hashed = lines.withColumn("_k", F.xxhash64("input"))
    joined = hashed.join(own, (hashed["_k"] == own["_h"]) & hashed["input"].eqNullSafe(own["_in"]), "left")
    return joined.select(*lines.columns, F.coalesce("file", F.lit(missing)).alias("file"))


def leak_rates(names: DataFrame, leaks: DataFrame) -> DataFrame:
    """Files and distinct customers, and how many of each leak. names: line, file."""
    leaking = leaks.select("line").distinct().withColumn("_leak", F.lit(True))
    df = names.join(leaking, "line", "left").withColumn("customer", customer_of(F.col("file")))
    return df.agg(
        F.count(F.lit(1)).alias("files"), F.count("_leak").alias("leaked_files"),
        F.countDistinct("customer").alias("customers"), F.countDistinct(F.when(F.col("_leak"), F.col("customer"))).alias("leaked_customers"),
    )

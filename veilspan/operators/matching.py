"""Predictions against gold: quality, greedy one-to-one assignment, counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import let
from . import matchwise
from .vocab import BASE, CANON, match_group


def cleaned(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"(?U)[\s.,!?;:\-]+", " ")))


def match_quality(pred: Column, gold: Column) -> Column:
    """2 if equal when cleaned, the ratio of lengths if one holds the other, else -1."""
    return _quality(cleaned(pred), cleaned(gold))


def _quality(p: Column, g: Column) -> Column:
    n, m = F.length(p), F.length(g)
    ratio = F.least(n, m) / F.nullif(F.greatest(n, m), F.lit(0)).cast("double")
    return F.when((n == 0) | (m == 0), -1.0).when(p == g, 2.0).when(g.contains(p) | p.contains(g), ratio).otherwise(-1.0)


PAIR = "struct<k:double,i:int,j:int,pred_label:string,gold_label:string>"


ITEMS = "array<struct<n:int,t:string,label:string,g:string>>"


def _own(n: Column, text: Column, label: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), cleaned(text).alias("t"), label.alias("label"), match_group(label).alias("g"))


def settled(preds: Column, golds: Column) -> Column:
    """The out of outcomes, from both sides of a call as arrays of ITEMS: the plain statement of what
    matchwise does in workers, against which tests hold it.

    One test leaves few pairs before qualities are worked out: columns inside array functions
    are interpreted, so what is asked of all pairs is asked first and once.
    """

    def met(x: Column, y: Column) -> Column:
        n, m = F.length(x["t"]), F.length(y["t"])
        k = F.when(x["t"] == y["t"], -2.0).otherwise(-(F.least(n, m) / F.greatest(n, m)))
        return F.struct(k.alias("k"), x["n"].alias("i"), y["n"].alias("j"), x["label"].alias("pred_label"), y["label"].alias("gold_label"))

    def of(x: Column) -> Column:
        near = F.filter(golds, lambda y: (y["g"] == x["g"]) & (y["t"].contains(x["t"]) | x["t"].contains(y["t"])) & (y["t"] != ""))
        return F.transform(near, lambda y: met(x, y))

    def step(kept: Column, c: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k["i"] == c["i"]) | (k["j"] == c["j"])), kept).otherwise(F.array_append(kept, c))

    def left(side: Column, taken: Column, name: str) -> Column:
        none = F.filter(side, lambda x: ~F.coalesce(F.array_contains(taken, x["n"]), F.lit(False)))
        return F.transform(none, lambda x: F.struct(x["n"].alias(name), x["label"].alias("label")))

    def told(pairs: Column) -> Column:
        hits = F.aggregate(pairs, F.array().cast(f"array<{PAIR}>"), step)
        rest = lambda h: F.struct(pairs.alias("pairs"), h.alias("hits"), let(h["i"], lambda t: left(preds, t, "i")).alias("fp"), let(h["j"], lambda t: left(golds, t, "j")).alias("fn"))
        return let(hits, rest)

    pairs = F.flatten(F.transform(F.filter(preds, lambda x: x["t"] != ""), of)).cast(f"array<{PAIR}>")
    return let(F.sort_array(pairs), told)


def outcomes(pred: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per call: key and out, a struct of arrays.

    pairs: possible matches, pred (key, i, text, label) with gold (key, j, text, label) of the
    same group and positive quality, best first, then in order of prediction and gold (k is
    minus the quality). hits: those a greedy pass keeps. fp (i, label) and fn (j, label): what
    no kept pair holds. Each side is grouped by call once, and a call is matched in one row, so
    nothing shuffles again. A null key meets nothing.
    """
    own = lambda n: F.struct(F.col(n).cast("int").alias(n), F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label"))
    listed = lambda df, n, name: df.groupBy(key).agg(F.collect_list(own(n)).alias(name))
    both = listed(pred, "i", "_p").join(listed(gold, "j", "_g"), key, "full")
    return both.select(key, matchwise.settled_column(pred.sparkSession, F.col("_p"), F.col("_g")).alias("out"))


def outcomes_in_rows(calls: DataFrame, pred_col: str, gold_col: str, key: str = "doc_id") -> DataFrame:
    """The same of calls that have both sides in their row, as arrays of pred (i, text, label) and
    gold (j, text, label): one row per call, and nothing shuffles. Null arrays count as empty."""
    return calls.select(key, matchwise.settled_column(calls.sparkSession, *_sides(calls, pred_col, gold_col)).alias("out"))


def _sides(calls: DataFrame, pred_col: str, gold_col: str) -> list[Column]:
    """Both sides with the fields that workers read; arrays that have just these go as they are."""

    def items(c: str, n: str) -> Column:
        fields = f"array<struct<{n}:int,text:string,label:string>>"
        if calls.select(c).schema[0].dataType.simpleString() == fields:
            return F.col(c)
        return F.transform(c, lambda x: F.struct(x[n].cast("int").alias(n), x["text"].cast("string").alias("text"), x["label"].cast("string").alias("label")))

    return [items(pred_col, "i"), items(gold_col, "j")]


def label_counts_in_rows(calls: DataFrame, pred_col: str, gold_col: str) -> DataFrame:
    """label_counts of such calls: each batch of calls is counted where it is matched."""
    counts = matchwise.counts(calls, *_sides(calls, pred_col, gold_col))
    return counts.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def _listed(found: DataFrame, what: str, key: str) -> DataFrame:
    return found.select(key, F.explode(F.col("out")[what]).alias("m"))


def pairs(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, i, j, pred_label, gold_label, quality of every possible match of outcomes."""
    return _listed(found, "pairs", key).select(key, "m.i", "m.j", "m.pred_label", "m.gold_label", (-F.col("m.k")).alias("quality"))


def assigned(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same columns of the pairs that were kept."""
    return _listed(found, "hits", key).select(key, "m.i", "m.j", "m.pred_label", "m.gold_label", (-F.col("m.k")).alias("quality"))


def unmatched(found: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(false positives: key, i, label; false negatives: key, j, label)."""
    return _listed(found, "fp", key).select(key, "m.i", "m.label"), _listed(found, "fn", key).select(key, "m.j", "m.label")


def label_counts(found: DataFrame) -> DataFrame:
    """label, tp, fp, fn: hits and misses by gold label, false alarms by predicted label."""
    one = lambda arr, label, k: F.transform(arr, lambda m: F.struct(m[label].alias("label"), *(F.lit(int(x == k)).alias(x) for x in ("tp", "fp", "fn"))))
    every = F.concat(one("out.hits", "gold_label", "tp"), one("out.fp", "label", "fp"), one("out.fn", "label", "fn"))
    return found.select(F.explode(every).alias("x")).groupBy("x.label").agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")))


def rounded(x: Column, places: int = 4) -> Column:
    """x to so many places by its exact binary value, ties to even, as Python rounds; Spark's
    own rounding goes by the decimal print (3/160, just below 0.01875, would become 0.0188)."""
    return F.format_number(x, places).try_cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, rounded(a / b.cast("double"))).otherwise(0.0)


def with_scores(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    """counts (tp, fp, fn) with precision and recall to 4 places, F1 from those, F-beta."""
    p, r, b2 = F.col("precision"), F.col("recall"), beta * beta
    df = counts.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    df = df.withColumn("f1", F.when(p + r > 0, rounded(2 * p * r / (p + r))).otherwise(0.0))
    return df.withColumn("f_beta", F.when(p + r > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(0.0))


def gate(counts: DataFrame, threshold: float = X.GATE, labels: list[str] = CANON) -> DataFrame:
    """label, scores and passed for every label asked for; absent labels count nothing."""
    dim = counts.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    full = F.broadcast(dim).join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    df = with_scores(full)
    return df.withColumn("passed", (F.col("precision") > threshold) & (F.col("recall") > threshold) & (F.col("f1") > threshold))


def overall(counts: DataFrame) -> DataFrame:
    """Sums over all nine labels and over the base seven, with scores; the counts are worked out once."""
    sums = [F.struct(F.lit(k).alias("labels"), *(F.coalesce(F.sum(F.when(F.col("label").isin(names), F.col(c))), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))) for k, names in (("all", CANON), ("base", BASE))]
    return with_scores(counts.agg(F.array(*sums).alias("_s")).select(F.explode("_s").alias("s")).select("s.*"))


def nric_protection(found: DataFrame) -> DataFrame:
    """nric_total: calls with a gold NRIC; nric_protected: those where one of them was caught."""
    caught = F.exists("out.hits", lambda h: h["gold_label"] == "SG_NRIC_FIN")
    there = caught | F.exists("out.fn", lambda m: m["label"] == "SG_NRIC_FIN")
    return found.select(there.alias("there"), caught.alias("caught")).agg(F.count_if("there").alias("nric_total"), F.count_if("caught").alias("nric_protected"))

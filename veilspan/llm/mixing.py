"""Mixing sources to target weights with DataFrame operations only.

A token budget is handed down a domain, language, source tree. At each node the children share
by weight, none beyond what its subtree can supply over `max_epochs`; what a child cannot use
goes to its siblings by weight, and only what all of them cannot use goes back up (a node is
never given more than its subtree holds, so that part is shared among the node's siblings).

A leaf's budget is whole epochs of all its documents, then a prefix of one more epoch, whose
order is a seeded hash. The prefix is found without sorting a leaf: hash ranges of about
BUCKET_ROWS documents are summed, whole ranges before the cut are in, and only the range that
holds the cut is ordered. All shares are whole numbers, so budgets are met to the token.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, packed, stage, unstage

LEVELS = ("_domain", "_lang", "_source")
BUCKET_ROWS = 1000
#: Words between ASCII white space.
TOKEN = r"[^ \t\n\x0B\f\r]+"
NONE = "(none)"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its nth token."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[ \t\n\x0B\f\r]*" + TOKEN), F.lit(0)), F.lit(1), n.cast("int")), "")


def source_domain(source: Column, n: int = 4) -> Column:
    """Domain of a source by its number; sources without one are `other`."""
    return F.coalesce(F.concat(F.lit("domain"), F.regexp_extract(source, "[0-9]+", 0).try_cast("int") % n), F.lit("other"))


def _weight(weights: Mapping[str, int], name: str) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(F.col(name) == k, w).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], child: str, weights: Mapping[str, int]) -> DataFrame:
    """nodes (parent columns, child, _cap, _up: the parent's budget) with _budget.

    Capacities are filled in order of capacity by weight; a child is full if its weight's share
    of what is left would exceed its capacity. The others share the rest by weight, rounded
    down, and the tokens that rounding leaves go to the first of them by name, one each.
    """
    up = Window.partitionBy(*parent)
    by = up.orderBy(F.col("_cap") / F.col("_w"), child)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    df = nodes.withColumn("_w", _weight(weights, child))
    df = df.withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_left", F.sum("_w").over(after))
    df = df.withColumn("_full", F.expr("_cap * _left <= (_up - _used) * _w"))
    df = df.withColumn("_taken", F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(up), F.lit(0)))
    df = df.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("_w"))).over(up))
    df = df.withColumn("_part", F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("(_up - _taken) * _w div nullif(_open, 0)")))
    df = df.withColumn("_over", F.least("_up", F.sum("_cap").over(up)) - F.sum("_part").over(up))
    df = df.withColumn("_rank", F.row_number().over(up.orderBy("_full", child)))
    df = df.withColumn("_budget", F.col("_part") + F.when(~F.col("_full") & (F.col("_rank") <= F.col("_over")), 1).otherwise(0))
    return df.select(*nodes.columns, "_budget")


def budgets(counted: DataFrame, budget: int | None, fraction: tuple[int, int], weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """One row per leaf: LEVELS, _rows, _supply, _budget, _epochs (whole ones) and _rest."""
    leaves = counted.filter("_n > 0").groupBy(*LEVELS).agg(F.sum("_n").alias("_supply"), F.count(F.lit(1)).alias("_rows"))
    tree = leaves.withColumn("_cap", F.col("_supply") * max_epochs)
    top = F.lit(budget).cast("long") if budget is not None else F.expr(f"sum(_supply) * {int(fraction[0])} div {int(fraction[1])}")
    root = tree.agg(F.least(top, F.sum("_cap")).alias("_up"))
    nodes = tree.groupBy("_domain").agg(F.sum("_cap").alias("_cap")).crossJoin(F.broadcast(root))  # root is one row
    at = share(nodes, ["_up"], "_domain", weights.get("domain", {})).select("_domain", F.col("_budget").alias("_up"))
    nodes = tree.groupBy("_domain", "_lang").agg(F.sum("_cap").alias("_cap")).join(at, "_domain")
    at = share(nodes, ["_domain"], "_lang", weights.get("lang", {})).select("_domain", "_lang", F.col("_budget").alias("_up"))
    nodes = tree.join(at, ["_domain", "_lang"])
    out = share(nodes, ["_domain", "_lang"], "_source", weights.get("source", {}))
    return out.select(*LEVELS, "_rows", "_supply", "_budget", F.expr("_budget div _supply").alias("_epochs"), F.expr("_budget % _supply").alias("_rest"))


def _bucketed(rows: DataFrame, seed: int) -> DataFrame:
    """rows with _h, and _bucket: the hash range of a document among those of its leaf."""
    return rows.withColumn("_h", _hash(seed)).withColumn("_bucket", F.expr(f"_h * (_rows div {BUCKET_ROWS} + 1) div 4294967296"))


def _hash(seed: int) -> Column:
    """32 bits for a document in the epoch after its leaf's whole ones."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(NONE)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def _levels(domain: Column, lang_col: str, source_col: str) -> dict[str, Column]:
    keys = [domain, F.col(lang_col), F.col(source_col)]
    return {a: F.coalesce(k.cast("string"), F.lit(NONE)) for k, a in zip(keys, LEVELS)}


def _plan(counted: DataFrame, leaves: DataFrame, total: int, seed: int) -> DataFrame:
    """leaves with the hash range that holds the cut of the last epoch, and the tokens before it."""
    keys = list(LEVELS)
    slim = attach(counted.filter("_n > 0"), leaves, keys, "_rows", total).filter("_rest > 0")
    sums = _bucketed(slim, seed).groupBy(*keys, "_rest", "_bucket").agg(F.sum("_n").alias("_sum"))
    so_far = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket"))
    cut = sums.withColumn("_end", so_far).filter("_end >= _rest and _end - _sum < _rest")
    cut = cut.select(*keys, F.col("_bucket").alias("_cut"), (F.col("_end") - F.col("_sum")).alias("_before"))
    return stage(leaves.join(cut, keys, "left"), "mix")


def _select(rows: DataFrame, n: Column, some: Column, plan: DataFrame, total: int, seed: int) -> DataFrame:
    """rows (with _id and LEVELS) that the plan takes, with _n, epoch and taken.

    n is a row's number of tokens and `some` whether there is one: texts are counted once, after
    it is known that the row is wanted. Only rows of the range that holds a cut are ordered.
    """
    full = _bucketed(attach(rows, plan, list(LEVELS), "_rows", total).filter(F.expr("_budget > 0") & some), seed)
    times = F.col("_epochs") + F.when(F.expr("_rest > 0 and _bucket < _cut"), 1).otherwise(0)
    whole = full.withColumn("_times", times).filter("_times > 0").withColumn("_n", n)
    whole = whole.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))).withColumn("taken", F.col("_n"))
    order = Window.partitionBy(*LEVELS).orderBy("_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = full.filter("_rest > 0 and _bucket = _cut").withColumn("_n", n).withColumn("epoch", F.col("_epochs"))
    edge = edge.withColumn("_ahead", F.sum("_n").over(order) - F.col("_n") + F.col("_before"))
    edge = edge.withColumn("taken", F.least(F.col("_n"), F.col("_rest") - F.col("_ahead"))).filter("taken > 0")
    cols = [*dict.fromkeys([*rows.columns, "_n", "epoch", "taken"])]
    return whole.select(*cols).unionByName(edge.select(*cols))


def mix(docs: DataFrame, *, budget: int | None = None, fraction: tuple[int, int] = (3, 4), weights: Mapping[str, Mapping[str, int]] | None = None, max_epochs: int = 4, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, with_text: bool = False) -> DataFrame:
    """The documents of a mixture: id, domain, lang, source, n_tokens, epoch and taken.

    budget is in tokens; without it, it is that fraction of all tokens. weights map level
    (domain, lang, source) to name to a whole number, 1 where unnamed. A null level counts as
    `(none)`, a null text as empty; documents without tokens have nothing to take. taken is
    below n_tokens only for the document a leaf's prefix ends in. Rows that repeat are
    separate supply. An empty table gives no rows.

    With with_text, the rows are docs' own columns, once for each epoch, texts cut to what is
    taken; otherwise other columns are ignored, whatever their names.
    """
    levels = _levels(source_domain(F.col(source_col)) if domain is None else domain, lang_col, source_col)
    own = [c.alias(k) for k, c in levels.items()]
    counted = stage(docs.select(F.col(id_col).alias("_id"), *own, token_count(F.col(text_col)).alias("_n")), "counted")
    leaves = stage(budgets(counted, budget, fraction, weights or {}, max_epochs), "leaves")
    total = counted.count()
    plan = _plan(counted, leaves, total, seed)
    if not with_text:
        out = _select(counted, F.col("_n"), F.col("_n") > 0, plan, total, seed)
        return out.select(F.col("_id").alias(id_col), *(F.col(k).alias(k[1:]) for k in LEVELS), F.col("_n").alias("n_tokens"), "epoch", "taken")
    unstage(counted, leaves)
    text = F.col("_row")[text_col]
    out = _select(packed(docs, _id=F.col(id_col), **levels), token_count(text), F.coalesce(text.rlike(TOKEN), F.lit(False)), plan, total, seed)
    cut = F.when(F.col("taken") < F.col("_n"), first_tokens(text, F.col("taken"))).otherwise(text)
    return out.select(*((cut if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns), F.col("taken").alias("_taken"))

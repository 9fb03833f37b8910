"""Training logs: losses by step and epoch, smoothing, the best epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values. The log's patterns.
TRAIN = r"loss=([0-9.]+),\s*lr=[0-9.eE+-]+,[^\n]*?epoch=([0-9.]+)"
EVAL = r"'?eval_loss'?:\s*([0-9.]+)"


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(train: i, epoch, loss; val: i, loss) of a training log, one file read as one text."""
    text = spark.read.text(path, wholetext=True).select("value")
    pick = lambda p, g: F.regexp_extract_all("value", F.lit(p), F.lit(g))
    train = text.select(F.posexplode(F.arrays_zip(pick(TRAIN, 2).alias("epoch"), pick(TRAIN, 1).alias("loss"))).alias("i", "x"))
    val = text.select(F.posexplode(pick(EVAL, 1)).alias("i", "x"))
    return train.select("i", F.col("x.epoch").cast("double").alias("epoch"), F.col("x.loss").cast("double").alias("loss")), val.select("i", F.col("x").cast("double").alias("loss"))


def smoothing_span(n: int) -> int | None:
    """Rows behind a smoothed value; none for short series."""
    return max(5, n // 50) if n >= 20 else None


#: Width of a range of the order column, and rows of a block of one series: what one task orders.
RANGE, BLOCK = 1 << 16, 1 << 16


def _ranked(series: DataFrame, order: str, by: list[str]) -> DataFrame:
    """series with _ix, the place of each row in its own series, counted by range of the order
    column, so that no task holds a whole series."""
    part = F.floor(F.col(order) / F.lit(RANGE))
    rows = series.withColumn("_part", part)
    sizes = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order))
    ranked = rows.withColumn("_r", inside)
    same = [ranked[c].eqNullSafe(base[c]) for c in (*by, "_part")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return ranked.join(base, cond).select(*(ranked[c] for c in series.columns), (F.col("_base") + F.col("_r") - 1).alias("_ix"))


def smoothed(series: DataFrame, order: str, value: str, n: int, by: list[str] | None = None) -> DataFrame:
    """series with the mean of each value and up to k before it.

    A series is cut into blocks of its own rows; the last k of a block go with the next one too,
    and only lend their values there.
    """
    k, by = smoothing_span(n), by or []
    if k is None:
        return series.withColumn("smooth", F.lit(None).cast("double"))
    size = max(BLOCK, 4 * k)
    block, end = F.floor(F.col("_ix") / F.lit(size)), F.col("_ix") % size >= size - k
    homes = F.when(end, F.array(block, block + 1)).otherwise(F.array(block))
    rows = _ranked(series, order, by).select("*", F.posexplode(homes).alias("_lent", "_block"))
    w = Window.partitionBy(*by, "_block").orderBy("_ix").rowsBetween(-k, 0)
    return rows.withColumn("smooth", F.avg(value).over(w)).filter("_lent = 0").select(*series.columns, "smooth")


def best_epoch(val: DataFrame, epoch: str = "i", loss: str = "loss", by: list[str] | None = None) -> DataFrame:
    """The first epoch of the least loss, that loss, and whether losses never rise.

    Losses are compared within ranges of epochs, then the last of each range with the first of
    the next; only a row a range meets in one place.
    """
    by = by or []
    at = F.struct(F.col(epoch).alias("e"), F.col(loss).alias("l"))
    rows = val.withColumn("_part", F.floor(F.col(epoch) / F.lit(RANGE)))
    rows = rows.withColumn("_up", F.col(loss) > F.lag(loss).over(Window.partitionBy(*by, "_part").orderBy(epoch, loss)))
    parts = rows.groupBy(*by, "_part").agg(
        F.bool_or("_up").alias("_up"), F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e"))).alias("m"),
    )
    over = F.lag("_last.l").over(Window.partitionBy(*by).orderBy("_part"))
    ends = parts.withColumn("_rise", F.coalesce("_up", F.lit(False)) | F.coalesce(F.col("_first.l") > over, F.lit(False)))
    g = ends.groupBy(*by) if by else ends.groupBy()
    df = g.agg(F.min("m").alias("m"), F.bool_or("_rise").alias("_rise"), F.sum("_n").alias("_n")).filter("_n > 0")
    trend = F.when(~F.col("_rise"), "descending").when(F.col("_n") > 1, "oscillating").otherwise("one point")
    return df.select(*by, F.col("m.e").alias("best_epoch"), F.col("m.l").alias("best_loss"), trend.alias("trend"))


def run_name(prefix: str = "run") -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))

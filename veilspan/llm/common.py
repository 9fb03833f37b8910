"""Shared plumbing: staged tables in the cluster's shared folder, hot-key joins, sizes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship

#: Rows of a document batch sent to a Python worker hold at most about this many bytes.
BATCH_BYTES = 4 << 20


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = (), codec: str = "zstd", into: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing.

    With `into`, df is added to what that folder holds.
    """
    spark = df.sparkSession
    path = into or scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.mode("append").option("compression", codec).partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veilspan_path = path
    return out


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes within drop their shuffle files once they are done; the session's setting is as before after it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def collected(df: DataFrame) -> list:
    """A result of bounded size, by way of the shared folder: its tasks run once whatever is lost meanwhile."""
    done = stage(df, "collected")
    rows = done.collect()
    unstage(done)
    return rows


def unstage(*tables: DataFrame, part: str = "") -> None:
    """Delete staged tables, or one partition folder of each, that nothing lazy reads any more."""
    for df in tables:
        _delete(df, part)


def _delete(df: DataFrame, part: str) -> None:
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(f"{df._veilspan_path}/{part}".rstrip("/"))
    p.getFileSystem(conf).delete(p, True)


def tune(spark: SparkSession) -> None:
    """Send the package to workers, and bound Arrow batches by bytes as well as rows, so that
    long texts do not fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """df's rows whole, as _row, beside computed columns: no name of df can clash with theirs."""
    return df.select(F.struct("*").alias("_row"), *(c.alias(k) for k, c in columns.items()))


def give_back() -> None:
    """Return a worker's free memory to the system: workers wait for more tasks between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's bytes, from file sizes; counted if there is none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n >= 1 << 55:  # an in-memory relation has no estimate
        texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
        total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8)).cast("long")
        n = int(df.agg(F.sum(total)).first()[0] or 0)
    return n


def parts_for(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    return max(least, -(-input_bytes(df) // bytes_each))


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], count_col: str, total: int, share: int = 1000, how: str = "left") -> DataFrame:
    """Join (left or inner) of rows with per-key stats where one key may hold a third of all rows.

    A key with at least total/share rows is hot; there can be at most `share` of those, so
    their stats are broadcast and their rows never shuffle. All other keys hold few rows
    each and meet in an ordinary shuffle join. stats must have one row per key.
    """
    floor = max(2, -(-total // share))
    names = [c for c in stats.columns if c not in keys]
    hot = F.broadcast(stats.filter(F.col(count_col) >= floor).withColumn("_hot", F.lit(True)))
    cold = stats.filter(F.col(count_col) < floor)
    marked = rows.join(hot, list(keys), "left")
    there = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns)
    return there.select(*rows.columns, *names).unionByName(rest.join(cold, list(keys), how).select(*rows.columns, *names))

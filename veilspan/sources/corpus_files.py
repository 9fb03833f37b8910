"""Corpus files: JSON records in folders, JSON lines, whole texts; and the writers for them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITIES = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
RECORD = T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StructType([T.StructField("entities", ENTITIES)]))])
_READ = T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])


def file_name() -> Column:
    """The name of a row's file; Spark gives it as a part of a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_split(spark: SparkSession, folder: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records: file, input, entities, split; rejects: file, reason) of all JSON files below a
    folder, one record each, `example.json` left out. A file that does not parse, or lacks
    input or output, is a reject."""
    raw = spark.read.schema(_READ).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(folder)
    named = raw.select(file_name().alias("file"), "input", "output", "_corrupt_record").filter("file <> 'example.json'")
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "not JSON")
        .when(F.col("input").isNull(), "no input")
        .when(F.col("output").isNull(), "no output")
    )
    marked = named.withColumn("reason", reason)
    records = marked.filter("reason IS NULL").select("file", "input", F.coalesce("output.entities", F.create_map().cast(ENTITIES)).alias("entities"), F.lit(split).alias("split"))
    return records, marked.filter("reason IS NOT NULL").select("file", "reason")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of text files: lines are numbered from 0 through all files in order of
    path, as one after the other.

    A split's lines are ranked among themselves and start after the lines of all splits before
    it, so no task holds a whole file. Empty lines count, as they do in the files.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), file_name().alias("file"), F.col("_metadata.file_block_start").alias("_b"), "value")
    sizes = raw.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    base = sizes.select(F.col("_f").alias("_bf"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_at")) - 1
    ranked = raw.withColumn("_at", F.monotonically_increasing_id()).withColumn("_r", inside)  # _at only orders a split's lines
    joined = ranked.join(base, (F.col("_f") == F.col("_bf")) & (F.col("_b") == F.col("_bb")))
    return joined.select("file", (F.col("_base") + F.col("_r")).alias("line"), "value")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """line, gold_ix, text, label of a JSON-lines gold file. A line's number is its place in the
    file, or its own `line` key where it has one; labels become canonical, and an unknown one is
    an error."""
    from ..operators.vocab import canon_of_model

    schema = T.StructType([T.StructField("line", T.LongType()), *RECORD.fields])
    lines = numbered_lines(spark, path).select("line", F.from_json("value", schema).alias("r"))
    own = F.coalesce("r.line", "line").alias("line")
    by_label = lines.select(own, F.posexplode(F.map_entries("r.output.entities")).alias("k", "e"))
    rows = by_label.select("line", "k", "e.key", F.posexplode("e.value").alias("n", "text"))
    order = F.row_number().over(_by_line()) - 1
    return rows.select("line", order.alias("gold_ix"), "text", canon_of_model(F.col("key")).alias("label"))


def _by_line():
    return Window.partitionBy("line").orderBy("k", "n")


def read_redacted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("line int, redacted string").json(path)


def read_judged(spark: SparkSession, folder: str, method: str = "finetuned") -> DataFrame:
    """line, n, type, value of a method's judge shards. The default method's names have no
    method in them, so the other methods' files are left out of its shards."""
    schema = "assessed int, leaked_lines array<int>, details array<struct<line:int,type:string,value:string>>"
    glob = "judge_result_*.json" if method == "finetuned" else f"judge_result_{method}_*.json"
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(folder).withColumn("_f", F.col("_metadata.file_name"))
    if method == "finetuned":
        df = df.filter(~F.col("_f").rlike("judge_result_(baseline|rulebased)_"))
    return df.select(F.posexplode("details").alias("n", "d")).select("d.line", "n", "d.type", "d.value")


def read_account_detail(spark: SparkSession, path: str) -> DataFrame:
    """line, value, digits, total, redacted, labels of account-detail files: JSON lines, or an
    array of such records on one line."""
    schema = "line int, vals array<struct<v:string,digits:int,total:int,red:int,labels:map<string,int>>>"
    df = spark.read.schema(schema).json(path)
    return df.select("line", F.explode("vals").alias("x")).select("line", F.col("x.v").alias("value"), "x.digits", "x.total", F.col("x.red").alias("redacted"), "x.labels")


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """The reference bank: one row, the whole text."""
    return spark.read.text(path, wholetext=True)


def write_records(records: DataFrame, path: str, mode: str = "error") -> None:
    """{"input", "output": {"entities"}} lines; characters beyond ASCII stay as they are."""
    line = F.to_json(F.struct("input", F.struct("entities").alias("output")))
    records.select(line.alias("value")).write.mode(mode).text(path)


def write_by_key(records: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """JSON files in a folder for each key."""
    records.repartition(key).write.mode(mode).partitionBy(key).json(path)


def write_record_files(records: DataFrame, folder: str, name_col: str = "file") -> int:
    """<folder>/<name> for each record (name, input, entities), as read_split reads them; returns how many.

    Tasks write their own files, so a task that runs again writes the same bytes again. Names
    must be plain (no folder, no leading dot or underscore, which Spark would not read) and each may
    occur once; others are an error before anything is written. The
    folder is a path or URI that every executor reaches. Null inputs count as empty.
    """
    name = F.col(name_col)
    bad = records.groupBy(name.alias("name")).count().filter((F.col("count") > 1) | F.col("name").isNull() | F.col("name").rlike(r"/|^[._]|^$")).limit(1).collect()
    if bad:
        raise ValueError(f"not a file name for one record: {bad[0]['name']!r}")
    line = F.to_json(F.struct(F.coalesce("input", F.lit("")).alias("input"), F.struct(F.coalesce("entities", F.create_map().cast(ENTITIES)).alias("entities")).alias("output")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_output_stream(f"{base}/{own}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return records.select(name.alias("name"), line.alias("line")).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_redacted(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select("line", "redacted").write.mode(mode).json(path)


def write_account_detail(survival: DataFrame, path: str, key: str = "line", mode: str = "error", calls: DataFrame | None = None) -> None:
    """A line for each call with its values; with calls (key), those whose values never occur
    have a line too, with an empty list."""
    vals = F.collect_list(F.struct(F.col("value").alias("v"), "digits", "total", F.col("redacted").alias("red"), "labels"))
    out = survival.groupBy(F.col(key).alias("line")).agg(F.array_sort(vals, lambda a, b: F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)).alias("vals"))
    if calls is not None:
        every = calls.select(F.col(key).alias("line")).distinct()
        out = every.join(out, "line", "left").select("line", F.coalesce("vals", F.filter("vals", lambda x: F.lit(False)), F.array().cast(out.schema["vals"].dataType)).alias("vals"))
    out.write.mode(mode).json(path)


def read_account_calls(spark: SparkSession, path: str) -> DataFrame:
    """line and number of values of every line of an account-detail file, empty ones too."""
    schema = "line int, vals array<struct<v:string>>"
    return spark.read.schema(schema).json(path).select("line", F.size("vals").alias("n_values"))


def write_shards(lines: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Rows with a shard column, one folder a shard; shards that `done` (shard) holds are kept
    as they are, so an interrupted run goes on where it stopped."""
    todo = lines if done is None else lines.join(F.broadcast(done.select("shard").distinct()), "shard", "left_anti")
    todo.write.mode("append").partitionBy("shard").json(path)


def write_methods(df: DataFrame, path: str, method_col: str = "method", mode: str = "error") -> None:
    """One folder for each method, in place of suffixes in file names."""
    df.write.mode(mode).partitionBy(method_col).json(path)

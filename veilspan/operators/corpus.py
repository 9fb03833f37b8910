"""Corpus preparation: label counts, split checks, and the rule that gold occurs as listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import fixed as X
from . import textwise

MODEL_LABELS = [x[0] for x in X.LABELS]


def mentions(records: DataFrame, key: str = "doc_id", entities_col: str = "entities") -> DataFrame:
    """key, label, n, text: one row per listed mention; repeats are meaningful and stay."""
    by_label = records.select(key, F.explode(F.map_entries(entities_col)).alias("e"))
    return by_label.select(key, F.col("e.key").alias("label"), F.posexplode("e.value").alias("n", "text"))


#: Keys of records that one task of label_report holds.
RECORDS_PER_TASK = 50_000


def label_report(records: DataFrame, key: str = "doc_id", entities_col: str = "entities", labels: list[str] = MODEL_LABELS) -> DataFrame:
    """label, mentions, files for every label in the list; missing ones count nothing.

    Files are distinct keys, so records of one key meet: one row a record, in as many tasks as
    there are records to hold, so that none holds more as there are more. Records are counted
    first, by their keys alone. Those without a key are no file; they are spread out.
    """
    tasks = max(records.sparkSession.sparkContext.defaultParallelism, -(-records.count() // RECORDS_PER_TASK))
    sizes = [F.nullif(F.array_size(F.col(entities_col)[x]), F.lit(0)).alias(f"_{i}") for i, x in enumerate(labels)]
    apart = F.when(F.col(key).isNull(), F.monotonically_increasing_id() % tasks).alias("_apart")
    met = records.select(F.col(key).alias("_key"), apart, *sizes).repartition(tasks, "_key", "_apart").groupBy("_key", "_apart")
    own = met.agg(*(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(labels))))
    file = lambda i: F.col("_key").isNotNull() & F.col(f"_{i}").isNotNull()
    sums = [F.struct(F.lit(x).alias("label"), F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias("mentions"), F.count_if(file(i)).alias("files")) for i, x in enumerate(labels)]
    return own.agg(F.array(*sums).alias("_s")).select(F.inline("_s"))


def missing_labels(records: DataFrame, key: str = "doc_id", entities_col: str = "entities", labels: list[str] = MODEL_LABELS) -> DataFrame:
    return label_report(records, key, entities_col, labels).filter("mentions = 0").select("label")


def split_report(records: DataFrame, text_col: str = "input", entities_col: str = "entities", split_col: str = "split") -> DataFrame:
    """Per split: records, mean characters (rounded), mentions, records without any entity."""
    total = F.aggregate(F.map_values(entities_col), F.lit(0), lambda a, v: a + F.size(v))
    df = records.select(split_col, F.length(text_col).alias("_n"), total.alias("_m"))
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("_n"), 0).cast("long").alias("mean_chars"), F.sum("_m").alias("mentions"), F.count_if(F.col("_m") == 0).alias("zero_entity"))


def shared_inputs(left: DataFrame, right: DataFrame, text_col: str = "input") -> DataFrame:
    """MD5 of inputs that stand in both; an empty result means the splits are disjoint."""
    h = lambda df: df.select(F.md5(F.col(text_col).cast("binary")).alias("md5"))
    return h(left).join(h(right), "md5", "left_semi").distinct()


def standalone_counts(text: Column, values: Column) -> Column:
    """array<struct<value,n>>: occurrences of each distinct value with no letter or digit at
    either side, longest values first (then by value), leaving out those inside a span that a
    longer value took. Trailing punctuation of a value does not count."""
    return textwise.standalone_column(SparkSession.active(), text, values)


def gold_problems(records: DataFrame, key: str = "doc_id", text_col: str = "input", entities_col: str = "entities", labels: list[str] = MODEL_LABELS) -> DataFrame:
    """key, problem (`count` or `label`), value, listed, occurs: where gold and text disagree."""
    text, entities = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(entities_col), F.create_map().cast("map<string,array<string>>"))
    values = F.flatten(F.map_values(entities))
    df = records.select(key, values.alias("_v"), standalone_counts(text, values).alias("_c"), F.array_except(F.map_keys(entities), F.array(*map(F.lit, labels))).alias("_u"))
    count = F.transform("_c", lambda c: F.struct(F.lit("count").alias("problem"), c["value"].alias("value"), F.size(F.filter("_v", lambda v: v == c["value"])).alias("listed"), c["n"].alias("occurs")))
    unknown = F.transform("_u", lambda u: F.struct(F.lit("label").alias("problem"), u.alias("value"), F.lit(0).alias("listed"), F.lit(0).alias("occurs")))
    every = F.concat(F.filter(count, lambda c: c["listed"] != c["occurs"]), unknown)
    return df.select(key, F.explode(every).alias("x")).select(key, "x.*")


def clean_counts(records: DataFrame, problems: DataFrame, key: str = "doc_id") -> DataFrame:
    """is_clean, n: records without and with problems."""
    bad = problems.select(key).distinct().withColumn("_bad", F.lit(True))
    return records.select(key).join(bad, key, "left").groupBy(F.col("_bad").isNull().alias("is_clean")).agg(F.count(F.lit(1)).alias("n"))


def shards(lines: DataFrame, total: int | DataFrame, pieces: int = 8, line_col: str = "line") -> DataFrame:
    """lines with a shard: contiguous slices of ceil(total / pieces) lines. total is a number, or
    a table of one number, which is then worked out in the same query."""
    n = total.scalar() if isinstance(total, DataFrame) else F.lit(total)
    return lines.withColumn("shard", F.floor(F.col(line_col) / F.ceil(n / F.lit(pieces))).cast("int"))


def report_ranks(lines: DataFrame, order_col: str = "line", bucket: int = 1 << 16) -> DataFrame:
    """lines with rank, 1 for the smallest, without sorting all of them in one task: rows are
    counted by range of the order column, and ranked within their range."""
    part = F.floor(F.col(order_col) / F.lit(bucket)).alias("_part")
    sizes = lines.groupBy(part).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    ranked = lines.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(order_col)))
    return ranked.join(before, "_part").withColumn("rank", F.col("_before") + F.col("_n")).drop("_part", "_before", "_n")


def letter_focus(index: Column) -> Column:
    """The three letters a generator's nth record should favour."""
    return F.transform(F.array(F.lit(0), F.lit(9), F.lit(18)), lambda k: F.char(F.lit(65) + (index + k) % 26))


def slug(text: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")), 1, 48)


def transcripts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One text per conversation: its turns in order, `role: text`, joined by line ends."""
    line = F.concat(F.coalesce(role, F.lit("unknown")), F.lit(": "), F.coalesce(text, F.lit("")))
    own = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l"))))
    return turns.groupBy(conv).agg(F.array_join(F.transform(own, lambda x: x["l"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_turns"))

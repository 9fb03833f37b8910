"""Redaction on streams: the rule chain row by row, and values remembered by conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.redact import tagged
from ..operators.windows import document_spans, rules_detector
from ..session import ship


def redact_stream(calls: DataFrame, text_col: str = "text") -> DataFrame:
    """Streaming or batch rows with `redacted`. No state: every row stands alone."""
    df = document_spans(calls, rules_detector(), text_col, "_spans")
    return df.withColumn("redacted", tagged(F.coalesce(F.col(text_col), F.lit("")), F.col("_spans"))).drop("_spans")


def read_calls(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there to a Parquet sink and stop; a restart goes on after it.

    Batches without data are off: with timers they would go on for ever.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


class ValueMemory(StatefulProcessor):
    """Per conversation, values found in earlier turns are masked where they come again.

    Each row brings its text and the values found in it; all rows of a conversation in a trigger
    are taken in order of turn. A value is kept `ttl_ms`, so state is bounded by the conversations
    of that time.
    """

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "label string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        import re

        batches = list(rows)  # what one trigger brings of one conversation
        if not batches:
            return
        turns = pd.concat(batches).sort_values("turn", kind="stable")
        known = {k[0]: v[0] for k, v in self.seen.iterator()}
        pattern, out = None, []
        for turn, text, found in zip(turns["turn"].tolist(), turns["text"].tolist(), turns["found"].tolist()):
            new = {f["value"]: f["label"] for f in found if known.get(f["value"]) != f["label"]}
            for value, label in new.items():
                self.seen.updateValue((value,), (label,))
            if new or (pattern is None and known):  # longer values first, all in one pattern
                known |= new
                values = sorted(known, key=lambda v: (-len(v), v))
                pattern = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, values))})(?![A-Za-z0-9])")
            out.append((key[0], turn, pattern.sub(lambda m: f"<{known[m[0]]}>", text) if pattern else text))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "redacted"])

    def close(self) -> None:
        pass


def redact_conversations(turns: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """A stream of turns (conv_id, turn, text) with values masked from the turn that names them on."""
    from ..operators.predicates import propagates

    ship(turns.sparkSession)
    marked = document_spans(turns, rules_detector(), "text", "_spans")
    own = F.transform(F.filter("_spans", lambda m: propagates(m["text"], m["label"])), lambda m: F.struct(m["text"].alias("value"), m["label"].alias("label")))
    rows = marked.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), own.alias("found"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    turn = turns.schema["turn"].dataType.simpleString()
    return rows.groupBy("conv_id").transformWithStateInPandas(ValueMemory(ttl_ms), f"conv_id {kind}, turn {turn}, redacted string", "Append", "processingTime")

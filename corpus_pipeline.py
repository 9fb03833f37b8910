"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bpe as _bpe
from veilspan.llm import exact_dedup as _exact
from veilspan.llm import langid as _langid
from veilspan.llm import mixing as _mixing
from veilspan.llm import queries as _queries
from veilspan.llm import simhash as _simhash

#: A document whose largest language has less than this share is rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a main language go: no text, no letter, or no language with half of it."""
    marked = _langid.with_language(docs.withColumns({"_in": F.struct("*")}).select("_in", "text"), _langid.train(docs))
    kept = marked.filter((F.col("lang_pred") != _langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select("_in.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row with the largest doc_id stays."""
    return _exact.drop_copies(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays."""
    return _simhash.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters of the tokens, shared by the target weights. One epoch at most, so that
    no copies return; the document a leaf's budget ends in is cut there."""
    mixed = _mixing.mix(docs, fraction=(3, 4), weights=_queries.WEIGHTS, max_epochs=1, seed=7, with_text=True)
    lengths = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.withColumn("n_chars", lengths).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again: counts and digests of both. Blocks are small,
    since executors still hold what the stages before left."""
    return _bpe.round_trip(docs, _queries.tokenizer_path("byte_bpe_50k.json"), block_bytes=4 << 20)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash", simhash), ("mixing", mixing), ("bpe", bpe)]

#: The language model, fingerprints and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is staged, as the stages are run one by one."""
    from veilspan.llm.common import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

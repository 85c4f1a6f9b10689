"""A corpus pipeline of five operators, from raw documents to sharded training positions.

Language ID drops documents without a letter and those no language's regression comes near;
the n-gram Jaccard join keeps one document of each group of near copies; decontamination drops
documents that contain a benchmark item; mixing repeats or cuts sources to their targets; and
sharding deals what is left over 24 shards of near equal bytes, with the documents themselves.

Edge cases: null texts have no language and go in the first stage; null ids, repeated rows and
extra columns pass through every stage, the last of which replaces columns that have its own
columns' names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, language_id, mixing, ngram_join, sharding
from tracemill.llm.common import table, written

#: Below this score every one-versus-rest value is clearly negative.
MIN_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, MIN_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.dealt(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Language identification is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

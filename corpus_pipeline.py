"""The corpus pipeline: stages over documents, each written and read again as Parquet."""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import bpe, decontaminate, jaccard_join, language_id, pii
from plumbline.session import shared_dir

#: Rows that Arrow hands to Python at once.  Spark's 10,000 are over 50 MB of texts, which the JVM
#: and the Python worker of each running task hold at the same time.
ARROW_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _few_at_once(stage):
    """``stage`` with at most ``ARROW_ROWS`` rows in a batch.  A stage runs when its result is
    written, so the session keeps the setting."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= ARROW_ROWS:  # 0 and less: no bound
            spark.conf.set(_ARROW_ROWS, ARROW_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@_few_at_once
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; ``lang`` is what the text says."""
    found = language_id.identify(docs, language_id.learn(docs))
    return found.where(~F.col("rejected")).select(
        *[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


@_few_at_once
def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


@_few_at_once
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_few_at_once
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


@_few_at_once
def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of all documents."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("similar", drop_similar),
    ("benchmark", drop_benchmark_leaks),
    ("personal", redact_personal_data),
    ("encode", encode_bpe),
]

#: Compression, subset joins, a singular value decomposition and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    before = spark.conf.get(_ARROW_ROWS)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    return docs

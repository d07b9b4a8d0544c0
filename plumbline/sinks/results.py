"""Storing run results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

PRIMARY_KEY = ["run_id", "schema_name", "table_name", "dqmethod", "col"]
STORED_SCHEMA = (
    "run_id string, schema_name string, table_name string, dqmethod string, col string, "
    "status string, run_timestamp timestamp_ntz, failed_count long, rule_seq long"
)
# Columns of the stored results table, in order; the rule's number follows, so
# that failing rows find the result of their own rule.
STORED = [*PRIMARY_KEY, "status", "run_timestamp", "failed_count", "rule_seq"]


def keep_last(results: DataFrame) -> DataFrame:
    """One result per stored key: of rules that look the same, the last one wins.

    An aggregate with map-side combine; rule numbers are unique within a run.
    """
    others = [c for c in results.columns if c not in PRIMARY_KEY]
    return (
        results.groupBy(*PRIMARY_KEY)
        .agg(F.max_by(F.struct(*others), "rule_seq").alias("last"))
        .select(*PRIMARY_KEY, "last.*")
        .select(*results.columns)
    )


def stored_form(results: DataFrame) -> DataFrame:
    """The columns of the stored results table."""
    return results.withColumn("failed_count", F.coalesce("failed_count", F.lit(0).cast("long"))).select(*STORED)


def save_results(results: DataFrame, path: str) -> None:
    """Add a run's results to the store, a folder per run.

    Writing a run again replaces it, so a retried job leaves no duplicates.
    """
    (
        stored_form(keep_last(results))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The stored results.  Filters on ``run_id`` read only that run's folder."""
    return spark.read.schema(STORED_SCHEMA).parquet(path).select(*STORED)


def save_results_jdbc(results: DataFrame, url: str, table: str, properties: Mapping[str, str]) -> None:
    """Append a run's results to a database table."""
    stored_form(keep_last(results)).drop("rule_seq").write.mode("append").option("batchsize", "10000").jdbc(
        url, table, properties=dict(properties)
    )

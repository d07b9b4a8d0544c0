"""Row-local rules over a stream of increments.

Each micro-batch is checked like a small table.  Its results and failing rows go to
folders named after the batch and are overwritten if the batch is replayed, so a
lost driver or executor never counts a batch twice.  Rules over the whole table are kept
as state by ``streaming.accumulated`` or left to a batch run over the accumulated table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from plumbline.operators import KINDS, ROW_LOCAL
from plumbline.plans.rule import RECORD_SCHEMA, RESULT_SCHEMA, Rule, Run, TableSource
from plumbline.plans.ruleset import TableRun, compile_table, number_rules, results_frame

RULE_KEY = ["run_id", "schema_name", "table_name", "rule_seq", "dqmethod"]


def split_rules(rules: Sequence[Rule]) -> tuple[list[Rule], list[Rule]]:
    """Rules an increment can be checked against alone, and rules that need the whole table."""
    if not any(r.rule_seq for r in rules):
        rules = number_rules(rules)
    local = [r for r in rules if KINDS.get(r.dqmethod.lower(), r.dqmethod) in ROW_LOCAL]
    return local, [r for r in rules if r not in local]


def check_stream(
    stream: DataFrame,
    rules: Sequence[Rule],
    out: str,
    run: Run | None = None,
    source: TableSource | None = None,
    keep_rows: bool = True,
    **trigger,
) -> StreamingQuery:
    """Start checking ``stream``; ``trigger`` is passed on, e.g. ``availableNow=True``."""
    run = run or Run.start()
    local, _ = split_rules(rules)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows, table = compile_table(batch, local, run, source).settled()
        results = results_frame(batch.sparkSession, rows).coalesce(1)
        results.write.mode("overwrite").parquet(f"{out}/results/batch_id={batch_id}")
        if keep_rows:
            table.failed_records().write.mode("overwrite").json(f"{out}/failed/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def check_whole(
    table: DataFrame, rules: Sequence[Rule], run: Run | None = None, source: TableSource | None = None
) -> TableRun:
    """The rules left out by ``check_stream``, over the accumulated table."""
    _, whole = split_rules(rules)
    return compile_table(table, whole, run, source)


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Counts summed over all increments, one row per rule.

    An increment in which the rule ended in an error still counts its rows (all rules of an
    increment see the same); ``error_batches`` says in how many it did, and failed and passed
    counts cover the others.
    """
    batches = spark.read.schema(RESULT_SCHEMA + ", batch_id long").parquet(f"{out}/results")
    batch = Window.partitionBy("run_id", "schema_name", "table_name", "batch_id")  # a row for each rule
    batches = batches.withColumn("batch_rows", F.max("total_count").over(batch))
    errors = F.count_if(F.col("status") == "Error")
    failed = F.sum("failed_count")
    status = F.when(errors > 0, "Error").when(failed > 0, "Failed").otherwise("Success")
    label = F.max(F.when(F.col("col") != "N/A", F.col("col")))  # error rows have none
    return batches.groupBy(*RULE_KEY).agg(
        F.coalesce(label, F.lit("N/A")).alias("col"),
        status.alias("status"),
        F.min("run_timestamp").alias("run_timestamp"),
        F.sum("batch_rows").alias("total_count"),
        failed.alias("failed_count"),
        F.sum("passed_count").alias("passed_count"),
        errors.alias("error_batches"),
    )


def failed_records(spark: SparkSession, out: str) -> DataFrame:
    """Failing rows of all increments."""
    return spark.read.schema(RECORD_SCHEMA + ", batch_id long").json(f"{out}/failed")

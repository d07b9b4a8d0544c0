"""Whole-table rules over a stream of increments.

Each micro-batch leaves a small state that can be added up: rows per key for keyed rules,
one row of aggregates for table rules.  A verdict on everything seen so far is made from
the states alone; no increment is read again.  A batch's state lies in folders named after
the batch and is overwritten when the batch is replayed, so nothing is counted twice.

Comparing texts of two tables needs both tables and is left to ``check_whole``; so are
failing rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.keys import quoted
from plumbline.operators import KeyedCheck, SchemaValidation
from plumbline.plans.rule import RESULT_SCHEMA, Rule, Run, TableSource
from plumbline.plans.ruleset import Compiled, TableRun, compile_table, union, verdict_columns, verdict_row
from plumbline.streaming.incremental import split_rules

NOT_MERGEABLE = "the rule's state cannot be added up over increments; check the whole table"


def _planned(df: DataFrame, rules: Sequence[Rule], run: Run | None, source: TableSource | None):
    """The table's whole-table rules, those of keys apart, and those no state can be kept for."""
    _, whole = split_rules(rules)
    table = compile_table(df, whole, run, source)
    keyed = [c for c in table.compiled if isinstance(c.check, KeyedCheck)]
    # Seen from the method, not from a call, which would plan a query for each rule.
    mergeable = [c for c in keyed if type(c.check).key_counts is not KeyedCheck.key_counts]
    others = [c for c in table.compiled if c not in keyed]
    return table, mergeable, others, [c for c in keyed if c not in mergeable]


def _aggregates(others: Sequence[Compiled], schema: T.StructType) -> list:
    parts = [F.count(F.lit(1)).alias("total")]
    for c in others:
        parts += [p.alias(f"r{c.rule.rule_seq}_{n}") for n, p in c.check.parts(schema).items()]
    return parts


def keep_batch(batch: DataFrame, batch_id: int, rules: Sequence[Rule], out: str, source: TableSource | None = None) -> None:
    """Write one increment's state, replacing what an earlier attempt left of it."""
    _, keyed, others, _ = _planned(batch, rules, None, source)
    batch.agg(*_aggregates(others, batch.schema)).write.mode("overwrite").parquet(f"{out}/table/batch_id={batch_id}")
    for c in keyed:
        counts = c.check.key_counts(batch)
        counts.write.mode("overwrite").parquet(f"{out}/keys-{c.rule.rule_seq}/batch_id={batch_id}")


def accumulate_stream(
    stream: DataFrame, rules: Sequence[Rule], out: str, source: TableSource | None = None, **trigger
) -> StreamingQuery:
    """Start keeping the state of ``stream``'s whole-table rules below ``out``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        keep_batch(batch, batch_id, rules, out, source)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def accumulated(
    spark: SparkSession,
    schema: T.StructType,
    rules: Sequence[Rule],
    out: str,
    run: Run | None = None,
    source: TableSource | None = None,
) -> DataFrame:
    """Verdicts on all increments so far, one row per whole-table rule.

    ``schema`` is the stream's.  A rule whose state cannot be kept is an ``Error`` row.
    """
    empty = spark.createDataFrame([], schema)
    table, keyed, others, refused = _planned(empty, rules, run, source)
    errors = [*table.errors, *[(c.rule, NOT_MERGEABLE) for c in refused]]
    frames = [_table_verdicts(spark, table, others, schema, out)] if others else []
    frames += [_key_verdict(spark, table, c, empty, out) for c in keyed]
    if errors:
        frames.append(TableRun(empty, table.run, table.schema_name, table.table_name, (), tuple(errors)).results())
    return union(frames) if frames else spark.createDataFrame([], RESULT_SCHEMA)


def _table_verdicts(spark, table: TableRun, others: Sequence[Compiled], schema: T.StructType, out: str) -> DataFrame:
    state_schema = spark.createDataFrame([], schema).agg(*_aggregates(others, schema)).schema
    state = spark.read.schema(state_schema).parquet(f"{out}/table")
    total = F.coalesce(F.sum("total"), F.lit(0))
    wide, rows = [total.alias("total")], []
    for c in others:
        check = c.check.bound(schema) if isinstance(c.check, SchemaValidation) else c.check
        name = f"r{c.rule.rule_seq}"
        merged = check.merged({n: F.col(f"{name}_{n}") for n in check.parts(schema)})
        wide += [m.alias(f"{name}_{n}") for n, m in merged.items()]
        verdict = check.verdict(F.col("total"), {n: F.col(f"{name}_{n}") for n in merged})
        rows.append(verdict_row(
            c.rule, check.label(), check.result_name(), verdict.passed, F.col("total"),
            verdict.failed_count, verdict.passed_count, verdict.details))
    return table.finished(state.agg(*wide).select(F.inline(F.array(*rows))))


def _key_verdict(spark, table: TableRun, c: Compiled, empty: DataFrame, out: str) -> DataFrame:
    counted = c.check.key_counts(empty)
    state = spark.read.schema(counted.schema).parquet(f"{out}/keys-{c.rule.rule_seq}")
    keys = [quoted(name) for name in counted.columns if name != "n"]
    verdict = c.check.judged(state.groupBy(*keys).agg(F.sum("n").alias("n")))
    names = ("passed", "total_count", "failed_count", "passed_count", "details")
    return table.finished(verdict.select(
        *verdict_columns(c.rule, c.check.label(), c.check.result_name(), *[F.col(n) for n in names])))

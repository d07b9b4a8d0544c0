"""Summaries, trends, pages and drill-down over stored results.

Every function takes the results as stored (see ``sinks.results``) and returns a
DataFrame; counts by status are conditional aggregates, so each is one pass with
map-side combine.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.errors import RuleConfigError
from plumbline.operators import METHODS
from plumbline.operators.joins import attach

STATUSES = ("Success", "Failed", "Error")
BUCKETS = ("hour", "day", "week")
# How bad a status is.
SEVERITY = {"Success": 0, "Failed": 1, "Error": 2}
DRILL_KEY = ["run_id", "schema_name", "table_name", "dqmethod", "col"]


def _rows() -> Column:
    return F.count(F.lit(1))


def _with_status(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def select_results(
    results: DataFrame, run_id: str = "", table: str = "", method: str = "", status: str = "",
    from_ts: str = "", to_ts: str = "",
) -> DataFrame:
    """Results that meet all the given conditions; an empty text means any."""
    equal = {"run_id": run_id, "table_name": table, "dqmethod": method, "status": status}
    wanted = [F.col(c) == v for c, v in equal.items() if v]
    if from_ts:
        wanted.append(F.col("run_timestamp") >= F.lit(from_ts).cast("timestamp_ntz"))
    if to_ts:
        wanted.append(F.col("run_timestamp") <= F.lit(to_ts).cast("timestamp_ntz"))
    return results.filter(reduce(lambda a, b: a & b, wanted)) if wanted else results


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        _rows().alias("total_evals"),
        _with_status("Success").alias("passed"),
        _with_status("Failed").alias("failed"),
        _with_status("Error").alias("errors"),
        F.coalesce(F.sum("failed_count"), F.lit(0)).alias("total_failed_records"),
    )


def status_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        _rows().alias("total"),
        _with_status("Success").alias("success"),
        _with_status("Failed").alias("failed"),
        _with_status("Error").alias("error"),
    )


def by_method(results: DataFrame) -> DataFrame:
    """Results per check method and status, zero where there are none."""
    return results.groupBy("dqmethod").agg(*[_with_status(s).alias(s) for s in STATUSES])


def trend(results: DataFrame, bucket: str = "hour") -> DataFrame:
    """Results per time bucket and status; weeks start on Monday."""
    if bucket not in BUCKETS:
        raise RuleConfigError(f"bucket must be one of {BUCKETS}")
    ts = F.col("run_timestamp").cast("timestamp_ntz")
    day = ts.cast("date")
    # date_trunc would go through the session's time zone, where some hours do not exist.
    ts = F.expr("make_timestamp_ntz(year(ts), month(ts), day(ts), hour(ts), 0, 0)".replace("ts", "run_timestamp")) \
        if bucket == "hour" else (day if bucket == "day" else F.trunc(day, bucket)).cast("timestamp_ntz")
    return results.groupBy(ts.alias("ts")).agg(*[_with_status(s).alias(s) for s in STATUSES]).orderBy("ts")


def run_list(results: DataFrame, limit: int = 50) -> DataFrame:
    """The latest runs with their start, number of checks and failures."""
    return (
        results.groupBy("run_id")
        .agg(F.min("run_timestamp").alias("started_at"), _rows().alias("total"), _with_status("Failed").alias("failed"))
        .orderBy(F.desc("started_at"), "run_id")
        .limit(limit)
    )


def latest_run(results: DataFrame) -> DataFrame:
    """The run that started last."""
    starts = results.groupBy("run_id").agg(F.min("run_timestamp").alias("started_at"))
    return starts.agg(F.max(F.struct("started_at", "run_id")).alias("last")).select("last.run_id", "last.started_at")


def health_matrix(results: DataFrame) -> DataFrame:
    """A row per table, a column per method: the worst status seen, null if never run."""
    severity = reduce(lambda c, s: c.when(F.col("status") == s, SEVERITY[s]), STATUSES, F)
    worst = results.groupBy("table_name").agg(
        *[F.max(F.when(F.col("dqmethod") == m, severity)).alias(m) for m in METHODS]
    )
    names = F.array(*[F.lit(s) for s in sorted(SEVERITY, key=SEVERITY.get)])
    return worst.select("table_name", *[F.get(names, F.col(m)).alias(m) for m in METHODS])


def kpis(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Headline numbers as (kpi, value, pct); shares are 0 where there is nothing to share."""

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0))

    def rows(df: DataFrame, parts: Mapping[str, str | None]) -> DataFrame:
        cells = [
            F.struct(
                F.lit(name).alias("kpi"),
                F.col(name).alias("value"),
                (share(name, whole) if whole else F.lit(None).cast("double")).alias("pct"),
            )
            for name, whole in parts.items()
        ]
        return df.select(F.inline(F.array(*cells)))

    counted_rules = rules.agg(_rows().alias("total_rules"), F.count_if("is_active").alias("active_rules"))
    counted = results.agg(
        _rows().alias("total_checks"), _with_status("Success").alias("passed"),
        _with_status("Failed").alias("failed"), _with_status("Error").alias("errors"),
    )
    checks = "total_checks"
    return rows(counted_rules, {"total_rules": None, "active_rules": "total_rules"}).unionByName(
        rows(counted, {checks: None, "passed": checks, "failed": checks, "errors": checks})
    )


def quality_score(results: DataFrame, tags: Mapping[str, str] | None = None) -> DataFrame:
    """Run results (with counts and details) plus a score from 0 to 100.

    100 if the check itself says it passed; for another successful check the share
    of passing rows; otherwise 0.
    """
    says_passed = F.get_json_object("details", "$.passed") == "true"
    share = F.coalesce(F.round(F.try_divide(F.col("passed_count"), F.col("total_count")) * 100, 2), F.lit(0.0))
    score = F.when(says_passed, 100.0).when(F.col("status") == "Success", share).otherwise(0.0)
    scored = results.withColumn("score", score)
    if tags:
        pairs = [F.lit(x) for item in tags.items() for x in item]
        scored = scored.withColumn("tags", F.create_map(*pairs))
    return scored


def options(results: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, for pick lists."""
    return results.select(column).distinct().orderBy(column)


def _newest_first() -> list[Column]:
    return [F.desc("run_timestamp"), *[F.col(c) for c in ("run_id", "schema_name", "table_name", "dqmethod", "col")]]


def results_page(results: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One page, newest first; ties are ordered by the key, so pages never overlap."""
    return results.orderBy(*_newest_first()).offset((number - 1) * size).limit(size)


def results_total(results: DataFrame) -> DataFrame:
    return results.agg(_rows().alias("total"))


def recent_failed(results: DataFrame, limit: int = 10) -> DataFrame:
    return results.filter(F.col("status") == "Failed").orderBy(*_newest_first()).limit(limit)


def drill_down(results: DataFrame, records: DataFrame) -> DataFrame:
    """Failed results with the rows that failed, one row per failing row.

    Rules may share method and label: where both sides tell their number (``rule_seq``), a
    row is shown with the count of the very rule that caught it.  A store keeps the last of
    such rules, and of these alone rows are shown.

    One rule may hold a large share of all failing rows, so the records are not
    shuffled by rule unless the results are too many to broadcast.
    """
    numbered = "rule_seq" in results.columns and "rule_seq" in records.columns
    key = [*DRILL_KEY, "rule_seq"] if numbered else DRILL_KEY
    failed = results.filter(F.col("status") == "Failed").select(*key, "status", "failed_count")
    return attach(records.select(*key, "failed_row"), failed, key)

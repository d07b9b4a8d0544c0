"""Checks that judge a table as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import build_check, summary
from registry.base import damaged, damaged_sql, query, table

FRESHNESS = {"column": "ts", "freshness_threshold": "2h", "as_of": "2024-01-31 00:00:00"}


def _outcome(df, method, config):
    return summary(df, build_check(method, config))


def _field(name, kind="string"):
    return F.get_json_object("details", f"$.{name}").cast(kind)


@query(
    "rowcount",
    """SELECT CASE WHEN COUNT(*) BETWEEN 100 AND 100000 THEN 'Success' ELSE 'Failed' END AS status,
              CAST(COUNT(*) AS BIGINT) AS total_count, CAST(100 AS BIGINT) AS min_required,
              CAST(100000 AS BIGINT) AS max_allowed
       FROM orders""",
)
def rowcount(spark, sf):
    out = _outcome(table(spark, sf, "orders"), "RowCountEval", {"min": 100, "max": 100000})
    return out.select(
        "status", "total_count", _field("min_required", "long").alias("min_required"),
        _field("max_allowed", "long").alias("max_allowed"),
    )


@query(
    "feature_drift",
    f"""SELECT CASE WHEN ABS(AVG(c_acctbal) - 4500) <= 200 AND ABS(STDDEV_SAMP(c_acctbal) - 3100) <= 200
                    THEN 'Success' ELSE 'Failed' END AS status,
               ROUND(ABS(AVG(c_acctbal) - 4500), 4) AS drift_mean,
               ROUND(ABS(STDDEV_SAMP(c_acctbal) - 3100), 4) AS drift_std
        FROM {damaged_sql('customer')}""",
)
def feature_drift(spark, sf):
    config = {
        "column": "c_acctbal", "mode": "feature_drift",
        "reference_stats": {"mean": 4500, "std": 3100}, "tolerance": 200,
    }
    return _outcome(damaged(spark, sf, "customer"), "StatisticalDistributionEval", config).select(
        "status",
        F.round(_field("drift_mean", "double"), 4).alias("drift_mean"),
        F.round(_field("drift_std", "double"), 4).alias("drift_std"),
    )


@query(
    "freshness",
    """SELECT CASE WHEN MAX(ts) > TIMESTAMP '2024-01-30 22:00:00' THEN 'Success' ELSE 'Failed' END AS status,
              strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS latest, '2024-01-30 22:00:00' AS cutoff
       FROM events""",
)
def freshness(spark, sf):
    return _outcome(table(spark, sf, "events"), "DataFreshnessEval", FRESHNESS).select(
        "status",
        F.date_format(_field("latest_timestamp").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("latest"),
        _field("cutoff_timestamp").alias("cutoff"),
    )


@query(
    "schema_report",
    """SELECT 'Failed' AS status, CAST(COUNT(*) AS BIGINT) AS total_count, CAST(2 AS BIGINT) AS failed_count,
              CAST(3 AS BIGINT) AS passed_count, '["o_missing"]' AS missing,
              '[{"column":"o_totalprice","expected":"string","actual":"double"}]' AS mistyped
       FROM orders""",
)
def schema_report(spark, sf):
    expected = {
        "o_orderkey": "int", "o_orderstatus": "object", "o_orderdate": "datetime64[ns]",
        "o_totalprice": "string", "o_missing": "int",
    }
    return _outcome(table(spark, sf, "orders"), "SchemaValidationEval", {"expected_schema": expected}).select(
        "status", "total_count", "failed_count", "passed_count",
        _field("missing_columns").alias("missing"), _field("type_mismatches").alias("mistyped"),
    )

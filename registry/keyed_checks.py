"""Checks that bring rows together by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import build_check, summary
from registry.base import check_summary, damaged, damaged_sql, query, summary_sql, table

EVENTS, ORDERS = damaged_sql("events"), damaged_sql("orders")

LINE_COUNTS = "(SELECT COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) AS counted"
TEXT_COUNTS = "(SELECT doc_id, lang, COUNT(*) OVER (PARTITION BY text) AS n FROM documents) AS counted"
USER_COUNTS = f"(SELECT COUNT(*) OVER (PARTITION BY user_id, event_type) AS n FROM {EVENTS}) AS counted"
ORPHAN = "o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer)"


@query("dup_summary", summary_sql("DupEval", "l_orderkey,l_linenumber", LINE_COUNTS, "n > 1"))
def dup_summary(spark, sf):
    config = {"columns": ["l_orderkey", "l_linenumber"]}
    return check_summary(table(spark, sf, "lineitem"), "DupEval", config)


@query(
    "dup_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
       FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) AS counted
       WHERE n > 1""",
)
def dup_rows(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return build_check("DupEval", {"columns": ["l_orderkey", "l_linenumber"]}).failing(df)


@query("dup_null_keys_summary", summary_sql("DupEval", "user_id,event_type", USER_COUNTS, "n > 1"))
def dup_null_keys_summary(spark, sf):
    return check_summary(damaged(spark, sf, "events"), "DupEval", {"columns": ["user_id", "event_type"]})


@query("unique_summary", summary_sql("UniqueEval", "text", TEXT_COUNTS, "n > 1"))
def unique_summary(spark, sf):
    return check_summary(table(spark, sf, "documents"), "UniqueEval", {"columns": ["text"]})


@query("unique_rows", f"SELECT doc_id, lang FROM {TEXT_COUNTS} WHERE n > 1")
def unique_rows(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return build_check("UniqueEval", {"columns": ["text"]}).failing(df).select("doc_id", "lang")


def _balance(df, column, **more):
    config = {"column": column, "mode": "label_balance", **more}
    return build_check("StatisticalDistributionEval", config)


@query(
    "label_balance",
    f"""SELECT CASE WHEN MAX(n) * 1.0 / SUM(n) <= 0.9 THEN 'Success' ELSE 'Failed' END AS status,
               ROUND(CAST(MAX(n) AS DOUBLE) / SUM(n), 6) AS max_class_ratio, CAST(COUNT(*) AS BIGINT) AS classes
        FROM (SELECT event_type, COUNT(*) AS n FROM {EVENTS} GROUP BY event_type) AS counted""",
)
def label_balance(spark, sf):
    df = damaged(spark, sf, "events")
    return summary(df, _balance(df, "event_type")).select(
        "status",
        F.round(F.get_json_object("details", "$.max_class_ratio").cast("double"), 6).alias("max_class_ratio"),
        F.get_json_object("details", "$.classes").cast("long").alias("classes"),
    )


@query(
    "label_distribution",
    f"""SELECT o_orderpriority AS label, CAST(COUNT(*) AS BIGINT) AS n,
               ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(o_orderpriority) FROM {ORDERS}), 6) AS ratio
        FROM {ORDERS} WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""",
)
def label_distribution(spark, sf):
    df = damaged(spark, sf, "orders")
    return _balance(df, "o_orderpriority").distribution(df).withColumn("ratio", F.round("ratio", 6))


def _orphans(spark, sf):
    return {
        "column": "o_custkey", "reference_df": table(spark, sf, "customer"), "reference_column": "c_custkey",
    }


@query("ri_summary", summary_sql("ReferentialIntegrityEval", "o_custkey", ORDERS, ORPHAN))
def ri_summary(spark, sf):
    return check_summary(damaged(spark, sf, "orders"), "ReferentialIntegrityEval", _orphans(spark, sf))


@query("ri_rows", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {ORDERS} WHERE {ORPHAN}")
def ri_rows(spark, sf):
    check = build_check("ReferentialIntegrityEval", _orphans(spark, sf))
    return check.failing(damaged(spark, sf, "orders")).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "ri_null_keys_summary",
    summary_sql("ReferentialIntegrityEval", "user_id", EVENTS,
                "user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM customer)"),
)
def ri_null_keys_summary(spark, sf):
    config = {
        "column": "user_id", "reference_df": table(spark, sf, "customer"), "reference_column": "c_custkey",
    }
    return check_summary(damaged(spark, sf, "events"), "ReferentialIntegrityEval", config)

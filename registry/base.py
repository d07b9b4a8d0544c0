"""Registration, the input tables with injected defects, and shared SQL pieces."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import build_check, summary
from plumbline.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SUMMARY = ("dqmethod", "col", "status", "total_count", "failed_count", "passed_count")

# The given tables are clean, so defects are put in by rule, the same in Spark and
# in the SQL twin.  Every row of every table is kept.
DAMAGED = {
    "customer": {
        "c_custkey": "c_custkey",
        "c_name": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ''"
                  " WHEN c_custkey % 13 = 0 THEN '  ' WHEN c_custkey % 17 = 0 THEN c_name || 'x' ELSE c_name END",
        "c_nationkey": "c_nationkey",
        "c_acctbal": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END",
        "c_mktsegment": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_mktsegment END",
        "email": "CASE WHEN c_custkey % 23 = 0 THEN 'bademail.com'"
                 " ELSE 'user' || CAST(c_custkey AS VARCHAR(20)) || '@test.com' END",
    },
    "orders": {
        "o_orderkey": "o_orderkey",
        "o_custkey": "CASE WHEN o_orderkey % 19 = 0 THEN o_custkey + 100000000 ELSE o_custkey END",
        "o_orderstatus": "o_orderstatus",
        "o_totalprice": "o_totalprice",
        "o_orderdate": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END",
        "o_orderpriority": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderpriority END",
        "key_text": "CASE WHEN o_orderkey % 17 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR(20))"
                    " WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey AS VARCHAR(20)) || '.5'"
                    " WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR(20)) END",
    },
    "lineitem": {
        "l_orderkey": "l_orderkey",
        "l_partkey": "l_partkey",
        "l_linenumber": "l_linenumber",
        "l_quantity": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END",
        "l_extendedprice": "l_extendedprice",
        "l_discount": "l_discount",
        "l_tax": "l_tax",
        "l_returnflag": "l_returnflag",
        "l_shipdate": "l_shipdate",
    },
    "documents": {
        "doc_id": "doc_id",
        "lang": "lang",
        "text": "CASE WHEN doc_id % 13 = 0 THEN text || ' cafÃ©' WHEN doc_id % 29 = 0 THEN text || '�'"
                " WHEN doc_id % 31 = 0 THEN NULL ELSE text END",
    },
    "events": {
        "event_id": "event_id",
        "user_id": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END",
        "event_type": "CASE WHEN event_id % 14 = 0 THEN '' ELSE event_type END",
        "value": "CASE WHEN event_id % 21 = 0 THEN -1.0 ELSE value END",
        "ts": "ts",
    },
}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def damage(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in DAMAGED[name].items()])


def damaged(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return damage(table(spark, sf, name), name)


def damaged_sql(name: str) -> str:
    columns = ", ".join(f"{e} AS {c}" for c, e in DAMAGED[name].items())
    return f"(SELECT {columns} FROM {name}) AS {name}_damaged"


def check_summary(df: DataFrame, method: str, config: dict) -> DataFrame:
    return summary(df, build_check(method, config)).select(*SUMMARY)


def summary_sql(method: str, col: str, source: str, fails: str, extra: str = "") -> str:
    """One result row: rows of ``source`` for which the condition ``fails`` holds."""
    return f"""
        SELECT {extra}'{method}' AS dqmethod, '{col}' AS col,
               CASE WHEN COALESCE(SUM(f), 0) = 0 THEN 'Success' ELSE 'Failed' END AS status,
               CAST(COUNT(*) AS BIGINT) AS total_count,
               CAST(COALESCE(SUM(f), 0) AS BIGINT) AS failed_count,
               CAST(COUNT(*) - COALESCE(SUM(f), 0) AS BIGINT) AS passed_count
        FROM (SELECT CASE WHEN {fails} THEN 1 ELSE 0 END AS f FROM {source}) AS flagged"""


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder below the cluster's shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4()}"

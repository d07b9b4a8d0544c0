"""Failing rows of large tables: moved as rows, stored as compressed lines."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import Rule, Run, compile_table
from plumbline.plans.ruleset import number_rules
from plumbline.sinks.failed_log import log_outcome, write_log
from plumbline.plans.pipeline import Outcome
from plumbline.sources import failed_log as log
from registry import QUERIES
from registry.rulesets import RUN_ID

LINES = """id % 300 AS l_orderkey, id AS l_partkey, id AS l_suppkey, CAST(id % 4 AS INT) AS l_linenumber,
    CAST(id % 50 AS DOUBLE) AS l_quantity, id * 100.0D AS l_extendedprice, (id % 11) / 100.0D AS l_discount,
    (id % 9) / 100.0D AS l_tax, CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS l_returnflag,
    'O' AS l_linestatus, timestamp_ntz'1995-06-01 00:00:00' + make_dt_interval(CAST(id % 2000 AS INT)) AS l_shipdate"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(2000).selectExpr(*_split(LINES)).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(290).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice",
        "timestamp_ntz'1995-06-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(10).selectExpr(
        "id AS c_custkey", "'c' AS c_name", "id AS c_nationkey", "1.0D AS c_acctbal", "'BUILDING' AS c_mktsegment",
    ).write.parquet(f"{folder}/customer.parquet")
    return folder


def _split(text):
    """At commas outside brackets."""
    parts, depth = [""], 0
    for sign in text:
        depth += (sign == "(") - (sign == ")")
        if sign == "," and not depth:
            parts.append("")
        else:
            parts[-1] += sign
    return parts


def _moved(df):
    """The plan's lines below each node that moves rows."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith(("Rebalance", "Repartition")):
            below = i + 1
            while below < len(lines) and depth[below] > depth[i]:
                yield lines[below]
                below += 1


@pytest.mark.parametrize("name", ["failed_records", "drilldown_join"])
def test_failing_rows_are_not_moved_as_json(spark, tables, name):
    df = QUERIES[name](spark, tables)
    moved = list(_moved(df))
    assert moved and not [line for line in moved if "to_json" in line or "failed_row" in line]
    assert df.count() == QUERIES["failed_manifest"](spark, tables).first()["failed_count"]


def _stored(path):
    return sum(p.stat().st_size for p in Path(path).rglob("part-*"))


def test_log_is_compressed_and_whole(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "array(id) AS l", "map('k', id) AS m", "repeat('é', 50) AS text")
    rules = number_rules([Rule("RangeEval", {"column": "id", "min": -2, "max": -1}, "t", "s"),
                          Rule("CustomEval", {"func": "id < 0"}, "t", "s"),
                          Rule("UniqueEval", {"columns": ["text"]}, "t", "s")])
    run = compile_table(df, rules, Run.start(RUN_ID))
    records = run.failed_records(evened=True)
    plain = records.select(F.sum(F.octet_length("failed_row"))).first()[0]
    for path, write in ((str(tmp_path / "log"), lambda p: write_log(records, p)),
                        (str(tmp_path / "rows"), lambda p: log_outcome(
                            Outcome(run.run, run.results(), (run,), ()), p))):
        write(path)
        assert 0 < _stored(path) < plain / 5
        stored = log.read_log(spark, path)
        assert stored.count() == 60_000
        assert stored.exceptAll(records).isEmpty() and records.exceptAll(stored).isEmpty()


def test_evened_rows_without_plain_columns(spark):
    df = spark.range(50).selectExpr("map('k', id) AS m")
    run = compile_table(df, number_rules([Rule("CustomEval", {"func": "m['k'] < 0"}, "t", "s")]))
    assert run.failed_records(evened=True).count() == run.failed_rows(evened=True).count() == 50

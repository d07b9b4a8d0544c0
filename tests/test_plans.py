"""The plans are the ones wanted: scans pruned, filters pushed, shuffles few and narrow."""

import re

import pytest

from plumbline import Rule, build_check, compile_table
from plumbline.plans.ruleset import number_rules

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_failing_rows_of_row_checks_do_not_shuffle(lineitem):
    check = build_check("RangeEval", {"column": "l_quantity", "min": 1, "max": 40})
    text = plan(check.failing(lineitem))
    assert "Exchange" not in text
    assert "PushedFilters: [Or(IsNull(l_quantity),Or(LessThan(l_quantity,1.0),GreaterThan(l_quantity,40.0)))]" in text


def test_date_range_is_pushed(lineitem):
    check = build_check("DateRangeEval", {"column": "l_shipdate", "min_date": "1995-01-01", "max_date": "1999-01-01"})
    assert re.search(r"PushedFilters: \[Or\(Or\(IsNull\(l_shipdate\),LessThan", plan(check.failing(lineitem)))


def test_rules_share_one_scan(lineitem):
    rules = number_rules([
        Rule("RangeEval", {"column": "l_quantity", "min": 1, "max": 40}),
        Rule("EmptyEval", {"columns": ["l_returnflag"]}),
        Rule("StatisticalDistributionEval", {"column": "l_tax", "mode": "feature_drift", "reference_stats": {"mean": 0, "std": 0}}),
        Rule("DataFreshnessEval", {"column": "l_shipdate"}),
        Rule("RowCountEval", {"min": 1}),
        Rule("SchemaValidationEval", {"expected_schema": {"l_tax": "float"}}),
    ])
    text = plan(compile_table(lineitem, rules).results())
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "SinglePartition" in text
    assert "l_extendedprice" not in text and "l_orderkey" not in text


def test_keyed_checks_read_and_shuffle_keys_only(spark, lineitem):
    text = plan(build_check("DupEval", {"columns": ["l_orderkey"]}).tally(lineitem))
    assert "ReadSchema: struct<l_orderkey:bigint>" in text and "partial_count(1)" in text
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(build_check("UniqueEval", {"columns": ["text"]}).tally(documents))
    assert "sha2" in text.split("partial_count")[1]


def test_small_facts_keep_the_table_in_place(spark, lineitem):
    text = plan(build_check("DupEval", {"columns": ["l_orderkey", "l_linenumber"]}).failing(lineitem))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    config = {"column": "l_orderkey", "reference_df": orders, "reference_column": "o_orderkey"}
    text = plan(build_check("ReferentialIntegrityEval", config).failing(lineitem))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "hashpartitioning" not in text


def test_no_cross_join_anywhere(spark):
    from __spark_entry__ import queries

    for name, query in queries().items():
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name

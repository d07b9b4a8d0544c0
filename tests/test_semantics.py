"""Edge values per check, and how configurations are guarded."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from plumbline import Rule, build_check, compile_table, returns_column, run_check
from plumbline.errors import MissingColumnError, RuleConfigError
from plumbline.functions.durations import parse_duration
from plumbline.functions.json import identity_json


def failing(df, method, config, column="i"):
    return sorted(r[column] for r in build_check(method, config).failing(df).collect())


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (1, 5.0, "abc", 3, True, dt.datetime(2020, 1, 1)),
        (2, math.nan, "", None, False, dt.datetime(2020, 6, 1, 12)),
        (3, None, None, 30, None, None),
        (4, -1.0, "  ", 0, True, dt.datetime(2021, 1, 1)),
        (5, 10.0, "Abc\n", 1, True, dt.datetime(2019, 1, 1)),
    ]
    return spark.createDataFrame(rows, "i int, f double, s string, n int, b boolean, t timestamp_ntz")


@pytest.mark.parametrize("method, config, expected", [
    ("EmptyEval", {"columns": ["s"]}, [2, 3]),
    ("EmptyEval", {"columns": ["s"], "trim": True}, [2, 3, 4]),
    ("EmptyEval", {"columns": ["f"]}, [2, 3]),
    ("EmptyEval", {"columns": ["n", "b"]}, [2, 3]),
    ("EmptyEval", {"columns": ["t"]}, [3]),
    ("RangeEval", {"column": "f", "min": 0, "max": 10}, [2, 3, 4]),
    ("RangeEval", {"column": "f", "min": 0, "max": 10, "null_policy": "pass"}, [4]),
    ("RangeEval", {"column": "n", "min": 0.5, "max": 3}, [2, 3, 4]),
    ("CategoricalValuesEval", {"column": "s", "allowed_values": ["abc", ""]}, [3, 4, 5]),
    ("CategoricalValuesEval", {"column": "s", "allowed_values": ["abc", "", None]}, [4, 5]),
    ("CategoricalValuesEval", {"column": "s", "allowed_values": [1, 2]}, [1, 2, 3, 4, 5]),
    ("CategoricalValuesEval", {"column": "n", "allowed_values": [3, "30", 0.0, True]}, [2, 3]),
    ("CategoricalValuesEval", {"column": "b", "allowed_values": [True]}, [2, 3]),
    ("CategoricalValuesEval", {"column": "t", "allowed_values": ["2020-01-01"]}, [2, 3, 4, 5]),
    ("CategoricalValuesEval", {"column": "t", "allowed_values": ["2020-01-01", "no date", None]}, [2, 4, 5]),
    ("CategoricalValuesEval", {"column": "s", "allowed_values": []}, [1, 2, 3, 4, 5]),
    ("StringFormatEval", {"column": "s", "pattern": "[a-z]"}, [2, 3, 4, 5]),
    ("StringFormatEval", {"column": "s", "pattern": "(?i)abc$"}, [2, 3, 4]),
    ("StringFormatEval", {"column": "s", "pattern": "a", "full": True}, [1, 2, 3, 4, 5]),
    ("StringFormatEval", {"column": "n", "pattern": r"\d$"}, [2, 3]),
    ("StringFormatEval", {"column": "b", "pattern": "True"}, [2, 3]),
    ("DateRangeEval", {"column": "t", "min_date": "2020-01-01", "max_date": "2020-12-31"}, [3, 4, 5]),
    ("MojibakeEval", {"column": "n"}, []),
    ("CustomEval", {"column": "n", "func": "lambda x: x > 0"}, [2, 4]),
    ("CustomEval", {"column": "n", "func": "lambda x: x != 3"}, [1]),
    ("CustomEval", {"column": "n", "func": "lambda x: not x > 0"}, [1, 3, 5]),
    ("CustomEval", {"column": "n", "func": "lambda x: 0 < x <= 3"}, [2, 3, 4]),
    ("CustomEval", {"column": "s", "func": "lambda x: x is None or len(x) == 3"}, [2, 4, 5]),
    ("CustomEval", {"func": "lambda r: r['n'] in (3, 30) or r['f'] == -1"}, [2, 5]),
    ("CustomEval", {"func": "n > 0 AND f > 0"}, [2, 3, 4]),
    ("CustomEval", {"column": "n", "func": lambda x: x > 0}, [2, 4]),
    ("CustomEval", {"func": lambda r: r["n"] > 0 and r["s"] != "abc"}, [1, 2, 4]),
    ("CustomEval", {"column": "n", "func": returns_column(lambda c: c > 0)}, [2, 4]),
    ("DupEval", {"columns": ["b"]}, [1, 4, 5]),
])
def test_row_semantics(mixed, method, config, expected):
    assert failing(mixed, method, config) == expected
    out = run_check(mixed, method, config)
    assert out["failed_count"] == len(expected)
    assert out["failed_count"] + out["passed_count"] == out["total_count"] == 5
    assert out["status"] == ("Failed" if expected else "Success")


TEXTS = ["1", " 2.5 ", "1e3", "inf", "nan", "x", "1d", "0x1f", "", None, "true", "2020-01-01", "2020-13-01", "02:03:04", "3 days"]


@pytest.mark.parametrize("name, good", [
    ("int", {"1", " 2.5 ", "1e3", "inf", None}),
    ("Float64", {"1", " 2.5 ", "1e3", "inf", None}),
    ("str", set(TEXTS)),
    ("bool", {None}),
    ("timedelta", {"1", "1d", "02:03:04", "3 days", None}),
    ("decimal(10,2)", {"1", " 2.5 ", "1e3", None}),
    ("category", set()),
    ("no_such_type", set()),
])
def test_dtype_of_text(spark, name, good):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    bad = {r["s"] for r in build_check("DtypeEval", {"columns": {"s": name}}).failing(df).collect()}
    assert bad == set(TEXTS) - good


def test_dtype_datetime_and_strict(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    dates = {r["s"] for r in build_check("DtypeEval", {"columns": {"s": "datetime"}}).failing(df).collect()}
    assert "2020-01-01" not in dates and {"x", "2020-13-01", "true"} <= dates
    strict = {r["s"] for r in build_check("DtypeEval", {"columns": {"s": "int"}, "strict": True}).failing(df).collect()}
    assert set(TEXTS) - strict == {"1", None}


def test_dtype_of_native_columns(mixed):
    assert failing(mixed, "DtypeEval", {"columns": {"n": "bool"}}) == [1, 3]
    assert failing(mixed, "DtypeEval", {"columns": {"b": "boolean", "t": "datetime64[ns]", "f": "int"}}) == [2]
    assert failing(mixed, "DtypeEval", {"columns": {"n": "str"}}) == [1, 3, 4, 5]


def test_date_range_of_text(spark):
    df = spark.createDataFrame([(1, "2020-05-05"), (2, "not a date"), (3, None), (4, "2022-01-01 10:00:00")], "i int, s string")
    assert failing(df, "DateRangeEval", {"column": "s", "min_date": "2020-01-01", "max_date": "2021-01-01"}) == [2, 3, 4]


def test_date_range_of_dates(spark):
    df = spark.createDataFrame([(1, "2019-12-31"), (2, "2020-01-01"), (3, "2020-06-30"), (4, "2020-07-01"), (5, None)], "i int, s string")
    df = df.selectExpr("i", "CAST(s AS DATE) AS d")
    assert failing(df, "DateRangeEval", {"column": "d", "min_date": "2020-01-01", "max_date": "2020-06-30"}) == [1, 4, 5]
    noon = {"column": "d", "min_date": "2020-01-01 12", "max_date": "2020-07-01 12", "date_format": "%Y-%m-%d %H"}
    assert failing(df, "DateRangeEval", noon) == [1, 2, 5]


def test_regex_follows_python(spark):
    texts = ["naïve", "a\u0085b", "end\n", "٣", "tab\there"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")

    def bad(pattern, **more):
        return {r["s"] for r in build_check("StringFormatEval", {"column": "s", "pattern": pattern, **more}).failing(df).collect()}

    import re

    for pattern in (r"\w+$", r"a.b$", r"end$", r"\d", r"(?P<x>t)ab\s", r"end\Z", r"[^\s]+"):
        assert bad(pattern) == {t for t in texts if not re.match(pattern, t)}, pattern
        assert bad(pattern, full=True) == {t for t in texts if not re.fullmatch(pattern, t)}, pattern


def test_nulls_and_nan_are_one_key(spark):
    df = spark.createDataFrame([(1, None), (2, math.nan), (3, 1.0), (4, -0.0), (5, 0.0)], "i int, f double")
    assert failing(df, "DupEval", {"columns": ["f"]}) == [1, 2, 4, 5]


def test_long_text_keys(spark):
    import hashlib

    long = "x" * 500
    digest = hashlib.sha256(long.encode()).hexdigest()
    df = spark.createDataFrame([(1, long), (2, long), (3, digest), (4, long + "y"), (5, "")], "i int, s string")
    assert failing(df, "UniqueEval", {"columns": ["s"]}) == [1, 2]


def test_label_balance_ignores_nulls(spark):
    df = spark.createDataFrame([("a",)] * 19 + [("b",)] + [(None,)] * 80, "s string")
    out = run_check(df, "StatisticalDistributionEval", {"column": "s", "mode": "label_balance"})
    assert out["status"] == "Failed" and out["max_class_ratio"] == 0.95 and out["classes"] == 2
    none = spark.createDataFrame([(None,)], "s string")
    assert run_check(none, "StatisticalDistributionEval", {"column": "s", "mode": "label_balance"})["status"] == "Error"


def test_freshness(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31),), (None,)], "t timestamp_ntz")
    config = {"column": "t", "freshness_threshold": "1d", "as_of": "2024-02-01 00:00:00"}
    assert run_check(df, "DataFreshnessEval", config)["status"] == "Failed"  # strictly newer is wanted
    assert run_check(df, "DataFreshnessEval", config | {"freshness_threshold": "1441m"})["status"] == "Success"
    future = run_check(df, "DataFreshnessEval", config | {"freshness_threshold": "-2h"})
    assert future["cutoff_timestamp"] == "2024-02-01 02:00:00"
    assert run_check(df.filter("t IS NULL"), "DataFreshnessEval", config)["status"] == "Failed"


def test_schema_check(spark):
    df = spark.createDataFrame([], "a int, b bigint, c decimal(10,2), d array<string>, e string")
    good = {"a": "int", "b": "int64", "c": "decimal(10, 2)", "d": "array<string>", "e": "object"}
    assert run_check(df, "SchemaValidationEval", {"expected_schema": good})["status"] == "Success"
    bad = run_check(df, "SchemaValidationEval", {"expected_schema": {"a": "str", "z": "int", "b": int}})
    assert bad["missing_columns"] == ["z"]
    assert bad["type_mismatches"] == {"a": {"expected": "str", "actual": "int"}}
    assert (bad["failed_count"], bad["passed_count"], bad["total_count"]) == (2, 1, 0)
    report = build_check("SchemaValidationEval", {"expected_schema": {"a": "int", "z": "int"}}).report(df)
    assert [r["problem"] for r in report.orderBy("column").collect()] == ["ok", "missing"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, s string")
    for method, config in (("RangeEval", {"column": "a", "min": 0, "max": 1}), ("DupEval", {"columns": ["a"]}),
                           ("EmptyEval", {"columns": ["s"]})):
        out = run_check(df, method, config)
        assert (out["status"], out["total_count"], out["failed_count"]) == ("Success", 0, 0)
    assert run_check(df, "RowCountEval", {"min": 1})["status"] == "Failed"


@pytest.mark.parametrize("method, config", [
    ("RangeEval", {"column": "n", "min": 1}),
    ("RangeEval", {"column": "n", "min": "1", "max": 2}),
    ("RangeEval", {"column": "s", "min": 1, "max": 2}),
    ("UniqueEval", {"columns": ["n", "f"]}),
    ("EmptyEval", {"columns": []}),
    ("EmptyEval", {"columns": "n"}),
    ("RowCountEval", {}),
    ("StringFormatEval", {"column": "s", "pattern": "("}),
    ("StatisticalDistributionEval", {"column": "n", "mode": "other"}),
    ("StatisticalDistributionEval", {"column": "n", "mode": "feature_drift"}),
    ("StatisticalDistributionEval", {"column": "s", "mode": "feature_drift", "reference_stats": {"mean": 1, "std": 1}}),
    ("DataFreshnessEval", {"column": "n"}),
    ("DataFreshnessEval", {"column": "t", "freshness_threshold": "2 weeks"}),
    ("DateRangeEval", {"column": "t", "min_date": "yesterday", "max_date": "2020-01-01"}),
    ("CustomEval", {"column": "n"}),
    ("CustomEval", {"column": "n", "func": "lambda x: open('f')"}),
    ("CustomEval", {"column": "n", "func": "lambda x: x.__class__ == 1"}),
    ("ReferentialIntegrityEval", {"column": "n", "reference_df": "unresolved", "reference_column": "x"}),
    ("NoSuchEval", {}),
])
def test_bad_configurations(mixed, method, config):
    with pytest.raises(RuleConfigError):
        build_check(method, config).guard(mixed)


def test_missing_column(mixed):
    with pytest.raises(MissingColumnError):
        build_check("DupEval", {"columns": ["zz"]}).guard(mixed)


def test_integer_tolerance_is_accepted(mixed):
    config = {"column": "n", "mode": "feature_drift", "reference_stats": {"mean": 8, "std": 14}, "tolerance": 10}
    assert run_check(mixed, "StatisticalDistributionEval", config)["status"] == "Success"


def test_durations():
    assert parse_duration(" 2H ") == dt.timedelta(hours=2)
    assert parse_duration("-7d") == dt.timedelta(days=-7)
    for text in ("2w", "h", "1.5h", ""):
        with pytest.raises(RuleConfigError):
            parse_duration(text)


def test_label_of_a_rule():
    assert build_check("EmptyEval", {"columns": ["a", "b"]}).label() == "a,b"
    assert build_check("DtypeEval", {"columns": {"a": "int"}}).label() == "{'a': 'int'}"
    assert build_check("MojibakeEval", {"column": "a"}).label() == "a"
    assert build_check("RowCountEval", {"min": 1}).label() == "N/A"


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (2, "y")], ["a.b", "c d"])
    run = compile_table(df, [Rule("EmptyEval", {"columns": ["c d"]}, rule_seq=1), Rule("DupEval", {"columns": ["a.b"]}, rule_seq=2)])
    assert {r["rule_seq"]: r["failed_count"] for r in run.results().collect()} == {1: 1, 2: 2}
    assert run.failed_records().count() == 3


def test_equal_configurations(spark):
    """Numbers agree by value at any depth; texts, keys and structure do as they stand."""
    groups = [
        ['{"a": 1, "b": [1.50]}', '{"b":[15e-1],"a":1.0}', '{"a":10E-1, "b": [0.150e+1]}', '{"a":1e0,"b":[1.5]}'],
        ['{"a": "1", "b": [1.5]}'], ['{"a": "1.0", "b": [1.5]}'],
        ['{"a": 0}', '{"a": -0.0}', '{"a": 0e9}', '{"a": 0.000}'],
        ['{"a": 100}', '{"a": 1e2}', '{"a": 1.00E+2}'], ['{"a": -100}', '{"a": -1e2}'],
        ['{"a": 12345678901234567890123456789012345678901}'], ['{"a": 12345678901234567890123456789012345678902}'],
        ['{"a": 0.05}', '{"a": 5e-2}'], ['{"a": 0.5}'], ['{"a": "#1e0"}'], ['{"a": "x \\" 1.0 \\\\"}'], ['{"a": "x \\" 1 \\\\"}'],
        ['{"1.0": null}'], ['{"1": null}'], ["not json 1.0"], ["not json 1"], ["[1, 1]"], ["[11]"], ["-1", "-1.0"], ["{}"], [""],
    ]
    texts = [(i, t) for i, group in enumerate(groups) for t in group] + [(99, None)]
    df = spark.createDataFrame(texts, "i int, t string").select("i", identity_json(F.col("t")).alias("same"))
    found = {}
    for row in df.collect():
        found.setdefault(row["same"], set()).add(row["i"])
    assert len(found) == len(groups) + 1 and all(len(ids) == 1 for ids in found.values())

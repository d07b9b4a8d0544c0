"""Rule catalogue, table sources, generators."""

import datetime as dt

import pytest

from plumbline import Rule, compile_table
from plumbline.errors import RuleConfigError
from plumbline.plans.ruleset import number_rules
from plumbline.sources import generators, rules as rulebook, tables
import fixtures as fx

DAY = dt.datetime(2024, 1, 1)
EMAIL = r"^[^@\s]+@[^@\s]+\.[a-z]+$"


@pytest.fixture()
def stored(spark):
    return rulebook.catalogue(spark, [
        (1, "public", "a", "RangeEval", '{"column": "x", "min": 1, "max": 2}', True, DAY),
        (2, "public", "a", "EmptyEval", '{"columns": ["x"]}', False, DAY + dt.timedelta(days=1)),
        (3, "hr", "b", "DupEval", '{"columns": ["x", "y"]}', True, DAY + dt.timedelta(days=2)),
        (4, "hr", "b", "RangeEval", "{broken", True, DAY),
    ])


def ids(df):
    return [r["control_id"] for r in df.collect()]


def test_listing(stored):
    assert ids(rulebook.list_rules(stored)) == [3, 2, 4, 1]
    assert ids(rulebook.list_rules(stored, schema="public", active_only=True)) == [1]
    assert ids(rulebook.active_rules(stored)) == [3, 4, 1]
    assert [tuple(r) for r in rulebook.rule_options(stored).collect()] == [("hr", "b"), ("public", "a")]


def test_insert_guard(spark, stored):
    new = rulebook.catalogue(spark, [
        (10, "public", "a", "RangeEval", '{"max":2,"min":1,"column":"x"}', True, DAY),  # same, other order
        (11, "public", "a", "RangeEval", '{"max":2,"min":1,"column":"x"}', False, DAY),  # inactive: not checked
        (12, "public", "a", "EmptyEval", '{"columns": ["x"]}', True, DAY),  # the stored one is inactive
        (13, "hr", "b", "DupEval", '{"columns": ["y", "x"]}', True, DAY),  # list order matters
        (14, "hr", "b", "DupEval", '{"columns":["y","x"]}', True, DAY),  # same as 13
    ])
    # The malformed one stays; it equals no other.
    assert [(r["control_id"], r["existing_id"]) for r in rulebook.rejected_rules(new, stored).collect()] == [(10, 1)]
    assert sorted(ids(rulebook.insert_rules(new, stored))) == [1, 2, 3, 4, 11, 12, 13]


def test_switching_and_deleting(stored):
    off = rulebook.set_active(stored, [1, 3], False)
    assert ids(rulebook.active_rules(off)) == [4]
    assert sorted(ids(rulebook.delete_rules(stored, [1, 4]))) == [2, 3]


def test_loading(spark, stored):
    loaded = rulebook.load_rules(stored)
    assert [(r.schema_name, r.dqmethod, r.rule_seq) for r in loaded] == [("hr", "DupEval", 1), ("hr", "RangeEval", 2), ("public", "RangeEval", 3)]
    assert loaded[0].config == {"columns": ["x", "y"]}
    df = spark.createDataFrame([(1, 2)], "x int, y int")
    statuses = {r["rule_seq"]: r["status"] for r in compile_table(df, loaded).results().collect()}
    assert statuses == {1: "Success", 2: "Error", 3: "Success"}
    plain = spark.createDataFrame([("vendor", "DupEval", '{"columns": ["x"]}')], "tablename string, dqmethod string, config string")
    assert rulebook.load_rules(plain)[0].table_name == "vendor"
    with pytest.raises(RuleConfigError):
        Rule.of("DupEval", "{broken")


def test_sources_and_discovery(spark, tmp_path):
    fx.trips(spark).write.parquet(str(tmp_path / "o.parquet"))
    assert tables.from_files(spark, str(tmp_path))("any", "o").count() == len(fx.TRIPS)
    with pytest.raises(KeyError):
        tables.from_mapping({})("s", "t")
    spark.sql("DROP TABLE IF EXISTS discovered")
    fx.trips(spark).write.saveAsTable("discovered")
    fx.trips(spark).createOrReplaceTempView("a_view")
    assert "default" in [r["schema_name"] for r in tables.list_schemas(spark).collect()]
    names = [r["table_name"] for r in tables.list_tables(spark).collect()]
    assert "discovered" in names and "a_view" not in names
    assert [tuple(r)[1:] for r in tables.list_columns(spark, "default", "discovered").collect()][0] == ("trip", "int")
    assert tables.from_catalog(spark)("default", "discovered").count() == len(fx.TRIPS)
    assert tables.read_query(spark, "SELECT * FROM discovered WHERE seats > :q", {"q": 4}).count() == sum(o[1] > 4 for o in fx.TRIPS)
    spark.sql("DROP TABLE discovered")


def counts(df, rules):
    run = compile_table(df, number_rules([Rule(m, c) for m, c in rules]))
    return [r["failed_count"] for r in run.results().orderBy("rule_seq").collect()]


def test_product_generator(spark):
    df = generators.products(generators.numbers(spark, 10_000))
    assert counts(df, [
        ("DupEval", {"columns": ["product_id"]}), ("EmptyEval", {"columns": ["product_name"]}),
        ("CategoricalValuesEval", {"column": "category", "allowed_values": list(generators.CATEGORIES)}),
        ("RangeEval", {"column": "price", "min": 0, "max": 100000}), ("RangeEval", {"column": "stock", "min": 0, "max": 10000}),
        ("StringFormatEval", {"column": "supplier_email", "pattern": EMAIL}),
        ("StringFormatEval", {"column": "supplier_email", "pattern": EMAIL.replace("\\.", "\\\\.")}),
    ]) == [2, 2, 1, 2, 1, 1, 10_000]


def test_employee_generator(spark):
    df = generators.employees(generators.numbers(spark, 1_000_000))
    assert counts(df, [
        ("DupEval", {"columns": ["id"]}), ("EmptyEval", {"columns": ["name"]}),
        ("RangeEval", {"column": "age", "min": 18, "max": 65}), ("StringFormatEval", {"column": "email", "pattern": "@email"}),
        ("CategoricalValuesEval", {"column": "department", "allowed_values": list(generators.DEPARTMENTS)}),
        ("CustomEval", {"column": "score", "func": "lambda x: x >= 0"}),
        ("CustomEval", {"func": "lambda row: row['age'] >= 18 and row['country'] == 'US'"}),
    ]) == [101, 200, 223, 142, 166, 250, 125]


def test_customer_generator(spark):
    df = generators.customers(generators.numbers(spark, 1_000_000))
    assert counts(df, [
        ("DupEval", {"columns": ["customer_id"]}), ("UniqueEval", {"columns": ["email"]}),
        ("RangeEval", {"column": "age", "min": 18, "max": 100}),
        ("CategoricalValuesEval", {"column": "gender", "allowed_values": list(generators.GENDERS)}),
    ]) == [101, 142, 223, 166]

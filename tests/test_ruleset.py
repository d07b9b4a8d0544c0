"""Rule sets: one pass gives what single checks give, and errors stay contained."""

import json

import pytest

import fixtures as fx
from plumbline import Rule, Run, compile_table, plan_all, run_all, run_yaml, summary
from plumbline.errors import RuleConfigError
from plumbline.operators import Duplicate
from plumbline.plans import ruleset
from plumbline.plans.pipeline import select_rules
from plumbline.plans.ruleset import TableRun, number_rules
from plumbline.sinks.failed_log import export_csv, log_outcome, promote, promote_to_table, write_log
from plumbline.sinks.report import report_json, write_report
from plumbline.sinks.results import keep_last, read_results, save_results, stored_form
from plumbline.sources import failed_log as log
from plumbline.sources.tables import from_mapping

RUN_ID = "123e4567-e89b-12d3-a456-426614174000"


@pytest.fixture(scope="module")
def source(spark):
    return from_mapping({"readings": fx.readings(spark), "gauges": fx.gauges(spark), "hr.trips": fx.trips(spark)})


def reading_rules():
    return number_rules([Rule(m, c, "readings") for m, c, *_ in fx.READING_RULES])


def test_fused_equals_single(spark, source):
    df = fx.readings(spark)
    run = compile_table(df, reading_rules(), source=source)
    fused = {r["rule_seq"]: (r["status"], r["failed_count"], r["details"]) for r in run.results().collect()}
    for c in run.compiled:
        alone = summary(df, c.check).first()
        assert fused[c.rule.rule_seq] == (alone["status"], alone["failed_count"], alone["details"])


def test_many_passes_equal_one(spark, source, monkeypatch):
    df = fx.readings(spark)
    run = compile_table(df, reading_rules(), source=source)
    columns = ("rule_seq", "status", "failed_count")
    one = sorted(map(tuple, run.results().select(*columns).collect()))
    rows = sorted(map(tuple, run.failed_records().select("rule_seq", "failed_row").collect()))
    monkeypatch.setattr(ruleset, "EXPRESSIONS_PER_PASS", 2)
    assert sorted(map(tuple, run.results().select(*columns).collect())) == one
    assert sorted(map(tuple, run.failed_records().select("rule_seq", "failed_row").collect())) == rows


def test_two_hundred_rules(spark):
    df = fx.readings(spark)
    rules = number_rules([Rule("RangeEval", {"column": "level", "min": i, "max": 200}, "readings") for i in range(200)])
    rows = compile_table(df, rules).results().collect()
    levels = [r["level"] for r in fx.reading_rows()]
    assert {r["rule_seq"]: r["failed_count"] for r in rows} == {i + 1: sum(v is None or v < i for v in levels) for i in range(200)}


def test_rules_that_cannot_be_planned(spark, source):
    rules = number_rules([
        Rule("RangeEval", {"column": "level", "min": 100, "max": 170}, "readings"),
        Rule("RangeEval", {"column": "zz", "min": 18, "max": 65}, "readings"),
        Rule("Unknown", {}, "readings"),
        Rule("ReferentialIntegrityEval", {"column": "gauge_no", "reference_df": "nowhere", "reference_column": "id"}, "readings"),
        Rule("CustomEval", {"func": "no_such_column > 3"}, "readings"),
    ])
    rows = {r["rule_seq"]: r for r in compile_table(fx.readings(spark), rules, source=source).results().collect()}
    assert [rows[i]["status"] for i in range(1, 6)] == ["Failed", "Error", "Error", "Error", "Error"]
    assert rows[2]["col"] == "N/A" and "zz" in json.loads(rows[2]["details"])["error_message"]
    assert rows[3]["failed_count"] == 0


def test_rules_that_fail_at_run_time(spark):
    def explode(value):
        raise ValueError("broken predicate")

    rules = number_rules([
        Rule("RangeEval", {"column": "level", "min": 100, "max": 170}, "readings"),
        Rule("CustomEval", {"column": "level", "func": explode}, "readings"),
        Rule("CustomEval", {"func": "CAST(gauge AS INT) > 0"}, "readings"),
        Rule("DupEval", {"columns": ["reading_id"]}, "readings"),
    ])
    rows, settled = compile_table(fx.readings(spark), rules).settled()
    statuses = {r["rule_seq"]: r["status"] for r in rows}
    assert statuses == {1: "Failed", 2: "Error", 3: "Error", 4: "Failed"}
    # What is left can be used without the offenders.
    assert {r["rule_seq"] for r in settled.failed_records().select("rule_seq").distinct().collect()} == {1, 4}


def test_same_label_rules_stay_apart(spark):
    rules = number_rules([
        Rule("CustomEval", {"func": "level > 1000"}, "readings"), Rule("CustomEval", {"func": "quality > -5"}, "readings"),
    ])
    run = compile_table(fx.readings(spark), rules, Run.start(RUN_ID))
    assert sorted((r["col"], r["failed_count"]) for r in run.results().collect()) == [("N/A", 0), ("N/A", 32)]
    kept = stored_form(keep_last(run.results())).collect()
    assert len(kept) == 1 and kept[0]["failed_count"] == 0  # the last rule wins in the store


def test_prepared_facts_change_nothing(spark, source, monkeypatch):
    from plumbline.operators import keyed

    boats = spark.createDataFrame(fx.HALF_WIDTH, "boat int, name string")
    target = spark.createDataFrame(fx.FULL_WIDTH, "boat int, name string")
    texts = Rule("UnicodeValidationEval", {"key_column": "boat", "columns": ["name"], "target_df": target})
    for run in (compile_table(fx.readings(spark), reading_rules(), source=source),
                compile_table(boats, number_rules([texts, Rule("DupEval", {"columns": ["name"]})]))):
        columns = ("rule_seq", "status", "total_count", "failed_count", "passed_count", "details")
        expected = sorted(map(str, run.results().select(*columns).collect()))
        rows = sorted(map(str, run.failed_records().select("rule_seq", "failed_row").collect()))
        ready = run.prepared()
        with monkeypatch.context() as m:  # nothing is counted again
            m.setattr(keyed, "rows_per_key", None)
            assert sorted(map(str, ready.results().select(*columns).collect())) == expected
            assert sorted(map(str, ready.failed_records().select("rule_seq", "failed_row").collect())) == rows


def test_rules_on_the_same_key_share_failing_rows(spark, source, monkeypatch):
    from plumbline.operators import keyed

    calls = []
    real = keyed.attach
    monkeypatch.setattr(keyed, "attach", lambda *a, **k: calls.append(1) or real(*a, **k))
    few = from_mapping({"gauges": fx.gauges(spark), "some": fx.gauges(spark).limit(3)})
    reference = {"column": "gauge_no", "reference_column": "id"}
    rules = number_rules([
        Rule("DupEval", {"columns": ["reading_id"]}, "readings"), Rule("UniqueEval", {"columns": ["reading_id"]}, "readings"),
        Rule("DupEval", {"columns": ["grade", "unit"]}, "readings"),
        Rule("ReferentialIntegrityEval", {**reference, "reference_df": "gauges"}, "readings"),
        Rule("ReferentialIntegrityEval", {**reference, "reference_df": "some"}, "readings"),
    ])
    run = compile_table(fx.readings(spark), rules, source=few)
    counted = {r["rule_seq"]: r["count"] for r in run.failed_records().groupBy("rule_seq").count().collect()}
    assert counted == {1: 2, 2: 2, 3: 31, 4: 2, 5: 29} and len(calls) == 2


def test_run_all(spark, source):
    rules = [
        *[Rule(m, c, "readings") for m, c, *_ in fx.READING_RULES],
        *[Rule(m, c, "trips", "hr") for m, c, _ in fx.TRIP_RULES],
        Rule("RowCountEval", {"min": 1}, "no_such_table"),
    ]
    outcome = run_all(spark, rules, source, Run.start(RUN_ID))
    results = outcome.results.collect()
    assert len(results) == len(rules) - 1 and {r["run_id"] for r in results} == {RUN_ID}
    assert len({r["run_timestamp"] for r in results}) == 1
    assert [(s, t) for s, t, _ in outcome.skipped] == [("default", "no_such_table")]
    expected = sum(n for *_, n in fx.READING_RULES) + sum(n for *_, n in fx.TRIP_RULES)
    assert outcome.failed_records().count() == expected == sum(r["failed_count"] for r in results)
    rows = outcome.failing_rows("readings", "RangeEval", "level")
    assert rows.columns == fx.readings(spark).columns and rows.count() == 3
    assert outcome.failing_rows("readings", "RangeEval", "nope") is None
    tables, _ = plan_all(select_rules(rules, schema="hr"), source)
    assert [t.table_name for t in tables] == ["trips"]


def test_run_id_must_be_a_uuid():
    with pytest.raises(RuleConfigError):
        Run.start("not-a-uuid")


def test_log_store_and_promotion(spark, source, tmp_path):
    df = fx.readings(spark)
    run = compile_table(df, reading_rules(), Run.start(RUN_ID), source, "default", "readings")
    path, store = str(tmp_path / "log"), str(tmp_path / "results")
    for _ in range(2):  # writing again replaces
        write_log(run.failed_records(), path)
        save_results(run.results(), store)
    records = log.read_log(spark, path)
    expected = sum(n for *_, n in fx.READING_RULES)
    assert records.count() == expected
    assert log.manifest(records).collect()[0]["failed_count"] == expected
    assert [tuple(r) for r in log.runs(records).collect()] == [(RUN_ID, ["readings"], expected)]
    newest = log.runs(records, read_results(spark, store)).collect()
    assert [(r["run_id"], r["started_at"]) for r in newest] == [(RUN_ID, run.run.run_timestamp)]
    assert log.select_records(records, method="RangeEval", col="level").count() == 3
    assert log.page(records, 1, 5).count() == 5 and log.page(records, 4, 5).count() == expected - 15

    row = json.loads(log.select_records(records, method="EmptyEval").first()["failed_row"])
    assert row["gauge"] in (None, "", "gauge 25") and row["taken_at"].startswith("2031-05-04T11:")

    for _ in range(2):
        target = promote(records, "readings", df.schema, str(tmp_path), RUN_ID)
    promoted = spark.read.parquet(target)
    assert promoted.count() == expected and target.endswith("readings_failed_rows")
    assert set(promoted.columns) == {"run_id", "dqmethod", "col", *df.columns}
    back = promoted.filter("dqmethod = 'RangeEval'").select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.filter("level < 100 OR level > 170 OR level IS NULL").collect()))

    export_csv(log.select_records(records, method="RangeEval"), df.schema, str(tmp_path / "csv"))
    exported = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert exported.columns == [*df.columns, "dqmethod", "col", "run_id"] and exported.count() == 3

    stored = read_results(spark, store)
    assert stored.columns[0] == "run_id"
    assert stored.count() == len(fx.READING_RULES) - 1  # one label occurs twice


def test_promotion_to_a_catalog_table(spark, source):
    df = fx.trips(spark)
    run = compile_table(df, number_rules([Rule(m, c, "small_trips") for m, c, _ in fx.TRIP_RULES]))
    spark.sql("DROP TABLE IF EXISTS small_trips_failed_rows")
    name = promote_to_table(run.failed_records(), "small_trips", df.schema)
    assert spark.table(name).count() == sum(n for *_, n in fx.TRIP_RULES)
    spark.sql("DROP TABLE small_trips_failed_rows")


YAML = """
run_id: "123e4567-e89b-12d3-a456-426614174000"
evals:
  - {type: duplicate, columns: [reading_id]}
  - {type: Empty, columns: [gauge, level]}
  - type: dtype
    columns: {reading_id: int, gauge: str}
  - {type: referentialintegrity, column: gauge_no, reference_df: ref_df, reference_column: id}
  - {type: custom, column: quality, func: "lambda x: x >= 0"}
  - {type: custom, func: deep}
  - {type: statisticaldistribution, column: grade, mode: label_balance}
  - {type: range, column: level}
  - {type: nonsense}
  - {columns: [reading_id]}
"""


def test_yaml(spark, tmp_path):
    report = run_yaml(fx.readings(spark), YAML, {"ref_df": fx.gauges(spark)}, {"deep": lambda r: r["quality"] >= 62})
    assert [r["status"] for r in report] == ["Failed", "Failed", "Success", "Failed", "Failed", "Failed", "Success"] + ["Error"] * 3
    assert [r["failed_count"] for r in report[:6]] == [2, 3, 0, 2, 1, 3]
    assert report[3]["config"]["reference_df"] == "ref_df" and report[3]["engine"] == "spark"
    assert report[7]["check_index"] == 7
    assert "max" in report[7]["error_message"] or "min" in report[7]["error_message"]
    assert {r["run_id"] for r in report} == {RUN_ID}
    assert len(json.loads(report_json(report))) == 10
    write_report(spark, report, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 10


def test_yaml_that_is_not_yaml(spark):
    with pytest.raises(RuleConfigError):
        run_yaml(fx.readings(spark), "evals: [")


def test_log_keeps_schemas_apart(spark, tmp_path):
    """Tables of one name, a run without failing rows, and a manifest that was counted on writing."""
    path = str(tmp_path / "log")
    tables = {"a": spark.createDataFrame([(1, 5), (2, None)], "id int, v int"),
              "b": spark.createDataFrame([(3, None), (4, None)], "id int, v int")}
    rules = number_rules([Rule("EmptyEval", {"columns": ["v"]}, "t", "a"), Rule("RangeEval", {"column": "v", "min": 0, "max": 9}, "t", "a"),
                          Rule("EmptyEval", {"columns": ["v"]}, "t", "b")])
    outcome = run_all(spark, rules, lambda schema, name: tables[schema], Run.start())
    for _ in range(2):
        manifest = log_outcome(outcome, path)
    wanted = {("a", 1, 2), ("b", 2, 2)}
    shown = ("schema_name", "failed_rows", "failed_count")
    assert {tuple(r) for r in manifest.select(*shown).collect()} == wanted
    assert {tuple(r) for r in log.read_manifest(spark, path).select(*shown).collect()} == wanted
    assert log.read_rows(spark, path).count() == 3 and log.read_log(spark, path).count() == 4
    again = str(tmp_path / "records")
    for table in outcome.tables:
        write_log(table.failed_records(), again)
    records = log.read_log(spark, again)
    assert sorted(map(str, records.collect())) == sorted(map(str, log.read_log(spark, path).collect()))
    with pytest.raises(RuleConfigError):
        promote(records, "t", tables["a"].schema, str(tmp_path))
    target = promote(records, "t", tables["a"].schema, str(tmp_path), outcome.run.run_id, schema_name="b")
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [3, 4]
    promote(records.limit(0), "t", tables["a"].schema, str(tmp_path), outcome.run.run_id, schema_name="b")
    assert spark.read.schema(tables["a"].schema).parquet(target).count() == 0
    clean = run_all(spark, rules[2:], lambda schema, name: tables[schema].limit(0), outcome.run)
    log_outcome(clean, path)
    assert {r["schema_name"] for r in log.read_log(spark, path).collect()} == {"a"}
    assert {tuple(r) for r in log.read_manifest(spark, path).select(*shown).collect()} == {("a", 1, 2), ("b", 0, 0)}


def test_a_bad_predicate_costs_one_action(spark, monkeypatch):
    """Spark names the place of the error, so nothing is halved."""
    df = spark.createDataFrame([(i, "x") for i in range(5)], "id int, t string")
    good = [Rule("RangeEval", {"column": "id", "min": 0, "max": i}, "t") for i in range(20)]
    bad = [Rule("CustomEval", {"func": "CAST(t AS INT) > 0"}, "t"), Rule("CustomEval", {"func": "1 / (id - id) > 0"}, "t")]
    table = compile_table(df, number_rules([*good[:10], bad[0], *good[10:], bad[1]]))
    runs = []
    results = TableRun.results
    monkeypatch.setattr(TableRun, "results", lambda self: runs.append(len(self.compiled)) or results(self))
    rows, settled = table.settled()
    assert runs == [22, 21, 20, 0]
    errors = {r["rule_seq"]: json.loads(r["details"])["error_message"] for r in rows if r["status"] == "Error"}
    assert set(errors) == {11, 22} and "CAST_INVALID_INPUT" in errors[11] and "DIVIDE_BY_ZERO" in errors[22]
    assert "CAST(t AS INT)" in errors[11].splitlines()[2]  # all lines of the message
    assert sum(r["status"] == "Success" for r in rows) == 16 and len(settled.compiled) == 20


def test_equal_bad_predicates_are_told_apart(spark):
    """Two rules hold the text that Spark names: both are tried alone."""
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    rules = number_rules([Rule("CustomEval", {"func": "CAST(t AS INT) > 0"}, "t"),
                          Rule("CustomEval", {"func": "id < 5 OR CAST(t AS INT) > 0"}, "t"),
                          Rule("EmptyEval", {"columns": ["t"]}, "t")])
    rows, _ = compile_table(df, rules).settled()
    assert {r["rule_seq"]: r["status"] for r in rows} == {1: "Error", 2: "Success", 3: "Success"}


def test_distributions(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    rules = number_rules([Rule("StatisticalDistributionEval", {"column": "k", "mode": "label_balance"}, "t"),
                          Rule("EmptyEval", {"columns": ["k"]}, "t")])
    outcome = run_all(spark, rules, lambda schema, name: df, Run.start())
    rows = {(r["rule_seq"], r["label"], r["n"], round(r["ratio"], 4)) for r in outcome.distributions().collect()}
    assert rows == {(1, "a", 2, 0.6667), (1, "b", 1, 0.3333)}
    empty = run_all(spark, rules, lambda schema, name: df.limit(0), Run.start())
    assert empty.distributions().count() == 0
    assert run_all(spark, [], lambda schema, name: df, Run.start()).distributions().count() == 0


def test_failing_rows_use_stored_facts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    outcome = run_all(spark, number_rules([Rule("DupEval", {"columns": ["id"]}, "t", "s")]), lambda schema, name: df, Run.start())
    monkeypatch.setattr(Duplicate, "facts", lambda self, df: pytest.fail("counted again"))
    assert sorted(r["v"] for r in outcome.failing_rows("t", rule_seq=1).collect()) == ["a", "b"]

"""Small tables and the defects put into them."""

import json
import statistics

import pytest

import fixtures as fx
from plumbline import Rule, build_check, compile_table, run_check, summary as build_summary
from plumbline.plans.ruleset import number_rules
from plumbline.plans.single import payload
from plumbline.sources.tables import from_mapping


@pytest.fixture(scope="module")
def reading_run(spark):
    source = from_mapping({"gauges": fx.gauges(spark)})
    rules = number_rules([Rule(m, c, "readings") for m, c, *_ in fx.READING_RULES])
    return compile_table(fx.readings(spark), rules, source=source)


def test_reading_rules(reading_run):
    rows = {r["rule_seq"]: r for r in reading_run.results().collect()}
    got = [(rows[i]["status"], rows[i]["failed_count"]) for i in range(1, len(fx.READING_RULES) + 1)]
    assert got == [(status, failed) for *_, status, failed in fx.READING_RULES]
    assert all(r["total_count"] == 32 for r in rows.values())


def test_failing_rows_match_counts(reading_run):
    counted = {r["rule_seq"]: r["count"] for r in reading_run.failed_records().groupBy("rule_seq").count().collect()}
    assert counted == {i: n for i, (*_, n) in enumerate(fx.READING_RULES, start=1) if n}


def test_drift_and_balance_details(spark):
    flows = [r["flow"] for r in fx.reading_rows()]
    drift = run_check(fx.readings(spark), "StatisticalDistributionEval", fx.READING_RULES[9][1])
    assert drift["drift_mean"] == pytest.approx(statistics.mean(flows) - 30)
    assert drift["drift_std"] == pytest.approx(abs(statistics.stdev(flows) - 1))
    assert "total_count" not in drift
    fine = sum(r["grade"] == "fine" for r in fx.reading_rows())
    balance = run_check(fx.readings(spark), "StatisticalDistributionEval", fx.READING_RULES[10][1])
    assert balance["max_class"] == "fine" and balance["max_class_ratio"] == pytest.approx(fine / 32)


def test_summary_payload(spark):
    config = {"column": "level", "min": 100, "max": 170}
    summary, rows = run_check(
        fx.readings(spark), "range", config, run_id="123e4567-e89b-12d3-a456-426614174000", advanced=True)
    assert summary["type"] == "range_eval" and summary["range"] == {"min": 100, "max": 170}
    assert (summary["total_count"], summary["failed_count"], summary["passed_count"]) == (32, 3, 29)
    assert summary["run_id"] == "123e4567-e89b-12d3-a456-426614174000"
    assert sorted(r["reading_id"] for r in rows.collect()) == [3, 20, 25]
    json.dumps(summary)
    row = build_summary(fx.readings(spark), build_check("RangeEval", config)).first()
    prefixed = payload(row, prefix="old_")
    assert prefixed["old_type"] == "range_eval" and prefixed["old_failed_count"] == 3 and "column" in prefixed


def test_trips(spark):
    df = fx.trips(spark)
    assert [run_check(df, m, c)["failed_count"] for m, c, _ in fx.TRIP_RULES] == [n for *_, n in fx.TRIP_RULES]


def test_tides(spark):
    out = run_check(fx.tides(spark), "DateRangeEval",
                    {"column": "high", "min_date": "2030-01-01", "max_date": "2030-01-11"})
    assert (out["status"], out["failed_count"]) == ("Failed", 7)


def test_notes(spark):
    df = fx.notes(spark)
    assert run_check(df, "MojibakeEval", {"column": "note"})["failed_count"] == 4
    assert run_check(df, "MojibakeEval", {"column": "author"})["failed_count"] == 1


def test_repeated_rows(spark):
    df = spark.createDataFrame([(7, "x"), (8, None), (8, "x"), (9, "")], "berth int, boat string")
    assert run_check(df, "DupEval", {"columns": ["berth"]})["failed_count"] == 2
    assert run_check(df, "EmptyEval", {"columns": ["boat"]})["failed_count"] == 2


def _unicode(spark, source, target, columns, form):
    schema = ", ".join(["boat int", *[f"{c} string" for c in columns]])
    config = {"key_column": "boat", "columns": columns, "normalization_form": form, "batch_size": 1000,
              "target_df": spark.createDataFrame(target, schema)}
    return run_check(spark.createDataFrame(source, schema), "UnicodeValidationEval", config, advanced=True)


def test_ledger(spark):
    out, rows = _unicode(spark, fx.LEDGER, fx.REGISTER, ["name", "part"], "NFKC")
    counts = {k: v for k, v in out.items() if k.endswith("_count")}
    assert counts == {"total_count": 6, "matched_count": 6, "failed_count": 4, "passed_count": 2,
                      "mojibake_count": 1, "replacement_char_count": 1}
    assert sorted(r["boat"] for r in rows.collect()) == [2, 3, 4, 5]


@pytest.mark.parametrize("form, failed", [("NFKC", 1), ("NFC", 2), ("NFD", 2), ("NFKD", 1)])
def test_half_width(spark, form, failed):
    out, _ = _unicode(spark, fx.HALF_WIDTH, fx.FULL_WIDTH, ["name"], form)
    assert (out["failed_count"], out["mojibake_count"]) == (failed, 0)


def test_compare_report(spark):
    schema = "boat int, name string, part string"
    source = spark.createDataFrame([*fx.LEDGER, (7, "unmatched", "x")], schema)
    target = spark.createDataFrame(fx.REGISTER, schema)
    check = build_check("UnicodeValidationEval", {
        "key_column": "boat", "columns": ["name", "part"], "target_df": target, "normalization_form": "NFKC"})
    report = {r["boat"]: r for r in check.compare_report(source).collect()}
    assert [report[i]["reason"] for i in range(1, 8)] == [
        "—", "Value mismatch", "Replacement char (U+FFFD)", "Mojibake detected", "Value mismatch", "—", "—"]
    assert report[7]["target_value"] == "NOT FOUND" and report[7]["status"] == "PASS"
    assert report[2]["target_value"] == "カモメ"

"""Increments summed up equal the whole table, also when a batch is replayed."""

import fixtures as fx
from plumbline import Rule, Run, compile_table
from plumbline.plans.ruleset import number_rules
from plumbline.streaming.accumulated import accumulated, keep_batch
from plumbline.streaming.incremental import check_stream, check_whole, failed_records, split_rules, totals

RULES = number_rules([
    Rule("RangeEval", {"column": "seats", "min": 1, "max": 40}, "trips"),
    Rule("CategoricalValuesEval", {"column": "state", "allowed_values": fx.STATES}, "trips"),
    Rule("CustomEval", {"func": "fare >= 0"}, "trips"),
    Rule("RangeEval", {"column": "zz", "min": 1, "max": 100}, "trips"),
    Rule("DupEval", {"columns": ["trip"]}, "trips"),
    Rule("DataFreshnessEval", {"column": "sailed_on"}, "trips"),
])


def test_split():
    local, whole = split_rules(RULES)
    assert [r.rule_seq for r in local] == [1, 2, 3, 4] and [r.rule_seq for r in whole] == [5, 6]


def test_whole_table_rules(spark):
    rows = check_whole(fx.trips(spark), RULES).results().collect()
    assert {r["rule_seq"]: (r["status"], r["failed_count"]) for r in rows} == {5: ("Failed", 2), 6: ("Error", 0)}


def test_increments_equal_batch(spark, tmp_path):
    df = fx.trips(spark)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    out, run = str(tmp_path / "out"), Run.start()

    def stream():
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        check_stream(source, RULES, out, run, availableNow=True).awaitTermination()

    def summed():
        columns = ("rule_seq", "status", "total_count", "failed_count")
        return sorted((tuple(r) for r in totals(spark, out).select(*columns).collect()), key=lambda r: r[0])

    stream()
    local, _ = split_rules(RULES)
    batch = compile_table(df, local, run)
    # A rule that cannot be planned still has seen all rows of the stream.
    expected = {r["rule_seq"]: (r["status"], len(fx.TRIPS), r["failed_count"]) for r in batch.results().collect()}
    assert summed() == [(k, *v) for k, v in sorted(expected.items())]
    logged = sorted(map(tuple, failed_records(spark, out).select("rule_seq", "failed_row").collect()))
    assert logged == sorted(map(tuple, batch.failed_records().select("rule_seq", "failed_row").collect()))

    before = summed()
    stream()  # nothing new
    assert summed() == before
    fx.trips(spark).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream()
    assert [r[3] for r in summed()] == [2 * r[3] if r[1] != "Error" else 0 for r in before]


def test_replayed_batch_counts_once(spark, tmp_path):
    df = fx.trips(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for checkpoint_lost in (False, True):
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        writer = check_stream(source, RULES[:1], out, Run.start(), availableNow=True)
        writer.awaitTermination()
        if not checkpoint_lost:  # forget that batch 0 was done, as after a crash before the commit
            import shutil

            shutil.move(f"{out}/checkpoint", f"{out}/checkpoint-lost")
    assert [r["total_count"] for r in totals(spark, out).collect()] == [len(fx.TRIPS)]


WHOLE = number_rules([
    Rule("DupEval", {"columns": ["k"]}, "t"),
    Rule("StatisticalDistributionEval", {"column": "k", "mode": "label_balance", "threshold": 0.5}, "t"),
    Rule("StatisticalDistributionEval", {"column": "v", "mode": "feature_drift", "tolerance": 1e-6,
                                         "reference_stats": {"mean": 1e9 + 4.5, "std": 2.4618298195866546}}, "t"),
    Rule("RowCountEval", {"min": 10, "max": 20}, "t"),
    Rule("SchemaValidationEval", {"expected_schema": {"v": "float64", "gone": "int"}}, "t"),
    Rule("ReferentialIntegrityEval", {"column": "k", "reference_df": "known", "reference_column": "k"}, "t"),
    Rule("UnicodeValidationEval", {"key_column": "k", "columns": ["k"], "target_df": "known"}, "t"),
])


def _accumulated(spark, out, parts):
    known = spark.createDataFrame([("a",), ("b",)], "k string")
    source = lambda schema, name: known
    for number, part in parts:
        keep_batch(part, number, WHOLE, out, source)
    rows = accumulated(spark, parts[0][1].schema, WHOLE, out, Run.start(), source).collect()
    return {r["rule_seq"]: (r["status"], r["total_count"], r["failed_count"], r["passed_count"]) for r in rows}


def test_states_add_up_to_the_whole_table(spark, tmp_path):
    rows = [(k, 1e9 + i % 10 if i % 4 else None) for i, k in enumerate(["a", "b", "a", None, "c", "d", "a", None, "a", "b"])]
    rows += [("e", float("nan")), ("f", 1e9 + 9)]
    df = spark.createDataFrame(rows, "k string, v double")
    parts = [(n, spark.createDataFrame(rows[5 * n:5 * n + 5], df.schema)) for n in range(3)]
    parts += [(3, df.limit(0)), (1, parts[1][1])]  # an empty increment, and one replayed
    got = _accumulated(spark, str(tmp_path), parts)
    known = lambda schema, name: spark.createDataFrame([("a",), ("b",)], "k string")
    batch = check_whole(df, WHOLE, Run.start(), known).results().collect()
    wanted = {r["rule_seq"]: (r["status"], r["total_count"], r["failed_count"], r["passed_count"]) for r in batch}
    assert got.pop(7)[0] == "Error" and wanted.pop(7)
    assert got == wanted


def test_drift_of_large_values_keeps_its_digits(spark, tmp_path):
    values = [1e9 + i % 7 for i in range(200)]
    mean = sum(values) / 200
    std = (sum((v - mean) ** 2 for v in values) / 199) ** 0.5
    rule = number_rules([Rule("StatisticalDistributionEval", {
        "column": "v", "mode": "feature_drift", "tolerance": 1e-6, "reference_stats": {"mean": mean, "std": std}}, "t")])
    for n in range(4):
        part = spark.createDataFrame([(v,) for v in values[50 * n:50 * n + 50]], "v double")
        keep_batch(part, n, rule, str(tmp_path))
    row = accumulated(spark, part.schema, rule, str(tmp_path)).first()
    assert (row["status"], row["total_count"]) == ("Success", 200)


def test_states_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, v double")
    got = _accumulated(spark, str(tmp_path), [(0, empty)])
    assert got[1] == ("Success", 0, 0, 0) and got[2][0] == "Error" and got[4][0] == "Failed"

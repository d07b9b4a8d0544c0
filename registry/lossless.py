"""Values at their edges: microseconds, blanks, nested and collated keys, odd numbers, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import Rule, Run, build_check, compile_table, summary
from plumbline.analytics import history as h
from plumbline.plans.ruleset import number_rules
from plumbline.sinks.failed_log import export_csv, promote, read_csv_options, write_log
from plumbline.sources import failed_log as log, rules as rulebook
from registry.base import check_summary, damaged, damaged_sql, query, scratch, summary_sql, table

RUN_ID = "123e4567-e89b-12d3-a456-426614174001"


def _fine_events(spark, sf):
    """Events with microseconds in their time."""
    return table(spark, sf, "events").withColumn("ts", F.expr("timestampadd(MICROSECOND, event_id % 1000 + 123456, ts)"))


FINE_EVENTS = "(SELECT * REPLACE (ts + to_microseconds(event_id % 1000 + 123456) AS ts) FROM events) AS fine"


def _promoted(spark, df, name, rules):
    """Rows of the log as written, promoted and read back."""
    run = compile_table(df, number_rules([Rule(m, c, name, "public") for m, c in rules]), Run.start(RUN_ID),
                        schema_name="public", table_name=name)
    path = scratch(spark, "log")
    write_log(run.failed_records(evened=True), path)
    target = promote(log.read_log(spark, path), name, df.schema, scratch(spark, "promoted"), RUN_ID)
    return spark.read.parquet(target).select("col", *df.columns)


@query(
    "failed_round_trip",
    f"""SELECT 'value' AS col, * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts)
        FROM {FINE_EVENTS} WHERE value IS NULL OR value > 20""",
)
def failed_round_trip(spark, sf):
    """All columns of events, times to the microsecond."""
    rows = _promoted(spark, _fine_events(spark, sf), "events", [("RangeEval", {"column": "value", "min": -1e9, "max": 20})])
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("failed_round_trip_lines", "SELECT 'l_quantity' AS col, * FROM lineitem WHERE l_quantity IS NULL OR l_quantity > 45")
def failed_round_trip_lines(spark, sf):
    """All columns of line items."""
    return _promoted(spark, table(spark, sf, "lineitem"), "lineitem",
                     [("RangeEval", {"column": "l_quantity", "min": 0, "max": 45})])


# Blanks at the ends, quotes, line breaks and separators in names.
AWKWARD = """CASE c_custkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN '' WHEN 2 THEN ' "' || c_name || '" ' WHEN 3 THEN c_name || chr(10) || 'x, y'
             WHEN 4 THEN NULL ELSE c_name || chr(92) END"""


@query("failed_csv_whole", f"SELECT * REPLACE ({AWKWARD} AS c_name), 'RangeEval' AS dqmethod FROM customer WHERE c_acctbal < 9000")
def failed_csv_whole(spark, sf):
    """Every column and character of failing customers, through CSV and back."""
    df = table(spark, sf, "customer").withColumn("c_name", F.expr(AWKWARD.replace("chr(92)", "char(92)")))
    rules = number_rules([Rule("RangeEval", {"column": "c_acctbal", "min": 9000, "max": 1e9}, "customer")])
    path = scratch(spark, "csv")
    export_csv(compile_table(df, rules).failed_records(evened=True), df.schema, path)
    shape = df.schema.simpleString()[7:-1].replace(":", " ") + ", dqmethod string, col string, run_id string"
    return spark.read.options(**read_csv_options()).schema(shape).csv(path).drop("col", "run_id")


@query("dup_nested_keys", summary_sql(
    "DupEval", "stamps", "(SELECT COUNT(*) OVER (PARTITION BY ts + to_microseconds(event_id % 2)) > 1 AS again FROM events) AS k", "again"))
def dup_nested_keys(spark, sf):
    """Arrays of times that differ by a microsecond are different keys."""
    df = table(spark, sf, "events").select(
        F.array(F.expr("timestampadd(MICROSECOND, event_id % 2, ts)")).alias("stamps"))
    return check_summary(df, "DupEval", {"columns": ["stamps"]})


@query("dup_collated_keys", summary_sql(
    "DupEval", "name", "(SELECT COUNT(*) OVER (PARTITION BY lower(c_mktsegment) || repeat('z', c_nationkey * 8)) > 1 AS again"
    " FROM customer) AS k", "again"))
def dup_collated_keys(spark, sf):
    """Texts of any length under a collation that ignores case."""
    text = F.expr("IF(c_custkey % 2 = 0, upper(c_mktsegment), lower(c_mktsegment)) || repeat('z', int(c_nationkey * 8))")
    df = table(spark, sf, "customer").select(F.collate(text, "UTF8_LCASE").alias("name"))
    return check_summary(df, "DupEval", {"columns": ["name"]})


SHIFTED = "(SELECT o_custkey - 700 AS n FROM orders) AS shifted"


@query("custom_lambda_modulo", summary_sql("CustomEval", "n", SHIFTED, "(((n % 3) + 3) % 3) <> 1"))
def custom_lambda_modulo(spark, sf):
    """Remainders of negative numbers are as in Python."""
    df = table(spark, sf, "orders").select((F.col("o_custkey") - 700).alias("n"))
    return check_summary(df, "CustomEval", {"column": "n", "func": "lambda x: x % 3 == 1"})


HOLES = "CASE WHEN event_id % 9 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 7 = 0 THEN NULL ELSE value END"


@query("custom_lambda_nan", summary_sql(
    "CustomEval", "value", f"(SELECT {HOLES} AS value FROM events) AS holes", "value IS NULL OR isnan(value) OR value < 5"))
def custom_lambda_nan(spark, sf):
    """NaN and null compare false."""
    df = table(spark, sf, "events").select(F.expr(HOLES).alias("value"))
    return check_summary(df, "CustomEval", {"column": "value", "func": "lambda x: x >= 5"})


@query("custom_lambda_truth", summary_sql(
    "CustomEval", "event_type", damaged_sql("events"), "event_type IS NULL OR event_type = ''"))
def custom_lambda_truth(spark, sf):
    """A bare text is true unless it is empty."""
    return check_summary(damaged(spark, sf, "events"), "CustomEval", {"column": "event_type", "func": "lambda x: x"})


@query(
    "trend_hour_zone",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS ts, CAST(COUNT(*) AS BIGINT) AS failed
       FROM (SELECT ts + to_hours(event_id % 24 + 24 * 40) AS ts FROM events) AS r GROUP BY 1""",
)
def trend_hour_zone(spark, sf):
    """Hours are as stored, also those that a zone skips."""
    results = table(spark, sf, "events").select(
        F.lit("Failed").alias("status"),
        F.expr("timestampadd(HOUR, event_id % 24 + 24 * 40, CAST(ts AS timestamp_ntz))").alias("run_timestamp"))
    return h.trend(results, "hour").select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), F.col("Failed").alias("failed"))


@query("freshness_offset", """SELECT CASE WHEN MAX(ts) > TIMESTAMP '2024-01-30 13:00:00' THEN 'Success' ELSE 'Failed' END AS status,
                              '2024-01-30 13:00:00' AS cutoff FROM events""")
def freshness_offset(spark, sf):
    """10:00 nine hours east of Greenwich is 01:00."""
    out = summary(table(spark, sf, "events"), build_check("DataFreshnessEval", {
        "column": "ts", "freshness_threshold": "12h", "as_of": "2024-01-31T10:00:00+09:00"}))
    return out.select("status", F.get_json_object("details", "$.cutoff_timestamp").alias("cutoff"))


@query("rules_insert_malformed", """
    SELECT control_id, config FROM (
        SELECT c_custkey AS control_id, CASE WHEN c_custkey % 5 = 0 THEN '{broken ' || c_custkey ELSE '{"columns":["c' || c_custkey || '"]}' END AS config
        FROM customer
        UNION ALL
        SELECT c_custkey + 10000000, CASE WHEN c_custkey % 2 = 0 THEN '{"columns":["n' || c_custkey || '"]}' ELSE '{worse ' || c_custkey END
        FROM customer WHERE c_custkey % 10 <> 1) AS r""")
def rules_insert_malformed(spark, sf):
    """Configurations that are no JSON, stored or new, equal only themselves and pass through."""
    keys = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    shared = [F.lit("public").alias("schema_name"), F.lit("t").alias("table_name"), F.lit("EmptyEval").alias("dqmethod")]
    when = F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at")
    stored = keys.select(
        F.col("k").alias("control_id"), *shared,
        F.expr("""CASE WHEN k % 5 = 0 THEN '{broken ' || k ELSE '{"columns":["c' || k || '"]}' END""").alias("config"),
        F.lit(True).alias("is_active"), when)
    new = keys.select(
        (F.col("k") + 10_000_000).alias("control_id"), *shared,
        F.expr("""CASE WHEN k % 10 = 1 AND k % 5 <> 0 THEN '{ "columns" : ["c' || k || '"] }'
                       WHEN k % 2 = 0 THEN '{"columns":["n' || k || '"]}' ELSE '{worse ' || k END""").alias("config"),
        F.lit(True).alias("is_active"), when)
    return rulebook.insert_rules(new, stored).select("control_id", "config")


@query("dtype_strict_int8", summary_sql(
    "DtypeEval", "{''n'': ''int8''}", "(SELECT CAST(o_custkey AS INTEGER) - 700 AS n FROM orders) AS shifted", "n NOT BETWEEN -128 AND 127"))
def dtype_strict_int8(spark, sf):
    """Whole numbers that do not fit one byte."""
    df = table(spark, sf, "orders").select((F.col("o_custkey") - 700).cast("int").alias("n"))
    return check_summary(df, "DtypeEval", {"columns": {"n": "int8"}, "strict": True})


@query("dtype_strict_double", summary_sql(
    "DtypeEval", "{''l_quantity'': ''int''}", "(SELECT CASE WHEN l_orderkey % 4 = 0 THEN l_quantity + 0.5 ELSE l_quantity END AS q FROM lineitem) AS l",
    "q <> floor(q)"))
def dtype_strict_double(spark, sf):
    """Halves are no whole numbers."""
    quantity = F.when(F.col("l_orderkey") % 4 == 0, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity"))
    df = table(spark, sf, "lineitem").select(quantity.cast("double").alias("l_quantity"))
    return check_summary(df, "DtypeEval", {"columns": {"l_quantity": "int"}, "strict": True})


# Values of both signs, halves, and values past 255.
_BALANCE = "CAST(CASE WHEN c_custkey % 4 = 0 THEN c_custkey / 2.0 WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS DOUBLE)"


@query("dtype_strict_uint8", summary_sql(
    "DtypeEval", "{''n'': ''uint8''}", f"(SELECT {_BALANCE} AS n FROM customer) AS c", "n < 0 OR n > 255 OR n != FLOOR(n)"))
def dtype_strict_uint8(spark, sf):
    df = table(spark, sf, "customer").select(F.expr(_BALANCE).alias("n"))
    return check_summary(df, "DtypeEval", {"columns": {"n": "uint8"}, "strict": True})


@query("custom_lambda_none", "\nUNION ALL\n".join(
    summary_sql("CustomEval", "c_acctbal", damaged_sql("customer"), fails) for fails in ("c_acctbal IS NULL", "c_acctbal IS NOT NULL")))
def custom_lambda_none(spark, sf):
    """Nothing else equals None, and None does."""
    df = damaged(spark, sf, "customer")
    told = [check_summary(df, "CustomEval", {"column": "c_acctbal", "func": f"lambda x: x {op} None"}) for op in ("!=", "==")]
    return told[0].unionByName(told[1])

"""The events table read as a stream of increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import Rule, Run
from plumbline.plans.ruleset import number_rules
from plumbline.sources.tables import from_mapping
from plumbline.streaming.accumulated import accumulate_stream, accumulated
from plumbline.streaming.incremental import check_stream, failed_records, totals
from registry.base import SUMMARY, damage, damaged_sql, query, scratch, summary_sql, table

EVENTS = damaged_sql("events")
RULES = [
    ("EmptyEval", {"columns": ["user_id", "event_type"]}, "user_id,event_type",
     "user_id IS NULL OR event_type IS NULL OR event_type = ''"),
    ("RangeEval", {"column": "value", "min": 0, "max": 100}, "value", "value IS NULL OR value < 0 OR value > 100"),
    ("StringFormatEval", {"column": "event_type", "pattern": "[a-z]+"}, "event_type",
     "event_type IS NULL OR NOT regexp_matches(event_type, '^[a-z]+')"),
]


def _checked(spark, sf, keep_rows):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rules = number_rules([Rule(m, c, "events", "public") for m, c, *_ in RULES])
    out = scratch(spark, "stream")
    run = check_stream(damage(stream, "events"), rules, out, Run.start(), keep_rows=keep_rows, availableNow=True)
    run.awaitTermination()
    return out


@query(
    "stream_totals",
    "\nUNION ALL\n".join(summary_sql(m, label, EVENTS, fails) for m, _, label, fails in RULES),
)
def stream_totals(spark, sf):
    return totals(spark, _checked(spark, sf, keep_rows=False)).select(*SUMMARY)


@query(
    "stream_failed_rows",
    "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS BIGINT) AS rule_seq, '{m}' AS dqmethod, event_id FROM {EVENTS} WHERE {fails}"
        for i, (m, _, _, fails) in enumerate(RULES, start=1)
    ),
)
def stream_failed_rows(spark, sf):
    event = F.get_json_object("failed_row", "$.event_id").cast("long").alias("event_id")
    return failed_records(spark, _checked(spark, sf, keep_rows=True)).select("rule_seq", "dqmethod", event)


def _in_parts(spark, sf):
    """Events in files of consecutive ids, one for each micro-batch."""
    path = scratch(spark, "parts")
    damage(table(spark, sf, "events"), "events").repartitionByRange(4, "event_id").write.parquet(path)
    return path


PART_RULES = [
    ("EmptyEval", {"columns": ["event_type"]}, "event_type", "event_type IS NULL OR event_type = ''"),
    ("CustomEval", {"func": "100 / (event_id - 7) > -1000"}, "N/A", "FALSE"),
]


@query(
    "stream_error_batch",
    f"""SELECT 'EmptyEval' AS dqmethod, 'Failed' AS status, CAST(COUNT(*) AS BIGINT) AS total_count,
               CAST(0 AS BIGINT) AS error_batches FROM {EVENTS}
        UNION ALL SELECT 'CustomEval', 'Error', CAST(COUNT(*) AS BIGINT), CAST(1 AS BIGINT) FROM {EVENTS}""",
)
def stream_error_batch(spark, sf):
    """Four micro-batches; a predicate divides by zero in one.  One total for each rule."""
    path = _in_parts(spark, sf)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    rules = number_rules([Rule(m, c, "events", "public") for m, c, *_ in PART_RULES])
    out = scratch(spark, "stream")
    check_stream(stream, rules, out, Run.start(), keep_rows=False, availableNow=True).awaitTermination()
    return totals(spark, out).select("dqmethod", "status", "total_count", "error_batches")


@query(
    "stream_many_batches",
    "\nUNION ALL\n".join(summary_sql(m, label, EVENTS, fails) for m, _, label, fails in RULES),
)
def stream_many_batches(spark, sf):
    """Counts add up over micro-batches."""
    path = _in_parts(spark, sf)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    rules = number_rules([Rule(m, c, "events", "public") for m, c, *_ in RULES])
    out = scratch(spark, "stream")
    check_stream(stream, rules, out, Run.start(), keep_rows=False, availableNow=True).awaitTermination()
    return totals(spark, out).select(*SUMMARY)


COUNTED = "CAST(COUNT(*) AS BIGINT) AS total_count, CAST(0 AS BIGINT) AS failed_count, CAST(NULL AS BIGINT) AS passed_count"
WHOLE_RULES = [
    ("DupEval", {"columns": ["user_id", "event_type"]}, "user_id,event_type"),
    ("UniqueEval", {"columns": ["event_id"]}, "event_id"),
    ("ReferentialIntegrityEval", {"column": "user_id", "reference_df": "customer", "reference_column": "c_custkey"}, "user_id"),
    ("StatisticalDistributionEval", {"column": "event_type", "mode": "label_balance", "threshold": 0.5}, "event_type"),
    ("StatisticalDistributionEval", {"column": "value", "mode": "feature_drift",
                                     "reference_stats": {"mean": 50.0, "std": 30.0}, "tolerance": 1.0}, "value"),
    ("RowCountEval", {"min": 100}, "N/A"),
    ("DataFreshnessEval", {"column": "ts", "freshness_threshold": "1d", "as_of": "2020-01-01T00:00:00"}, "ts"),
    ("UniqueEval", {"columns": ["no_such_column"]}, "N/A"),
]
PASSING = {  # of the rules that judge the table as a whole
    4: f"(SELECT MAX(n) <= 0.5 * SUM(n) FROM (SELECT COUNT(*) AS n FROM {EVENTS} GROUP BY event_type) AS classes)",
    5: "ABS(AVG(value) - 50.0) <= 1.0 AND ABS(STDDEV_SAMP(value) - 30.0) <= 1.0",
    6: "COUNT(*) >= 100",
    7: "MAX(ts) > TIMESTAMP '2019-12-31 00:00:00'",
}
PER_KEY = {
    1: f"(SELECT COUNT(*) OVER (PARTITION BY user_id, event_type) AS n FROM {EVENTS}) AS c",
    2: f"(SELECT COUNT(*) OVER (PARTITION BY event_id) AS n FROM {EVENTS}) AS c",
}


def _whole_sql():
    parts = []
    for i, (method, _, label) in enumerate(WHOLE_RULES, start=1):
        head = f"CAST({i} AS BIGINT) AS rule_seq, "
        if i in PER_KEY:
            parts.append(summary_sql(method, label, PER_KEY[i], "n > 1", head))
        elif i in PASSING:
            parts.append(f"""SELECT {head}'{method}' AS dqmethod, '{label}' AS col,
                CASE WHEN {PASSING[i]} THEN 'Success' ELSE 'Failed' END AS status, {COUNTED} FROM {EVENTS}""")
        elif method == "ReferentialIntegrityEval":
            parts.append(summary_sql(
                method, label, EVENTS, "user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM customer)", head))
        else:
            parts.append(f"""SELECT {head}'{method}' AS dqmethod, 'N/A' AS col, 'Error' AS status,
                CAST(NULL AS BIGINT) AS total_count, CAST(0 AS BIGINT) AS failed_count, CAST(NULL AS BIGINT) AS passed_count""")
    return "\nUNION ALL\n".join(parts)


@query("stream_whole_table", _whole_sql())
def stream_whole_table(spark, sf):
    """Duplicates, references, balance, drift and freshness from the states of four micro-batches."""
    path = _in_parts(spark, sf)
    events = spark.read.parquet(path)
    rules = number_rules([Rule(m, c, "events", "public") for m, c, _ in WHOLE_RULES])
    source = from_mapping({"customer": table(spark, sf, "customer")})
    out = scratch(spark, "state")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    accumulate_stream(stream, rules, out, source, availableNow=True).awaitTermination()
    return accumulated(spark, events.schema, rules, out, Run.start(), source).select("rule_seq", *SUMMARY)

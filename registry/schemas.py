"""Tables of one name in two schemas: the log, its manifest, promotion and drill-down tell them apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import Rule, Run, run_all
from plumbline.analytics.history import drill_down
from plumbline.plans.ruleset import number_rules
from plumbline.sinks.failed_log import log_outcome, promote, write_log
from plumbline.sinks.results import read_results, save_results
from plumbline.sources import failed_log as log
from registry.base import damaged, damaged_sql, query, scratch
from registry.rulesets import CUSTOMER, CUSTOMER_RULES, ORDERS, RUN_ID

# (schema, method, configuration, label, relation, condition for failing)
TWO_SCHEMAS = [("public", *rule) for rule in CUSTOMER_RULES] + [
    ("archive", "RangeEval", {"column": "o_totalprice", "min": 1000, "max": 200000}, "o_totalprice", ORDERS,
     "o_totalprice IS NULL OR o_totalprice < 1000 OR o_totalprice > 200000"),
    ("archive", "EmptyEval", {"columns": ["o_orderpriority"]}, "o_orderpriority", ORDERS,
     "o_orderpriority IS NULL OR o_orderpriority = ''"),
]
KEYS = {"public": "c_custkey", "archive": "o_orderkey"}


def _outcome(spark, sf):
    """Customers are 'customer' in one schema, orders in the other."""
    tables = {"public": damaged(spark, sf, "customer"), "archive": damaged(spark, sf, "orders")}
    rules = number_rules([Rule(m, c, "customer", schema) for schema, m, c, *_ in TWO_SCHEMAS])
    return run_all(spark, rules, lambda schema, name: tables[schema], Run.start(RUN_ID)), tables


RECORDS = "(" + "\nUNION ALL\n".join(
    f"SELECT '{schema}' AS schema_name, CAST({i} AS BIGINT) AS rule_seq, '{m}' AS dqmethod, '{label}' AS col, "
    f"{KEYS[schema]} AS id FROM {relation} WHERE {fails}"
    for i, (schema, m, _, label, relation, fails) in enumerate(TWO_SCHEMAS, start=1)
) + ") AS records"


def _with_ids(records):
    ids = F.coalesce(*[F.get_json_object("failed_row", f"$.{k}").cast("long") for k in KEYS.values()])
    return records.select("schema_name", "rule_seq", "dqmethod", "col", ids.alias("id"))


@query("failed_two_schemas", f"SELECT * FROM {RECORDS}")
def failed_two_schemas(spark, sf):
    """One schema written after the other into the log of one run."""
    outcome, _ = _outcome(spark, sf)
    path = scratch(spark, "two-schemas")
    for table in outcome.tables:
        write_log(table.failed_records(evened=True), path)
    return _with_ids(log.read_log(spark, path))


@query("failed_rows_tagged", f"SELECT * FROM {RECORDS}")
def failed_rows_tagged(spark, sf):
    """Each row stored once with its rules, written twice as by a retried job."""
    outcome, _ = _outcome(spark, sf)
    path = scratch(spark, "tagged")
    for _ in range(2):
        log_outcome(outcome, path)
    return _with_ids(log.read_log(spark, path))


@query(
    "failed_log_manifest",
    f"""SELECT '{RUN_ID}' AS run_id, schema_name, 'customer' AS table_name,
               CAST(COUNT(DISTINCT id) AS BIGINT) AS failed_rows, CAST(COUNT(*) AS BIGINT) AS failed_count
        FROM {RECORDS} GROUP BY schema_name""",
)
def failed_log_manifest(spark, sf):
    """Counted while the log is written; reading it reads no failing row."""
    outcome, _ = _outcome(spark, sf)
    path = scratch(spark, "manifest")
    log_outcome(outcome, path)
    return log.read_manifest(spark, path)


@query(
    "failed_promoted_schema",
    f"SELECT dqmethod, col, {KEYS['archive']}, o_orderpriority, o_totalprice FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{m}' AS dqmethod, '{label}' AS col, * FROM {relation} WHERE {fails}"
        for schema, m, _, label, relation, fails in TWO_SCHEMAS if schema == "archive") + ") AS promoted",
)
def failed_promoted_schema(spark, sf):
    """Promoted twice: of a run with all rows, then of the same run again."""
    outcome, tables = _outcome(spark, sf)
    path = scratch(spark, "promoted")
    records = outcome.failed_records(evened=True)
    for _ in range(2):
        target = promote(records, "customer", tables["archive"].schema, path, RUN_ID, schema_name="archive")
    return spark.read.parquet(target).select("dqmethod", "col", KEYS["archive"], "o_orderpriority", "o_totalprice")


@query(
    "drilldown_same_label",
    f"""SELECT schema_name, dqmethod, col, rule_seq, id,
               CAST(COUNT(*) OVER (PARTITION BY schema_name, rule_seq) AS BIGINT) AS failed_count
        FROM {RECORDS}""",
)
def drilldown_same_label(spark, sf):
    """Two range rules on one column: each row with the count of its own rule."""
    outcome, _ = _outcome(spark, sf)
    return _numbered(drill_down(outcome.results, outcome.failed_records()))


@query(
    "drilldown_stored",
    f"""SELECT * FROM (
          SELECT schema_name, dqmethod, col, rule_seq, id,
                 CAST(COUNT(*) OVER (PARTITION BY schema_name, rule_seq) AS BIGINT) AS failed_count,
                 MAX(rule_seq) OVER (PARTITION BY schema_name, dqmethod, col) AS last
          FROM {RECORDS}) AS r WHERE rule_seq = last""".replace("SELECT * FROM (", "SELECT * EXCLUDE (last) FROM (", 1),
)
def drilldown_stored(spark, sf):
    """From the store, which keeps the last of two rules of one label, and the log."""
    outcome, _ = _outcome(spark, sf)
    store, path = scratch(spark, "results"), scratch(spark, "log")
    save_results(outcome.results, store)
    log_outcome(outcome, path)
    return _numbered(drill_down(read_results(spark, store), log.read_log(spark, path)))


def _numbered(joined):
    ids = F.coalesce(*[F.get_json_object("failed_row", f"$.{k}").cast("long") for k in KEYS.values()])
    return joined.select("schema_name", "dqmethod", "col", "rule_seq", ids.alias("id"), "failed_count")


@query(
    "failing_rows_of_rule",
    f"SELECT * FROM {CUSTOMER} WHERE {CUSTOMER_RULES[2][4]}",
)
def failing_rows_of_rule(spark, sf):
    """The failing rows of one of two rules of one label, from a finished run."""
    outcome, _ = _outcome(spark, sf)
    return outcome.failing_rows("customer", schema_name="public", rule_seq=3)

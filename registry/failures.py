"""Failing rows: capture, log, pages, promotion, export, drill-down."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import Rule, Run, compile_table
from plumbline.analytics.history import drill_down
from plumbline.plans.ruleset import number_rules
from plumbline.sinks.failed_log import export_csv, promote, read_csv_options, write_log
from plumbline.sinks.results import keep_last, read_results, save_results, stored_form
from plumbline.sources import failed_log as log
from registry.base import damaged, damaged_sql, query, scratch, table
from registry.rulesets import LINE_RULES, RUN_ID, line_run

LINEITEM = damaged_sql("lineitem")
COLUMNS = "l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_returnflag"
DUPLICATES = """(SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
                 FROM (SELECT * FROM {}) AS d) AS dup""".format(LINEITEM)


def _records_sql() -> str:
    """The failing rows of the line-item rules; a duplicate rule needs the window."""
    parts = []
    for i, (method, _, label, relation, fails) in enumerate(LINE_RULES, start=1):
        if relation is None:
            continue
        relation = DUPLICATES if method == "DupEval" else relation
        parts.append(f"""SELECT '{RUN_ID}' AS run_id, 'public' AS schema_name, 'lineitem' AS table_name,
            CAST({i} AS BIGINT) AS rule_seq, '{method}' AS dqmethod, '{label}' AS col, {COLUMNS}
            FROM {relation} WHERE {fails}""")
    return "\nUNION ALL\n".join(parts)


RECORDS = f"({_records_sql()}) AS records"


def _from_json(records, schema, shown=("run_id", "schema_name", "table_name", "rule_seq", "dqmethod", "col")):
    parsed = records.withColumn("r", F.from_json("failed_row", schema))
    values = [F.col(f"r.{c.strip()}") for c in COLUMNS.split(",")]
    return parsed.select(*shown, *values)


@query("failed_records", f"SELECT * FROM {RECORDS}")
def failed_records(spark, sf):
    run = line_run(spark, sf)
    return _from_json(run.failed_records(evened=True), run.df.schema)


@query(
    "failed_manifest",
    f"""SELECT run_id, schema_name, table_name, CAST(COUNT(*) AS BIGINT) AS failed_count
        FROM {RECORDS} GROUP BY run_id, schema_name, table_name""",
)
def failed_manifest(spark, sf):
    return log.manifest(line_run(spark, sf).failed_records())


@query(
    "failed_log_by_rule",
    f"""SELECT run_id, table_name, rule_seq, dqmethod, col, CAST(COUNT(*) AS BIGINT) AS n,
               CAST(SUM(l_partkey) AS BIGINT) AS parts
        FROM {RECORDS} GROUP BY run_id, table_name, rule_seq, dqmethod, col""",
)
def failed_log_by_rule(spark, sf):
    """Written to the log and read back."""
    run, path = line_run(spark, sf), scratch(spark, "failed-log")
    write_log(run.failed_records(evened=True), path)
    part = F.get_json_object("failed_row", "$.l_partkey").cast("long")
    return log.read_log(spark, path).groupBy("run_id", "table_name", "rule_seq", "dqmethod", "col").agg(
        F.count(F.lit(1)).alias("n"), F.sum(part).alias("parts")
    )


@query(
    "failed_runs",
    f"SELECT run_id, table_name, CAST(COUNT(*) AS BIGINT) AS records FROM {RECORDS} GROUP BY run_id, table_name",
)
def failed_runs(spark, sf):
    runs = log.runs(line_run(spark, sf).failed_records())
    return runs.select("run_id", F.explode("tables").alias("table_name"), "records")


ORDER_SQL = damaged_sql("orders")
ORDER_JSON = ("'{\"o_orderkey\":' || CAST(o_orderkey AS VARCHAR) || ',\"o_orderstatus\":\"' || o_orderstatus ||"
              " '\",\"o_orderpriority\":' || COALESCE('\"' || o_orderpriority || '\"', 'null') || '}'")
ORDER_FAILURES = [
    (1, "EmptyEval", "o_orderpriority", "o_orderpriority IS NULL"),
    (2, "CategoricalValuesEval", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')"),
]
ORDER_RECORDS = "(" + "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS rule_seq, '{m}' AS dqmethod, '{c}' AS col, {ORDER_JSON} AS failed_row"
    f" FROM {ORDER_SQL} WHERE {fails}"
    for i, m, c, fails in ORDER_FAILURES
) + ") AS records"


def _order_records(spark, sf, evened=False):
    df = damaged(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rules = number_rules([
        Rule("EmptyEval", {"columns": ["o_orderpriority"]}, "orders", "public"),
        Rule("CategoricalValuesEval", {"column": "o_orderstatus", "allowed_values": ["F", "O"]}, "orders", "public"),
    ])
    run = compile_table(df, rules, Run.start(RUN_ID))
    return df, run.failed_records(evened)


@query("failed_json", f"SELECT * FROM {ORDER_RECORDS}")
def failed_json(spark, sf):
    """The JSON text itself, nulls kept."""
    return _order_records(spark, sf)[1].select("rule_seq", "dqmethod", "col", "failed_row")


@query("failed_page", f"SELECT * FROM {ORDER_RECORDS} ORDER BY rule_seq, failed_row LIMIT 100 OFFSET 100")
def failed_page(spark, sf):
    return log.page(_order_records(spark, sf)[1], 2).select("rule_seq", "dqmethod", "col", "failed_row")


@query(
    "failed_page_filtered",
    f"""SELECT * FROM {ORDER_RECORDS} WHERE dqmethod = 'CategoricalValuesEval' AND col = 'o_orderstatus'
        ORDER BY rule_seq, failed_row LIMIT 100""",
)
def failed_page_filtered(spark, sf):
    records = log.select_records(
        _order_records(spark, sf)[1], run_id=RUN_ID, table="orders", method="CategoricalValuesEval", col="o_orderstatus"
    )
    return log.page(records).select("rule_seq", "dqmethod", "col", "failed_row")


@query("failed_total", f"SELECT CAST(COUNT(*) AS BIGINT) AS total FROM {ORDER_RECORDS}")
def failed_total(spark, sf):
    return log.total(_order_records(spark, sf)[1])


PROMOTED = "\nUNION ALL\n".join(
    f"""SELECT '{RUN_ID}' AS run_id, '{m}' AS dqmethod, '{c}' AS col, o_orderkey, o_orderstatus, o_orderpriority
        FROM {ORDER_SQL} WHERE {fails}"""
    for _, m, c, fails in ORDER_FAILURES
)


@query("failed_flat", PROMOTED)
def failed_flat(spark, sf):
    """Promoted to a table of its own, and read from there."""
    df, records = _order_records(spark, sf, evened=True)
    target = promote(records, "orders", df.schema, scratch(spark, "promoted"), RUN_ID)
    return spark.read.parquet(target)


@query("failed_csv", PROMOTED)
def failed_csv(spark, sf):
    df, records = _order_records(spark, sf, evened=True)
    path = scratch(spark, "export")
    export_csv(records, df.schema, path)
    schema = "o_orderkey long, o_orderstatus string, o_orderpriority string, dqmethod string, col string, run_id string"
    return spark.read.options(**read_csv_options()).schema(schema).csv(path)


@query(
    "drilldown_join",
    f"""SELECT run_id, table_name, dqmethod, col, 'Failed' AS status,
               CAST(COUNT(*) OVER (PARTITION BY dqmethod, col) AS BIGINT) AS failed_count, {COLUMNS}
        FROM {RECORDS}""",
)
def drilldown_join(spark, sf):
    run = line_run(spark, sf)
    run = run.prepared()
    joined = drill_down(stored_form(keep_last(run.results())), run.failed_records(evened=True))
    shown = ("run_id", "table_name", "dqmethod", "col", "status", "failed_count")
    return _from_json(joined, run.df.schema, shown)


@query(
    "results_store",
    f"""SELECT '{RUN_ID}' AS run_id, dqmethod, col, status, failed_count FROM (
          SELECT 'EmptyEval' AS dqmethod, 'event_type' AS col,
                 CASE WHEN COUNT(*) = 0 THEN 'Success' ELSE 'Failed' END AS status, CAST(COUNT(*) AS BIGINT) AS failed_count
          FROM {damaged_sql('events')} WHERE event_type IS NULL OR event_type = ''
          UNION ALL
          SELECT 'RowCountEval', 'N/A', CASE WHEN COUNT(*) >= 1 THEN 'Success' ELSE 'Failed' END, CAST(0 AS BIGINT)
          FROM events) AS r""",
)
def results_store(spark, sf):
    """Saved twice, as a retried job would, and read back once."""
    rules = number_rules([
        Rule("EmptyEval", {"columns": ["event_type"]}, "events", "public"),
        Rule("RowCountEval", {"min": 1}, "events", "public"),
    ])
    run, path = compile_table(damaged(spark, sf, "events"), rules, Run.start(RUN_ID)), scratch(spark, "results")
    for _ in range(2):
        save_results(run.results(), path)
    stored = read_results(spark, path).filter(F.col("run_id") == RUN_ID)
    return stored.select("run_id", "dqmethod", "col", "status", "failed_count")

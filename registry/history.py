"""Questions to a result history, derived from orders: one result per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.analytics import history as h
from plumbline.operators import METHODS
from plumbline.sinks.results import keep_last
from plumbline.sources.tables import read_query
from registry.base import query, table

METHOD = "CASE " + " ".join(f"WHEN o_orderkey % {len(METHODS)} = {i} THEN '{m}'" for i, m in enumerate(METHODS)) + " END"
COLUMNS = {
    "run_id": "'run-' || CAST(o_orderkey % 89 AS VARCHAR(9))",
    "schema_name": "'public'",
    "table_name": "'table_' || CAST(o_custkey % 12 AS VARCHAR(9))",
    "dqmethod": METHOD,
    "col": "'c' || CAST(o_orderkey % 5 AS VARCHAR(9))",
    "status": "CASE WHEN o_orderkey % 13 = 0 THEN 'Error' WHEN o_orderkey % 3 = 0 THEN 'Failed' ELSE 'Success' END",
    "run_timestamp": "o_orderdate",
    "failed_count": "CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 3 = 0 THEN o_orderkey % 50 ELSE 0 END",
    "rule_seq": "o_orderkey",
}
HISTORY = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS.items())} FROM orders) AS history"
BY_STATUS = ", ".join(
    f"CAST(SUM(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{s}\"" for s in h.STATUSES
)
KEY = "run_id, schema_name, table_name, dqmethod, col"
# Timestamps leave as text, and rows of one page are told apart by their number.
PAGE = f"{KEY}, status, strftime(run_timestamp, '%Y-%m-%d') AS day"


def _history(spark, sf):
    return table(spark, sf, "orders").select(*[F.expr(e).alias(c) for c, e in COLUMNS.items()])


def _page(df):
    return df.select(*KEY.split(", "), "status", F.date_format("run_timestamp", "yyyy-MM-dd").alias("day"))


def _counts(*names):
    statuses = dict(zip(names, ("Success", "Failed", "Error")))
    return ", ".join(f"CAST(SUM(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, s in statuses.items())


@query(
    "run_summary",
    f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_evals, {_counts('passed', 'failed', 'errors')},
               CAST(SUM(failed_count) AS BIGINT) AS total_failed_records
        FROM {HISTORY} WHERE run_id = 'run-7'""",
)
def run_summary(spark, sf):
    return h.run_summary(h.select_results(_history(spark, sf), run_id="run-7"))


@query(
    "results_filtered",
    f"""SELECT {PAGE} FROM {HISTORY} WHERE table_name = 'table_3' AND status = 'Failed'
        AND run_timestamp >= TIMESTAMP '1996-01-01' AND run_timestamp <= TIMESTAMP '1999-12-31'""",
)
def results_filtered(spark, sf):
    return _page(h.select_results(
        _history(spark, sf), table="table_3", status="Failed", from_ts="1996-01-01", to_ts="1999-12-31",
    ))


@query("kpi_totals", f"SELECT CAST(COUNT(*) AS BIGINT) AS total, {_counts('success', 'failed', 'error')} FROM {HISTORY}")
def kpi_totals(spark, sf):
    return h.status_totals(_history(spark, sf))


@query("kpi_by_method", f"SELECT dqmethod, {BY_STATUS} FROM {HISTORY} GROUP BY dqmethod")
def kpi_by_method(spark, sf):
    return h.by_method(_history(spark, sf))


def _trend_sql(bucket):
    return f"""SELECT strftime(DATE_TRUNC('{bucket}', run_timestamp), '%Y-%m-%d %H:%M') AS ts, {BY_STATUS}
               FROM {HISTORY} GROUP BY 1"""


def _trend(spark, sf, bucket):
    return h.trend(_history(spark, sf), bucket).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm"))


@query("trend_hour", _trend_sql("hour"))
def trend_hour(spark, sf):
    return _trend(spark, sf, "hour")


@query("trend_day", _trend_sql("day"))
def trend_day(spark, sf):
    return _trend(spark, sf, "day")


@query("trend_week", _trend_sql("week"))
def trend_week(spark, sf):
    return _trend(spark, sf, "week")


@query(
    "run_list",
    f"""SELECT run_id, strftime(MIN(run_timestamp), '%Y-%m-%d') AS started, CAST(COUNT(*) AS BIGINT) AS total,
               CAST(SUM(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed
        FROM {HISTORY} GROUP BY run_id ORDER BY MIN(run_timestamp) DESC, run_id LIMIT 50""",
)
def run_list(spark, sf):
    return h.run_list(_history(spark, sf)).select(
        "run_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"), "total", "failed"
    )


@query(
    "latest_run",
    f"""SELECT run_id, strftime(MIN(run_timestamp), '%Y-%m-%d') AS started FROM {HISTORY}
        GROUP BY run_id ORDER BY MIN(run_timestamp) DESC, run_id DESC LIMIT 1""",
)
def latest_run(spark, sf):
    latest = h.latest_run(_history(spark, sf))
    return latest.select("run_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


SEVERITY = "CASE status WHEN 'Error' THEN 2 WHEN 'Failed' THEN 1 ELSE 0 END"


@query(
    "health_matrix",
    "SELECT table_name, " + ", ".join(
        f"CASE MAX(CASE WHEN dqmethod = '{m}' THEN {SEVERITY} END)"
        f" WHEN 2 THEN 'Error' WHEN 1 THEN 'Failed' WHEN 0 THEN 'Success' END AS {m}" for m in METHODS
    ) + f" FROM {HISTORY} GROUP BY table_name",
)
def health_matrix(spark, sf):
    return h.health_matrix(_history(spark, sf))


SHARE = "CASE WHEN COUNT(*) = 0 THEN 0.0 ELSE ROUND(100.0 * {n} / COUNT(*), 6) END"


def _kpi(name, count):
    return (f"SELECT '{name}' AS kpi, CAST({count} AS BIGINT) AS value, CAST("
            + SHARE.format(n=count) + " AS DOUBLE) AS pct")


@query(
    "kpi_percentages",
    "\nUNION ALL\n".join([
        _kpi("active_rules", "SUM(CASE WHEN c_custkey % 4 <> 0 THEN 1 ELSE 0 END)") + " FROM customer",
        *[_kpi(n, f"SUM(CASE WHEN status = '{s}' THEN 1 ELSE 0 END)") + f" FROM {HISTORY}"
          for n, s in (("passed", "Success"), ("failed", "Failed"), ("errors", "Error"))],
        "SELECT 'total_rules', CAST(COUNT(*) AS BIGINT), CAST(-1 AS DOUBLE) FROM customer",
        f"SELECT 'total_checks', CAST(COUNT(*) AS BIGINT), CAST(-1 AS DOUBLE) FROM {HISTORY}",
    ]),
)
def kpi_percentages(spark, sf):
    rules = table(spark, sf, "customer").select(F.expr("c_custkey % 4 <> 0").alias("is_active"))
    return h.kpis(rules, _history(spark, sf)).select("kpi", "value", F.round(F.coalesce("pct", F.lit(-1.0)), 6).alias("pct"))


@query(
    "quality_score",
    """SELECT o_orderkey AS rule_seq,
              CASE WHEN o_orderkey % 7 = 0 THEN 100.0
                   WHEN o_orderkey % 3 = 0 THEN 0.0
                   WHEN o_custkey % 10 = 0 THEN 0.0
                   ELSE ROUND(CAST(o_orderkey % 1000 AS DOUBLE) / (o_custkey % 10 * 997) * 100, 2) END AS score
       FROM orders""",
)
def quality_score(spark, sf):
    results = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rule_seq"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'Failed' ELSE 'Success' END").alias("status"),
        F.expr("o_custkey % 10 * 997").alias("total_count"),
        F.expr("o_orderkey % 1000").alias("passed_count"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '{\"passed\":true}' ELSE '{}' END").alias("details"),
    )
    return h.quality_score(results, {"team": "orders"}).select("rule_seq", "score")


@query("result_options", f"SELECT DISTINCT dqmethod FROM {HISTORY}")
def result_options(spark, sf):
    return h.options(_history(spark, sf), "dqmethod")


ORDERED = f"run_timestamp DESC, {KEY}"


@query("results_page", f"SELECT {PAGE} FROM {HISTORY} ORDER BY {ORDERED} LIMIT 50 OFFSET 100")
def results_page(spark, sf):
    return _page(h.results_page(_history(spark, sf), number=3))


@query("results_total", f"SELECT CAST(COUNT(*) AS BIGINT) AS total FROM {HISTORY} WHERE dqmethod = 'RangeEval'")
def results_total(spark, sf):
    return h.results_total(h.select_results(_history(spark, sf), method="RangeEval"))


@query("recent_failed", f"SELECT {PAGE} FROM {HISTORY} WHERE status = 'Failed' ORDER BY {ORDERED} LIMIT 10")
def recent_failed(spark, sf):
    return _page(h.recent_failed(_history(spark, sf)))


@query(
    "history_dedup_last",
    f"""SELECT {KEY}, rule_seq, status FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY rule_seq DESC) AS rn FROM {HISTORY}) AS ranked
        WHERE rn = 1""",
)
def history_dedup_last(spark, sf):
    return keep_last(_history(spark, sf)).select(*KEY.split(", "), "rule_seq", "status")


@query(
    "adhoc_query",
    """SELECT o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n FROM orders
       WHERE o_totalprice > 100000 GROUP BY o_orderstatus""",
)
def adhoc_query(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("adhoc_orders")
    return read_query(
        spark, "SELECT o_orderstatus, COUNT(*) AS n FROM adhoc_orders WHERE o_totalprice > :least GROUP BY o_orderstatus",
        {"least": 100000},
    )

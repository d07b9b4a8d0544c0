"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores.
Every query is planned and run in full; results go to Spark's ``noop`` sink, which
computes all rows and columns without fetching them.  Each query runs once untimed, so
that class loading and compilation are not counted, and is then timed once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from plumbline.session import local_session
from registry import QUERIES

HEADLINE = (
    "range_summary", "range_rows", "empty_summary", "categorical_summary", "stringformat_summary",
    "dtype_summary", "daterange_summary", "mojibake_summary", "custom_row", "custom_callable_summary",
    "rowcount", "feature_drift", "freshness", "label_balance",
    "dup_summary", "dup_rows", "unique_summary", "unique_rows", "ri_summary", "ri_rows",
    "unicode_summary", "unicode_rows", "compare_report",
    "ruleset_results", "ruleset_multi_table", "failed_records", "failed_log_by_rule", "drilldown_join",
    "kpi_by_method", "trend_day", "run_list", "health_matrix", "results_page", "stream_totals",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()

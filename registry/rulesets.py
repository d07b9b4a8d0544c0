"""Rule sets: many rules in one pass, several tables, YAML lists."""

from __future__ import annotations

from plumbline import Rule, Run, compile_table, plan_all, run_all, run_yaml
from plumbline.plans.ruleset import number_rules, union
from plumbline.sinks.results import keep_last, stored_form
from plumbline.sources.tables import from_mapping
from registry.base import SUMMARY, damaged, damaged_sql, query, summary_sql, table

LINEITEM, ORDERS, CUSTOMER = damaged_sql("lineitem"), damaged_sql("orders"), damaged_sql("customer")
RUN_ID = "00000000-0000-4000-8000-000000000001"

# (method, configuration, label, source, condition for failing, or None if the rule cannot be planned)
LINE_RULES = [
    ("EmptyEval", {"columns": ["l_quantity", "l_returnflag"]}, "l_quantity,l_returnflag", LINEITEM,
     "l_quantity IS NULL OR l_returnflag IS NULL OR l_returnflag = ''"),
    ("RangeEval", {"column": "l_quantity", "min": 1, "max": 40}, "l_quantity", LINEITEM,
     "l_quantity IS NULL OR l_quantity < 1 OR l_quantity > 40"),
    ("RangeEval", {"column": "l_discount", "min": 0.01, "max": 0.09}, "l_discount", LINEITEM,
     "l_discount IS NULL OR l_discount < 0.01 OR l_discount > 0.09"),
    ("RangeEval", {"column": "l_extendedprice", "min": 1000, "max": 80000}, "l_extendedprice", LINEITEM,
     "l_extendedprice IS NULL OR l_extendedprice < 1000 OR l_extendedprice > 80000"),
    ("CategoricalValuesEval", {"column": "l_returnflag", "allowed_values": ["A", "N"]}, "l_returnflag", LINEITEM,
     "l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N')"),
    ("StringFormatEval", {"column": "l_returnflag", "pattern": "[A-N]"}, "l_returnflag", LINEITEM,
     "l_returnflag IS NULL OR NOT regexp_matches(l_returnflag, '^[A-N]')"),
    ("DateRangeEval", {"column": "l_shipdate", "min_date": "1996-01-01", "max_date": "1999-12-31"}, "l_shipdate",
     LINEITEM, "l_shipdate IS NULL OR l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate > TIMESTAMP '1999-12-31'"),
    ("MojibakeEval", {"column": "l_returnflag"}, "l_returnflag", LINEITEM, "FALSE"),
    ("CustomEval", {"column": "l_tax", "func": "lambda x: x >= 0.02"}, "l_tax", LINEITEM,
     "NOT COALESCE(l_tax >= 0.02, FALSE)"),
    ("CustomEval", {"func": "l_quantity > 5 AND l_tax < 0.07"}, "N/A", LINEITEM,
     "NOT COALESCE(l_quantity > 5 AND l_tax < 0.07, FALSE)"),
    ("DupEval", {"columns": ["l_orderkey", "l_linenumber"]}, "l_orderkey,l_linenumber",
     "(SELECT COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) AS c", "n > 1"),
    ("ReferentialIntegrityEval",
     {"column": "l_orderkey", "reference_df": "orders", "reference_column": "o_orderkey"}, "l_orderkey", LINEITEM,
     "l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    ("RangeEval", {"column": "no_such_column", "min": 0, "max": 1}, "N/A", None, None),
]
ORDER_RULES = [
    ("EmptyEval", {"columns": ["o_orderpriority"]}, "o_orderpriority", ORDERS, "o_orderpriority IS NULL OR o_orderpriority = ''"),
    ("UniqueEval", {"columns": ["o_orderkey"]}, "o_orderkey",
     "(SELECT COUNT(*) OVER (PARTITION BY o_orderkey) AS n FROM orders) AS c", "n > 1"),
    ("ReferentialIntegrityEval",
     {"column": "o_custkey", "reference_df": "customer", "reference_column": "c_custkey"}, "o_custkey", ORDERS,
     "o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    ("RangeEval", {"column": "o_totalprice", "min": 0, "max": 300000}, "o_totalprice", ORDERS,
     "o_totalprice IS NULL OR o_totalprice < 0 OR o_totalprice > 300000"),
]
CUSTOMER_RULES = [
    ("EmptyEval", {"columns": ["c_name"]}, "c_name", CUSTOMER, "c_name IS NULL OR c_name = ''"),
    # The same rule twice: one of the two results is kept in the store.
    ("RangeEval", {"column": "c_acctbal", "min": 0, "max": 9000}, "c_acctbal", CUSTOMER,
     "c_acctbal IS NULL OR c_acctbal < 0 OR c_acctbal > 9000"),
    ("RangeEval", {"column": "c_acctbal", "min": 0, "max": 5000}, "c_acctbal", CUSTOMER,
     "c_acctbal IS NULL OR c_acctbal < 0 OR c_acctbal > 5000"),
]
ALL_RULES = {"lineitem": LINE_RULES, "orders": ORDER_RULES, "customer": CUSTOMER_RULES}


def rules_of(name: str) -> list[Rule]:
    return [Rule(m, c, name, "public") for m, c, *_ in ALL_RULES[name]]


def every_rule() -> list[Rule]:
    return number_rules([r for name in ALL_RULES for r in rules_of(name)])


def source(spark, sf):
    return from_mapping({name: damaged(spark, sf, name) for name in ALL_RULES})


def line_run(spark, sf):
    rules = number_rules(rules_of("lineitem"))
    return compile_table(damaged(spark, sf, "lineitem"), rules, Run.start(RUN_ID), source(spark, sf))


def rules_sql(name: str, extra: str = "", start: int = 1) -> str:
    return verdicts_sql(ALL_RULES[name], extra, start)


def verdicts_sql(rules, extra: str = "", start: int = 1) -> str:
    parts = []
    for i, (method, _, label, relation, fails) in enumerate(rules, start=start):
        head = f"{extra}CAST({i} AS BIGINT) AS rule_seq, "
        if relation is None:
            parts.append(f"""SELECT {head}'{method}' AS dqmethod, 'N/A' AS col, 'Error' AS status,
                CAST(-1 AS BIGINT) AS total_count, CAST(0 AS BIGINT) AS failed_count, CAST(-1 AS BIGINT) AS passed_count""")
        else:
            parts.append(summary_sql(method, label, relation, fails, head))
    return "\nUNION ALL\n".join(parts)


def every_rule_sql() -> str:
    parts, start = [], 1
    for name, rules in ALL_RULES.items():
        parts.append(rules_sql(name, f"'public' AS schema_name, '{name}' AS table_name, ", start))
        start += len(rules)
    return "\nUNION ALL\n".join(parts)


def _shown(results, *more):
    return results.na.fill(-1, ["total_count", "passed_count"]).select(*more, "rule_seq", *SUMMARY)


@query("ruleset_results", rules_sql("lineitem"))
def ruleset_results(spark, sf):
    return _shown(line_run(spark, sf).results())


@query("ruleset_settled", rules_sql("lineitem"))
def ruleset_settled(spark, sf):
    """As ``ruleset_results``, run at once with each failing rule set apart."""
    rows, run = line_run(spark, sf).settled()
    from plumbline.plans.ruleset import results_frame

    return _shown(results_frame(spark, rows))


@query("ruleset_multi_table", every_rule_sql())
def ruleset_multi_table(spark, sf):
    tables, _ = plan_all(every_rule(), source(spark, sf), Run.start(RUN_ID))
    return _shown(union([t.results() for t in tables]), "schema_name", "table_name")


@query(
    "results_dedup_last",
    f"""SELECT '{RUN_ID}' AS run_id, schema_name, table_name, dqmethod, col, status, failed_count AS failed_count
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY schema_name, table_name, dqmethod, col
                                           ORDER BY rule_seq DESC) AS rn
              FROM ({every_rule_sql()}) AS results) AS ranked
        WHERE rn = 1""",
)
def results_dedup_last(spark, sf):
    outcome = run_all(spark, every_rule(), source(spark, sf), Run.start(RUN_ID))
    return stored_form(keep_last(outcome.results)).drop("run_timestamp", "rule_seq")


YAML = """
run_id: "00000000-0000-4000-8000-000000000001"
evals:
  - type: empty
    columns: [c_name]
  - type: range
    column: c_acctbal
    min: 0
    max: 9000
  - type: unique
    columns: [c_custkey]
  - type: referentialintegrity
    column: c_nationkey
    reference_df: nations
    reference_column: n_nationkey
  - type: custom
    column: c_acctbal
    func: "lambda x: x > 0"
  - type: no_such_check
"""


@query(
    "yaml_report",
    "\nUNION ALL\n".join(
        f"""SELECT CAST({i} AS BIGINT) AS position,
              CASE WHEN SUM(f) = 0 THEN 'Success' ELSE 'Failed' END AS status, '{kind}' AS check_type,
              CAST(COUNT(*) AS BIGINT) AS total, CAST(SUM(f) AS BIGINT) AS failed
            FROM (SELECT CASE WHEN {fails} THEN 1 ELSE 0 END AS f FROM {relation}) AS t"""
        for i, kind, relation, fails in (
            (0, "empty_eval", CUSTOMER, "c_name IS NULL OR c_name = ''"),
            (1, "range_eval", CUSTOMER, "c_acctbal IS NULL OR c_acctbal < 0 OR c_acctbal > 9000"),
            (2, "unique_eval", "(SELECT COUNT(*) OVER (PARTITION BY c_custkey) AS n FROM customer) AS c", "n > 1"),
            (3, "referentialintegrity_eval", CUSTOMER,
             "c_nationkey IS NULL OR c_nationkey NOT IN (SELECT n_nationkey FROM nation)"),
            (4, "custom_eval_column", CUSTOMER, "NOT COALESCE(c_acctbal > 0, FALSE)"),
        )
    )
    + """\nUNION ALL\nSELECT CAST(5 AS BIGINT), 'Error', 'none', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)""",
)
def yaml_report(spark, sf):
    report = run_yaml(damaged(spark, sf, "customer"), YAML, {"nations": table(spark, sf, "nation")})
    rows = [
        (i, r["status"], r.get("type", "none"), r.get("total_count", -1), r.get("failed_count", -1))
        for i, r in enumerate(report)
    ]
    return spark.createDataFrame(rows, "position long, status string, check_type string, total long, failed long")


LABELS = [("l_returnflag", "lineitem", LINEITEM), ("o_orderpriority", "orders", ORDERS), ("c_mktsegment", "customer", CUSTOMER)]


@query(
    "ruleset_distributions",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS table_name, CAST({i} AS BIGINT) AS rule_seq, '{column}' AS col, {column} AS label,
                   CAST(COUNT(*) AS BIGINT) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS ratio
            FROM {relation} WHERE {column} IS NOT NULL GROUP BY {column}"""
        for i, (column, name, relation) in enumerate(LABELS, start=1)
    ),
)
def ruleset_distributions(spark, sf):
    """Every class of the balance rules of a run over three tables."""
    rules = [Rule("StatisticalDistributionEval", {"column": c, "mode": "label_balance"}, name, "public") for c, name, _ in LABELS]
    found = run_all(spark, number_rules(rules), source(spark, sf), Run.start(RUN_ID)).distributions()
    return found.select("table_name", "rule_seq", "col", "label", "n", "ratio")


# Two predicates that fail while they run, among rules that do not.
BAD_RULES = [
    ORDER_RULES[0],
    ("CustomEval", {"func": "CAST(key_text AS INT) > 0"}, "N/A", None, None),
    ORDER_RULES[1],
    ORDER_RULES[3],
    ("CustomEval", {"func": "o_totalprice / (o_custkey - o_custkey) > 1"}, "N/A", None, None),
    ORDER_RULES[2],
]


@query("ruleset_bad_predicates", verdicts_sql(BAD_RULES))
def ruleset_bad_predicates(spark, sf):
    """Each bad predicate ends as an error of its own; the others have their results."""
    rules = number_rules([Rule(m, c, "orders", "public") for m, c, *_ in BAD_RULES])
    outcome = run_all(spark, rules, source(spark, sf), Run.start(RUN_ID))
    return _shown(outcome.results)

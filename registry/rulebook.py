"""The rule catalogue, derived from customers: one rule per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.json import canonical_json, identity_json
from plumbline.sources import rules as rulebook
from registry.base import query, table

# Same configuration, keys in either order.
CONFIG = ("CASE WHEN c_custkey % 2 = 0 THEN '{\"column\": \"age\", \"min\": ' || CAST(c_nationkey AS VARCHAR(9)) || ', \"max\": 65}'"
          " ELSE '{\"max\":65,\"min\":' || CAST(c_nationkey AS VARCHAR(9)) || ',\"column\":\"age\"}' END")
COLUMNS = {
    "control_id": "c_custkey",
    "schema_name": "CASE WHEN c_nationkey % 2 = 0 THEN 'public' ELSE 'staging' END",
    "table_name": "c_mktsegment",
    "dqmethod": "CASE WHEN c_custkey % 3 = 0 THEN 'RangeEval' ELSE 'EmptyEval' END",
    "config": CONFIG,
    "is_active": "c_custkey % 4 <> 0",
}
CANONICAL = "'{\"column\":\"age\",\"max\":65,\"min\":' || CAST(c_nationkey AS VARCHAR) || '}'"


def _relation(shift: int = 0, cut: str = "") -> str:
    columns = ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())
    key = f"control_id + {shift}" if shift else "control_id"
    return f"""(SELECT {key} AS control_id, schema_name, table_name, dqmethod, is_active, c_nationkey, canonical
                FROM (SELECT {columns}, c_nationkey, {CANONICAL} AS canonical, c_acctbal FROM customer) AS b {cut})"""


def _rules(spark, sf):
    df = table(spark, sf, "customer")
    day = F.make_dt_interval(days=F.pmod("c_custkey", F.lit(365)).cast("int"))
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + day
    return df.select(*[F.expr(e).alias(c) for c, e in COLUMNS.items()], created.alias("created_at"), "c_acctbal")


SHOWN = ("control_id", "schema_name", "table_name", "dqmethod", "canonical", "is_active")


def _shown(df):
    return df.withColumn("canonical", canonical_json("config")).select(*SHOWN)


@query(
    "rules_list",
    f"SELECT {', '.join(SHOWN)} FROM {_relation()} AS r WHERE schema_name = 'public' AND table_name = 'BUILDING' AND is_active",
)
def rules_list(spark, sf):
    return _shown(rulebook.list_rules(_rules(spark, sf), "public", "BUILDING", active_only=True))


@query("rules_active", f"SELECT schema_name, table_name, dqmethod, control_id FROM {_relation()} AS r WHERE is_active")
def rules_active(spark, sf):
    return rulebook.active_rules(_rules(spark, sf)).drop("config")


# Customers with a negative balance hold rules already stored, the others' are new.
STORED, NEW = _relation(0, "WHERE c_acctbal < 0"), _relation(10_000_000, "WHERE c_acctbal >= 0")


def _halves(spark, sf):
    rules = _rules(spark, sf)
    stored = rules.filter("c_acctbal < 0").drop("c_acctbal")
    new = rules.filter("c_acctbal >= 0").drop("c_acctbal")
    return stored, new.withColumn("control_id", F.col("control_id") + 10_000_000)


IDENTITY = "schema_name, table_name, dqmethod, canonical"
KNOWN = f"(SELECT {IDENTITY}, MIN(control_id) AS existing_id FROM {STORED} AS s WHERE is_active GROUP BY {IDENTITY})"


@query(
    "rules_insert_guard",
    f"""SELECT n.control_id, schema_name, table_name, dqmethod, canonical, is_active, existing_id
        FROM {NEW} AS n JOIN {KNOWN} AS k USING ({IDENTITY}) WHERE n.is_active""",
)
def rules_insert_guard(spark, sf):
    stored, new = _halves(spark, sf)
    rejected = rulebook.rejected_rules(new, stored)
    return rejected.withColumn("canonical", canonical_json("config")).select(*SHOWN, "existing_id")


@query(
    "rules_insert",
    f"""SELECT {', '.join(SHOWN)} FROM {STORED} AS s
        UNION ALL SELECT {', '.join(SHOWN)} FROM {NEW} AS n WHERE NOT is_active
        UNION ALL SELECT MIN(control_id) AS control_id, schema_name, table_name, dqmethod, canonical, TRUE AS is_active
        FROM {NEW} AS n WHERE is_active AND NOT EXISTS (
            SELECT 1 FROM {KNOWN} AS k WHERE k.schema_name = n.schema_name AND k.table_name = n.table_name
            AND k.dqmethod = n.dqmethod AND k.canonical = n.canonical)
        GROUP BY {IDENTITY}""",
)
def rules_insert(spark, sf):
    stored, new = _halves(spark, sf)
    return _shown(rulebook.insert_rules(new, stored))


@query(
    "rules_set_active",
    f"""SELECT control_id, schema_name, table_name, dqmethod, canonical,
               CASE WHEN control_id IN (1, 2, 3, 50) THEN FALSE ELSE is_active END AS is_active
        FROM {_relation()} AS r""",
)
def rules_set_active(spark, sf):
    return _shown(rulebook.set_active(_rules(spark, sf), [1, 2, 3, 50], False))


@query("rules_delete", f"SELECT {', '.join(SHOWN)} FROM {_relation()} AS r WHERE control_id NOT IN (4, 5, 77)")
def rules_delete(spark, sf):
    return _shown(rulebook.delete_rules(_rules(spark, sf), [4, 5, 77]))


@query("rules_options", f"SELECT DISTINCT schema_name, table_name FROM {_relation()} AS r")
def rules_options(spark, sf):
    return rulebook.rule_options(_rules(spark, sf))


# The same numbers written in four ways, nested too; and a text that only looks like a number.
SPELLINGS = ["1", "1.0", "1e0", "10E-1"]
NUMBERED = """'{"column": "age", "min": ' || spelling || ', "more": [{"max": ' || spelling || '}, "' || spelling || '"]}'"""
SPELLED = "CASE " + " ".join(f"WHEN c_custkey % 4 = {i} THEN '{t}'" for i, t in enumerate(SPELLINGS)) + " END"


@query(
    "rules_equal_numbers",
    f"""SELECT c_nationkey, CAST(COUNT(*) AS BIGINT) AS kinds, CAST(SUM(n) AS BIGINT) AS rules
        FROM (SELECT c_nationkey, {SPELLED} AS spelling, COUNT(*) AS n FROM customer GROUP BY c_nationkey, spelling) AS t
        GROUP BY c_nationkey""",
)
def rules_equal_numbers(spark, sf):
    """Configurations are one where only numbers are written in another way; the quoted number tells four apart."""
    spelled = table(spark, sf, "customer").select("c_nationkey", F.expr(SPELLED).alias("spelling"))
    same = spelled.select("c_nationkey", identity_json(F.expr(NUMBERED)).alias("config"))
    kinds = same.groupBy("c_nationkey", "config").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rules"))

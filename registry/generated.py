"""Tables with known defects, generated from the keys of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import Rule, compile_table
from plumbline.plans.ruleset import number_rules
from plumbline.sources import generators
from registry.base import query, table

# One row per line item, numbered by part: every number occurs many times.
IDS = "(SELECT l_orderkey AS id FROM lineitem) AS ids"
EMAIL = "^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$"


def _every(*moduli):
    return " OR ".join(f"id % {m} = 0" for m in moduli)


RULES = {
    "employees": [
        ("EmptyEval", {"columns": ["name"]}, _every(5000)),
        ("RangeEval", {"column": "age", "min": 18, "max": 65}, _every(8000, 9000)),
        ("StringFormatEval", {"column": "email", "pattern": EMAIL}, _every(7000)),
        ("CategoricalValuesEval", {"column": "department", "allowed_values": list(generators.DEPARTMENTS)}, _every(6000)),
        ("CustomEval", {"column": "score", "func": "lambda x: x >= 0"}, _every(4000)),
        ("CustomEval", {"func": "lambda row: row['age'] >= 18 and row['country'] == 'US'"}, _every(8000)),
    ],
    "customers": [
        ("EmptyEval", {"columns": ["customer_name"]}, _every(5000)),
        ("StringFormatEval", {"column": "email", "pattern": EMAIL}, _every(7000)),
        ("RangeEval", {"column": "age", "min": 18, "max": 100}, _every(8000, 9000)),
        ("CategoricalValuesEval", {"column": "gender", "allowed_values": list(generators.GENDERS)}, _every(6000)),
    ],
    "products": [
        ("EmptyEval", {"columns": ["product_name"]}, _every(5000)),
        ("CategoricalValuesEval", {"column": "category", "allowed_values": list(generators.CATEGORIES)}, _every(6000)),
        ("RangeEval", {"column": "price", "min": 0, "max": 100000}, _every(7000, 9000)),
        ("RangeEval", {"column": "stock", "min": 0, "max": 10000}, _every(8000)),
        ("StringFormatEval", {"column": "supplier_email", "pattern": EMAIL}, _every(7500)),
        # Over-escaped, as stored by a seed script: no e-mail address has a backslash.
        ("StringFormatEval", {"column": "supplier_email", "pattern": EMAIL.replace("\\.", "\\\\.")}, "TRUE"),
    ],
}


def _sql(name):
    return "\nUNION ALL\n".join(
        f"""SELECT CAST({i} AS BIGINT) AS rule_seq, '{method}' AS dqmethod, CAST(COUNT(*) AS BIGINT) AS total_count,
                   CAST(SUM(CASE WHEN {fails} THEN 1 ELSE 0 END) AS BIGINT) AS failed_count FROM {IDS}"""
        for i, (method, _, fails) in enumerate(RULES[name], start=1)
    )


def _counts(spark, sf, name):
    ids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    rules = number_rules([Rule(m, c, name) for m, c, _ in RULES[name]])
    results = compile_table(getattr(generators, name)(ids), rules).results()
    return results.select("rule_seq", "dqmethod", "total_count", "failed_count")


@query("datagen_employees", _sql("employees"))
def datagen_employees(spark, sf):
    return _counts(spark, sf, "employees")


@query("datagen_customers", _sql("customers"))
def datagen_customers(spark, sf):
    return _counts(spark, sf, "customers")


@query("datagen_products", _sql("products"))
def datagen_products(spark, sf):
    return _counts(spark, sf, "products")

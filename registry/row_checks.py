"""Checks decided row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import build_check
from registry.base import check_summary, damaged, damaged_sql, query, summary_sql

CUSTOMER, ORDERS = damaged_sql("customer"), damaged_sql("orders")
LINEITEM, DOCUMENTS = damaged_sql("lineitem"), damaged_sql("documents")

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
NAME = "Customer#[0-9]{9}"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
PRIORITY_LIST = ", ".join(f"'{p}'" for p in PRIORITIES)

EMPTY = "c_name IS NULL OR c_name = '' OR c_mktsegment IS NULL OR c_mktsegment = ''"
EMPTY_TRIMMED = "c_name IS NULL OR TRIM(c_name) = ''"
RANGE = "l_quantity IS NULL OR l_quantity < 1 OR l_quantity > 40"
CATEGORY = f"o_orderpriority IS NULL OR o_orderpriority NOT IN ({PRIORITY_LIST})"
DATES = ("o_orderdate IS NULL OR o_orderdate < TIMESTAMP '1996-01-01 00:00:00'"
         " OR o_orderdate > TIMESTAMP '2000-12-31 00:00:00'")
GARBLED = ("text IS NOT NULL AND (regexp_matches(text, '[\\x{00C2}-\\x{00EF}][\\x{0080}-\\x{00BF}]')"
           " OR contains(text, '�'))")
NO_NUMBER = "key_text IS NOT NULL AND TRY_CAST(key_text AS DOUBLE) IS NULL"
NO_NAME = f"c_name IS NULL OR NOT regexp_matches(c_name, '^(?:{NAME})')"
CUSTOM_ROW = "NOT COALESCE(l_quantity > 5 AND l_returnflag <> 'R', FALSE)"

CUSTOMER_KEYS = "c_custkey, c_name, c_mktsegment"
LINE_KEYS = "l_orderkey, l_linenumber, l_quantity, l_returnflag"
ORDER_KEYS = "o_orderkey, o_orderstatus, o_orderpriority"


def _rows(df, method, config, columns):
    return build_check(method, config).failing(df).select(*[c.strip() for c in columns.split(",")])


@query("empty_summary", summary_sql("EmptyEval", "c_name,c_mktsegment", CUSTOMER, EMPTY))
def empty_summary(spark, sf):
    return check_summary(damaged(spark, sf, "customer"), "EmptyEval", {"columns": ["c_name", "c_mktsegment"]})


@query("empty_rows", f"SELECT {CUSTOMER_KEYS} FROM {CUSTOMER} WHERE {EMPTY}")
def empty_rows(spark, sf):
    config = {"columns": ["c_name", "c_mktsegment"]}
    return _rows(damaged(spark, sf, "customer"), "EmptyEval", config, CUSTOMER_KEYS)


@query("empty_trimmed_summary", summary_sql("EmptyEval", "c_name", CUSTOMER, EMPTY_TRIMMED))
def empty_trimmed_summary(spark, sf):
    return check_summary(damaged(spark, sf, "customer"), "EmptyEval", {"columns": ["c_name"], "trim": True})


@query("range_summary", summary_sql("RangeEval", "l_quantity", LINEITEM, RANGE))
def range_summary(spark, sf):
    return check_summary(damaged(spark, sf, "lineitem"), "RangeEval", {"column": "l_quantity", "min": 1, "max": 40})


@query("range_rows", f"SELECT {LINE_KEYS} FROM {LINEITEM} WHERE {RANGE}")
def range_rows(spark, sf):
    config = {"column": "l_quantity", "min": 1, "max": 40}
    return _rows(damaged(spark, sf, "lineitem"), "RangeEval", config, LINE_KEYS)


@query("range_null_passes_summary", summary_sql("RangeEval", "l_quantity", LINEITEM, "l_quantity < 1 OR l_quantity > 40"))
def range_null_passes_summary(spark, sf):
    config = {"column": "l_quantity", "min": 1, "max": 40, "null_policy": "pass"}
    return check_summary(damaged(spark, sf, "lineitem"), "RangeEval", config)


@query("categorical_summary", summary_sql("CategoricalValuesEval", "o_orderpriority", ORDERS, CATEGORY))
def categorical_summary(spark, sf):
    config = {"column": "o_orderpriority", "allowed_values": PRIORITIES}
    return check_summary(damaged(spark, sf, "orders"), "CategoricalValuesEval", config)


@query("categorical_rows", f"SELECT {ORDER_KEYS} FROM {ORDERS} WHERE {CATEGORY}")
def categorical_rows(spark, sf):
    config = {"column": "o_orderpriority", "allowed_values": PRIORITIES}
    return _rows(damaged(spark, sf, "orders"), "CategoricalValuesEval", config, ORDER_KEYS)


@query(
    "categorical_null_listed_summary",
    summary_sql("CategoricalValuesEval", "o_orderpriority", ORDERS,
                f"o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ({PRIORITY_LIST})"),
)
def categorical_null_listed_summary(spark, sf):
    config = {"column": "o_orderpriority", "allowed_values": [*PRIORITIES, None]}
    return check_summary(damaged(spark, sf, "orders"), "CategoricalValuesEval", config)


@query("stringformat_summary", summary_sql("StringFormatEval", "c_name", CUSTOMER, NO_NAME))
def stringformat_summary(spark, sf):
    return check_summary(damaged(spark, sf, "customer"), "StringFormatEval", {"column": "c_name", "pattern": NAME})


@query("stringformat_rows", f"SELECT {CUSTOMER_KEYS} FROM {CUSTOMER} WHERE {NO_NAME}")
def stringformat_rows(spark, sf):
    config = {"column": "c_name", "pattern": NAME}
    return _rows(damaged(spark, sf, "customer"), "StringFormatEval", config, CUSTOMER_KEYS)


@query(
    "stringformat_full_summary",
    summary_sql("StringFormatEval", "c_name", CUSTOMER, f"c_name IS NULL OR NOT regexp_full_match(c_name, '{NAME}')"),
)
def stringformat_full_summary(spark, sf):
    config = {"column": "c_name", "pattern": NAME, "full": True}
    return check_summary(damaged(spark, sf, "customer"), "StringFormatEval", config)


@query(
    "stringformat_preset_summary",
    summary_sql("StringFormatEval", "email", CUSTOMER, f"email IS NULL OR NOT regexp_matches(email, '{EMAIL}')"),
)
def stringformat_preset_summary(spark, sf):
    return check_summary(damaged(spark, sf, "customer"), "StringFormatEval", {"column": "email", "pattern": "@email"})


@query(
    "dtype_summary",
    summary_sql("DtypeEval", "{''key_text'': ''int'', ''o_orderkey'': ''float'', ''o_orderdate'': ''datetime''}",
                ORDERS, NO_NUMBER),
)
def dtype_summary(spark, sf):
    config = {"columns": {"key_text": "int", "o_orderkey": "float", "o_orderdate": "datetime"}}
    return check_summary(damaged(spark, sf, "orders"), "DtypeEval", config)


@query("dtype_rows", f"SELECT {ORDER_KEYS}, key_text FROM {ORDERS} WHERE {NO_NUMBER}")
def dtype_rows(spark, sf):
    return _rows(damaged(spark, sf, "orders"), "DtypeEval", {"columns": {"key_text": "int"}}, f"{ORDER_KEYS}, key_text")


@query(
    "dtype_strict_summary",
    summary_sql("DtypeEval", "{''key_text'': ''int''}", ORDERS,
                "key_text IS NOT NULL AND NOT regexp_full_match(key_text, '[+-]?[0-9]+')"),
)
def dtype_strict_summary(spark, sf):
    config = {"columns": {"key_text": "int"}, "strict": True}
    return check_summary(damaged(spark, sf, "orders"), "DtypeEval", config)


@query("daterange_summary", summary_sql("DateRangeEval", "o_orderdate", ORDERS, DATES))
def daterange_summary(spark, sf):
    config = {"column": "o_orderdate", "min_date": "1996-01-01", "max_date": "2000-12-31"}
    return check_summary(damaged(spark, sf, "orders"), "DateRangeEval", config)


@query("daterange_rows", f"SELECT {ORDER_KEYS} FROM {ORDERS} WHERE {DATES}")
def daterange_rows(spark, sf):
    config = {
        "column": "o_orderdate", "min_date": "01/01/1996", "max_date": "31/12/2000", "date_format": "%d/%m/%Y",
    }
    return _rows(damaged(spark, sf, "orders"), "DateRangeEval", config, ORDER_KEYS)


@query("mojibake_summary", summary_sql("MojibakeEval", "text", DOCUMENTS, GARBLED))
def mojibake_summary(spark, sf):
    return check_summary(damaged(spark, sf, "documents"), "MojibakeEval", {"column": "text"})


@query("mojibake_rows", f"SELECT doc_id, lang, text FROM {DOCUMENTS} WHERE {GARBLED}")
def mojibake_rows(spark, sf):
    return _rows(damaged(spark, sf, "documents"), "MojibakeEval", {"column": "text"}, "doc_id, lang, text")


@query(
    "replacement_char_rows",
    f"SELECT doc_id, lang FROM {DOCUMENTS} WHERE contains(text, '�')",
)
def replacement_char_rows(spark, sf):
    from plumbline.functions.text import has_replacement_char

    return damaged(spark, sf, "documents").filter(has_replacement_char(F.col("text"))).select("doc_id", "lang")


@query("custom_column", summary_sql("CustomEval", "l_discount", LINEITEM, "NOT (l_discount <= 0.08)"))
def custom_column(spark, sf):
    config = {"column": "l_discount", "func": "lambda x: x <= 0.08"}
    return check_summary(damaged(spark, sf, "lineitem"), "CustomEval", config)


@query("custom_row", summary_sql("CustomEval", "N/A", LINEITEM, CUSTOM_ROW))
def custom_row(spark, sf):
    config = {"func": "lambda row: row['l_quantity'] > 5 and row['l_returnflag'] != 'R'"}
    return check_summary(damaged(spark, sf, "lineitem"), "CustomEval", config)


@query("custom_sql_rows", f"SELECT {LINE_KEYS} FROM {LINEITEM} WHERE {CUSTOM_ROW}")
def custom_sql_rows(spark, sf):
    config = {"func": "l_quantity > 5 AND l_returnflag <> 'R'"}
    return _rows(damaged(spark, sf, "lineitem"), "CustomEval", config, LINE_KEYS)


@query("custom_callable_summary", summary_sql("CustomEval", "l_quantity", LINEITEM, "NOT COALESCE(l_quantity >= 10, FALSE)"))
def custom_callable_summary(spark, sf):
    def at_least_ten(quantity):
        return quantity >= 10

    config = {"column": "l_quantity", "func": at_least_ten}
    return check_summary(damaged(spark, sf, "lineitem"), "CustomEval", config)


@query("custom_callable_row_summary", summary_sql("CustomEval", "N/A", LINEITEM, CUSTOM_ROW))
def custom_callable_row_summary(spark, sf):
    def shipped_and_kept(row):
        return row["l_quantity"] > 5 and row["l_returnflag"] != "R"

    df = damaged(spark, sf, "lineitem").select("l_quantity", "l_returnflag")
    return check_summary(df, "CustomEval", {"func": shipped_and_kept})

"""Comparing the texts of two tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import build_check, summary
from plumbline.functions.text import normalised
from registry.base import damaged, damaged_sql, query, table

COMPOSED, DECOMPOSED = "\u00e9", "e\u0301"
# The target: some texts changed, accents decomposed, some keys moved or doubled.
TARGET = {
    "doc_id": "CASE WHEN doc_id % 19 = 0 THEN -doc_id WHEN doc_id % 23 = 0 THEN doc_id - 1 ELSE doc_id END",
    "body": "CASE WHEN doc_id % 17 = 0 THEN text || ' changed'"
            f" ELSE replace(text, '{COMPOSED}', '{DECOMPOSED}') END",
    "language": "CASE WHEN doc_id % 41 = 0 THEN NULL ELSE lang END",
}
SOURCE_SQL = damaged_sql("documents")
TARGET_SQL = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in TARGET.items())} FROM documents) AS target"
DAMAGED_TEXT = ("(regexp_matches(COALESCE({c}, ''), '[\\x{{00C2}}-\\x{{00EF}}][\\x{{0080}}-\\x{{00BF}}]')"
                " OR contains(COALESCE({c}, ''), '�'))")
MOJIBAKE_TEXT = "regexp_matches(COALESCE(text, ''), '[\\x{00C2}-\\x{00EF}][\\x{0080}-\\x{00BF}]')"
PAIRS = f"""(SELECT s.doc_id, s.lang, s.text, {MOJIBAKE_TEXT} AS moji, contains(COALESCE(text, ''), '�') AS repl,
        (nfc_normalize(COALESCE(s.text, '')) <> nfc_normalize(COALESCE(t.body, ''))
         OR COALESCE(s.lang, '') <> COALESCE(t.language, '')
         OR {DAMAGED_TEXT.format(c='s.text')}) AS fails
    FROM (SELECT * FROM {SOURCE_SQL}) AS s
    JOIN (SELECT * FROM {TARGET_SQL}) AS t ON s.doc_id IS NOT DISTINCT FROM t.doc_id) AS pairs"""


def _target(spark, sf):
    return table(spark, sf, "documents").select(*[F.expr(e).alias(c) for c, e in TARGET.items()])


def _check(spark, sf, form="NFC"):
    return build_check("UnicodeValidationEval", {
        "key_column": "doc_id", "columns": ["text", "lang"], "target_df": _target(spark, sf),
        "target_columns": ["body", "language"], "normalization_form": form,
    })


@query(
    "unicode_summary",
    f"""SELECT CASE WHEN SUM(CASE WHEN fails THEN 1 ELSE 0 END) = 0 THEN 'Success' ELSE 'Failed' END AS status,
               CAST((SELECT COUNT(*) FROM documents) AS BIGINT) AS total_count,
               CAST(COUNT(*) AS BIGINT) AS matched_count,
               CAST(SUM(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS failed_count,
               CAST(SUM(CASE WHEN fails THEN 0 ELSE 1 END) AS BIGINT) AS passed_count,
               CAST(SUM(CASE WHEN moji THEN 1 ELSE 0 END) AS BIGINT) AS mojibake_count,
               CAST(SUM(CASE WHEN repl THEN 1 ELSE 0 END) AS BIGINT) AS replacement_char_count
        FROM {PAIRS}""",
)
def unicode_summary(spark, sf):
    out = summary(damaged(spark, sf, "documents"), _check(spark, sf))
    details = [
        F.get_json_object("details", f"$.{n}").cast("long").alias(n)
        for n in ("matched_count", "mojibake_count", "replacement_char_count")
    ]
    return out.select("status", "total_count", "failed_count", "passed_count", *details)


@query("unicode_rows", f"SELECT doc_id, lang, text FROM {PAIRS} WHERE fails")
def unicode_rows(spark, sf):
    return _check(spark, sf).failing(damaged(spark, sf, "documents")).select("doc_id", "lang", "text")


@query(
    "compare_report",
    f"""WITH bad AS (SELECT DISTINCT doc_id FROM {PAIRS} WHERE fails),
             shown AS (SELECT doc_id, MIN(body) AS body FROM {TARGET_SQL} GROUP BY doc_id)
        SELECT s.doc_id, s.text AS source_value,
               CASE WHEN shown.doc_id IS NULL THEN 'NOT FOUND' ELSE shown.body END AS target_value,
               CASE WHEN bad.doc_id IS NULL THEN 'PASS' ELSE 'FAIL' END AS status,
               CASE WHEN bad.doc_id IS NULL THEN '—'
                    WHEN contains(COALESCE(s.text, ''), '�') THEN 'Replacement char (U+FFFD)'
                    WHEN {MOJIBAKE_TEXT.replace('text', 's.text')} THEN 'Mojibake detected'
                    ELSE 'Value mismatch' END AS reason
        FROM (SELECT * FROM {SOURCE_SQL}) AS s
        LEFT JOIN bad ON s.doc_id = bad.doc_id LEFT JOIN shown ON s.doc_id = shown.doc_id""",
)
def compare_report(spark, sf):
    return _check(spark, sf).compare_report(damaged(spark, sf, "documents"))


@query(
    "compare_summary",
    f"""SELECT CAST((SELECT COUNT(*) FROM documents) AS BIGINT) AS total_count,
               CAST(COUNT(*) AS BIGINT) AS matched_count,
               CAST(SUM(CASE WHEN fails THEN 0 ELSE 1 END) AS BIGINT) AS passed_count,
               CAST(SUM(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS failed_count
        FROM {PAIRS}""",
)
def compare_summary(spark, sf):
    counts = _check(spark, sf).counts(damaged(spark, sf, "documents"))
    return counts.select("total_count", "matched_count", "passed_count", "failed_count")


@query(
    "normalise_nfc",
    """SELECT doc_id, sha256(nfc_normalize(COALESCE(body, ''))) AS digest FROM
       (SELECT doc_id, replace(text, '""" + COMPOSED + """', '""" + DECOMPOSED + """') AS body FROM documents) AS t""",
)
def normalise_nfc(spark, sf):
    body = F.replace(F.col("text"), F.lit(COMPOSED), F.lit(DECOMPOSED))
    return table(spark, sf, "documents").select("doc_id", F.sha2(normalised(body, "NFC"), 256).alias("digest"))


@query("unicode_nfkc_summary")
def unicode_nfkc_summary(spark, sf):
    """No SQL twin: DuckDB has no NFKC.  Checked on the Japanese fixtures in the tests."""
    out = summary(damaged(spark, sf, "documents"), _check(spark, sf, "NFKC"))
    return out.select("status", "total_count", "failed_count", "passed_count")


@query(
    "unicode_rows_once",
    f"""SELECT doc_id, lang, text, CAST(COUNT(*) AS BIGINT) AS pairs
        FROM {PAIRS} WHERE fails GROUP BY doc_id, lang, text""",
)
def unicode_rows_once(spark, sf):
    """Each failing source row once, whatever the number of target rows it fails against."""
    found = _check(spark, sf).failing_once(damaged(spark, sf, "documents"))
    return found.select("doc_id", "lang", "text", F.col("__pairs").alias("pairs"))


DIGITS, WIDE_DIGITS = "0123456789", "".join(chr(0xFF10 + i) for i in range(10))
CHANGED = "CASE WHEN doc_id % 17 = 0 THEN text || ' changed' ELSE text END"


@query(
    "unicode_nfkc_digits",
    f"""SELECT CASE WHEN SUM(f) = 0 THEN 'Success' ELSE 'Failed' END AS status, CAST(COUNT(*) AS BIGINT) AS total_count,
               CAST(SUM(f) AS BIGINT) AS failed_count, CAST(SUM(1 - f) AS BIGINT) AS passed_count
        FROM (SELECT CASE WHEN translate(translate(text, '{DIGITS}', '{WIDE_DIGITS}'), '{WIDE_DIGITS}', '{DIGITS}') <> {CHANGED}
                            OR {DAMAGED_TEXT.format(c='text')} THEN 1 ELSE 0 END AS f FROM documents) AS compared""",
)
def unicode_nfkc_digits(spark, sf):
    """Full-width digits in the source, plain ones in the target: equal in NFKC."""
    documents = table(spark, sf, "documents")
    wide = documents.select("doc_id", F.translate("text", DIGITS, WIDE_DIGITS).alias("text"))
    target = documents.select("doc_id", F.expr(CHANGED).alias("text"))
    check = build_check("UnicodeValidationEval", {
        "key_column": "doc_id", "columns": ["text"], "target_df": target, "normalization_form": "NFKC"})
    return summary(wide, check).select("status", "total_count", "failed_count", "passed_count")

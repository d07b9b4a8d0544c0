"""Keyed checks against brute force, on skewed data and on every join path."""

import random
import unicodedata
from collections import Counter

import pytest

from plumbline import build_check, summary
from plumbline.operators import joins


@pytest.fixture(params=["broadcast", "hot keys", "shuffle"])
def join_path(request, monkeypatch):
    """Force each way of joining, whatever the data's size."""
    if request.param == "hot keys":
        monkeypatch.setattr(joins, "HOT_KEYS", 3)
        # Everything but the few hot keys' facts is "too large".
        real = joins.fits_broadcast
        monkeypatch.setattr(joins, "fits_broadcast", lambda df: df.count() <= 3 and real(df))
        monkeypatch.setattr("plumbline.operators.keyed.fits_broadcast", lambda df: False)
    elif request.param == "shuffle":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
        monkeypatch.setattr("plumbline.operators.keyed.fits_broadcast", lambda df: False)
    return request.param


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, many are null, a quarter are unique."""
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        key = rng.choice([1, 1, None, rng.randrange(2, 60), 1000 + i])
        rows.append((i, key, rng.choice(["a", "b", None]), "t" * rng.choice([1, 70, 71])))
    return rows, spark.createDataFrame(rows, "i int, k int, s string, t string").repartition(5)


@pytest.mark.parametrize("columns", [["k"], ["k", "s"], ["t"], ["k", "s", "t"]])
def test_duplicates(skewed, join_path, columns):
    rows, df = skewed
    at = [["i", "k", "s", "t"].index(c) for c in columns]
    counts = Counter(tuple(r[j] for j in at) for r in rows)
    expected = sorted(r[0] for r in rows if counts[tuple(r[j] for j in at)] > 1)
    check = build_check("DupEval", {"columns": columns})
    failing = check.failing(df)
    assert failing.columns == df.columns
    assert sorted(r["i"] for r in failing.collect()) == expected
    row = summary(df, check).first()
    assert (row["total_count"], row["failed_count"]) == (len(rows), len(expected))


@pytest.mark.parametrize("known", [[], [1], [1, None, 5, 5, 7], list(range(2000))])
def test_references(spark, skewed, join_path, known):
    rows, df = skewed
    reference = spark.createDataFrame([(k,) for k in known], "id long")
    expected = sorted(r[0] for r in rows if r[1] is None or r[1] not in known)
    check = build_check("ReferentialIntegrityEval", {"column": "k", "reference_df": reference, "reference_column": "id"})
    assert sorted(r["i"] for r in check.failing(df).collect()) == expected
    assert summary(df, check).first()["failed_count"] == len(expected)


WORDS = ["caf\u00e9", "cafe\u0301", "plain", "", None, "caf\u00c3\u00a9", "bad \ufffd", "\uff76\uff9e", "\u30ac"]


def _pairs(source, target, form):
    """Brute force: every matched pair with its verdict."""

    def norm(v):
        return unicodedata.normalize(form, v or "")

    def moji(v):
        return any("\u00c2" <= a <= "\u00ef" and "\u0080" <= b <= "\u00bf" for a, b in zip(v or "", (v or "")[1:]))

    for i, k, a, b in source:
        for k2, a2, b2 in target:
            if k == k2:
                m, r = moji(a) or moji(b), "\ufffd" in (a or "") or "\ufffd" in (b or "")
                yield i, k, m, r, m or r or norm(a) != norm(a2) or norm(b) != norm(b2)


@pytest.mark.parametrize("form", ["NFC", "NFKC"])
def test_text_comparison(spark, join_path, form):
    rng = random.Random(3)

    def key():
        return rng.choice([1, 1, None, rng.randrange(2, 25), rng.randrange(100, 400)])

    source = [(i, key(), rng.choice(WORDS), rng.choice(WORDS[:4])) for i in range(250)]
    target = [(key(), rng.choice(WORDS), rng.choice(WORDS[:4])) for _ in range(150)]
    pairs = list(_pairs(source, target, form))
    df = spark.createDataFrame(source, "i int, k int, a string, b string")
    other = spark.createDataFrame(target, "k int, x string, y string")
    check = build_check("UnicodeValidationEval", {
        "key_column": "k", "columns": ["a", "b"], "target_df": other, "target_columns": ["x", "y"],
        "normalization_form": form,
    })
    counts = check.counts(df).first()
    assert counts["total_count"] == len(source)
    assert counts["matched_count"] == len(pairs)
    assert counts["failed_count"] == sum(p[4] for p in pairs)
    assert counts["mojibake_count"] == sum(p[2] for p in pairs)
    assert counts["replacement_char_count"] == sum(p[3] for p in pairs)
    failing = check.failing(df)
    assert failing.columns == ["k", "i", "a", "b"]
    assert Counter(r["i"] for r in failing.collect()) == Counter(p[0] for p in pairs if p[4])

    report = {r["k"]: r for r in check.compare_report(df).collect()}
    failed_keys = {p[1] for p in pairs if p[4]}
    shown = {}
    for k, x, _ in target:
        if x is not None and (shown.get(k) is None or x < shown[k]):
            shown[k] = x
        shown.setdefault(k, None)
    assert {k for k, r in report.items() if r["status"] == "FAIL"} == failed_keys
    assert check.compare_report(df).count() == len(source)
    for k, row in report.items():
        assert row["target_value"] == (shown[k] if k in shown else "NOT FOUND")


def test_many_pairs_of_one_key(spark):
    """Repeating a row is exact beyond one block of a thousand."""
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    other = spark.range(2500).selectExpr("1 AS k", "CASE WHEN id < 400 THEN 'x' ELSE 'z' END AS a")
    check = build_check("UnicodeValidationEval", {"key_column": "k", "columns": ["a"], "target_df": other})
    got = Counter(r["a"] for r in check.failing(df).collect())
    assert got == {"x": 2100, "y": 2500}


def test_drill_down_paths(spark, join_path):
    from plumbline.analytics.history import drill_down

    results = spark.createDataFrame(
        [("r", "s", f"t{i}", "RangeEval", "c", "Failed" if i % 2 else "Success", None, i) for i in range(20)],
        "run_id string, schema_name string, table_name string, dqmethod string, col string, status string, "
        "run_timestamp timestamp_ntz, failed_count long")
    records = spark.createDataFrame(
        [("r", "s", f"t{i % 20 if i % 3 else 1}", "RangeEval", "c", str(i)) for i in range(300)]
        + [("r", "other", "t1", "RangeEval", "c", "another schema's")],
        "run_id string, schema_name string, table_name string, dqmethod string, col string, failed_row string")
    got = Counter(r["failed_row"] for r in drill_down(results, records).collect())
    assert got == Counter(str(i) for i in range(300) if (i % 20 if i % 3 else 1) % 2)

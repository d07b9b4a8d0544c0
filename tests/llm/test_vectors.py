"""Vector codes and whitening against plain numpy; quality rules against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality_rules, vector_codes, whitening

WORD = re.compile("[^\x20\x09-\x0D]+")
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(i, v, lab) for i, v, lab in rows], f"vec_id long, embedding {kind}, label int")
    for clash in ("id", "v", "x", "n", "ids", "code", "codes", "error", "sums", "bounds", "lot", "size"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def made(n, size, seed, clusters=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size)) * 3
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, size)) * 0.2
    x[n // 2] = x[0]  # equal vectors
    return x.astype(np.float32)


# -- codes ---------------------------------------------------------------------

def plain_codes(x, entries, parts, rounds):
    x = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    w = x.shape[1] // parts
    books = [x[:entries, p * w:(p + 1) * w].copy() for p in range(parts)]

    def assigned():
        d = [((x[:, None, p * w:(p + 1) * w] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        return np.stack([q.argmin(axis=1) for q in d], axis=1), sum(q.min(axis=1) for q in d)

    for _ in range(rounds):
        codes, _e = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = x[codes[:, p] == k, p * w:(p + 1) * w]
                if len(own):
                    books[p][k] = [int(s) // len(own) for s in own.sum(axis=0)]
    codes, error = assigned()
    text = ",".join(str(c) for book in books for c in book.reshape(-1))
    return codes.tolist(), error.tolist(), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n, size, entries, groups, rounds, seed", [
    (400, 8, 16, 4, 4, 1), (300, 16, 64, 8, 6, 2), (50, 4, 256, 8, 4, 3), (1, 8, 16, 8, 4, 4), (200, 4, 7, 1, 5, 5), (90, 4, 3, 8, 0, 6)])
def test_codes_equal_whole_rounds(spark, n, size, entries, groups, rounds, seed):
    x = made(n, size, seed)
    df = vectors(spark, [(i, v.tolist(), i % 3 or None) for i, v in enumerate(x)]).repartition(3)
    got = vector_codes.with_label_errors(vector_codes.encode(df, entries=entries, groups=groups, rounds=rounds)) \
        .orderBy("vec_id").collect()
    codes, error, digest = plain_codes(x, entries, 4, rounds)
    assert [r["codes"] for r in got] == codes
    assert [r["error"] for r in got] == error
    assert {r["codebooks_sha256"] for r in got} == {digest}
    totals = Counter()
    for r in got:
        totals[r["label"]] += r["error"]
    assert all(r["label_error"] == totals[r["label"]] for r in got)


def test_bounds_save_distances(spark):
    x = made(3000, 16, 7, clusters=60)
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    compared = vector_codes.encode(df, entries=64, groups=16).first()["compared"]
    assert compared < 0.6 * len(x) * 4 * 64 * 5


def test_net_moves_are_tighter_than_summed_moves():
    rng = np.random.default_rng(0)
    history = [rng.integers(-99, 99, (1, 5, 4)) for _ in range(4)]
    books = vector_codes.Codebooks(history, np.zeros((1, 5), int), 1)
    steps = sum(np.linalg.norm(b - a, axis=2) for a, b in zip(history, history[1:]))
    assert (books.moved(0) <= steps * (1 + 1e-5)).all() and (books.moved(0) < steps).any()


def test_codes_of_odd_rows(spark):
    good = [0.5, -0.25, 1.0, 2.0]
    rows = [(1, good, 1), (2, None, 1), (3, [], 1), (4, [1.0, None, 0.0, 0.0], 1), (5, [NAN, 0.0, 0.0, 0.0], 1),
            (6, [INF, 0.0, 0.0, 0.0], 1), (7, [1.0, 2.0], 1), (8, [1e6, 0.0, 0.0, 0.0], 1), (None, good, None), (1, good, 1)]
    got = vector_codes.encode(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 1]
    assert {tuple(r["codes"]) for r in got} == {(0, 0, 0, 0)} and {r["error"] for r in got} == {0}
    assert vector_codes.encode(vectors(spark, [])).count() == 0
    five = vector_codes.encode(vectors(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1)])).first()
    assert five["codebooks_sha256"] == hashlib.sha256(b"1024,2048,3072,4096,5120,0,0,0").hexdigest()


# -- whitening -----------------------------------------------------------------

def plain_whitening(x, k):
    x = np.floor(1024 * x.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return y @ q / np.sqrt(e), e / np.trace(v), [sum(int(n * a - b) ** 2 for a, b in zip(r, s)) for r in x.tolist()]


@pytest.mark.parametrize("n, size, seed", [(300, 12, 1), (500, 64, 2), (40, 3, 3)])
def test_whitening_equals_eigenvectors(spark, n, size, seed):
    x = made(n, size, seed)
    got = whitening.whiten(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).repartition(3)).orderBy("vec_id").collect()
    k = min(8, size)
    w, explained, deviation = plain_whitening(x, k)
    found = np.array([r["whitened"] for r in got])
    sign = np.sign((found * w).sum(axis=0))
    assert np.abs(found * sign - w).max() < 1e-8
    assert np.allclose(got[0]["explained"], explained, rtol=1e-9)
    assert [r["deviation"] for r in got] == deviation
    assert got[0]["identity_error"] < 1e-9 and {r["n"] for r in got} == {n}


@pytest.mark.parametrize("values", [
    np.linspace(1, 100, 40), [5.0] * 20 + [3.0] * 10 + [0.0] * 10, 10.0 ** -np.arange(0, 16, 0.4), [1.0] + [0.0] * 9,
    [7.0] * 12, [2.0, 2.0 * (1 - 1e-10), 1.0], [4.0]])
def test_divide_and_conquer(values):
    values = np.array(values)
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    h = (q * values) @ q.T
    h = (h + h.T) / 2
    e, v = whitening.eigen(h, 8)
    top = np.sort(values)[::-1][:8]
    assert np.allclose(e, top, atol=1e-13 * top[0])
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13
    assert np.linalg.norm(h @ v - v * e) < 1e-13 * np.linalg.norm(h)


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    values = np.array([3, 1e-9, -1e-9, -2, 5, -7, 1, 1, -1])
    sign = whitening.polar((q * values) @ q.T)
    assert np.abs(sign - (q * np.sign(values)) @ q.T).max() < 1e-6
    assert np.abs(sign @ sign - np.eye(9)).max() < 1e-12


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [], 0), (4, [NAN, 1.0], 0), (5, [1.0, None], 0), (6, [1.0, 2.0, 3.0], 0),
            (None, [2.0, 2.5], 0), (1, [0.0, 1.0], 0), (8, [1e30, 0.0], 0)]
    got = whitening.whiten(vectors(spark, rows, "array<double>")).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 1] and {r["n"] for r in got} == {3}
    assert whitening.whiten(vectors(spark, [])).count() == 0
    alone = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [r["whitened"] for r in alone] == [[], []] and [r["deviation"] for r in alone] == [0, 0]


def test_deviations_are_exact_or_null():
    fitted = whitening.Whitener(1 << 20, np.array([1 << 40, 7]), 1.0, np.ones(1), np.zeros((2, 1)))
    x = np.array([[1 << 20, 0], [(1 << 20) + 3, 5], [0, 0]])
    wanted = [sum((int(fitted.n) * int(a) - int(b)) ** 2 for a, b in zip(r, fitted.sums)) for r in x]
    assert fitted.deviations(x) == [d if d < 1 << 63 else None for d in wanted] and fitted.deviations(x)[2] is None


# -- quality rules -------------------------------------------------------------

def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    found = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if found[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_python(spark, documents):
    make = random.Random(5)
    words = ["the", "of", "x#", "Ünï", "a|b", "\xa0", "…", "und", "1", "𝒳𝒴"]
    texts = ["", " \t\n", None, "the", "a b c d e a b c d e", "w " * 30, "a\n\na\nb\n a\na\r\nb", "x" * 5000, "#" * 50 + "\x0b$"]
    for _ in range(150):
        texts.append(make.choice([" ", "\n", "\t\x0b "]).join(make.choices(words[:make.randint(2, 10)], k=make.randint(0, 80))))
    for _ in range(20):
        part = make.choices(words, k=make.randint(5, 12))
        texts.append(" ".join(make.choices(words, k=20) + part + make.choices(words, k=3) + part))
    rows = list(enumerate(texts)) + [(None, "a b"), (3, "again")]
    got = quality_rules.judge(documents(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(str((r["doc_id"], *[r[n] for n in names])) for r in got) \
        == sorted(str((i, *plain_measures(t))) for i, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_that_are_broken(spark, documents):
    good = "The report was written by a group of people from the city and it is kept with care in this house."
    rows = [(1, good), (2, "too short"), (3, " ".join(f"{w}### $$$" for w in good.split())),
            (4, " ".join("zzz" + c for c in "abcdefghijklmnop")), (5, " ".join(["the the the the cat"] + [f"of of of w{i}" for i in range(9)])),
            (6, "\n".join(["the same line of text is here", good] * 3)), (7, " ".join(map(str, range(30))) + " the of"), (8, None)]
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(rows)).collect()}
    assert got[1]["kept"] and got[1]["broken"] == []
    assert got[2]["broken"][0] == "words" and "symbols" in got[3]["broken"] and got[4]["broken"] == ["stop_words"]
    assert "stutter" in got[5]["broken"] and "duplicate_lines" in got[6]["broken"] and "words_with_letter" in got[7]["broken"]
    assert got[8]["base_failed"] and not any(got[i]["kept"] for i in range(2, 9))


def test_thresholds_are_a_parameter(spark, documents):
    only = (quality_rules.Threshold("long", "n_words", most=3, base=True),)
    got = quality_rules.judge(documents([(1, "a b c"), (2, "a b c d")]), thresholds=only).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [True, False] and [r["broken"] for r in got] == [[], ["long"]]


def test_one_projection_without_python(spark, documents):
    plan = quality_rules.judge(documents([(1, "a")], clashes=False))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert quality_rules.judge(documents([], clashes=False)).count() == 0

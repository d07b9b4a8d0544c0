"""Repeated passages, similar documents, neighbours: against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _blocks, ann, jaccard_join, substring_dedup
from plumbline.llm._components import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    """Short documents of few words, with copies, near copies, shared and periodic passages."""
    make = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "\xa0", "x" * 300]
    shared = make.choices(words, k=30)
    out = []
    for i in range(n):
        kind = make.random()
        if kind < 0.15 and out:
            text = make.choice(out)[1]
        elif kind < 0.4 and out:
            own = (make.choice(out)[1] or "").split(" ")
            for _ in range(make.randint(1, 3)):
                own[make.randrange(len(own))] = make.choice(words)
            text = " ".join(own)
        elif kind < 0.5:
            text = " ".join(make.choices(words, k=12) + shared + make.choices(words, k=12))
        elif kind < 0.6:
            text = " ".join(make.choices(words, k=make.randint(1, 3)) * make.randint(1, 60))
        elif kind < 0.85:
            text = "\n".join(make.choices(words, k=make.randint(0, 14)))
        else:
            text = "\t ".join(make.choices(words, k=make.randint(20, 200)))
        out.append((i, text))
    return out + [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "One"), (3, "tie of ids here")]


def kept_words(rows, window=20):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a:a + window])
            if key in seen:
                gone[a:a + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((str(i), len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed, levels, block", [(1, 2, 1 << 23), (2, 3, 400), (3, 1, 1000), (4, 2, 400)])
def test_repeated_passages(documents, seed, levels, block):
    rows = corpus(seed) + [(None, " ".join(f"w{k}" for k in range(40)))]
    got = substring_dedup.mark_repeats(documents(rows), levels=levels, block_bytes=block).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == kept_words(rows)


def test_repeated_passages_texts(documents):
    text = " ".join(f"t{k}" for k in range(25))
    docs = documents([(1, text), (2, text + " end"), (3, "a b")])
    got = {r.doc_id: r.kept for r in substring_dedup.mark_repeats(docs, texts=True).collect()}
    assert got == {1: text, 2: "end", 3: "a b"}
    assert substring_dedup.mark_repeats(documents([])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.mark_repeats(docs, window=25)


def groups(rows, threshold=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, text in rows:
        words = WORD.findall((text or "").translate(lower))
        sets.append(frozenset(tuple(words[a:a + 5]) for a in range(max(1, len(words) - 4))) if words else frozenset())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed, threshold, block", [(1, 80, 1 << 23), (2, 80, 500), (3, 60, 800), (5, 50, 1 << 23)])
def test_similar_documents(documents, seed, threshold, block):
    rows = corpus(seed, 90)
    got = jaccard_join.similar_documents(documents(rows), threshold=threshold, block_bytes=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows, threshold)


def test_chains_and_stars_of_near_copies(documents):
    """Neighbours in a chain link, its ends do not; a hub links spokes that do not link."""
    words = [f"c{k}" for k in range(260)]
    chain = [(k, " ".join(words[5 * k:5 * k + 60])) for k in range(40)]
    hub = [f"h{k}" for k in range(80)]
    spokes = [(101 + k, " ".join(hub[:4 * k] + [f"s{k}"] + hub[4 * k + 1:])) for k in range(20)]
    rows = chain + [(100, " ".join(hub))] + spokes
    got = jaccard_join.similar_documents(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows)
    assert {r.component_id for r in got} == {0, 100}


def thue_morse(n, flip=0):
    """Words on which polynomials modulo a power of two agree, whatever their base."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


@pytest.mark.parametrize("size", [8, 64, 1024, 4096])
def test_words_of_one_length_keep_apart(documents, size):
    one, other = thue_morse(size), thue_morse(size, 1)
    raw = f"{one} {other}".encode()
    for key in (1, 2):
        a, b = _blocks.hash_words(raw, np.array([0, size + 1]), np.array([size, 2 * size + 1]), key)
        assert a != b
    assert {r.component_id for r in jaccard_join.similar_documents(documents([(1, one), (2, other)])).collect()} == {1, 2}
    head = " ".join(f"w{i}" for i in range(19))
    got = substring_dedup.mark_repeats(documents([(1, f"{head} {one}"), (2, f"{head} {other}")])).collect()
    assert {r.n_removed for r in got} == {0}


def test_hashes_of_words_are_their_own(documents):
    make = random.Random(3)
    words = list({bytes(make.choices(range(33, 256), k=make.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)})
    raw = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for key in (1, 2):
        found = _blocks.hash_words(raw, starts, ends, key)
        assert len(set(found.tolist())) == len(words)
        again = _blocks.hash_words(raw[starts[9]:], np.array([0]), np.array([ends[9] - starts[9]]), key)
        assert again[0] == found[9]


def test_rows_keep_their_other_columns(spark):
    rows = [(1, "a b c d e f", None, [1, None], {"k": 1.5}), (2, "A b c d e f", "x", None, None), (3, None, "y", [], {}),
            (4, "", None, [2], None), (5, "é \x00 z", "q", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, missing string, rest array<int>, c0 map<string,double>")
    kept = jaccard_join.one_of_each(docs, block_bytes=8)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == [rows[0], *rows[2:]]


def test_one_of_each(spark, documents, files):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (7, "other"), (8, None), (9, None), (7, "other"), (None, "null id")]
    for docs in (documents(rows), documents(rows).coalesce(1)):
        path = f"{files()}/docs-{docs.rdd.getNumPartitions()}"
        docs.write.mode("overwrite").parquet(path)
        for given in (docs, spark.read.parquet(path)):
            kept = jaccard_join.one_of_each(given)
            assert kept.columns == docs.columns
            assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "8", "9", "None"]
    assert jaccard_join.one_of_each(documents([])).count() == 0


@pytest.mark.parametrize("n", range(1, 9))
def test_subsets_prove_links(n):
    """Light sets share a key exactly if they link."""
    make = random.Random(n)
    for _ in range(30):
        pool = np.arange(1, 13, dtype=np.uint64)
        a = np.sort(make.sample(pool.tolist(), n)).astype(np.uint64)
        b = np.sort(make.sample(pool.tolist(), make.randint(1, 8))).astype(np.uint64)
        keys = [{(k, *s) for k, s in zip(*(x.tolist() for x in jaccard_join._subsets(v, 60, 8)))} for v in (a, b)]
        sizes = (min(len(a), len(b)), max(len(a), len(b)))
        shared = len(set(a.tolist()) & set(b.tolist()))
        linked = 100 * shared >= 60 * (len(a) + len(b) - shared)
        assert any(k[1:] == sizes for k in keys[0] & keys[1]) == linked


def test_components(spark):
    make = random.Random(7)
    links = [(k, k + 1) for k in range(60)] + [(200, 100 + k) for k in range(30)] + [(k, k) for k in (5, 300)]
    links += [(make.randint(400, 460), make.randint(400, 460)) for _ in range(35)]
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent if any(n in link and link[0] != link[1] for link in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_codes():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 500, dtype=np.uint64))
    filled = _blocks.fill_gaps(values, 255**4)
    assert set(values.tolist()) <= set(filled.tolist()) and (np.diff(filled.astype(np.int64)) > 0).all()
    for width in (4, 5):
        own = _blocks.fill_gaps(values, (1 << 8 * width) - 1)
        assert (_blocks.unpack_codes(_blocks.pack_codes(own, width), width) == own).all()


def test_word_hashes_differ():
    words = [f"{a}{b}{c}".encode() for a in range(60) for b in "abcdefghij" for c in range(60)] + [b"y" * k for k in range(1, 99)]
    row = _blocks._packed(0, [1], [b" ".join(words)], [None]).to_pylist()[0]
    assert len(set(_blocks.Block(row).words.tolist())) == len(set(words)) == len(words)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, v string")


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 100)
    make = np.random.default_rng(4)
    centres = make.standard_normal((8, 16)) * 2
    x = (centres[make.integers(0, 8, 3000)] + make.standard_normal((3000, 16))).astype(np.float32)
    x[1000:1900] = x[7]  # a group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0] * 3),
           (5500, [float("inf")] * 16), (None, [1.0] * 16), (0, rows[0][1])]
    got = ann.search(vectors(spark, rows + odd), F.col("vec_id") % 100 == 0).toPandas()
    x = x.astype(float)
    hits = asked = 0
    for i in range(0, 3000, 100):
        score = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        score[i] = np.inf
        true = np.lexsort((np.arange(3000), score))[:10]
        own = got[got.query_id == i].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and i not in own.vec_id.tolist()
        assert np.allclose(own.score, score[own.vec_id]) and own.score.is_monotonic_increasing
        hits, asked = hits + len(set(true) & set(own.vec_id)), asked + 10
        if 1000 <= i < 1900:
            assert own.vec_id.tolist() == true.tolist()  # ties go to the smaller ids
    assert hits >= 0.9 * asked and set(got.query_id) == set(range(0, 3000, 100))


def test_few_neighbours(spark):
    few = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0])]
    got = ann.search(vectors(spark, few), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(vectors(spark, few[2:]), F.col("vec_id") % 100 == 0).count() == 0

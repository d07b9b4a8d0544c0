"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into passages of ``PASSAGE`` words, every half a
passage.  Passages are TF-IDF vectors over the items' words, with document frequencies from
the whole corpus.  A randomised singular value decomposition of the items' passages gives
the latent space; every passage of every document is folded in and compared with all items
by cosine.  What comes near enough is checked word by word: the longest common subsequence
of the item and the text around the passage must hold most of the item's words, and of
its rare words.  Where it holds fewer than a copy would (a paraphrase), the item's answer
must be there too: what follows ``Answer:``, or else its last sentence.  Of an item longer than a
passage it is a leak as well if a document holds ``COPY`` of the words of one passage.

The decomposition is of the items' passages, not of the corpus's, for what it has to tell
apart is the items: the leading directions of a whole corpus are its commonest words.

The benchmark is taken in blocks of at most ``RANK`` passages, so that the latent space holds
all of a block's passages whole and what is broadcast is bounded.  An item of more passages
is spread over several blocks and still reported once.  Documents stay where they are:
nothing of them is shuffled but counts of terms.

Items of fewer than ``LEAST_WORDS`` words are compared exactly.  They leak where they are the
whole text, or where their words and next to them their answer follow each other, with the
word ``answer`` between or not; the words of an item that is all answer prove nothing inside
a text.

Cases: null and empty texts leak nothing; items that are null or without words are not looked
for; repeated rows and items are each reported;
without items, or without documents, the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import ArrowUDFType

from plumbline.llm._memory import give_back, tidy

PASSAGE, LEAST_WORDS = 32, 5
#: Rank of the latent space, which is the most passages of a block, and the columns it is
#: looked for with besides.
RANK, SPARE, TURNS = 512, 16, 2
#: Terms in a larger share of the documents, and in more than so many, count as common;
#: each item keeps its rarest.
COMMON, COMMON_DOCS, KEPT_TERMS = 0.01, 10, 8
#: Least cosine of a candidate; least share of an item's words, and of its rare words, in
#: the common subsequence; the share from which no answer is asked for.
COSINE, WORDS, RARE_WORDS, COPY = 0.35, 0.6, 0.6, 0.85
#: Items of fewer than LEAST_WORDS words that are searched together.
SHORT_ITEMS = 65536
#: Texts that are searched together.
TEXTS = 256
#: Raw words a worker remembers.
MAX_WORDS = 1_000_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_COMMON_EDGES = ".,;:!?\"'()[]{}<>-_*#|&%$/"
_ANSWER = re.compile(r"\banswer\s*:\s*(.+)\Z", re.I | re.S)


def word(raw: str) -> str:
    """A word as it is compared: lower case, without punctuation at its ends."""
    raw = raw.lower().strip(_COMMON_EDGES)
    return raw if raw.isalnum() else _EDGES.sub("", raw)


def words_of(text: str) -> list[str]:
    return [w for w in map(word, text.split()) if w]


class _Terms(dict):
    """Raw word -> number of its term; -1 for others, -2 for what is no word."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms

    def __missing__(self, raw: str) -> int:
        plain = word(raw)
        number = self[raw] = self.terms.get(plain, -1) if plain else -2
        return number


@dataclass
class Model:
    """What is known of a block of items.  ``space`` has a row for each term: its weight
    times its place in the latent space."""

    item_ids: list[int]
    items: list[list[str]]
    answers: list[list[str]]
    terms: dict[str, int]
    weights: np.ndarray
    space: np.ndarray
    passages: np.ndarray
    owners: np.ndarray
    starts: np.ndarray
    least_terms: int

    def finder(self) -> "Finder":
        return Finder(self)


def _halves(sizes: np.ndarray) -> np.ndarray:
    """For words of texts of ``sizes`` words, the number of their half passage; texts are
    kept apart by an unused number."""
    n = -(-sizes // (PASSAGE // 2)) + 1
    first = np.cumsum(n) - n
    own = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first, sizes) + own // (PASSAGE // 2)


class Finder:
    """Searches texts for a model's items."""

    def __init__(self, model: Model):
        self.model = model
        self.known = _Terms(model.terms)
        self.item_words = [set(i) for i in model.items]
        rare = model.terms
        self.rare = [[w for w in i if w in rare] for i in model.items]
        self.queries = model.passages.T.astype(np.float32)

    def candidates(self, texts: list[list[str]]) -> set[tuple[int, int, int, int]]:
        """(text, item, half passage, start in the item) of passages near one of an item's.
        ``texts`` are raw words."""
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        numbers = [np.fromiter(map(self.known.__getitem__, t), np.int32, len(t)) for t in texts]
        numbers = [n[n > -2] for n in numbers]
        sizes = np.array([len(n) for n in numbers], np.int64)
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        at = np.flatnonzero(flat >= 0)
        if not len(at):
            return set()
        half = _halves(sizes)[at]
        starts = np.flatnonzero(np.diff(half, prepend=-1))
        place, held = half[starts], np.diff(np.append(starts, len(half)))
        # A passage is a half and the next; halves without terms add nothing.
        after = np.append(np.where(place[1:] == place[:-1] + 1, held[1:], 0), 0)
        chosen = np.flatnonzero(held + after >= self.model.least_terms)
        n = -(-sizes // (PASSAGE // 2)) + 1
        first = np.cumsum(n) - n
        found = set()
        ends = np.append(starts, len(half))
        for a in range(0, len(chosen), 8192):
            own = chosen[a:a + 8192]
            size = held[own] + after[own]
            where = np.repeat(ends[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            terms, cuts = flat[at[where]], np.cumsum(size) - size
            vectors = np.add.reduceat(self.model.space[terms], cuts, axis=0)
            mass = np.add.reduceat(self.model.weights[terms] ** 2, cuts)
            scores = vectors @ self.queries
            rows, which = np.nonzero(scores >= COSINE * np.sqrt(mass)[:, None])
            halves = place[own][rows]
            texts_of = np.searchsorted(first, halves, "right") - 1
            found.update(zip(texts_of.tolist(), self.model.owners[which].tolist(),
                             (halves - first[texts_of]).tolist(), self.model.starts[which].tolist()))
        return found

    def find(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text the items that leak into it, with the share of their words."""
        raw = [t.split() if t else [] for t in texts]
        out: list[dict[int, float]] = [{} for _ in texts]
        plain: dict[int, list[str]] = {}
        for (text, item, half), near in groupby(sorted(self.candidates(raw)), key=lambda c: c[:3]):
            if out[text].get(item, 0) >= COPY:
                continue
            if text not in plain:
                plain[text] = [w for w in map(word, raw[text]) if w]
            share = self.share(item, plain[text], half, [start for *_, start in near])
            if share > out[text].get(item, 0):
                out[text][item] = share
        return [[(self.model.item_ids[i], s) for i, s in sorted(found.items())] for found in out]

    def share(self, item: int, text: list[str], half: int, starts: list[int]) -> float:
        """The share of the item's words in the text around a passage that is near the
        item's passages at ``starts``; 0 if it is no leak."""
        wanted = self.model.items[item]
        middle = half * (PASSAGE // 2)
        around = text[max(0, middle - len(wanted)):middle + PASSAGE + len(wanted)]
        share = common_subsequence(wanted, around) / len(wanted)
        if self.whole(item, share, around) or self.part(wanted, text, middle, starts):
            return share
        return 0.0

    def whole(self, item: int, share: float, around: list[str]) -> bool:
        """Whether what is around has most of the item."""
        rare = self.rare[item]
        if share < WORDS or rare and common_subsequence(rare, around) < RARE_WORDS * len(rare):
            return False
        if share < COPY:
            answer, there = self.model.answers[item], set(around)
            if sum(w in there for w in answer) < WORDS * len(answer):
                return False
        return True

    def part(self, wanted: list[str], text: list[str], middle: int, starts: list[int]) -> bool:
        """Whether one of the item's passages is copied, if it is longer than one."""
        if len(wanted) <= PASSAGE:
            return False
        around = text[max(0, middle - PASSAGE):middle + 2 * PASSAGE]
        for start in starts:
            start = min(start, len(wanted) - PASSAGE)  # the last is as long as the others
            passage = wanted[start:start + PASSAGE]
            if common_subsequence(passage, around) >= COPY * PASSAGE:
                rare = [w for w in passage if w in self.model.terms]
                if common_subsequence(rare, around) >= RARE_WORDS * len(rare):
                    return True
        return False


@dataclass
class ShortModel:
    """Items of fewer than ``LEAST_WORDS`` words: the places of those that leak as a whole
    text of these words, and as these words in a row."""

    item_ids: list[int]
    whole: dict[tuple[str, ...], list[int]]
    runs: dict[tuple[str, ...], list[int]]

    @classmethod
    def of(cls, block: list[tuple[int, str]]) -> "ShortModel":
        model = cls([i for i, _ in block], {}, {})
        for k, (_, text) in enumerate(block):
            words, answer = words_of(text), _answer(text)
            told = _ANSWER.search(text)
            asked = words_of(text[:told.start()]) if told else words[:len(words) - len(answer)]
            for run in {tuple(words), tuple(asked + answer)}:
                model.whole.setdefault(run, []).append(k)
                if asked and answer:
                    model.runs.setdefault(run, []).append(k)
        return model

    def finder(self) -> "ShortFinder":
        return ShortFinder(self)


class ShortFinder:
    """Searches texts for a model's short items."""

    def __init__(self, model: ShortModel):
        self.model = model
        self.lengths: dict[str, set[int]] = {}
        for run in model.runs:
            self.lengths.setdefault(run[0], set()).add(len(run))

    def find(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text the items that leak into it, with the share of their words."""
        out = []
        for text in texts:
            words = words_of(text) if text else []
            own: dict[tuple[str, ...], list[int]] = {}
            if len(words) < LEAST_WORDS and (items := self.model.whole.get(tuple(words))):
                own[tuple(words)] = items
            for a, w in enumerate(words):
                for n in self.lengths.get(w, ()):
                    run = tuple(words[a:a + n])
                    if run in self.model.runs:
                        own.setdefault(run, self.model.runs[run])
            out.append([(self.model.item_ids[i], 1.0) for i in sorted(set(chain.from_iterable(own.values())))])
        return out


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    bits: dict[str, int] = {}
    for i, w in enumerate(a):
        bits[w] = bits.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        match = bits.get(w)
        if match:
            both = row & match
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def _answer(text: str) -> list[str]:
    told = _ANSWER.search(text)
    if told:
        return words_of(told[1])
    sentences = [s for s in map(words_of, re.split(r"[.!?]+(?:\s+|\Z)", text)) if s]
    return sentences[-1] if sentences else []


def _frequencies(docs: DataFrame, text_col: str, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and the number of documents with a text."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(shared.value)
        total, n = np.zeros(len(shared.value), np.int64), 0
        slices = (b.column(0).slice(a, TEXTS) for b in batches for a in range(0, b.num_rows, TEXTS))  # batches are large
        for text in (t for part in slices for t in part.to_pylist()):
            raw = text.split()
            own = np.bincount(np.fromiter(map(known.__getitem__, raw), np.int64, len(raw)) + 2,
                              minlength=len(total) + 2)[2:]
            total += own > 0
            n += 1
            if len(known) > MAX_WORDS:
                known.clear()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))],
                                         ["term", "n"])

    rows = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(tidy(count), "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms), np.int64)
    inside = rows[rows["term"] >= 0]
    out[inside["term"].to_numpy()] = inside["n"].to_numpy()
    return out, int(rows.loc[rows["term"] < 0, "n"].sum())


def models(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> Iterator[Model | ShortModel]:
    """A model for each block of items."""
    for group in _groups(docs, benchmark, text_col, item_col, item_text_col):
        yield from group


def _passages(n: int) -> range:
    """Where the passages of an item of ``n`` words start."""
    return range(0, max(1, n - PASSAGE // 2), PASSAGE // 2)


def _groups(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str,
            item_text_col: str) -> Iterator[list[Model | ShortModel]]:
    """Models that belong together: one, or those that an item of more than ``RANK`` passages
    is spread over."""
    items = benchmark.where(F.col(item_text_col).isNotNull()) \
        .select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")) \
        .orderBy("item_id", "text")
    block: list[tuple[int, str, range]] = []
    short: list[tuple[int, str]] = []
    held = 0
    for row in items.toLocalIterator():
        n = len(words_of(row["text"]))
        if n < LEAST_WORDS:
            if n:
                short.append((row["item_id"], row["text"]))
            if len(short) == SHORT_ITEMS:
                yield [ShortModel.of(short)]
                short = []
            continue
        starts = _passages(n)
        if block and held + len(starts) > RANK:
            yield [_model(docs, text_col, block)]
            block, held = [], 0
        if len(starts) > RANK:
            yield [_model(docs, text_col, [(row["item_id"], row["text"], starts[a:a + RANK])])
                   for a in range(0, len(starts), RANK)]
        else:
            block.append((row["item_id"], row["text"], starts))
            held += len(starts)
    if block:
        yield [_model(docs, text_col, block)]
    if short:
        yield [ShortModel.of(short)]


def _model(docs: DataFrame, text_col: str, block: list[tuple[int, str, range]]) -> Model:
    """A model of the passages that start where the block's ranges say."""
    items = [words_of(t) for _, t, _ in block]
    # The words of a spread item's other passages are another block's.
    parts = [i[r[0]:r[-1] + PASSAGE] for i, (_, _, r) in zip(items, block)]
    every = sorted({w for i in parts for w in i})
    found, n = _frequencies(docs, text_col, {w: k for k, w in enumerate(every)})
    often = dict(zip(every, found.tolist()))
    kept = {w for w in every if often[w] <= max(COMMON_DOCS, COMMON * n)}
    for i in parts:
        kept.update(sorted(set(i), key=lambda w: (often[w], w))[:KEPT_TERMS])
    terms = {w: k for k, w in enumerate(sorted(kept))}
    weights = np.log((n + 1) / (np.array([often[w] for w in sorted(kept)]) + 1)) + 1
    owners, starts, rows = [], [], []
    for k, i in enumerate(items):
        for a in block[k][2]:
            own = [terms[w] for w in i[a:a + PASSAGE] if w in terms]
            if own:
                owners.append(k)
                starts.append(a)
                rows.append(own)
    # A leak keeps most of an item's words, and a passage holds half of the item's fullest
    # one at least, however the two lie.
    fullest = [max((len(r) for r, o in zip(rows, owners) if o == k), default=1) for k in range(len(items))]
    least = max(1, min(3, int(WORDS * min(fullest) / 2)))
    basis = latent_space(docs.sparkSession, rows, weights)
    space = (weights[:, None] * basis).astype(np.float32)
    passages = np.stack([space[r].sum(axis=0) for r in rows])
    passages /= np.maximum(np.linalg.norm(passages, axis=1), 1e-9)[:, None]
    return Model([i for i, _, _ in block], items, [_answer(t) for _, t, _ in block], terms,
                 weights.astype(np.float32), space, passages, np.array(owners), np.array(starts), least)


def latent_space(spark, rows: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """The leading right singular vectors (terms x RANK) of the passages' TF-IDF matrix A.

    A is spread over the cluster by rows.  Each turn multiplies random columns by A'A: every
    task handles its rows, and what the tasks have of a term is summed by term.
    """
    terms, rank = len(weights), min(RANK, len(rows), len(weights))
    columns = min(rank + SPARE, terms)
    matrix = spark.createDataFrame(pa.table({"row": pa.array(range(len(rows)), pa.int64()),
                                             "terms": pa.array(rows, pa.list_(pa.int32()))}))

    def times(block: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(weights[:, None] * block)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for own in b.column(0).to_pylist():
                    image = shared.value[own].sum(axis=0)  # a row of A times the columns
                    for t in own:
                        out[t] = out.get(t, 0) + weights[t] * image
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())],
                ["term", "v"])

        def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(v) for v in part["v"])
            return pd.DataFrame({"term": [key[0]], "v": [total.tobytes()]})

        got = matrix.select("terms").mapInArrow(multiply, "term int, v binary") \
            .groupBy("term").applyInPandas(add, "term int, v binary").collect()
        out = np.zeros_like(block)
        for r in got:
            out[r["term"]] = np.frombuffer(r["v"])
        return out

    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((terms, columns)))[0]
    for _ in range(TURNS):
        basis = np.linalg.qr(times(basis))[0]
    # In the basis, A'A is a small symmetric matrix.
    small = basis.T @ times(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


def leaks_of(model: Model | ShortModel, text: Column) -> Column:
    """Column with the items that leak into ``text`` and the share of their words."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)  # bounded by RANK or SHORT_ITEMS

    found_type = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = shared.value.finder()
        try:
            for texts in batches:  # large: their texts are taken out some at a time
                parts = []
                for a in range(0, len(texts), TEXTS):
                    found = finder.find(texts.slice(a, TEXTS).to_pylist())
                    parts.append(pa.array([[{"item_id": i, "share": s} for i, s in own] for own in found], found_type))
                yield pa.concat_arrays(parts) if parts else pa.array([], found_type)
        finally:
            del finder
            give_back()

    kind = F.arrow_udf(find, "array<struct<item_id:long,share:double>>", ArrowUDFType.SCALAR_ITER)
    return kind(text)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``share`` of the item's words, for each leak of an item into a
    document."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, share double")
    for group in _groups(docs, benchmark, text_col, "item_id", "text"):
        found = leaks_of(group[0], F.col(text_col))
        if len(group) > 1:  # parts of one item: its best share
            found = F.slice(F.sort_array(F.concat(*[leaks_of(m, F.col(text_col)) for m in group]), asc=False), 1, 1)
        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("found"))
        out = out.unionByName(found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.share"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without those that an item leaks into."""
    for model in models(docs, benchmark, text_col=text_col):
        docs = docs.where(F.size(F.coalesce(leaks_of(model, F.col(text_col)), F.array())) == 0)
    return docs

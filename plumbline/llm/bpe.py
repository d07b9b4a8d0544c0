"""Byte-pair encoding with an index of pair occurrences, and decoding.

The distinct words of a batch lie in one array of symbols.  An index maps the rank of each
adjacent pair to all its positions; the lowest active rank is merged everywhere at once,
and only the pairs next to a merge change their lists.  Ranks only grow this way, as a
pair that holds a merged symbol comes after the merge that makes it (checked on loading).

The vocabulary file must be of the word-level kind: NFC, white space and case folding by
its normalizer, words cut by its pattern, byte-level symbols, BPE with a word-end suffix
and no decoder, so that decoded text is the tokens with a blank between them.  Words are
cut by the library's own normalizer and pre-tokenizer; merging is done here.

Cases: a null text is empty: no ids, empty decoded text; strings of special tokens inside
a text are those tokens, as the library takes them; repeated rows each get their row;
an empty table gives an empty result; ids that are unknown or null are refused by ``decode``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm._memory import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Distinct words a task remembers; beyond, it starts anew.
MAX_WORDS = 600_000
#: Characters of text whose new words are merged together.
SLICE_CHARS = 6 << 20
SLICE_ROWS = 2048
#: The same for a task that writes ids, a stage among others whose memory Spark still holds.
SMALL_WORDS, SMALL_CHARS, SMALL_ROWS = 60_000, 1 << 20, 512
#: Python's blanks that are none for the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class PairIndexEncoder:
    """Merges for a vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or spec.get("decoder") or model.get("byte_fallback") \
                or model.get("continuing_subword_prefix") or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a word-level BPE vocabulary without decoder")
        self.suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.vocab = vocab
        self.tokens = np.array([""] * (1 + max([*vocab.values(), *special.values()])), object)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        born = np.full(len(self.tokens), -1, np.int64)
        for rank, new in enumerate(self.made.tolist()):
            if born[new] < 0:
                born[new] = rank
        if (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError(f"{path}: a merge comes before the one that makes its parts")
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        keys = left << 32 | right
        self.key_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.key_order[at], -1)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each byte-level word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1  # a gap after each word
        sym = np.full(int(sizes.sum()) + len(words) + 1, -1, np.int32)
        vocab, suffix = self.vocab, self.suffix
        plain = {c: vocab[c] for w in words for c in w[:-1]}
        final = {c: vocab[c + suffix] for c in {w[-1] for w in words}}
        inside = np.ones(len(sym), bool)
        inside[ends] = inside[-1] = False
        sym[inside] = np.fromiter((plain[c] if k else final[c] for w in words
                                   for k, c in zip(range(len(w) - 1, -1, -1), w)), np.int32, int(sizes.sum()))
        after = np.arange(1, len(sym) + 1, dtype=np.int64)
        after[-1] = len(sym) - 1
        before = np.arange(-1, len(sym) - 1, dtype=np.int64)
        before[0] = len(sym) - 1  # the last place is a gap
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            good = ranks >= 0
            if not good.any():
                return
            places, ranks = places[good], ranks[good]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for a, z, rank in zip(starts, starts[1:], ranks[[0, *cuts]].tolist()):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(places[a:z])

        enter(np.arange(len(sym) - 1), self.ranks(sym[:-1], sym[1:]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            a, b = self.left[rank], self.right[rank]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b:  # of overlapping places the left one merges
                at = np.unique(at)
                kept, last = [], -1
                for place in at.tolist():
                    if place != last:
                        kept.append(place)
                        last = int(after[place])
                at = np.array(kept, np.int64)
            if not len(at):
                continue
            gone = after[at]
            sym[at] = self.made[rank]
            sym[gone] = -2
            following = after[gone]
            after[at] = following
            before[following] = at
            before[0] = len(sym) - 1
            left = before[at]
            enter(np.concatenate([left, at]), np.concatenate(
                [self.ranks(sym[left], sym[at]), self.ranks(sym[at], sym[following])]))
        kept = sym >= 0
        counts = np.add.reduceat(kept, np.concatenate([[0], ends[:-1] + 1])) if len(words) else []
        return np.split(sym[kept], np.cumsum(counts)[:-1])


#: Marks that are a piece of their own after letters.
_MARKS = ("", ".", ",", ";", ":", "!", "?", ")")


class TextEncoder:
    """Ids of texts, and unless ``decoded`` is false what they decode to; each distinct run of
    non-blank characters is encoded once."""

    def __init__(self, path: str, decoded: bool = True):
        self.pairs, self.decoded = PairIndexEncoder(path), decoded
        self.most, self.chars, self.rows = (MAX_WORDS, SLICE_CHARS, SLICE_ROWS) if decoded else (SMALL_WORDS, SMALL_CHARS, SMALL_ROWS)
        self.known: dict[str, tuple[str, str, int]] = {}

    def pieces(self, run: str) -> list[str]:
        """The byte-level words of a run."""
        if run.isascii():  # letters, perhaps with one mark at the end, need no library
            core, mark = (run, "") if run.isalpha() else (run[:-1], run[-1])
            if core.isalpha() and mark in _MARKS:
                return [core.lower(), mark] if mark else [core.lower()]
        tokenizer = self.pairs.tokenizer
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(run))]

    def learn(self, runs: list[str]) -> None:
        """Id text, decoded text and number of ids of new runs."""
        pieces = [self.pieces(r) for r in runs]
        words = dict.fromkeys(p for ps in pieces for p in ps)
        # A run of small plain letters is a piece of itself.
        told = {w: self.known[w] for w in words if w in self.known and w.isalpha() and w.isascii() and w.islower()}
        words = [w for w in words if w not in told]
        tokens = self.pairs.tokens
        for word, ids in zip(words, self.pairs.merge(words)):
            ids = ids.tolist()
            told[word] = (" ".join(map(str, ids)), " ".join([tokens[i] for i in ids]) if self.decoded else "", len(ids))
        for run, ps in zip(runs, pieces):
            found = [told[p] for p in ps]
            self.known[run] = found[0] if len(found) == 1 else (
                " ".join(f[0] for f in found), " ".join(f[1] for f in found) if self.decoded else "", sum(f[2] for f in found))

    def runs(self, text: str) -> list[str]:
        """What the text's ids are put together from; special tokens are runs too."""
        if "<|" in text and self.pairs.cut.search(text) or _SEPARATORS.search(text):
            return [r for part in self.pairs.cut.split(text) if part
                    for r in ([part] if part in self.pairs.special else _split(part))]
        return text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """Id text, decoded text and number of ids of each text."""
        at = 0
        while at < len(texts):
            if len(self.known) > self.most:
                self.known.clear()
            for special, i in self.pairs.special.items():
                self.known[special] = (str(i), special, 1)
            runs, size = [], 0
            while at + len(runs) < len(texts) and size < self.chars:
                text = texts[at + len(runs)]
                size += len(text)
                runs.append(self.runs(text))
            new = list({r for rs in runs for r in rs if r not in self.known})
            if new:
                self.learn(new)
            known = self.known
            for rs in runs:
                found = [known[r] for r in rs]
                yield (" ".join([f[0] for f in found if f[2]]),
                       " ".join([f[1] for f in found if f[2]]) if self.decoded else "",
                       sum([f[2] for f in found]))
            at += len(runs)


_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _split(text: str) -> list[str]:
    return [r for r in _BLANKS.split(text) if r]


def _slices(batches: Iterator[pa.RecordBatch], encoder: TextEncoder) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that neither texts nor results of a large one are held at once.

    Words are forgotten at a task's end: Spark keeps Python workers for other tasks, which
    need the memory.
    """
    try:
        for b in batches:
            yield from (b.slice(at, encoder.rows) for at in range(0, b.num_rows, encoder.rows))
    finally:
        encoder.known = {}
        give_back()


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """This process's encoder."""
    return TextEncoder(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextEncoder(path, decoded=False)  # a task's own: other stages need the memory after it
        for b in _slices(batches, own):
            ids = [np.fromstring(i, np.int32, sep=" ") for i, _, _ in own.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                ["doc_id", "n_tokens", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text``: the tokens of each row's ids with blanks between."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = text_encoder(path).pairs.tokens
        for b in batches:
            texts = [None if ids is None else " ".join(tokens[np.array(ids, np.int64)]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")) \
        .mapInArrow(rows, "doc_id long, text string")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_encoder(path)
        for b in _slices(batches, own):
            made = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    for ids, text, n in own.encode(b.column(1).to_pylist())]
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(
        rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))

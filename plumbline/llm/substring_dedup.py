"""Remove passages that occur earlier, found by doubling the length of repeated windows.

First all windows of a fraction of the length are compared by short codes: of 150 million
windows each needs two bytes in the shuffle.  Only windows that occur more than once can
be halves of longer repeats: those are extended to twice their length, and so on up to the
length asked for, as long as candidates survive.  There 96-bit hashes decide which
occurrence is the first.

A window belongs to one document.  "Earlier" is a smaller id, or an earlier start in the
same document; null ids come before all others, and rows with the same id follow each
other by their text.  A word is removed if any window over it occurs earlier.

Cases: null and empty texts have no words and keep none; texts shorter than the window keep
all words; repeated rows lose everything but the first copy's words; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm._blocks import (Block, BlockTable, CodeSpace, block_table, join_halves,
                                   pack_codes, unpack_codes, windows)
from plumbline.session import cut_lineage

LISTS = "bucket long, block long, width int, codes binary, exact binary"
FLAGS = "block long, level int, bucket long, flags binary"


def mark_repeats(docs: DataFrame, *, window: int = 20, levels: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", block_bytes: int | None = None,
                 texts: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of each document, or with
    ``texts`` the kept words themselves as ``kept``.

    ``window`` words are compared after ``levels`` - 1 doublings.
    """
    if window % 2 ** (levels - 1):
        raise ValueError(f"{window} words cannot be halved {levels - 1} times")
    schema = "doc_id long, n_words long, n_removed long, " + ("kept string" if texts else "kept_sha256 string")
    blocks = block_table(docs, id_col, text_col, block_bytes)
    try:
        space = CodeSpace.of(blocks.n_words, blocks.scale)
        lengths = [window >> k for k in range(levels - 1, -1, -1)]
        flags = None
        for level in range(levels):
            lists = _with(blocks, flags).mapInArrow(_lister(lengths, level, space), LISTS)
            found = lists.groupBy("bucket").applyInPandas(_matcher(level, level == levels - 1), FLAGS)
            found = cut_lineage(found.select("block", F.struct("level", "bucket", "flags").alias("fact")))
            flags = found if flags is None else flags.unionByName(found)
        return cut_lineage(_with(blocks, flags).mapInArrow(_remover(lengths, space, texts), schema))
    finally:
        blocks.drop()


def _with(blocks: BlockTable, flags: DataFrame | None) -> DataFrame:
    if flags is None:
        return blocks.rows().withColumn("fact", F.lit(None).cast("array<struct<level:int,bucket:long,flags:binary>>"))
    return blocks.with_facts(flags, "fact")


class _Levels:
    """A block's candidate windows, level by level."""

    def __init__(self, row: dict, lengths: list[int], space: CodeSpace):
        self.block, self.space, self.lengths = Block(row), space, lengths
        self.facts: dict[int, dict[int, np.ndarray]] = {}
        for f in row["fact"] or ():
            self.facts.setdefault(f["level"], {})[f["bucket"]] = np.unpackbits(np.frombuffer(f["flags"], np.uint8))
        self.room = self.block.room()

    def walk(self, last: int):
        """Start, hash and second hash of the candidates at level ``last``."""
        hashes = windows(self.block.words, self.lengths[0], 1)
        at = np.flatnonzero(self.room[:len(hashes)] >= self.lengths[0])
        hashes = hashes[at]
        second = None
        for level in range(last):
            alive = np.zeros(len(self.block.words) + 1, bool)
            alive[at[self.repeated(level, hashes)]] = True
            places = np.zeros(len(alive), np.uint64)
            places[at] = hashes
            half = self.lengths[level]
            at = np.flatnonzero(alive[:-half] & alive[half:])
            at = at[self.room[at] >= 2 * half] if len(at) else at
            hashes = join_halves(places[at], places[at + half], 1)
        if last == len(self.lengths) - 1:
            whole = windows(self.block.words_again(), self.lengths[last], 2)
            second = whole[at].astype(np.uint32)
        return at, hashes, second

    def repeated(self, level: int, hashes: np.ndarray) -> np.ndarray:
        """Which windows occur more than once, here or in other blocks."""
        codes, which, n = np.unique(self.space.codes(hashes), return_inverse=True, return_counts=True)
        return ((self.space.places(codes, self.facts.get(level, {})) > 0) | (n > 1))[which]


def _lister(lengths: list[int], level: int, space: CodeSpace):
    last = level == len(lengths) - 1

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                own = _Levels(row, lengths, space)
                _, hashes, second = own.walk(level)
                out = []
                if last:
                    pairs = _distinct(hashes, second)[0]
                    buckets = (pairs["a"] >> np.uint64(64 - space.bucket_bits)).astype(np.int64)
                    edges = np.searchsorted(buckets, np.arange((1 << space.bucket_bits) + 1))
                    for k in np.flatnonzero(np.diff(edges)):
                        out.append((int(k), row["block"], 0, None, pairs[edges[k]:edges[k + 1]].tobytes()))
                else:
                    for bucket, width, filled in space.split(np.unique(space.codes(hashes))):
                        out.append((bucket, row["block"], width, pack_codes(filled, width), None))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(),
                                                                    pa.binary(), pa.binary()))],
                        ["bucket", "block", "width", "codes", "exact"])

    return lists


_PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])


def _distinct(hashes: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (hash, second hash), the number of each window's pair, and which
    windows are the first of theirs."""
    order = np.lexsort((second, hashes))
    a, b = hashes[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    pairs = np.zeros(int(new.sum()), _PAIR)
    pairs["a"], pairs["b"] = a[new], b[new]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.zeros(len(order), bool)
    first[order[new]] = True  # lexsort is stable: the first in block order
    return pairs, number, first


def _matcher(level: int, last: bool):
    def match(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        """For each block's list of a bucket, which entries other blocks have too: any
        other, or at the last level an earlier one."""
        lists = lists.sort_values("block")
        parts = [np.frombuffer(x, _PAIR) if last else unpack_codes(x, w)
                 for x, w in zip(lists["exact"] if last else lists["codes"], lists["width"])]
        sizes = np.array([len(x) for x in parts])
        values = np.concatenate(parts)
        order = np.lexsort((values["b"], values["a"])) if last else np.argsort(values, kind="stable")
        ordered = values[order]
        same = ordered[1:] == ordered[:-1]
        seen = np.zeros(len(values), bool)
        seen[order[1:][same]] = True
        if not last:
            seen[order[:-1][same]] = True
        flags = [np.packbits(x).tobytes() for x in np.split(seen, np.cumsum(sizes)[:-1])]
        found = [any(f) for f in flags]
        return pd.DataFrame({"block": lists["block"].to_numpy()[found], "level": level, "bucket": key[0],
                             "flags": [f for f, y in zip(flags, found) if y]})

    return match


def _remover(lengths: list[int], space: CodeSpace, texts: bool):
    top = len(lengths) - 1

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                own = _Levels(row, lengths, space)
                at, hashes, second = own.walk(top)
                pairs, number, first = _distinct(hashes, second)
                known = np.zeros(len(pairs), bool)
                buckets = (pairs["a"] >> np.uint64(64 - space.bucket_bits)).astype(np.int64)
                for bucket, flags in own.facts.get(top, {}).items():
                    a, z = np.searchsorted(buckets, [bucket, bucket + 1])
                    known[a:z] = flags[:z - a]
                gone = at[known[number] | ~first]
                block = own.block
                edge = np.zeros(len(block.words) + lengths[-1] + 1, np.int32)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + lengths[-1], -1)
                kept = np.cumsum(edge[:len(block.words)]) == 0
                n = np.diff(block.bounds)
                left = np.add.reduceat(np.append(kept, False), block.bounds[:-1]) * (n > 0) if len(n) else n
                out = []
                for text, z, k, m in zip(block.texts(), block.bounds, left.tolist(), n.tolist()):
                    words = text.split()
                    if k < m:
                        words = compress(words, kept[z:z + m].tolist())
                    whole = b" ".join(words)
                    out.append(whole.decode() if texts else hashlib.sha256(whole).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(n - left, pa.int64()), pa.array(out, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept" if texts else "kept_sha256"])

    return remove

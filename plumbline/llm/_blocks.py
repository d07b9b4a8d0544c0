"""Documents packed into blocks, and word windows of whole blocks as numpy arrays.

A block holds consecutive documents, in ascending order of id, as one compressed payload.
Blocks lie in a table bucketed by block, so that what other stages find out about a block
joins it without shuffling text again.  Within a task a block's bytes, words and windows
are plain arrays; what leaves a task is sorted, packed codes, not a row for each word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.llm._memory import tidy
from plumbline.session import shared_dir

#: Text in a block, and codes that meet in a bucket, up to ``SCALE_FROM`` bytes of input.
#: What is shuffled are lists, blocks x buckets of them.  Beyond, both grow with the square
#: root of the input, so that a list keeps its length.
BLOCK_BYTES = 8 << 20
BUCKET_CODES = 1 << 21
SCALE_FROM = 32 << 30
#: Input of one task, at most: with more there are more tasks than shuffle partitions.
TASK_BYTES = 256 << 20
BLOCKS = "block long, n_words long, doc_ids array<long>, sizes array<long>, payload binary"
_BLANKS = b" \t\n\x0b\x0c\r"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_BLANKS)] = False

#: Words of up to so many bytes are hashed by eight bytes at a time, all words at once.
_SHORT_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class BlockTable:
    """The table's name, its folder, and what is known of it."""

    spark: SparkSession
    name: str
    path: str
    buckets: int
    n_words: int
    scale: float

    def rows(self, rest: bool = False) -> DataFrame:
        """The blocks, with what was kept beside the texts only if asked for."""
        found = self.spark.table(self.name)
        return found if rest else found.drop("rest")

    def with_facts(self, facts: DataFrame, *columns: str, rest: bool = False) -> DataFrame:
        """Blocks with the lists of what ``facts`` says of each (null without any)."""
        found = facts.groupBy("block").agg(*[F.collect_list(c).alias(c) for c in columns])
        return self.rows(rest).join(found.hint("shuffle_hash"), "block", "left")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package made."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _input_bytes(docs: DataFrame) -> int:
    """Spark's estimate of the input's size, from the sizes of its files; 0 if it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def block_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int | None = None, rest: Column | None = None) -> BlockTable:
    """Write ``docs`` as blocks in ascending order of id (nulls first, ties by text).  The
    value of ``rest`` is kept beside each text."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                       (F.lit(0) if rest is None else rest).alias("rest"))
    size = _input_bytes(docs)
    scale = max(1.0, size / SCALE_FROM) ** 0.5
    block_bytes = block_bytes or int(BLOCK_BYTES * scale)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        ids: list = []
        texts: list[bytes] = []
        beside: list[pa.Array] = []
        held = 0
        for b in batches:
            others, taken = b.column(2), 0
            for k, (i, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if held and held + len(text) > block_bytes:
                    beside.append(others.slice(taken, k - taken))
                    yield _packed(first, ids, texts, beside)
                    first, ids, texts, beside, held, taken = first + len(ids), [], [], [], 0, k
                ids.append(i)
                texts.append(text)
                held += len(text)
            beside.append(others.slice(taken))
        if ids:
            yield _packed(first, ids, texts, beside)

    schema = T.StructType.fromDDL(BLOCKS).add("rest", T.ArrayType(docs.schema["rest"].dataType))
    docs.repartitionByRange(parts, "id").sortWithinPartitions("id", "text") \
        .mapInArrow(tidy(pack), schema).write.option("path", path).option("compression", "none") \
        .bucketBy(min(parts, 100_000), "block").saveAsTable(name)
    n = spark.table(name).agg(F.sum("n_words")).first()[0] or 0
    return BlockTable(spark, name, path, parts, n, scale)


def _packed(first: int, ids: list, texts: list[bytes], beside: list[pa.Array | None]) -> pa.RecordBatch:
    data = b"\n".join(texts) + b"\n"
    n = int((np.diff(_IS_WORD[np.frombuffer(b" " + data, np.uint8)].view(np.int8)) == 1).sum())
    rest = pa.concat_arrays([a for a in beside if a is not None] or [pa.nulls(len(ids))])
    return pa.RecordBatch.from_arrays(
        [pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
         pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
         pa.array([zstandard.ZstdCompressor(level=1).compress(data)], pa.binary()),
         pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest)],
        ["block", "n_words", "doc_ids", "sizes", "payload", "rest"])


def texts_of(payload: bytes, sizes: list[int]) -> list[bytes]:
    """The texts of a block's payload."""
    data = zstandard.ZstdDecompressor().decompress(payload)
    ends = np.cumsum(np.array(sizes, np.int64) + 1).tolist()
    return [data[z - 1 - n:z - 1] for z, n in zip(ends, sizes)]


class Block:
    """One block's documents and words.  Word ``i`` of document ``d`` is word
    ``bounds[d] + i`` of the block."""

    def __init__(self, row: dict, fold_case: bool = False):
        self.block, self.doc_ids = row["block"], row["doc_ids"]
        self.data = zstandard.ZstdDecompressor().decompress(row["payload"])
        sizes = np.array(row["sizes"], np.int64) + 1
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.raw = self.data.translate(_LOWER) if fold_case else self.data
        word = _IS_WORD[np.frombuffer(self.raw, np.uint8)]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.words = hash_words(self.raw, self.starts, self.ends, 1)
        self.bounds = np.searchsorted(self.starts, self.at)

    def words_again(self) -> np.ndarray:
        """Hashes of the words that have nothing in common with those of ``words``."""
        return hash_words(self.raw, self.starts, self.ends, 2)

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.at[:-1], self.at[1:]):
            yield self.data[a:b - 1]

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        n = np.diff(self.bounds)
        return np.repeat(self.bounds[1:], n) - np.arange(len(self.words))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64 bits, one to one."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def hash_words(raw: bytes, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of each word.  Eight bytes at a time are mixed in, and mixing is one to
    one, so different words of one length up to eight bytes never share a hash; others do
    by chance only.  Long words are left to xxh3."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    eights = np.ndarray(len(raw), "<u8", np.frombuffer(raw + bytes(8), np.uint8), strides=(1,))
    out = mix(size.astype(np.uint64), 100 + key)
    own: slice | np.ndarray = slice(None)
    for k in range(0, min(int(size.max()), _SHORT_WORD), 8):
        if k:
            own = np.flatnonzero((size > k) & (size <= _SHORT_WORD))
        more = eights[starts[own] + k] & _LOW_BYTES[np.minimum(size[own] - k, 8)]
        out[own] = mix(out[own] ^ more, key)
    for i in np.flatnonzero(size > _SHORT_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:ends[i]], key)
    return out


def windows(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` words, put together from runs of half the length."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    if length == 1:
        return mix(words, seed)
    half = length // 2
    left = windows(words, half, seed)
    right = left[half:] if length == 2 * half else windows(words, length - half, seed)[half:]
    n = len(words) - length + 1
    return join_halves(left[:n], right[:n], seed)


def join_halves(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of two neighbouring runs."""
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right, seed)


# Sorted sets of codes: differences of a few bytes each.

def fill_gaps(values: np.ndarray, top: int) -> np.ndarray:
    """Sorted distinct values with others put between, so that no difference exceeds ``top``."""
    if not len(values):
        return values
    before = np.concatenate([[np.uint64(0)], values[:-1]])
    steps = np.maximum(values - before, 1) - np.uint64(1)
    steps = (steps // np.uint64(top)).astype(np.int64) + 1
    if steps.max() == 1:
        return values
    which = np.repeat(np.arange(len(values)), steps)
    k = np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    out = before[which] + np.uint64(top) * k.astype(np.uint64)
    last = k == steps[which]
    out[last] = values
    return out


def pack_codes(filled: np.ndarray, width: int) -> bytes:
    steps = np.diff(filled, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_codes(packed: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


@dataclass(frozen=True)
class CodeSpace:
    """How many bits codes have, and which bucket a code is in."""

    bits: int
    bucket_bits: int

    @classmethod
    def of(cls, n: int, scale: float = 1.0, spare_bits: int = 7) -> "CodeSpace":
        """For ``n`` codes: two of 2**spare_bits differing ones get the same code by chance."""
        bits = max(n, 2).bit_length() + spare_bits
        return cls(bits, max(6, int(n // (BUCKET_CODES * scale)).bit_length()))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def split(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Bucket, width in bytes, and filled codes within the bucket, of sorted distinct
        codes.  What ``filled`` adds is alike each time."""
        below = self.bits - self.bucket_bits
        edges = np.searchsorted(codes, np.arange(1 << self.bucket_bits, dtype=np.uint64) << np.uint64(below))
        edges = np.append(edges, len(codes))
        mask = np.uint64((1 << below) - 1)
        for bucket in np.flatnonzero(np.diff(edges)):
            own = codes[edges[bucket]:edges[bucket + 1]] & mask
            gap = (1 << below) / len(own)
            width = min(8, int(np.ceil((np.log2(gap) + 2.5) / 8)) or 1) if gap > 1 else 1
            yield int(bucket), width, fill_gaps(own, (1 << 8 * width) - 1 if width < 8 else 1 << 62)

    def places(self, codes: np.ndarray, facts: dict[int, np.ndarray]) -> np.ndarray:
        """For each of the sorted codes, what was said of it in ``facts`` by bucket."""
        kind = next(iter(facts.values())).dtype if facts else np.uint8
        out = np.zeros(len(codes), kind)
        done = 0
        below = self.bits - self.bucket_bits
        mask = np.uint64((1 << below) - 1)
        for bucket, _, filled in self.split(codes):
            top = np.searchsorted(codes, np.uint64(bucket + 1) << np.uint64(below))
            if bucket in facts:
                out[done:top] = facts[bucket][np.searchsorted(filled, codes[done:top] & mask)]
            done = top
        return out

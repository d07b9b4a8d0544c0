"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

Codebooks are trained by whole rounds of assigning and averaging in integers, so codes do
not depend on how rows are dealt.  What saves work are bounds on distances that outlive a
round.  For each part of each vector are kept

* the entry it is assigned to, its distance, and the round in which that was measured;
* for each group of entries a lower bound of the distance to all others of the group, and
  the round in which it was measured.

All codebooks so far are kept, a few thousand numbers.  A bound of round ``s`` is brought to
round ``t`` by how far the entry really lies from where it lay in round ``s`` (the norm of
the sum of its moves), which is at most, and mostly far less than, the sum of the norms of
its moves.  A group is compared anew only if its bound does not exclude it.  Rounding is
allowed for, and all comparisons that decide are of whole numbers.

A round is one job: it reads blocks of vectors with their bounds, and writes them with new
bounds and the block's sums for each entry.  Reading the sums alone gives the next codebook.

Cases: a vector that is null, empty, or holds null or non-finite entries takes no part, nor
does one of an entry beyond ``LIMIT`` (its squares would not fit) or of another length than
most; a length that ``parts`` does not divide is filled up with zeros; rows without id come
after all others; equal ids are ordered by vector, and repeated rows count as often as they
occur; with fewer vectors than entries the codebook is as much smaller; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm._blocks import delete
from plumbline.llm._vectors import array_sum, common_size, matrix, whole
from plumbline.operators.joins import attach
from plumbline.session import shared_dir

PARTS, ENTRIES, ROUNDS, GROUPS = 4, 256, 4, 8
SCALE = 1024
#: Entries of greater size are not coded: sums of squares stay whole numbers below 2**63.
LIMIT = 16_384.0
#: What a bound is widened by, against rounding.
SLACK = 1e-6


@dataclass
class Codebooks:
    """The codebook of each round, ``history[t][part, entry, place]``, and groups of entries."""

    history: list[np.ndarray]
    groups: np.ndarray
    n_groups: int
    _moved: dict = field(default_factory=dict)

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def moved(self, since: int) -> np.ndarray:
        """How far each entry, by part, lies from where it lay in round ``since``."""
        if since not in self._moved:
            step = (self.last - self.history[since]).astype(np.float64)
            self._moved[since] = np.sqrt((step * step).sum(axis=2)) * (1 + SLACK)
        return self._moved[since]

    def group_moved(self, part: int, since: int) -> np.ndarray:
        """The farthest that any entry of each group has moved."""
        out = np.zeros(self.n_groups)
        np.maximum.at(out, self.groups[part], self.moved(since)[part])
        return out

    def after(self, book: np.ndarray) -> "Codebooks":
        return Codebooks([*self.history, book], self.groups, self.n_groups)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.last.reshape(-1).tolist())).encode()).hexdigest()


@dataclass
class Bounds:
    """What is known of one part of a block's vectors: see the module's text."""

    entry: np.ndarray  # uint16
    upper: np.ndarray  # float32
    upper_round: np.ndarray  # uint8
    lower: np.ndarray  # float32, by group
    lower_round: np.ndarray  # uint8, by group

    @classmethod
    def none(cls, n: int, groups: int) -> "Bounds":
        return cls(np.zeros(n, np.uint16), np.full(n, np.inf, np.float32), np.zeros(n, np.uint8),
                   np.zeros((n, groups), np.float32), np.zeros((n, groups), np.uint8))

    def packed(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.entry, self.upper, self.upper_round, self.lower, self.lower_round))

    @classmethod
    def unpacked(cls, data: bytes, n: int, groups: int) -> "Bounds":
        out, at = [], 0
        for kind, width in ((np.uint16, 1), (np.float32, 1), (np.uint8, 1), (np.float32, groups), (np.uint8, groups)):
            size = n * width * np.dtype(kind).itemsize
            a = np.frombuffer(data[at:at + size], kind).copy()
            out.append(a if width == 1 and len(out) < 3 else a.reshape(n, width))
            at += size
        return cls(*out)


def group_entries(book: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry of one part: entries that lie together, by a few rounds of
    k-means among the entries themselves."""
    x = book.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, groups).astype(int)]
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(own):
            centres[g] = x[own == g].mean(axis=0)
    return own


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``entries``, as int64."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * top) ** 2 < 2 ** 53:  # products of doubles are whole numbers here
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1))


def assign(x: np.ndarray, known: Bounds, books: Codebooks, part: int) -> tuple[np.ndarray, int]:
    """The squared distance of each row to its nearest entry, and how many distances were
    computed.  ``known`` is brought up to date."""
    now, book = len(books.history) - 1, books.last[part]
    group_of, n = books.groups[part], len(x)
    upper = np.full(n, np.inf)
    lower = known.lower.astype(np.float64)
    for s in range(now):
        old = known.upper_round == s
        if now and old.any():
            upper[old] = known.upper[old].astype(np.float64) + books.moved(s)[part][known.entry[old]]
        lower -= (known.lower_round == s) * books.group_moved(part, s)
    first = now == 0
    best = np.full(n, np.iinfo(np.int64).max)
    entry = known.entry.astype(np.int64)
    # With the entry's own distance measured anew, fewer groups are left to compare.
    unsure = np.full(n, first) | (upper * (1 + SLACK) >= lower.min(axis=1))
    rows = np.flatnonzero(unsure)
    done = 0
    if not first:
        own = x - book[entry]
        best = (own * own).sum(axis=1)  # needed for the sums of errors in any case
        upper[rows] = np.sqrt(best[rows].astype(np.float64))
        done += len(rows)
    old_entry, old_upper = entry.copy(), np.sqrt(best.astype(np.float64))
    least: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in range(books.n_groups):
        members = np.flatnonzero(group_of == g)
        if not len(members):
            lower[:, g], known.lower_round[:, g] = np.inf, now
            continue
        ask = rows if first else rows[upper[rows] * (1 + SLACK) >= lower[rows, g]]
        if not len(ask):
            continue
        d = squared(x[ask], book[members])
        done += d.size
        nearest = d.argmin(axis=1)
        at = np.arange(len(ask))
        d1 = d[at, nearest]
        d[at, nearest] = np.iinfo(np.int64).max
        least[g] = ask, members[nearest], d1, d.min(axis=1)
        closer = (d1 < best[ask]) | ((d1 == best[ask]) & (members[nearest] < entry[ask])) | np.full(len(ask), first and g == 0)
        entry[ask[closer]], best[ask[closer]] = members[nearest][closer], d1[closer]
    for g, (ask, nearest, d1, d2) in least.items():
        others = np.where(nearest == entry[ask], d2, d1)
        lower[ask, g] = np.where(others == np.iinfo(np.int64).max, np.inf, np.sqrt(others.astype(np.float64)))
    changed = np.flatnonzero(entry != old_entry) if not first else np.zeros(0, np.int64)
    if len(changed):  # the former entry is one of the others of its group now
        g = group_of[old_entry[changed]]
        lower[changed, g] = np.minimum(lower[changed, g], old_upper[changed])
    # A bound that no comparison has renewed keeps its own round's value and stamp.
    renewed = np.zeros(lower.shape, bool)
    for g, (ask, *_rest) in least.items():
        renewed[ask, g] = True
    if len(changed):
        renewed[changed, group_of[old_entry[changed]]] = True
    known.lower[renewed] = np.nextafter((lower[renewed] * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))
    known.lower_round[renewed] = now
    measured = np.zeros(n, bool)
    measured[rows] = True
    measured[changed] = True
    known.upper[measured] = np.nextafter((np.sqrt(best[measured].astype(np.float64)) * (1 + SLACK)).astype(np.float32), np.float32(np.inf))
    known.upper_round[measured] = now
    known.entry[:] = entry
    return best, done


def _sums(x: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """For each entry the number of its rows and the sums of their places."""
    order = np.argsort(entry, kind="stable")
    out = np.zeros((entries, x.shape[1] + 1), np.int64)
    found, at = np.unique(entry[order], return_index=True)
    if len(found):
        out[found, 1:] = np.add.reduceat(x[order], at, axis=0)
        out[found, 0] = np.diff(np.append(at, len(entry)))
    return out


def _coded_blocks(label: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)),
        T.StructField("vectors", T.BinaryType()), T.StructField("bounds", T.ArrayType(T.BinaryType())),
        T.StructField("sums", T.BinaryType()), T.StructField("errors", T.BinaryType()), T.StructField("compared", T.LongType())])


def encode(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> DataFrame:
    """``vec_id``, ``label``, ``codes`` (array of entries by part), ``error``, and as constants
    ``codebooks_sha256`` and ``compared``: the distances computed in all rounds."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    label_type = vectors.schema[label_col].dataType
    rows = vectors.where(whole(v, LIMIT)).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))
    size = common_size(rows, "v")
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label_type),
                        T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not size:
        return spark.createDataFrame([], out).withColumns(
            {"codebooks_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "compared": F.lit(0).cast("long")})
    rows = rows.where(F.size("v") == size)
    width = -(-size // parts)

    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, width * parts - size)))

    firsts = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    book = padded(np.array([r["v"] for r in firsts], np.int64)).reshape(len(firsts), parts, width).transpose(1, 0, 2)
    groups = max(1, min(groups, len(firsts)))
    books = Codebooks([book], np.array([group_entries(book[p], groups) for p in range(parts)]), groups)

    def round_of(books: Codebooks):
        entries = books.last.shape[1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                if "v" in b.schema.names:  # first round: rows become a block
                    blocks = [(b.column("id"), b.column("label"), matrix(b.column("v"), size).astype("<i4").tobytes(),
                               [Bounds.none(b.num_rows, groups).packed()] * parts, 0)]
                else:
                    blocks = [(b.column("ids")[i].values, b.column("labels")[i].values, b.column("vectors")[i].as_py(),
                               b.column("bounds")[i].as_py(), b.column("compared")[i].as_py()) for i in range(b.num_rows)]
                for ids, labels, data, bounds, compared in blocks:
                    n = len(ids)
                    x = padded(np.frombuffer(data, "<i4").astype(np.int64).reshape(n, size))
                    sums = np.zeros((parts, entries, width + 1), np.int64)
                    errors = np.zeros(n, np.int64)
                    packed = []
                    for p in range(parts):
                        own = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                        known = Bounds.unpacked(bounds[p], n, groups)
                        best, done = assign(own, known, books, p)
                        sums[p] = _sums(own, known.entry, entries)
                        errors += best
                        compared += done
                        packed.append(known.packed())
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                         pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), labels),
                         pa.array([data], pa.binary()), pa.array([packed], pa.list_(pa.binary())),
                         pa.array([sums.tobytes()], pa.binary()), pa.array([errors.tobytes()], pa.binary()),
                         pa.array([compared], pa.int64())],
                        ["ids", "labels", "vectors", "bounds", "sums", "errors", "compared"])

        return work

    folder = f"{shared_dir(spark)}/vector-codes-{uuid.uuid4()}"
    source, schema = rows, _coded_blocks(label_type)
    for t in range(rounds + 1):
        path = f"{folder}/{t}"
        source.mapInArrow(round_of(books), schema).write.option("compression", "zstd").parquet(path)
        source = spark.read.schema(schema).parquet(path)
        if t:
            delete(spark, f"{folder}/{t - 1}")
        if t < rounds:
            sums = array_sum(source, "<i8", parts * len(firsts) * (width + 1)).reshape(parts, len(firsts), width + 1)
            count = sums[:, :, :1]
            book = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books.last)
            books = books.after(book)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, n = b.column("ids")[i].values, len(b.column("ids")[i])
                codes = np.stack([Bounds.unpacked(p, n, groups).entry for p in b.column("bounds")[i].as_py()], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids, b.column("labels")[i].values,
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(codes.reshape(-1).astype(np.int32))),
                     pa.array(np.frombuffer(b.column("errors")[i].as_py(), np.int64))],
                    ["vec_id", "label", "codes", "error"])

    compared = source.agg(F.sum("compared")).first()[0] or 0
    return source.select("ids", "labels", "bounds", "errors").mapInArrow(decoded, out).withColumns(
        {"codebooks_sha256": F.lit(books.sha256()), "compared": F.lit(compared).cast("long")})


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of the same label, nulls together."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return attach(coded, totals, ["label"], weight="n").drop("n")

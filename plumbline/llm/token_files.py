"""Token ids in a byte-aligned variable-length code, written and read as blocks.

Ids are renumbered by falling frequency, so that the frequent ones need one byte.  A block
holds the ranks of consecutive documents as two streams: control bytes with four two-bit
lengths each, and the lengths' data bytes.  Readers look the lengths up in a table of 256
rows and gather the bytes with numpy, without a loop over ids.

A folder ``files`` has ``blocks`` (Parquet, binary streams uncompressed: they hold no
redundancy worth the time), one file for each range of ids, in ascending order of part and
block, and ``ranks`` (rank, id).  Spark commits both, so a repeated task leaves one copy.

Cases: a null text is empty and has the end id only; documents with null ids come first;
those with equal doc ids follow each other in the order of their token ids' bytes; a document may
be longer than a block and then has a block of its own; an empty table makes empty files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm._units import encoder
from plumbline.session import shared_dir

#: Ids in a block, unless one document has more.
BLOCK_IDS = 1 << 18
BLOCKS = "part int, block int, first long, doc_ids array<long>, sizes array<int>, control binary, data binary"

#: The four lengths less one of a control byte, as bytes of one number.
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8).view(np.uint32).reshape(-1)


def _own(sizes: np.ndarray) -> np.ndarray:
    """Which codes are those of values, if every document of ``sizes`` values starts a control
    byte."""
    gaps = -sizes % 4
    ends = np.cumsum(sizes + gaps)
    own = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    for k in (1, 2, 3):
        own[ends[gaps >= k] - k] = False
    return own


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values of documents of ``sizes`` values.  A
    document's last control byte is filled up with lengths of one that have no data."""
    values = np.ascontiguousarray(values, "<u4")
    longer = (values > 0xFF).astype(np.uint8)
    width = 1 + sum(int(values.max(initial=0)) >= 1 << 8 * k for k in (1, 2, 3))
    for k in range(2, width):
        longer += values >= 1 << 8 * k
    own = _own(sizes)
    codes = np.zeros(len(own), np.uint8)
    codes[own] = longer
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kept = np.ones((len(values), width), bool)
    for k in range(1, width):
        kept[:, k] = longer >= k
    data = values.view(np.uint8).reshape(-1, 4)[:, :width].reshape(-1)[kept.reshape(-1)]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The values of ``pack``."""
    longer = _CODES[np.frombuffer(control, np.uint8)].view(np.uint8)[_own(sizes)]
    at = np.arange(len(longer))
    at[1:] += np.cumsum(longer[:-1], dtype=np.int64)
    own = np.frombuffer(data, np.uint8)
    values = own[at].astype(np.uint32)
    for k in range(1, int(longer.max(initial=0)) + 1):
        more = np.flatnonzero(longer >= k)
        values[more] |= own[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def write_files(docs: DataFrame, path: str, files: str, *, end_id: int = 0,
                id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` with the vocabulary file ``path`` into the folder ``files``."""
    spark = docs.sparkSession
    stage = f"{files}/ids"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        kind = np.uint16 if own.vocabulary <= 1 << 16 else np.uint32
        for b in batches:
            ids = (np.append(i, end_id).astype(kind).tobytes() for i in own.encode(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")) \
        .mapInArrow(encode, "doc_id long, ids binary") \
        .write.option("compression", "zstd").parquet(stage)
    width = 2 if encoder(path).vocabulary <= 1 << 16 else 4
    ids = spark.read.schema("doc_id long, ids binary").parquet(stage)
    ranks = _ranks(ids, width)
    _write_ranks(spark, ranks, f"{files}/ranks")
    shared = spark.sparkContext.broadcast(ranks)  # one number for each id of the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.zeros(int(shared.value.max(initial=0)) + 1, np.uint32)
        order[shared.value] = np.arange(len(shared.value), dtype=np.uint32)
        return _blocks(batches, order, width)

    # Ids are put in order before they are coded, so that the sample that bounds the
    # ranges is taken without Python.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids") \
        .mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{files}/blocks")


def _lots(raw: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The ids of documents, those of many short ones together: counting any number of ids
    takes a pass over the vocabulary."""
    lot: list[bytes] = []
    held = 0
    for x in raw:
        lot.append(x)
        held += len(x) // width
        if held >= BLOCK_IDS:
            yield np.frombuffer(b"".join(lot), f"<u{width}")
            lot, held = [], 0
    if lot:
        yield np.frombuffer(b"".join(lot), f"<u{width}")


def _ranks(ids: DataFrame, width: int) -> np.ndarray:
    """The ids that occur, the most frequent first, ties by id: bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in _lots(b.column(0).to_pylist(), width):
                own = np.bincount(ids)
                if len(own) > len(total):
                    total, own = own, total
                total[:len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())],
                                         ["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def _write_ranks(spark: SparkSession, ranks: np.ndarray, path: str) -> None:
    rows = pa.table({"rank": pa.array(np.arange(len(ranks)), pa.int64()), "id": pa.array(ranks, pa.int64())})
    spark.createDataFrame(rows, "rank long, id long").coalesce(1).write.parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch], order: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Documents of one range, coded and joined to blocks.  Each starts a control byte."""
    from pyspark import TaskContext

    part, block, first = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    raw: list[bytes] = []
    held = 0

    def made() -> pa.RecordBatch:
        sizes = np.array([len(x) // width for x in raw], np.int64)
        ranks = order[np.frombuffer(b"".join(raw), f"<u{width}")]
        control, data = pack(ranks, sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
             pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
             pa.array([control], pa.binary()), pa.array([data], pa.binary())],
            ["part", "block", "first", "doc_ids", "sizes", "control", "data"])

    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and held + len(x) // width > BLOCK_IDS:
                yield made()
                block, first, held, ids, raw = block + 1, first + held, 0, [], []
            ids.append(i)
            raw.append(x)
            held += len(x) // width
    if ids:
        yield made()


def read_files(spark: SparkSession, files: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit integers) of every document in the files."""
    return _read(spark, files, lambda ids: ids.tobytes(), pa.binary(), "ids binary")


def _read(spark: SparkSession, files: str, value, kind: pa.DataType, column: str) -> DataFrame:
    ids_of = spark.sparkContext.broadcast(
        spark.read.parquet(f"{files}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32))
    blocks = spark.read.schema(BLOCKS).parquet(f"{files}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate(
        "sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, total = {}, 0  # one number for each file
    for row in sizes:
        before[row["part"]] = total
        total += row["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ids = ids_of.value[unpack(row["control"], row["data"], sizes)]
                starts = before[row["part"]] + row["first"] + np.cumsum(sizes) - sizes
                own = np.split(ids, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array([value(x) for x in own], kind)],
                    ["doc_id", "start", "n_tokens", column.split()[0]])

    return blocks.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {column}")


def read_digests(spark: SparkSession, files: str) -> DataFrame:
    """As ``read_files``, with ``ids_crc32`` instead of the ids."""
    return _read(spark, files, lambda ids: zlib.crc32(ids.astype("<u4", copy=False)), pa.int64(), "ids_crc32 long")


def new_files(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4()}"

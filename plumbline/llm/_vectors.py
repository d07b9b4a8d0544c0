"""Vectors as blocks of numpy rows, and sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Arrays that meet in one task of the first of two steps of a sum.
FAN_IN = 64


def whole(vector: Column, limit: float) -> Column:
    """Is the vector there, of finite numbers within ``limit``, and not without entries?"""
    entry = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= limit))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & entry, F.lit(False))


def common_size(vectors: DataFrame, column: str) -> int:
    """The commonest number of entries (of several the largest); 0 without vectors."""
    found = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def array_sum(parts: DataFrame, dtype: str, size: int) -> np.ndarray:
    """The sum of arrays of ``size`` numbers, one in each row's binary column ``sums``.

    They are added up in two steps, first ``FAN_IN`` tasks' worth, so neither a task nor
    the driver gets an array from every task of a large job.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for b in batches:
            for one in b.column("sums"):
                total += np.frombuffer(one.as_py(), dtype)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    def add_group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(add(iter(table.to_batches())))

    tasks = parts.select("sums").mapInArrow(add, "sums binary") \
        .groupBy((F.spark_partition_id() % FAN_IN).alias("lot")).applyInArrow(add_group, "sums binary")
    total = np.zeros(size, dtype)
    for row in tasks.toLocalIterator():
        total += np.frombuffer(row["sums"], dtype)
    return total

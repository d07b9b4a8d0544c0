"""Whitening of embeddings by QDWH spectral divide and conquer.

Sums and centred products are gathered in Spark, a matrix of the vectors' length from each
task, added up in two steps.  The covariance is then split on the driver: its size is the
square of the vectors' length, whatever the number of rows.

The orthogonal factor ``U`` of the polar decomposition of ``V - s I`` is its matrix sign, so
``(U + I) / 2`` projects on the eigenvectors whose eigenvalues exceed ``s``.  ``U`` comes from the
QR-based, dynamically weighted Halley iteration, a handful of QR factorisations.  Bases of
the two invariant subspaces cut the matrix into two blocks, which are split in turn; a
subspace below the components asked for is not split further.  Then the components go out to
all tasks (length x components numbers), which centre, project and scale their rows.

Cases: a vector that is null, empty, or holds null or non-finite entries takes no part, nor
does one of an entry beyond ``LIMIT`` or of another length than most; rows without id and
repeated rows are rows like others; components whose eigenvalue is nought up to rounding
have no whitened value and are left out, so one vector alone, or equal ones, give no rows;
equal eigenvalues leave their components free within their subspace, and one basis is taken
for all rows; a squared deviation that does not fit a long is null; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm._vectors import array_sum, common_size, matrix, whole

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of greater size are left out: sums stay whole numbers below 2**63.
LIMIT = float(1 << 20)
_EPS = np.finfo(np.float64).eps


# The polar decomposition and what is built on it.

def polar(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    n = len(a)
    unit = np.eye(n)
    alpha = np.linalg.norm(a)
    if not alpha:
        return unit
    x = a / alpha
    # The least singular value from below: QR, then the size of the inverse of R.
    r = np.linalg.qr(x, mode="r")
    with np.errstate(all="ignore"):
        try:
            least = 1 / np.linalg.norm(np.linalg.solve(r, unit))
        except np.linalg.LinAlgError:
            least = 0.0
    low = min(1.0, max(float(least) if np.isfinite(least) else 0.0, _EPS))
    for _ in range(rounds):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        weight = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - l2) / (l2 * root), 0.0))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * x, unit]))[0]
        after = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (weight + b * l2) / (1 + c * l2))
        if moved <= np.cbrt(_EPS) and abs(1 - low) <= 10 * _EPS:
            break
    return x


def subspaces(h: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below ``shift``."""
    n = len(h)
    projector = (polar(h - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(float(np.trace(projector))))
    if not 0 < rank < n:
        return np.eye(n)[:, :rank], np.eye(n)[:, rank:]
    # Columns of the projector in order of size span its range; a second round of the
    # projector makes the basis as good as the projector.
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    rng = np.random.Generator(np.random.PCG64(n))
    start = np.hstack([projector[:, order[:rank]], projector @ rng.standard_normal((n, rank))])
    left, size, _ = _ordered_qr(start, rank)
    upper = np.linalg.qr(projector @ left)[0]
    rest = rng.standard_normal((n, n - rank))
    for _ in range(2):
        rest -= upper @ (upper.T @ rest)
        rest = np.linalg.qr(rest)[0]
    return upper, rest


def _ordered_qr(a: np.ndarray, rank: int) -> tuple[np.ndarray, float, np.ndarray]:
    """``rank`` orthonormal columns that span those of ``a``: QR with the largest column
    that is left taken next."""
    left = a.copy()
    out = np.zeros((len(a), rank))
    size = 0.0
    for k in range(rank):
        lengths = np.einsum("ij,ij->j", left, left)
        best = int(lengths.argmax())
        q = left[:, best].copy()
        q -= out[:, :k] @ (out[:, :k].T @ q)
        size = float(np.linalg.norm(q))
        q /= size or 1.0
        out[:, k] = q
        left -= np.outer(q, q @ left)
    return out, size, left


def eigen(h: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and unit
    eigenvectors as columns."""
    scale = np.linalg.norm(h)
    found: list[tuple[float, np.ndarray]] = []

    def split(basis: np.ndarray, wanted: int) -> None:
        """Components of the subspace of ``basis``, the largest first."""
        block = basis.T @ h @ basis
        block = (block + block.T) / 2
        n = len(block)
        mean = float(np.trace(block)) / n
        if n == 1 or np.linalg.norm(block - mean * np.eye(n)) <= 4 * n * _EPS * scale:
            found.extend((float(block[i, i]), basis[:, i]) for i in range(min(n, wanted)))
            return
        for shift in (float(np.median(np.diag(block))), mean, *_between(block)):
            upper, lower = subspaces(block, shift)
            across = np.linalg.norm(upper.T @ block @ lower)
            if 0 < upper.shape[1] < n and across <= 100 * n * _EPS * scale:
                break
        else:  # no shift parts it to full precision: its eigenvalues agree up to rounding
            found.extend((float(block[i, i]), basis[:, i]) for i in range(min(n, wanted)))
            return
        split(basis @ upper, wanted)
        if wanted > upper.shape[1]:
            split(basis @ lower, wanted - upper.shape[1])

    split(np.eye(len(h)), wanted)
    vectors = np.stack([v for _, v in found], axis=1)
    vectors = np.linalg.qr(vectors)[0]
    values, vectors = _polished(h, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _between(block: np.ndarray) -> Iterator[float]:
    """Other places to cut, from the spread of the eigenvalues."""
    n = len(block)
    mean = float(np.trace(block)) / n
    spread = np.linalg.norm(block - mean * np.eye(n)) / np.sqrt(n)
    for k in (0.25, -0.25, 0.5, -0.5, 1.0, -1.0, 1e-3, -1e-3):
        yield mean + k * spread


def _polished(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations by first-order corrections among the components found."""
    for _ in range(2):
        inner = x.T @ h @ x
        values = np.diag(inner).copy()
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e3 * _EPS * max(abs(values).max(), 1e-300) * len(h)
        turn = np.where(near, 0.0, inner / np.where(near, 1.0, gap))
        np.fill_diagonal(turn, 0.0)
        if np.abs(turn).max(initial=0) > 1e-3:
            break
        x = np.linalg.qr(x + x @ turn)[0]
    return np.einsum("ij,ij->j", x, h @ x), x


# Whitening.

@dataclass(frozen=True)
class Whitener:
    """What is fitted: number of vectors, exact sums, trace of the covariance, components."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, centred, projected and scaled."""
        mean = self.sums // self.n
        rest = (self.sums - mean * self.n) / self.n
        return ((x - mean) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)**2, exact; null where a long can't hold one."""
        top = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        if top < 1 << 62:
            y = x * self.n - self.sums
            if x.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
                return (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - self.sums.astype(object)
        return [d if d < 1 << 63 else None for d in (y * y).sum(axis=1)]


def _whole_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`")
    return vectors.where(whole(v, LIMIT)).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))


def _per_task(rows: DataFrame, size: int, shape: int, dtype: str, add) -> np.ndarray:
    """The sum of ``add(x)`` over all batches ``x`` of rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for b in batches:
            if b.num_rows:
                total += add(matrix(b.column("x"), size))
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    return array_sum(rows.select("x").mapInArrow(work, "sums binary"), dtype, shape)


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of ``rows`` (``x``: whole numbers); none without rows."""
    found = _per_task(rows, size, size + 1, "<i8", lambda x: np.append(x.sum(axis=0), len(x)))
    n, sums = int(found[-1]), found[:-1]
    if not n:
        return None
    mean = sums // n
    rest = (sums - mean * n) / n

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - mean) - rest
        return (y.T @ y).reshape(-1)

    covariance = _per_task(rows, size, size * size, "<f8", products).reshape(size, size) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = eigen(covariance, min(components, size))
    real = values > size * _EPS * max(float(values.max(initial=0)), 0.0) * 16
    return Whitener(n, sums, float(np.trace(covariance)), values[real], vectors[:, real])


def identity_error(rows: DataFrame, size: int, fitted: Whitener) -> float:
    """How far the covariance of the whitened rows is from the identity, at most."""
    k = len(fitted.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = fitted.whiten(x)
        return np.append((w.T @ w).reshape(-1), w.sum(axis=0))

    found = _per_task(rows, size, k * k + k, "<f8", moments)
    mean = found[k * k:] / fitted.n
    covariance = found[:k * k].reshape(k, k) / fitted.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``n``, ``deviation`` and ``whitened`` (array by component), with ``explained``
    (array) and ``identity_error``, which are the same for all rows."""
    spark = vectors.sparkSession
    schema = ("vec_id long, n long, deviation long, whitened array<double>, explained array<double>, "
              "identity_error double")
    rows = _whole_rows(vectors, id_col, vector_col)
    size = common_size(rows, "x")
    if not size:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == size)
    fitted = fit(rows, size, components)
    error = identity_error(rows, size, fitted)
    explained = (fitted.values / fitted.trace).tolist() if len(fitted.values) else []
    known = spark.sparkContext.broadcast(fitted)  # (length + 2) x components numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        k = len(own.values)
        for b in batches:
            x = matrix(b.column("x"), size) if b.num_rows else np.zeros((0, size), np.int64)
            w = own.whiten(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(np.full(len(x), own.n)), pa.array(own.deviations(x), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w.reshape(-1))),
                 pa.array([explained] * len(x), pa.list_(pa.float64())), pa.array(np.full(len(x), error))],
                ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, schema)

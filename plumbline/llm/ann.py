"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree cuts space by the hyperplane between two random points of a bounded sample, over
and over.  Every vector is put into its leaf of each tree.  A query walks all trees through
one priority queue: the next node is the one whose cut lies nearest to the query, whichever
tree it belongs to, until the leaves taken hold ``budget`` distinct vectors.  All vectors
of these leaves are compared exactly, in double precision.

The budget is measured, not guessed: some queries are compared with all vectors, and the
budget is the least with which the forest finds ``recall`` of their true neighbours.

Leaves of many vectors are cut into blocks, and queries into blocks as well, so that no
group grows with the input.  What the driver holds is the sample, the trees and a count for
each leaf, all bounded by parameters.

Cases: vectors that are null, zero, of null or non-finite components, or of another length
than most of the sample take no part, nor do rows without id; repeated rows count once;
equal vectors are tied at their distance, and ties go to the smaller id; with fewer
candidates than asked for all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from plumbline.session import cut_lineage

#: Vectors the trees are grown on, trees, and vectors a leaf should hold.
SAMPLE, TREES, LEAF = 20_000, 8, 1024
#: Leaves that a tree of a small table should have, and vectors each then holds at least.
LEAVES, LEAST = 64, 8
#: Vectors and queries that meet in one group.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 8192
#: Queries that the budget is measured with, and the recall wanted on them.
MEASURED, RECALL = 64, 0.97


@dataclass
class Tree:
    """Nodes as arrays.  A child below zero is leaf ``-child - 1``."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        if not len(self.offsets):
            return np.zeros(len(x), np.int64)
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.normals[node]) > self.offsets[node]).astype(np.int64)
            at[inner] = self.children[node, side]
        return -at - 1


def grow(sample: np.ndarray, leaves: int, rng: np.random.Generator, least: int = 8) -> Tree:
    """A tree of about ``leaves`` leaves, each of at least ``least`` sample points."""
    normals, offsets, children = [], [], []
    made = 0

    def build(rows: np.ndarray, wanted: float) -> int:
        nonlocal made
        for _ in range(5 if wanted > 1 and len(rows) >= 2 * least else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            length = np.linalg.norm(normal)
            if not length:
                continue
            normal /= length
            along = sample[rows] @ normal
            for offset in (np.median(along), (a + b) @ normal / 2):
                right = along > offset
                share = right.mean()
                if 0.1 <= share <= 0.9:
                    break
            else:
                if not 0 < share < 1:
                    continue
            node = len(offsets)
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            children[node][0] = build(rows[~right], wanted * (1 - share))
            children[node][1] = build(rows[right], wanted * share)
            return node
        made += 1
        return -made

    build(np.arange(len(sample)), leaves)
    return Tree(np.array(normals).reshape(-1, sample.shape[1]), np.array(offsets),
                np.array(children, np.int64).reshape(-1, 2), made)


def visits(trees: list[Tree], counts: list[np.ndarray], query: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(tree, leaf, vectors taken so far) in the order of the shared queue."""
    queue = [(0.0, k, k, 0 if len(t.offsets) else -1) for k, t in enumerate(trees)]
    heapq.heapify(queue)
    taken, ticket = 0, len(queue)
    while queue:
        far, _, k, node = heapq.heappop(queue)
        tree = trees[k]
        while node >= 0:
            margin = float(tree.normals[node] @ query - tree.offsets[node])
            near = int(margin > 0)
            ticket += 1
            heapq.heappush(queue, (max(far, abs(margin)), ticket, k, int(tree.children[node, 1 - near])))
            node = int(tree.children[node, near])
        taken += int(counts[k][-node - 1])
        yield k, -node - 1, taken


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)) \
        .select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (distance): the ``k`` nearest rows found
    for every row for which ``is_query`` (on ``vec_id``) holds, its own id left out."""
    spark = vectors.sparkSession
    rows = cut_lineage(_usable(vectors, id_col, vector_col).distinct())
    sample = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()["v"]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return empty
    size = int(sample.map(len).mode().iloc[0])
    points = np.stack([x for x in sample if len(x) == size])
    rows = rows.where(F.size("v") == size)
    n = rows.count()
    rng = np.random.default_rng(seed)
    leaves = n // max(LEAST, min(LEAF, n // LEAVES))
    trees = [grow(points, max(1, leaves), rng) for _ in range(TREES)]
    forest = spark.sparkContext.broadcast(trees)  # of a bounded sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                for number, tree in enumerate(forest.value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), number), pa.int32()), pa.array(tree.route(x), pa.int32()),
                         b.column(0), b.column(1)], ["tree", "leaf", "vec_id", "v"])

    placed = rows.mapInArrow(route, "tree int, leaf int, vec_id long, v array<double>")
    # Equal vectors are one in the budget; a leaf's blocks are by its rows.
    seen = placed.groupBy("tree", "leaf").agg(F.countDistinct(F.xxhash64("v")).alias("distinct"),
                                              F.count("*").alias("n")).collect()
    counts = [np.zeros(t.leaves, np.int64) for t in trees]
    blocks = [np.ones(t.leaves, np.int64) for t in trees]
    for r in seen:
        counts[r["tree"]][r["leaf"]] = r["distinct"]
        blocks[r["tree"]][r["leaf"]] = -(-r["n"] // VECTOR_BLOCK)
    queries = rows.where(is_query)
    budget = _budget(rows, queries, trees, counts, k)
    query_blocks = -(-max(1, queries.count()) // QUERY_BLOCK)
    found_of = spark.sparkContext.broadcast((counts, blocks))  # two numbers for each leaf

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, blocks = found_of.value
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), _matrix(b.column(1)) if b.num_rows else ()):
                out = []
                for tree, leaf, taken in visits(forest.value, counts, x):
                    out += [(tree, leaf, block) for block in range(blocks[tree][leaf])]
                    if taken >= budget:
                        break
                where = np.array(out, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(where[:, 2]),
                     pa.array([i] * len(out), pa.int64()), pa.array([x] * len(out), pa.list_(pa.float64()))],
                    ["tree", "leaf", "block", "query_id", "q"])

    asked = queries.mapInArrow(walk, "tree int, leaf int, block int, query_id long, q array<double>") \
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    block_of = spark.createDataFrame(
        [(t, leaf, int(m)) for t, own in enumerate(blocks) for leaf, m in enumerate(own)], "tree int, leaf int, m int")
    held = placed.join(F.broadcast(block_of), ["tree", "leaf"]) \
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("m")).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))) \
        .select("tree", "leaf", "block", "part", "vec_id", "v")
    key = ["tree", "leaf", "block", "part"]

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = np.stack(v["v"].to_numpy()), v["vec_id"].to_numpy()
        parts = []
        for i, one in zip(q["query_id"], q["q"]):
            score = np.sqrt(((x - one) ** 2).sum(axis=1))
            near, scores = _nearest(ids[ids != i], score[ids != i], k)
            parts.append(pd.DataFrame({"query_id": i, "vec_id": near, "score": scores}))
        return pd.concat(parts)

    pairs = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(
        compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest scores, ties by id."""
    if len(ids) > k:
        kept = scores <= np.partition(scores, k - 1)[k - 1]
        ids, scores = ids[kept], scores[kept]
    order = np.lexsort((ids, scores))[:k]
    return ids[order], scores[order]


def exact(rows: DataFrame, ids: list[int], points: np.ndarray, k: int) -> dict[int, list[int]]:
    """The true neighbours of a bounded number of queries, from one pass over all rows."""
    spark = rows.sparkSession
    asked = spark.sparkContext.broadcast((ids, points))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = (_matrix(b.column(1)) if b.num_rows else np.zeros((0, 1))), b.column(0).to_numpy()
            for i, point in zip(*asked.value) if len(x) else ():
                score = np.sqrt(((x - point) ** 2).sum(axis=1))
                near, scores = _nearest(own[own != i], score[own != i], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(near), pa.int64()), pa.array(near, pa.int64()), pa.array(scores)],
                    ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = rows.mapInArrow(compare, "query_id long, vec_id long, score double") \
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect()
    out: dict[int, list[int]] = {}
    for r in best:
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def _budget(rows: DataFrame, queries: DataFrame, trees: list[Tree], counts: list[np.ndarray], k: int) -> int:
    """The least number of vectors to take so that the measured queries reach RECALL."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).toPandas()
    if not len(asked):
        return 1
    points = np.stack(asked["v"].to_numpy())
    true = exact(rows, asked["vec_id"].tolist(), points, k)
    wanted = rows.sparkSession.createDataFrame(
        [(i,) for i in sorted({v for near in true.values() for v in near})], "vec_id long")
    vectors = {r["vec_id"]: r["v"] for r in rows.join(F.broadcast(wanted), "vec_id").collect()}
    need = []
    for i, point in zip(asked["vec_id"].tolist(), points):
        near = true.get(i, [])
        if near:
            x = np.array([vectors[v] for v in near])
            leaves = [dict(enumerate(t.route(x).tolist())) for t in trees]
            open_ = set(range(len(near)))
            for tree, leaf, taken in visits(trees, counts, point):
                for j in [j for j in open_ if leaves[tree][j] == leaf]:
                    open_.discard(j)
                    need.append(taken)
                if not open_:
                    break
    return int(np.quantile(need, RECALL, method="higher")) if need else 1

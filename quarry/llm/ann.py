"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then sent down it to a leaf. A
query visits leaves best bin first: a priority queue holds tree nodes by the distance of
their centres and always opens the nearest. How many leaves are visited is calibrated: a
bounded set of queries is compared with all vectors, and visits widen until their recall
is reached. Leaves and the visits to them are dealt in blocks of bounded size, so neither
a crowded leaf nor a popular one is held by one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import written

SAMPLE = 20_000
BRANCHES = 8
#: Vectors in a leaf, as far as the sample can tell leaves apart.
LEAF_ROWS = 1024
MIN_SAMPLE_PER_LEAF = 16
CALIBRATION_QUERIES = 64
RECALL = 0.96
#: Most vectors, and most queries, that one task compares at a time.
BLOCK_ROWS = 4096
K = 10


@dataclass
class Tree:
    """Centres of each node's children; a child is a node or, negative, a leaf."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    n_leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, following the nearest centre."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            c = self.centres[node]
            near = np.argmin((c * c).sum(1)[None, :] - 2 * x[rows] @ c.T, axis=1)
            for k, child in enumerate(self.children[node].tolist()):
                mine = rows[near == k]
                if child < 0:
                    leaf[mine] = -child - 1
                else:
                    todo.append((child, mine))
        return leaf

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of best-bin-first search."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -node - 1
                continue
            gap = ((self.centres[node] - q) ** 2).sum(1)
            for d, child in zip(gap.tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (d, child))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_tree(x: np.ndarray, leaf_rows: float, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """Split the sample until a node holds at most ``leaf_rows`` of it."""
    rng, tree = np.random.default_rng(seed), Tree()

    def grow(rows: np.ndarray) -> int:
        me = len(tree.centres)
        tree.centres.append(np.zeros((0, 0)))
        tree.children.append(np.zeros(0))
        k = max(1, min(branches, int(np.ceil(len(rows) / leaf_rows)), len(rows)))
        centres = kmeans(x[rows], k, rng) if k > 1 else x[rows].mean(0, keepdims=True)
        near = np.argmin((centres * centres).sum(1)[None, :] - 2 * x[rows] @ centres.T, axis=1)
        children = []
        for j in range(k):
            mine = rows[near == j]
            if len(mine) > leaf_rows and len(mine) < len(rows):
                children.append(grow(mine))
            else:
                tree.n_leaves += 1
                children.append(-tree.n_leaves)
        tree.centres[me], tree.children[me] = centres, np.array(children, np.int64)
        return me

    grow(np.arange(len(x)))
    return tree


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, row numbers, distances) of each query's nearest rows of x, up to the
    one that brings the k-th distinct id, of an id no more than k: a matrix product narrows
    to all that may be among them, exact differences decide, ties to smaller ids."""
    norm = (x * x).sum(1)
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        own = (part * part).sum(1)
        d = norm[None, :] - 2 * part @ x.T + own[:, None]
        slack = 1e-9 * (own + norm.max())
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else d.max(axis=1)
        for i in range(len(part)):
            most, bound = k, kth[i]
            while True:
                at = np.flatnonzero(d[i] <= bound + slack[i])
                exact = np.sqrt(((x[at] - part[i]) ** 2).sum(1))
                order = np.lexsort((ids[at], exact))
                new = np.unique(ids[at][order], return_index=True)[1]
                if len(new) >= k or len(at) == len(x):
                    break
                most = min(4 * most, len(x))
                bound = np.partition(d[i], most - 1)[most - 1]
            if len(new) >= k:
                order = order[: np.sort(new)[k - 1] + 1]
            if len(order) > k:
                row = ids[at][order]
                by = np.argsort(row, kind="stable")
                first = np.flatnonzero(np.append(True, row[by][1:] != row[by][:-1]))
                nth = np.empty(len(row), np.int64)
                nth[by] = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                order = order[nth < k]
            yield a + i, at[order], exact[order]


def _first_ids(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first rows of each group up to the one that brings the k-th distinct id, of an id
    no more than k. What is left when an id is taken away are the first k - 1 rows or more.
    The first two cuts are made before the shuffle too, so no task holds a large group."""
    own = Window.partitionBy(*by, "vec_id").orderBy(*order)
    run = Window.partitionBy(*by).orderBy(*order, "vec_id", "_nth")
    few = df.withColumn("_nth", F.row_number().over(own)).where(F.col("_nth") <= k)
    near = few.withColumn("_r", F.row_number().over(run)).where(F.col("_r") <= k * k)
    ids = F.sum((F.col("_nth") == 1).cast("int")).over(run)
    return near.withColumn("_r", ids).where(F.col("_r") <= k).drop("_nth", "_r")


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int = 0) -> tuple[DataFrame, int]:
    """(vec_id, v, k1, k2) of the rows that take part, and the dimension: ``dim``, or that of
    most rows."""
    v = F.col(vector_col).cast("array<double>")
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("v", lambda c: c != 0)
    )
    if not dim:
        most = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        dim = most["d"] if most else 0
    if not dim:
        return usable.select("vec_id", "v", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")), 0
    # 0.0 and -0.0 are one value
    same = F.transform("v", lambda c: c + F.lit(0.0))
    ready = usable.where(F.size("v") == dim).select("vec_id", same.alias("v"))
    return ready.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")), dim


NONE = "query_id long, rank int, vec_id long, score double"


def ann_search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
    recall: float = RECALL,
    calibration_queries: int = CALIBRATION_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest vectors by Euclidean
    distance, its own id left out, ties to the smaller id.

    Null, zero and non-finite vectors, null ids and vectors of another dimension than
    that of most of the table's rows take no part, as queries or as candidates. Rows that
    repeat an id are candidates each, for queries of other ids; as queries they are asked
    and ranked once for each distinct vector. Of equal vectors only the
    k + 1 smallest ids, and k rows of each, can be among any query's k nearest, so only
    these are compared, and queries with equal vectors are searched once; both are exact.
    If a query's leaves hold too few ids it visits more, down to all. An empty table gives
    an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    ready, dim = valid_vectors(vectors, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], NONE)
    asked = written(valid_vectors(queries, id_col, vector_col, dim)[0], "ann-queries")
    points = written(_first_ids(ready, ["k1", "k2"], ["vec_id"], k + 1).select("vec_id", "v"), "ann-points")
    total = points.count()
    drawn = points.orderBy(F.xxhash64(F.lit("ann"), "vec_id"), "vec_id").limit(sample).select("v").toArrow()
    x = _matrix(drawn.column("v"), dim)
    per_leaf = max(leaf_rows * len(x) / max(total, 1), min(MIN_SAMPLE_PER_LEAF, len(x)))
    tree = fit_tree(x, per_leaf)
    shared_tree = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared_tree.value.assign(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column(0), b.column(1)], names=["leaf", "vec_id", "v"])

    placed = written(points.mapInArrow(to_leaves, "leaf long, vec_id long, v array<double>"), "ann-placed")
    held = np.zeros(tree.n_leaves, np.int64)
    ids_held = np.zeros(tree.n_leaves, np.int64)  # fewer than there are, if ids repeat
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.approx_count_distinct("vec_id").alias("d")).collect():
        held[r["leaf"]] = r["n"]
        ids_held[r["leaf"]] = min(r["n"], r["d"] * 3 // 4 + (r["d"] > 0))
    visits = calibrate(placed, asked, tree, dim, k, recall, calibration_queries)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column(2), dim)
            leaves, row = [], []
            for i in range(len(q)):
                seen = n = 0
                for leaf in shared_tree.value.best_bins(q[i]):
                    if n >= visits and seen > k:
                        break
                    leaves.append(leaf)
                    row.append(i)
                    n += 1
                    seen += int(ids_held[leaf])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves, pa.int64()), *(b.column(j).take(at) for j in range(3))], names=["leaf", "k1", "k2", "v"]
            )

    classes = asked.groupBy("k1", "k2").agg(F.first("v").alias("v"))
    visited = written(classes.mapInArrow(visit, "leaf long, k1 long, k2 long, v array<double>"), "ann-visits")
    called = np.zeros(tree.n_leaves, np.int64)
    for r in visited.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        called[r["leaf"]] = r["n"]
    blocks = spark.createDataFrame(
        [(i, -(-int(held[i]) // block_rows), -(-int(called[i]) // block_rows)) for i in range(tree.n_leaves) if held[i] and called[i]],
        "leaf long, nb int, nq int",
    )
    blocks = F.broadcast(blocks)  # a row per leaf, bounded by the sample
    left = placed.join(blocks, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "nb").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"),
        "vec_id", "v",
    )
    right = visited.join(blocks, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"),
        F.pmod(F.xxhash64("k1", "k2"), "nq").cast("int").alias("qb"), "k1", "k2", "v",
    )

    def compare(points: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["k1", "k2", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not points.num_rows or not wanted.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids = points.column("vec_id").to_numpy()
        found = list(nearest(_matrix(wanted.column("v"), dim), _matrix(points.column("v"), dim), ids, k + 1))
        row = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        at = pa.array(row)
        return pa.table(
            [wanted.column("k1").take(at), wanted.column("k2").take(at),
             pa.array(ids[np.concatenate([f[1] for f in found])]), pa.array(np.concatenate([f[2] for f in found]))],
            names=names,
        )

    hits = (
        left.groupBy("leaf", "b", "qb")
        .cogroup(right.groupBy("leaf", "b", "qb"))
        .applyInArrow(compare, "k1 long, k2 long, vec_id long, score double")
    )
    short = written(_first_ids(hits, ["k1", "k2"], ["score"], k + 1), "ann-short")
    own = Window.partitionBy("query_id", "k1", "k2").orderBy("score", "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), "k1", "k2")
        .distinct()
        .join(short, ["k1", "k2"])
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(own).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def calibrate(placed: DataFrame, asked: DataFrame, tree: Tree, dim: int, k: int, recall: float, most: int) -> int:
    """Leaves to visit: the fewest with which a bounded number of queries, compared with
    every vector, find ``recall`` of their true neighbours."""
    chosen = asked.orderBy(F.xxhash64(F.lit("calibrate"), "vec_id")).limit(most).select("vec_id", "v").toArrow()
    if not chosen.num_rows:
        return 1
    q, own = _matrix(chosen.column("v"), dim), chosen.column("vec_id").to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            leaf = b.column(0).to_numpy()
            ids = b.column(1).to_numpy()
            for i, at, d in nearest(q, _matrix(b.column(2), dim), ids, k + 1):
                keep = ids[at] != own[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(keep.sum(), i, np.int32)), pa.array(leaf[at][keep]), pa.array(d[keep])],
                    names=["q", "leaf", "d"],
                )

    first = Window.partitionBy("q").orderBy("d", "leaf")
    true = (
        placed.select("leaf", "vec_id", "v").mapInArrow(scan, "q int, leaf long, d double")
        .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).collect()
    )
    orders = [{leaf: n for n, leaf in enumerate(tree.best_bins(x))} for x in q]
    ranks = np.sort([orders[r["q"]][r["leaf"]] for r in true])
    if not len(ranks):
        return 1
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1

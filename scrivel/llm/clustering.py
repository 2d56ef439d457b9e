"""Exact k-means over integer vectors by kd-tree filtering.

Each partition's vectors are laid out in blocks, and each block in a kd-tree whose nodes hold a count, integer sums and a box.
The trees are written once. A round takes all centroids to every root; a node drops the centroids that are strictly farther
from all of its box than the one nearest to the box's middle, is assigned whole where one is left or all its points are
equal, and at a leaf the points are compared with what is left. So every point goes where a full comparison would send it,
and a round moves one count and one sum for each centroid and task. Centroids are the only thing that the driver holds.

Defined cases: a vector of another length, or null, or with null or non-finite components takes no part; ids may be repeated or
null, each row is a vector of its own; a row without an id is a first centroid only after all with one, of equal ids the smallest
vector in the order of arrays comes first; with fewer vectors than centroids asked for, there are as many as vectors; a centroid without
vectors stays; an empty table gives no rows. A component so large that squared
distances might not fit 64 bits is an error.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import mapped, only, scratch, written

#: Vectors in a tree, and in a leaf.
BLOCK, LEAF = 4096, 32
#: Up to here a product of matrices in double precision is exact, for up to 64 components.
EXACT = 1 << 22
TREE = "points binary, nodes binary, boxes binary, sums binary"


def integers(vectors: DataFrame, columns: dict[str, Column], vector_col: str, scale: int, size: int | None = None, limit: int = 1 << 52) -> DataFrame:
    """`columns` and v, the vector as integers floor(scale * x), of rows whose vectors are whole; of one length only if `size` is given. An integer beyond `limit` is an error."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(*(c.alias(n) for n, c in columns.items()), v.alias("v")).where("v IS NOT NULL").where(F.coalesce(good, F.lit(False)))
    rows = rows if size is None else rows.where(F.size("v") == size)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(F.when(F.abs(x) * scale <= limit, x * scale).otherwise(F.raise_error(F.lit(f"a component of a vector is beyond {limit} / {scale}")).cast("double")))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), width)


class Tree:
    """points (in the order of the leaves), nodes (begin, end, left, right; -1 for a leaf), boxes (least and greatest of each component) and sums."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, boxes: np.ndarray, sums: np.ndarray):
        self.points, self.nodes, self.boxes, self.sums = points, nodes, boxes, sums

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of some points and their order in it. A node is cut at the median of its widest side; one whose points are equal, or few, is a leaf."""
        order, nodes, boxes, ahead = np.arange(len(points)), [], [], [(0, len(points), -1, 0)]
        while ahead:
            begin, end, parent, side = ahead.pop()
            own, at = points[order[begin:end]], len(nodes)
            low, high = own.min(axis=0), own.max(axis=0)
            nodes.append([begin, end, -1, -1])
            boxes.append((low, high))
            if parent >= 0:
                nodes[parent][2 + side] = at
            widest = int((high - low).argmax())
            if end - begin > LEAF and high[widest] > low[widest]:
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, widest], middle)]
                ahead += [(begin, begin + middle, at, 0), (begin + middle, end, at, 1)]
        held, nodes = points[order], np.array(nodes, np.int32)
        running = np.concatenate((np.zeros((1, points.shape[1]), np.int64), held.cumsum(axis=0)))
        return cls(held, nodes, np.array(boxes), running[nodes[:, 1]] - running[nodes[:, 0]]), order

    def row(self) -> tuple[bytes, ...]:
        return self.points.astype(np.int32).tobytes(), self.nodes.tobytes(), self.boxes.astype(np.int32).tobytes(), self.sums.tobytes()

    @classmethod
    def of(cls, points: bytes, nodes: bytes, boxes: bytes, sums: bytes, width: int) -> Tree:
        read = lambda b, kind, *shape: np.frombuffer(b, kind).astype(np.int64).reshape(shape)
        return cls(read(points, np.int32, -1, width), read(nodes, np.int32, -1, 4), read(boxes, np.int32, -1, 2, width), read(sums, np.int64, -1, width))

    def assigned(self, centroids: np.ndarray):
        """(begin, end, centroid, node) of whole nodes, and (begin, end, centroids) of leaves' ranges with the numbers of their points' centroids (node is None)."""
        level, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(level):
            low, high = self.boxes[level, 0], self.boxes[level, 1]
            near = np.where(left, squared(low + high, 2 * centroids), np.iinfo(np.int64).max).argmin(axis=1)
            for at in range(0, len(level), 64):
                part = slice(at, at + 64)
                best = centroids[near[part], None]
                toward = centroids - best
                corner = np.where(toward > 0, high[part, None], low[part, None])
                # strictly dominated: even at the corner of the box that lies farthest towards it
                left[part] &= (toward * (centroids + best - 2 * corner)).sum(axis=2) <= 0
            below, keep = [], []
            for i, node in enumerate(level.tolist()):
                begin, end, a, b = self.nodes[node].tolist()
                if left[i].sum() == 1:
                    yield begin, end, int(left[i].argmax()), node
                elif a < 0:
                    some = np.flatnonzero(left[i])
                    if (low[i] == high[i]).all():  # one point, however often: of the nearest the smallest number
                        yield begin, end, int(some[squared(low[i : i + 1], centroids[some])[0].argmin()]), node
                    else:
                        yield begin, end, some[squared(self.points[begin:end], centroids[some]).argmin(axis=1)], None
                else:
                    below += [a, b]
                    keep += [i, i]
            level, left = np.array(below, np.int64), left[keep]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact: by one product in double precision where that can't round, else difference by difference."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in y], axis=1)


def grown(rows: DataFrame, size: int) -> DataFrame:
    """The trees of (vec_id, v), and the ids of each tree's points."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def each(batches):
        only("clustering")
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                tree, order = Tree.build(matrix(part.column("v"), size))
                ids = part.column("vec_id").take(pa.array(order))
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in tree.row())], ["ids", "points", "nodes", "boxes", "sums"])

    return mapped(rows.select("vec_id", "v"), each, f"ids array<{kind}>, {TREE}")


def trees_of(batch: pa.RecordBatch, width: int):
    for row in zip(*(batch.column(c).to_pylist() for c in ("points", "nodes", "boxes", "sums")), strict=True):
        yield Tree.of(*row, width)


def totals(trees: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, sums) over all vectors: one row for each centroid and task is shuffled, one for each centroid collected."""
    sent, (k, width) = trees.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def each(batches):
        only("clustering")
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for tree in trees_of(batch, width):
                for begin, end, which, node in tree.assigned(sent.value):
                    if node is not None:
                        n[which] += end - begin
                        sums[which] += tree.sums[node]
                    else:
                        np.add.at(n, which, 1)
                        np.add.at(sums, which, tree.points[begin:end])
        held = np.flatnonzero(n)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = mapped(trees.select("points", "nodes", "boxes", "sums"), each, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums")).collect()


def members(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    sent, width = trees.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]
    kind = trees.schema["ids"].dataType.elementType.simpleString()

    def each(batches):
        only("clustering")
        for batch in batches:
            for i, tree in enumerate(trees_of(batch, width)):
                cluster = np.empty(len(tree.points), np.int32)
                for begin, end, which, _ in tree.assigned(sent.value):
                    cluster[begin:end] = which
                away = ((tree.points - sent.value[cluster]) ** 2).sum(axis=1)
                yield pa.record_batch([batch.column("ids").slice(i, 1).flatten(), pa.array(cluster), pa.array(away)], ["vec_id", "cluster", "distance"])

    return mapped(trees, each, f"vec_id {kind}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def k_means(vectors: DataFrame, k: int, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of `size` components after `rounds` rounds.

    The first centroids are the k vectors with the smallest SHA-256 of `seed:id`, in that order. The driver holds k centroids, whatever the input.
    """
    spark = vectors.sparkSession
    # of corners, middles and centroids, squared differences fit, and components are stored in 32 bits
    rows = integers(vectors, {"vec_id": F.col(id_col)}, vector_col, scale, size, min(math.isqrt((1 << 63) // size) // 4, 1 << 30) - 1)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    with scratch(spark):
        trees = written(grown(rows, size), "trees")
        for _ in range(rounds):
            for r in totals(trees, centroids):
                centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        held = written(members(trees, centroids), "members", outer=True)
    sums = held.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    whole = sum(r["cluster_inertia"] for r in sums)
    facts = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], whole, digest(centroids[r["cluster"]])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return held.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

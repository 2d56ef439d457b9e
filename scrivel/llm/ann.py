"""Approximate nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Vectors are brought to length one, so that the largest inner product is the largest cosine. Pairs of components share a
codebook of sixteen words, learned so that the part of a residual parallel to its vector, which shifts the scores of those that
matter, costs more than the part across it. The codes of a task's rows are scored by table look-ups, block after block, and what
is among the `rerank` best of the task so far goes to an exact rerank on the original vectors; nothing else is scored exactly. Scores
are exact, then, and the nearest those of a search that may miss some: README has the recall.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
id; vectors are searched among those of their own length, which has a codebook of its own; ties among what is reranked go to the
smaller id; a repeated id is one candidate with the best score of its vectors, and asks with the smallest of them in the order
of arrays, once for each length; with fewer candidates than asked for, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivel.llm.common import mapped, only, written

WORDS = 16
RESULT = "query_id long, vec_id long, score double"
#: No id.
NONE = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(good, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero, without a sign


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # first to a largest component of one, so that no square over- or underflows
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantiser:
    """Codebooks of shape (parts, 16, 2) for vectors of length one."""

    def __init__(self, sample: np.ndarray, threshold: float = 0.2, rounds: int = 8):
        n, d = sample.shape
        self.width = d + d % 2
        x = self.split(sample)
        parts = x.shape[1]
        # how much more the parallel part costs, for scores above the threshold
        self.extra = max(0.0, threshold**2 / (1 - threshold**2) * (d - 1) - 1)
        pick = np.random.default_rng(7).choice(n, WORDS, replace=n < WORDS)
        self.words = x[pick].transpose(1, 0, 2).copy()
        for _ in range(rounds):
            codes = self.codes(x, 2)
            along = ((x - self.decoded(codes)) * x).sum(axis=2)  # each part's share of the parallel residual
            total = along.sum(axis=1)
            for m in range(parts):
                rest = total - along[:, m]
                for k in range(WORDS):
                    held = codes[:, m] == k
                    if not held.any():
                        continue
                    y = x[held, m]
                    a = held.sum() * np.eye(2) + self.extra * y.T @ y
                    b = (y + self.extra * (rest[held] + (y * y).sum(axis=1))[:, None] * y).sum(axis=0)
                    self.words[m, k] = np.linalg.solve(a, b)

    def split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1]))).reshape(len(x), -1, 2)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(codes.shape[1]), codes]

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """The words of each vector: the nearest ones, then part by part the word with the least anisotropic loss given the others."""
        across = ((x[:, :, None, :] - self.words) ** 2).sum(axis=3)
        along = ((x[:, :, None, :] - self.words) * x[:, :, None, :]).sum(axis=3)
        codes = across.argmin(axis=2)
        row = np.arange(len(x))
        for _ in range(sweeps):
            total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
            for m in range(x.shape[1]):
                rest = total - along[row, m, codes[:, m]]
                codes[:, m] = (across[:, m] + self.extra * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[row, m, codes[:, m]]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        codes = np.concatenate([self.codes(self.split(x[i : i + 2048])) for i in range(0, len(x), 2048)]).astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each byte of the codes and each query, the share of the score of each of its 256 values: (bytes, queries, 256)."""
        one = np.einsum("qmd,mkd->mqk", self.split(queries), self.words).astype(np.float32)
        if len(one) % 2:
            one = np.concatenate([one, np.zeros((1, *one.shape[1:]), np.float32)])
        return (one[::2, :, :, None] + one[1::2, :, None, :]).reshape(len(one) // 2, len(queries), WORDS * WORDS)


def distinct(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): each different vector with the smallest `most` ids that have it. More can't be among the nearest, as ties go to the smaller id.

    Repeated rows are summed up before they are shuffled, and of a frequent vector each task sends at most `most` ids.
    """
    once = rows.groupBy(F.xxhash64("v").alias("h"), "v", "vec_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    few = once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids")


def build(rows: DataFrame, sample: int, most: int) -> tuple[DataFrame, Quantiser | None]:
    """The index of usable rows (v, ids, codes), as a written table; its quantiser, learned from at most `sample` rows in the order of a hash of their ids."""
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    if not taken.num_rows:
        return rows, None
    quantiser = Quantiser(unit(matrix(taken.column("v"))))
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)

    def each(batches):
        only("ann")
        for batch in batches:
            if batch.num_rows:
                codes = sent.value.packed(unit(matrix(batch.column("v"))))
                yield pa.record_batch([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["v", "ids", "codes"])

    return written(mapped(distinct(rows, most), each, "v array<double>, ids array<long>, codes binary"), "index"), quantiser


class Nearest:
    """The nearest few of each query so far, by score and then by the smaller id, each id once. Empty places hold -inf."""

    def __init__(self, own: np.ndarray, few: int):
        self.own, self.few = own, few
        self.score, self.id = np.full((len(own), few), -np.inf), np.full((len(own), few), NONE)

    def least(self, rows: slice) -> np.ndarray:
        """The score that the next must reach."""
        return self.score[rows, -1]

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """For some queries as many further candidates each: score and ids of shape (queries, candidates); -inf stands for none."""
        score = np.concatenate((self.score[rows], np.where(ids == self.own[rows][:, None], -np.inf, score)), axis=1)
        ids = np.concatenate((self.id[rows], ids), axis=1)
        order = np.lexsort((ids, -score), axis=1)
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        by_id = np.argsort(ids, axis=1, kind="stable")  # of each id the first one counts
        sorted_ids = np.take_along_axis(ids, by_id, 1)
        again = np.zeros(ids.shape, bool)
        np.put_along_axis(again, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
        score = np.where(again, -np.inf, score)
        front = np.argsort(np.isneginf(score), axis=1, kind="stable")[:, : self.few]
        score, ids = np.take_along_axis(score, front, 1), np.take_along_axis(ids, front, 1)
        self.score[rows], self.id[rows] = score, np.where(np.isneginf(score), NONE, ids)


class Block:
    """Some rows of the index: their vectors, ids and codes."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        self.x = unit(matrix(batch.column("v")))
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, -1)
        lists = batch.column("ids")
        off = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        flat, size = lists.flatten().to_numpy(), np.diff(off)
        self.ids = np.full((n, int(size.max())), NONE)
        self.ids[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(off[:-1], size)] = flat
        order = np.argsort(self.ids[:, 0], kind="stable")  # so that of equal scores the smaller id comes first
        self.x, self.codes, self.ids = self.x[order], self.codes[order], self.ids[order]
        self.starts = np.flatnonzero(np.diff(self.ids[:, 0], prepend=self.ids[0, 0] - 1))

    def taken(self, nearest: Nearest, rows: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        """Candidates `at` of each of `rows`, with exact scores. First the vectors that matter, then all their ids."""
        few = min(nearest.few + 1, score.shape[1])
        order = np.lexsort((self.ids[at, 0], -score), axis=1)
        while True:
            first = order[:, :few]
            vectors, scores = np.take_along_axis(at, first, 1), np.take_along_axis(score, first, 1)
            ids = self.ids[vectors]
            if few == score.shape[1] or all(len(set(x.ravel().tolist()) - {NONE}) > nearest.few for x in ids):
                break
            few = min(2 * few, score.shape[1])  # the same ids again and again: look further
        wide = np.where(ids == NONE, -np.inf, scores[:, :, None])
        nearest.add(rows, wide.reshape(len(rows), -1), ids.reshape(len(rows), -1))

    def search(self, quantiser: Quantiser, queries: np.ndarray, rows: slice, nearest: Nearest, best: np.ndarray) -> None:
        """best: for each query the scores by tables of the best rows of the task so far, in no order; what beats the least of them is reranked."""
        q = queries[rows]
        numbers = np.arange(rows.start, rows.start + len(q))
        score = np.zeros((len(q), len(self.x)), np.float32)
        for b, table in enumerate(quantiser.tables(q)):
            score += table[:, self.codes[:, b]]
        rerank, at = best.shape[1], None
        if len(self.starts) < len(self.x):  # of a repeated id the best vector alone, so that it takes one place
            at = np.tile(self.starts, (len(q), 1))
            size = np.diff(self.starts, append=len(self.x))
            for k in np.flatnonzero(size > 1):
                at[:, k] += score[:, self.starts[k] : self.starts[k] + size[k]].argmax(axis=1)
            score = np.take_along_axis(score, at, 1)
        few = min(score.shape[1], rerank)
        top = np.argpartition(-score, few - 1, axis=1)[:, :few]
        kept = np.take_along_axis(score, top, 1)
        good = kept > best[rows].min(axis=1)[:, None]
        best[rows] = -np.partition(-np.concatenate((best[rows], kept), axis=1), rerank - 1, axis=1)[:, :rerank]
        for a in range(0, len(q), 32):
            near, ok = top[a : a + 32], good[a : a + 32]
            wide = int(ok.sum(axis=1).max())  # as many columns as the query with most candidates needs
            if wide:
                first = np.argsort(~ok, axis=1, kind="stable")[:, :wide]
                near, ok = np.take_along_axis(near, first, 1), np.take_along_axis(ok, first, 1)
                if at is not None:
                    near = np.take_along_axis(at[a : a + 32], near, 1)
                exact = (self.x[near] * q[a : a + 32, None, :]).sum(axis=2)
                self.taken(nearest, numbers[a : a + 32], np.where(ok, exact, -np.inf), near)


def scanned(index: DataFrame, quantiser: Quantiser, ids: np.ndarray, queries: np.ndarray, nearest: int, rerank: int) -> DataFrame:
    """(query_id, vec_id, score): for one block of queries, the nearest of each task's rows."""
    sent = index.sparkSession.sparkContext.broadcast((quantiser, ids, queries))

    def each(batches):
        only("ann")
        quantiser, ids, queries = sent.value
        found, best = Nearest(ids, nearest), np.full((len(ids), rerank), -np.inf, np.float32)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                block = Block(whole.slice(at, 4096))
                for a in range(0, len(ids), 256):
                    block.search(quantiser, queries, slice(a, a + 256), found, best)
        held = found.id != NONE
        yield pa.record_batch([pa.array(np.repeat(ids, held.sum(axis=1))), pa.array(found.id[held]), pa.array(found.score[held])], ["query_id", "vec_id", "score"])

    return mapped(index, each, RESULT)


def search(vectors: DataFrame, asks, nearest: int = 5, rerank: int = 200, sample: int = 20_000, block_bytes: int = 16 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where `asks` (a condition on vec_id) holds, the nearest other rows by cosine.

    Queries go in blocks of about `block_bytes` of their vectors, each against all rows; a block is all that the driver and a task hold of them.
    """
    spark, rows = vectors.sparkSession, usable(vectors, id_col, vector_col)
    parts = []
    for width in sorted(r["width"] for r in rows.select(F.size("v").alias("width")).distinct().collect()):
        own = rows.where(F.size("v") == width)
        index, quantiser = build(own, sample, nearest + 1)
        queries = written(own.where(asks).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
        blocks = -(-queries.count() * 8 * quantiser.width // block_bytes)
        for k in range(blocks):
            asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).orderBy("vec_id").toArrow()
            if asked.num_rows:
                found = scanned(index, quantiser, asked.column("vec_id").to_numpy(), unit(matrix(asked.column("v"))), nearest, rerank)
                parts.append(written(found, "nearest") if blocks > 1 else found)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = reduce(DataFrame.union, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")

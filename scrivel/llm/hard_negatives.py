"""Hard negatives by blocked dense products of anchors with all rows.

Anchors go out in blocks whose size is bounded. Each task multiplies such a block with blocks of its rows, as one product of
matrices in double precision, which is exact for integers while sums stay below 2^53, and keeps of each anchor the best few rows
of its own label; what tasks keep is merged by anchor. A second pass does the same with rows of other labels, whose scores lie
within the window that each positive's score opens. Work grows with anchors times rows; what a task, the driver and a shuffle
hold doesn't: blocks, and a few rows for each anchor of a block and task.

Defined cases: a row without an id or a label, or whose vector is null or has null or non-finite components, takes no part;
vectors of another length than an anchor's are no candidates for it; rows that repeat an id are rows of their own, anchors too, and
all but the anchor itself are candidates; ties go to the smaller id; with fewer rows than asked for, all are returned; a
positive without negatives in its window gives no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.llm.clustering import integers
from scrivel.llm.common import mapped, only, scratch, written

#: Rows and anchors of one product.
ROWS, ANCHORS = 2048, 256
#: No row of a place that is empty.
NONE = np.iinfo(np.int64).min
FOUND = "anchor long, place int, score long, vec_id long"


class Anchors:
    """A block of anchors of one length: keys, labels and vectors; `lows` and `highs`, windows of scores for each, in the second pass."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lows: np.ndarray | None = None, highs: np.ndarray | None = None):
        self.keys, self.labels, self.vectors, self.lows, self.highs = keys, labels, vectors, lows, highs


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of integer rows: in double precision where no sum can reach 2^53, else in whole numbers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    raise OverflowError("inner products don't fit 64 bits")


class Best:
    """For each anchor and place of its own (one, or one for each window) the `few` best rows so far: by score, then by the smaller id."""

    def __init__(self, anchors: int, places: int, few: int):
        self.few = few
        self.score, self.id = np.full((anchors, places, few), NONE), np.full((anchors, places, few), NONE)

    def add(self, rows: slice, place: int, score: np.ndarray, ids: np.ndarray) -> None:
        """score: (anchors, rows), NONE for what doesn't count, and is overwritten; ids ascend."""
        at = np.flatnonzero((score.max(axis=1, initial=NONE) >= self.score[rows, place, -1]) & (score.max(axis=1, initial=NONE) > NONE))
        if not len(at):
            return
        score, own = score[at], rows.start + at
        line, scores, found = np.arange(len(at)), [], []
        for _ in range(self.few):
            best = score.argmax(axis=1)  # the first of equals, so the smallest id
            scores.append(score[line, best])
            found.append(np.where(scores[-1] > NONE, ids[best], NONE))
            score[line, best] = NONE
        scores = np.concatenate((self.score[own, place], np.stack(scores, axis=1)), axis=1)
        found = np.concatenate((self.id[own, place], np.stack(found, axis=1)), axis=1)
        # NONE has no negative of its own: bits turned over descend as well
        order = np.lexsort((found, ~scores), axis=1)[:, : self.few]
        self.score[own, place], self.id[own, place] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)

    def table(self, keys: np.ndarray) -> pa.RecordBatch:
        anchor, place, nth = np.nonzero(self.score > NONE)
        return pa.record_batch([pa.array(keys[anchor]), pa.array(place.astype(np.int32)), pa.array(self.score[anchor, place, nth]), pa.array(self.id[anchor, place, nth])], ["anchor", "place", "score", "vec_id"])


def scanned(rows: DataFrame, anchors: Anchors, few: int, positive: bool) -> DataFrame:
    """(anchor, place, score, vec_id): of each task's rows, the best of each anchor: of its own label, or of others for each of its windows."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)
    width = anchors.vectors.shape[1]

    def each(batches):
        only("hard_negatives")
        held: Anchors = sent.value
        best = Best(len(held.keys), 1 if positive else held.lows.shape[1], few)
        for batch in batches:
            vectors = np.asarray(batch.column("v").flatten(), np.int64).reshape(batch.num_rows, width)
            keys, ids, labels = (np.asarray(batch.column(c)) for c in ("key", "vec_id", "label"))
            order = np.argsort(ids, kind="stable")
            for at in range(0, len(order), ROWS):
                some = order[at : at + ROWS]
                for a in range(0, len(held.keys), ANCHORS):
                    part = slice(a, min(a + ANCHORS, len(held.keys)))
                    score = product(held.vectors[part], vectors[some])
                    same = held.labels[part, None] == labels[some]
                    if positive:
                        best.add(part, 0, np.where(same & (held.keys[part, None] != keys[some]), score, NONE), ids[some])
                        continue
                    score[same] = NONE
                    for k in range(held.lows.shape[1]):
                        best.add(part, k, np.where((score >= held.lows[part, k, None]) & (score <= held.highs[part, k, None]), score, NONE), ids[some])
        yield best.table(held.keys)

    return mapped(rows.where(F.size("v") == width).select("key", "vec_id", "label", "v"), each, FOUND)


def merged(found: DataFrame, few: int) -> DataFrame:
    """The best few of each anchor's place, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def blocks(anchors: DataFrame, block_bytes: int):
    """Blocks of anchors (key, vec_id, label, v), each of one length and of about `block_bytes` at most; the driver holds one at a time."""
    for r in anchors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect():
        n = -(-r["n"] * 8 * max(r["width"], 1) // block_bytes)
        for k in range(n):
            taken = anchors.where((F.size("v") == r["width"]) & (F.pmod(F.xxhash64("key"), F.lit(n)) == k)).orderBy("key").toArrow()
            if taken.num_rows:
                vectors = np.asarray(taken.column("v").combine_chunks().flatten(), np.int64).reshape(taken.num_rows, r["width"])
                yield Anchors(taken.column("key").to_numpy(), taken.column("label").to_numpy(), vectors)


def windows(anchors: Anchors, positives: DataFrame, few: int, window: Callable[[int], tuple[int, int]]) -> Anchors:
    """The anchors with a window for each of their positives. Empty ones hold nothing."""
    lows, highs = np.full((len(anchors.keys), few), 0, np.int64), np.full((len(anchors.keys), few), -1, np.int64)
    at = {k: i for i, k in enumerate(anchors.keys.tolist())}
    for r in positives.select("anchor", "rank", "score").toLocalIterator():
        lows[at[r["anchor"]], r["rank"] - 1], highs[at[r["anchor"]], r["rank"] - 1] = window(r["score"])
    return Anchors(anchors.keys, anchors.labels, anchors.vectors, lows, highs)


def hard_negatives(
    vectors: DataFrame, asks: Column, label: Column | str = "label", positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: int = 256,
    block_bytes: int = 32 << 20, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the rows where `asks` (a condition on columns of vectors) holds, the best negatives whose scores are within `share`, in hundredths, of each positive's.

    Vectors count as integers floor(scale * x), scores are their inner products.
    """
    spark, (least, most) = vectors.sparkSession, share
    held = {"vec_id": F.col(id_col).cast("long"), "label": (F.col(label) if isinstance(label, str) else label).cast("long"), "asks": F.coalesce(asks, F.lit(False))}
    rows = integers(vectors, held, vector_col, scale).where("vec_id IS NOT NULL AND label IS NOT NULL")
    parts = []
    with scratch(spark):
        rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
        for anchors in blocks(rows.where("asks"), block_bytes):
            near = written(merged(scanned(rows, anchors, positives, True), positives), "positives", outer=True)
            anchors = windows(anchors, near, positives, lambda p: (-(-least * p // 100), most * p // 100))
            far = merged(scanned(rows, anchors, negatives, False), negatives).select("anchor", (F.col("place") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            names = rows.where("asks").select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
            near = near.select("anchor", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            parts.append(written(far.join(near, ["anchor", "nth"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", outer=True))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out

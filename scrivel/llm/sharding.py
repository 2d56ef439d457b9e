"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Rows of equal text are a group, and stay together. A partial partition is a tuple of as many sums as there are shards; of those
at hand, the two with the largest spread are combined, the largest sum of one with the smallest of the other, until one is
left. Groups are dealt into buckets by their digests, each bucket is differenced within a task, and so are the tuples that buckets
leave over, level by level, until few are left. Those are opened: their sums are items of the last differencing, together with the
groups that are large against a shard, as only many small items can even those out. Shards then come down by joins. So no
task holds more than some thousands of groups, the driver a number of sums that doesn't grow with the input, and a group
counts once however many rows it has.

Defined cases: a null text has no bytes, and is of one group with the empty text; ids may be null or repeated, each row has a
place of its own; of groups as large as one another the order of digests decides; of an empty table there are no rows. A group
larger than its share of a shard makes that shard as large as it is.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.llm.common import only, scratch, written

#: Groups, or tuples of the level below, in a bucket, about; tuples that are opened, at most.
FAN, TOP = 2_000, 500
#: A group is large beyond such a part of a shard, so there are at most so many for each shard.
LARGE = 100


def differenced(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of partial partitions (n, shards), each sorted from the largest sum: the sums of their union, sorted, and for each of them to which of these its own sums went.

    The two of the largest spread are combined, oppositely ordered; of equal spreads the earlier, and what was combined comes last.
    """
    n, shards = sums.shape
    held = np.zeros((2 * n - 1, shards), np.int64)
    held[:n] = sums
    heap = [(-int(s), i) for i, s in enumerate(sums[:, 0] - sums[:, -1])]
    heapq.heapify(heap)
    parts, order = np.zeros((n - 1, 2), np.int64), np.zeros((n - 1, shards), np.int64)
    for k in range(n - 1):
        _, a = heapq.heappop(heap)
        both = held[a] + held[heap[0][1]][::-1]
        order[k] = np.argsort(-both, kind="stable")
        held[n + k] = both = both[order[k]]
        parts[k] = a, heap[0][1]
        heapq.heapreplace(heap, (int(both[-1] - both[0]), n + k))
    went = np.zeros((2 * n - 1, shards), np.int64)
    went[-1] = np.arange(shards)
    for k in range(n - 2, -1, -1):
        a, b = parts[k]
        went[a, order[k]] = went[n + k]
        went[b, (shards - 1) - order[k]] = went[n + k]
    return held[-1], went[:n]


def level(items: DataFrame, shards: int, leaves: bool) -> DataFrame:
    """Each bucket of items (bucket, key, sums) differenced: (bucket, key, went) for each item, and one row with a null key that holds the bucket's own sums in `went`. An item of leaves has one sum, and one place that it went to."""
    kind = items.schema["key"].dataType.simpleString()

    def each(table: pa.Table) -> pa.Table:
        only("sharding")
        table = table.sort_by("key")
        flat = table.column("sums").combine_chunks().flatten().to_numpy()
        sums = np.zeros((table.num_rows, shards), np.int64)
        sums[:, : flat.size // table.num_rows] = flat.reshape(table.num_rows, -1)
        whole, went = differenced(sums)
        rows = [*(went[:, :1] if leaves else went).tolist(), whole.tolist()]
        key = pa.concat_arrays([table.column("key").combine_chunks(), pa.nulls(1, table.schema.field("key").type)])
        return pa.table({"bucket": pa.array(np.repeat(table.column("bucket")[0].as_py(), len(rows)), pa.int64()), "key": key, "went": pa.array(rows, pa.list_(pa.int64()))})

    return items.groupBy("bucket").applyInArrow(each, f"bucket long, key {kind}, went array<long>")


def balanced(groups: DataFrame, shards: int, fan: int = FAN, top: int = TOP) -> DataFrame:
    """(key, shard) of indivisible groups (key, size), a table of its own. The number of levels grows with the logarithm of the number of groups."""
    spark, kind = groups.sparkSession, groups.schema["key"].dataType.simpleString()
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bound = total // (shards * LARGE)
    buckets = max(1, min(top, -(-n // shards)), -(-n // fan))
    items = groups.where(F.col("size") <= bound).select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", F.array(F.col("size").cast("long")).alias("sums"))
    levels = []
    while True:
        levels.append(written(level(items, shards, not levels), "level"))
        tuples = levels[-1].where("key IS NULL").select("bucket", F.col("went").alias("sums"))
        if buckets <= top:
            break
        buckets = -(-buckets // min(fan, top))
        items = tuples.select(F.floor(F.col("bucket") / min(fan, top)).alias("bucket"), F.col("bucket").alias("key"), "sums")
    # `top` tuples and `shards` times LARGE groups at most
    opened, large = tuples.orderBy("bucket").collect(), groups.where(F.col("size") > bound).orderBy("key").collect()
    sums = np.zeros((len(opened) * shards + len(large), shards), np.int64)
    sums[:, 0] = [*(s for r in opened for s in r["sums"]), *(r["size"] for r in large)]
    went = differenced(sums)[1][:, 0].tolist() if len(sums) else []
    found = spark.createDataFrame([(r["bucket"], went[i * shards : (i + 1) * shards]) for i, r in enumerate(opened)], "bucket long, shards array<long>")
    for i, below in enumerate(reversed(levels)):
        over = F.broadcast(found) if not i else found
        found = below.where("key IS NOT NULL").join(over, "bucket").select("key", F.transform("went", lambda w: F.get("shards", w.cast("int"))).alias("shards")).withColumnRenamed("key", "bucket")
    small = found.select(F.col("bucket").alias("key"), F.get("shards", F.lit(0)).cast("int").alias("shard"))
    return small.union(spark.createDataFrame([(bytes(r["key"]) if kind == "binary" else r["key"], w) for r, w in zip(large, went[len(opened) * shards :], strict=True)], f"key {kind}, shard int"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row, and the columns `keep`: its UTF-8 bytes and one, its shard and its place there, without gaps from 0.

    Places follow the order in which rows were read: their count within a part of the input comes from a window over that part
    of one shard, and parts before it from counts.
    """
    spark = docs.sparkSession
    text: Column = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    extra = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    named = docs.select(F.col(id_col).alias("doc_id"), *extra, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    with scratch(spark):
        # the number is written, so that it stays a row's own however often it is read
        rows = written(named.withColumn("number", F.monotonically_increasing_id()), "rows")
        placed = written(balanced(written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups"), shards), "placed")
        at = written(rows.join(placed, "key").withColumn("part", F.shiftright("number", 33)).drop("key"), "at", outer=True)
    counts = at.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("number")) - 1
    out = at.withColumn("own", own).join(ahead, ["shard", "part"])
    return out.select("doc_id", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "size", "text_crc32", "shard", (F.col("own") + F.col("ahead")).cast("long").alias("slot"))

"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming check, connected components.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; rows without an id get a fingerprint, and the component of the others that share it (null if
there is none); repeated ids are repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scrivel.llm.common import filtered, mapped, only, scratch, slices, utf8, written

#: Shingles hashed at once.
BLOCK = 1 << 16
#: Buckets of more fingerprints than this go by meeting points instead of by pairs.
SMALL = 8


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = text.lower().split()  # bytes: A-Z, and the white space of ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    begins, ends = begins[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        data = b"".join([digest(joined[a:b], 42) for a, b in zip(begins[at : at + BLOCK], ends[at : at + BLOCK], strict=True)])
        ones += np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row."""
    kind = docs.schema[id_col].dataType

    def each(batches):
        only("simhash")
        for batch in batches:
            for part in slices(batch, "text"):
                off, data = utf8(part.column("text"))
                data, off = data.tobytes(), off.tolist()
                fp = [fingerprint(data[a:b], width) for a, b in zip(off, off[1:], strict=False)]
                yield pa.record_batch([part.column("id"), pa.array(fp, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, each, StructType([StructField("id", kind), StructField("fp", LongType())]))


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of all choices of blocks - distance blocks: two fingerprints that differ in at most `distance` bits agree under one of them."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(x)) for x in combinations(parts, blocks - distance)]


def links(nodes: DataFrame, distance: int = 2, blocks: int = 5) -> DataFrame:
    """Pairs (u, v) of node ids that span every group of linked fingerprints. nodes: (fp, rep), fp distinct.

    Fingerprints are joined on their blocks. A bucket of few is verified pair by pair. In a larger one, pairs would grow
    with its square: there, each fingerprint names the 65 points within one bit of it, and those that name the same point
    differ in at most two bits. At most 65 can name one point, so nothing grows with the bucket.
    """
    if not 0 <= distance <= 2:
        raise ValueError("a meeting point stands for at most two differing bits")
    masks = block_masks(blocks, distance)
    keys = F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    keyed = nodes.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.block", "k.key")
    sizes = written(keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    name = F.xxhash64("block", "key")
    likely = filtered(keyed.withColumn("bucket", name), "bucket", sizes.select(name.alias("bucket"))).where("may").drop("may", "bucket")  # buckets of one fingerprint aren't shuffled
    shared = written(likely.join(sizes, ["block", "key"]), "shared")

    differ = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    few = shared.where(F.col("n") <= SMALL).select("block", "key", "fp", "rep")
    other = few.select("block", "key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    pairs = few.join(other, ["block", "key"]).where((F.col("fp") < F.col("fp2")) & (differ("fp", "fp2") <= distance)).select(F.col("rep").alias("u"), F.col("rep2").alias("v"))

    if distance == 2:
        near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)))
    else:  # one bit: the point is the pair's value without that bit, with the bit's number
        near = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(~(1 << i) if i < 63 else (1 << 63) - 1)).alias("x")) for i in range(64)))
    points = shared.where(F.col("n") > SMALL).select("fp", "rep").distinct().select("rep", "fp", F.explode(near).alias("point"))
    met = points.groupBy("point").agg(F.collect_set(F.struct("rep", "fp")).alias("all")).where(F.size("all") > 1)
    star = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a.rep <> b.rep").where(differ("a.fp", "b.fp") <= distance)
    if distance == 0:
        star = star.limit(0)
    return pairs.union(star.select(F.col("a.rep"), F.col("b.rep"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over edges (u, v), for the nodes that have one.

    Each round hangs a node, and its label, below the smallest label beside it, then follows labels one step; rounds grow
    with the logarithm of the longest path. Every round is written, and no node's edges meet in one task: sums are partial,
    and the joins may be split.
    """
    with scratch(edges.sparkSession):
        edges = written(edges.union(edges.select(F.col("v"), F.col("u"))), "edges")
        labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
        while True:
            at = lambda a, b: labels.select(F.col("node").alias(a), F.col("label").alias(b))
            beside = edges.join(at("u", "lu"), "u").join(at("v", "lv"), "v").where("lv < lu")
            lower = beside.select(F.explode(F.array("u", "lu")).alias("node"), F.col("lv").alias("low")).groupBy("node").agg(F.min("low").alias("low"))
            hung = written(labels.join(lower, "node", "left").select("node", F.least("label", "low").alias("label"), F.col("low").isNotNull().alias("moved")), "hung")
            up = hung.select(F.col("node").alias("label"), F.col("label").alias("above"))
            labels = written(hung.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), (F.col("moved") | (F.col("above") < F.col("label"))).alias("moved")), "labels")
            if labels.where("moved").isEmpty():
                return written(labels.select("node", "label"), "components", outer=True)
            labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    marks = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    with scratch(docs.sparkSession):
        nodes = written(marks.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
        found = components(links(nodes.where("rep IS NOT NULL"), distance, blocks))
        named = written(nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("component_id")), "named", outer=True)
    hex16: Column = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marks.join(named, "fp", "left").select(F.col("id").alias("doc_id"), hex16.alias("fingerprint"), "component_id")

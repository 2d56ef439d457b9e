"""Near copies among distinct texts: SimHash links, and pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A 64-bit SimHash differs in about ten bits at similarity 0.8, a radius that no blocks of it cut selectively. So candidates
for the second kind come from bands of MinHash values of the shingles (two texts at 0.8 miss all bands with probability
(1 - 0.8^4)^20 = 0.00003, above it less), and each candidate's similarity is computed exactly. A bucket of few is compared
pair by pair; of a larger one, each text with the smallest, in the bucket and in what a second band makes of it, which
joins the copies that are many. What is then still apart in a large bucket is compared in full: members stand in blocks of
bounded size, blocks of one component alone meet none of their own, and of each two texts of different components a sketch (which
misses a pair at 0.8 with probability 0.00003) or else their shingles decide. So no link that would join two components is lost
in a bucket, whatever its size; the work grows with the square of a bucket only as far as its texts stay apart.

Defined cases: words are parted by ASCII white space and lower-cased in A-Z; a text of fewer words than a shingle is one
shingle; a null or empty text has none and is linked by its fingerprint alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.llm.common import filtered, mapped, only, scratch, slices, utf8, written
from scrivel.llm.simhash import SMALL, components, fingerprint, links

WIDTH = 5
#: Bands of so many MinHash values each.
BANDS, ROWS = 20, 4
#: Bands by which a large bucket is divided further.
FURTHER = (1, 2, 3, 4)
#: Shingles hashed at once.
BLOCK = 1 << 12
#: Bytes of a sketch, each of a MinHash value of its own, and how many must be equal: at 0.8 the mean is 205 of 256, and its deviation 6.4.
SKETCH, EQUAL = 256, 179
#: Shingles of a block of texts, about; a longer text is a block of its own.
BLOCK_SHINGLES = 1 << 14
SKETCH_FACTORS = np.random.default_rng(411).integers(0, 1 << 63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = np.random.default_rng(2025).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles, as sorted 64-bit hashes."""
    import xxhash

    words = text.lower().split()
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    if n < 1:
        each, n = np.append(each, np.zeros(width - len(words), np.uint64)), min(1, len(words))
    all_ = np.zeros(n, np.uint64)
    for k in range(width):
        all_ = mixed(all_ * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n])
    return np.unique(all_)


def band_keys(found: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        low = np.minimum(low, (found[at : at + BLOCK, None] * FACTORS[0] + FACTORS[1]).min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64).tolist()


def marked(docs: DataFrame) -> DataFrame:
    """(digest, fp, n, keys): fingerprint, number of shingles and band keys of each text."""

    def each(batches):
        only("near_copies")
        for batch in batches:
            for part in slices(batch, "text"):
                off, data = utf8(part.column("text"))
                data, off = data.tobytes(), off.tolist()
                texts = [data[a:b] for a, b in zip(off, off[1:], strict=False)]
                sets = [shingles(t) for t in texts]
                yield pa.record_batch(
                    [part.column("digest"), pa.array(map(fingerprint, texts), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    ["digest", "fp", "n", "keys"],
                )

    return mapped(docs.select("digest", "text"), each, "digest binary, fp long, n int, keys array<long>")


def _paired(keyed: DataFrame) -> list[DataFrame]:
    """Pairs (u, v, n, m) of the small and of the large buckets, and the members of the large ones. Only counts and members that share a bucket are written."""
    sizes = written(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    likely = filtered(keyed, "bucket", sizes.select("bucket")).where("may").drop("may")  # most buckets hold one text, and aren't shuffled
    shared = written(likely.join(sizes, "bucket"), "shared")
    few, large = (shared.where(c).select("bucket", "band", "digest", "n") for c in (F.col("size") <= SMALL, F.col("size") > SMALL))
    other = few.select("bucket", F.col("digest").alias("v"), F.col("n").alias("m"))
    pairs = few.join(other, "bucket").where("digest < v").select(F.col("digest").alias("u"), "v", "n", "m")
    least = written(large.groupBy("bucket").agg(F.min(F.struct("digest", "n")).alias("least")), "least")
    star = large.join(least, "bucket").where("least.digest < digest").select(F.col("least.digest").alias("u"), F.col("digest").alias("v"), F.col("least.n").alias("n"), F.col("n").alias("m"))
    return [pairs, star, large]


def candidates(marks: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct texts that share a band and whose numbers of shingles allow the similarity."""
    banded = marks.select("digest", "n", F.posexplode("keys").alias("band", "key"))
    found = _paired(banded.select("digest", "n", "band", F.xxhash64("band", "key").alias("bucket")))
    large = found.pop()
    further = F.transform(F.array(*map(F.lit, FURTHER)), lambda d: F.xxhash64("bucket", d, F.col("keys")[(F.col("band") + d) % BANDS]))
    again = large.join(marks.select("digest", "keys"), "digest")  # keys go with members of large buckets alone
    found += _paired(again.select("digest", "n", "band", F.explode(further).alias("bucket")))[:-1]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.where("5 * least(n, m) >= 4 * greatest(n, m)").select("u", "v").distinct()


def similar(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs, those whose texts have a similarity of 0.8 or more."""
    pairs = written(pairs, "pairs")
    named = written(pairs.select(F.explode(F.array("u", "v")).alias("digest")).distinct(), "named")
    likely = filtered(docs.select("digest", "text"), "digest", named).where("may").drop("may")
    texts = written(likely.groupBy("digest").agg(F.first("text").alias("text")).join(named, "digest", "left_semi"), "texts")
    side = lambda d, t: texts.select(F.col("digest").alias(d), F.col("text").alias(t))

    def each(batches):
        for batch in batches:
            for part in slices(batch, "a"):
                sides = []
                for c in ("a", "b"):
                    off, data = utf8(part.column(c))
                    data, off = data.tobytes(), off.tolist()
                    sides.append([shingles(data[x:y]) for x, y in zip(off, off[1:], strict=False)])
                keep = []
                for a, b in zip(*sides, strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(5 * both >= 4 * (len(a) + len(b) - both))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return mapped(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b"), each, "u binary, v binary")


def sketched(found: np.ndarray) -> bytes:
    low = np.full(SKETCH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        low = np.minimum(low, (found[at : at + BLOCK, None] * SKETCH_FACTORS[0] + SKETCH_FACTORS[1]).min(axis=0))
    return (mixed(low) >> np.uint64(56)).astype(np.uint8).tobytes()


def apart(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, band, digest, label, n, keys) of the members of large buckets that hold more than one component."""
    banded = marks.select("digest", "n", "keys", F.posexplode("keys").alias("band", "key")).select("digest", "n", "keys", "band", F.xxhash64("band", "key").alias("bucket"))
    sizes = banded.select("bucket").groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > SMALL).drop("size")
    sizes = written(sizes, "large")
    held = filtered(banded, "bucket", sizes).where("may").drop("may").join(sizes, "bucket")
    known = held.join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    known = written(known, "labelled")
    several = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return known.join(written(several, "several"), "bucket", "left_semi")


def blocked(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their block, and the pairs of blocks (bucket, i, j) that are to be compared.

    A component that would fill a block by itself has blocks of its own, which aren't compared with one another; others share blocks.
    """
    weight = members.groupBy("bucket", "label").agg(F.sum("n").alias("weight"))
    own = F.when(F.col("weight") > BLOCK_SHINGLES, F.col("label"))
    slots = weight.withColumn("own", own).groupBy("bucket", "own").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).alias("slots"))
    shares = weight.select("bucket", "label", own.alias("own")).join(slots.withColumnsRenamed({"bucket": "b", "own": "o"}), (F.col("bucket") == F.col("b")) & F.col("own").eqNullSafe(F.col("o"))).drop("b", "o")
    slot = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("label")).otherwise(F.col("digest"))), F.col("slots"))
    placed = written(members.join(shares, ["bucket", "label"]).withColumn("slot", slot).drop("slots"), "placed")
    ids = placed.select("bucket", "own", "slot").distinct().select("*", F.row_number().over(Window.partitionBy("bucket").orderBy("own", "slot")).alias("block"))
    ids = written(ids, "blocks")
    right = ids.select("bucket", F.col("own").alias("other"), F.col("block").alias("j"))
    pairs = ids.select("bucket", "own", F.col("block").alias("i")).join(right, "bucket").where("i <= j AND NOT coalesce(own = other, false)").select("bucket", "i", "j")
    named = ids.withColumnsRenamed({"bucket": "b", "own": "o", "slot": "s"})
    return placed.join(named, (F.col("bucket") == F.col("b")) & F.col("own").eqNullSafe(F.col("o")) & (F.col("slot") == F.col("s"))).drop("b", "o", "s", "own", "slot"), pairs


def compared(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links (u, v) between texts of different components in the same bucket: enough of them to join what is to be joined. A pair is looked at in the first band that it shares."""
    members, pairs = blocked(members)
    members = written(members, "members")
    named = written(members.select("digest").distinct(), "apart")
    likely = filtered(docs.select("digest", "text"), "digest", named).where("may").drop("may")

    def sets(batches):
        only("near_copies")
        for batch in batches:
            for part in slices(batch, "text"):
                off, data = utf8(part.column("text"))
                data, off = data.tobytes(), off.tolist()
                found = [shingles(data[a:b]) for a, b in zip(off, off[1:], strict=False)]
                yield pa.record_batch([part.column("digest"), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(map(sketched, found), pa.binary())], ["digest", "shingles", "sketch"])

    texts = likely.groupBy("digest").agg(F.first("text").alias("text")).join(named, "digest", "left_semi")
    held = written(mapped(texts, sets, "digest binary, shingles binary, sketch binary"), "sets")
    row = F.struct("digest", "label", "keys", "shingles", "sketch")
    blocks = written(members.join(held, "digest").groupBy("bucket", "block").agg(F.first("band").alias("band"), F.collect_list(row).alias("rows")), "rows")
    left = blocks.select("bucket", F.col("block").alias("i"), "band", F.col("rows").alias("a"))
    right = blocks.select("bucket", F.col("block").alias("j"), F.col("rows").alias("b"))

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                band, same, a, b = (batch.column(c)[k].as_py() for c in ("band", "same", "a", "b"))
                found = list(joining(band, a, a if same else b))
                yield pa.record_batch([pa.array([u for u, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["u", "v"])

    return mapped(written(pairs, "block_pairs").join(left, ["bucket", "i"]).join(right, ["bucket", "j"]).select("band", (F.col("i") == F.col("j")).alias("same"), "a", "b"), each, "u binary, v binary")


def joining(band: int, a: list[dict], b: list[dict]):
    """Of two blocks (or one twice), links between texts of different components that no link found before in them has joined."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    sketch = [np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), SKETCH) for rows in (a, b)]
    keys = [np.array([r["keys"] for r in rows], np.int64) for rows in (a, b)]
    found = [[np.frombuffer(r["shingles"], np.uint64) for r in rows] for rows in (a, b)]
    for x, r in enumerate(a):
        near = np.flatnonzero((sketch[1] == sketch[0][x]).sum(axis=1) >= EQUAL)
        near = near[near > x] if a is b else near
        near = near[~(keys[1][near, :band] == keys[0][x, :band]).any(axis=1)]  # those met in an earlier band
        for y in near.tolist():
            s = b[y]
            n, m = len(found[0][x]), len(found[1][y])
            if r["digest"] == s["digest"] or 5 * min(n, m) < 4 * max(n, m) or root(r["label"]) == root(s["label"]):
                continue
            both = len(np.intersect1d(found[0][x], found[1][y], assume_unique=True))
            if 5 * both >= 4 * (n + m - both):
                parent[root(r["label"])] = root(s["label"])
                yield r["digest"], s["digest"]


def near_copies(docs: DataFrame) -> DataFrame:
    """(digest, label) for each text that is linked to another: the smallest digest that it is linked to, over any number of links."""
    docs = docs.select(digest(F.col("text")).alias("digest"), "text")
    with scratch(docs.sparkSession):
        marks = written(marked(docs), "marks")
        marks = written(marks.groupBy("digest").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "distinct")
        nodes = written(marks.groupBy("fp").agg(F.min("digest").alias("rep")), "nodes")
        same = marks.join(nodes, "fp").where("digest <> rep").select(F.col("rep").alias("u"), F.col("digest").alias("v"))
        labels = written(components(links(nodes).union(same).union(similar(docs, candidates(marks))).distinct()), "labels").withColumnRenamed("node", "digest")
        rest = written(apart(marks, labels), "rest")
        if rest.isEmpty():
            return written(labels.withColumnRenamed("digest", "node"), "near_copies", outer=True)
        more = compared(docs, rest).distinct()
        stars = labels.where("digest <> label").select(F.col("label").alias("u"), F.col("digest").alias("v"))
        return written(components(stars.union(more)), "near_copies", outer=True)

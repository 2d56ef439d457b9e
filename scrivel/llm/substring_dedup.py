"""Passages that repeat across documents, by content-defined chunks under a gear rolling hash.

A gear hash of the bytes before each word rates the word's start; the lowest rate among any WINDOW words next to one
another is a cut. So cuts depend on nearby text alone, an insertion moves none beyond itself, and cuts are never more
than WINDOW words apart. A chunk runs from a cut to the first cut at least `min_bytes` on; chunks with the same 128-bit
digest in different documents are repeated, and repeated chunks that touch are one passage. Passages of 16 words or more are
reported, and those of 128 bytes or more, as text without spaces has few words.

Defined cases: null and empty texts have no chunks; a text shorter than a window is one chunk; rows without an id take
no part; rows with the same id are the same document, in one version for each of their texts, and repeated rows count once; repeats within one document alone are not reported; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivel.llm.common import mapped, only, slices, utf8, written

WINDOW = 10
#: Bytes that the gear hash looks back on.
REACH = 16
#: Bits of the filter over repeated digests: four MiB.
FILTER_BITS = 1 << 25


def gear_table() -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = h[i - 1] * 2 + table[data[i]], each over the last REACH bytes: sums of doubled reach."""
    h, reach = table[data], 1
    while reach < REACH:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))  # the right side is complete before it is stored
        reach *= 2
    return h


def cuts(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts data[off[k]:off[k + 1]]: their word starts, the number of each text's first word, and which starts are cuts."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~blank
    start[1:] &= blank[:-1]
    inner = off[1:-1][off[1:-1] < len(data)]
    start[inner] = ~blank[inner]
    at = np.flatnonzero(start)
    first = np.searchsorted(at, off)
    cut = np.zeros(len(at), bool)
    if len(at) >= WINDOW:
        # the hash of what precedes a word; in a text's first bytes it would hold another text's, so there nothing is rated
        rate = gear(data, table)[np.maximum(at - 1, 0)].astype(np.int64)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rate[at - off[text] < REACH] = 1 << 40
        whole = text[: len(at) - WINDOW + 1] == text[WINDOW - 1 :]
        view = np.lib.stride_tricks.sliding_window_view(rate, WINDOW)
        for a in range(0, len(view), 1 << 18):
            low = view[a : a + (1 << 18)].argmin(axis=1) + np.arange(a, min(a + (1 << 18), len(view)))
            cut[low[whole[a : a + (1 << 18)]]] = True
    cut[first[:-1][first[:-1] < first[1:]]] = True
    return at, first, cut


def chunks(docs: DataFrame, min_bytes: int = 64, id_col: str = "doc_id", text_col: str = "text", wanted=None) -> DataFrame:
    """(doc_id, version, hi, lo, w0, w1, b0, b1): a chunk's digest in two halves, its words and its bytes, ends exclusive. version tells texts of one id apart.

    `wanted`, a broadcast bit filter over digests, leaves out chunks that it rules out.
    """
    kind = docs.schema[id_col].dataType

    def each(batches):
        import xxhash

        only("substring_dedup")
        digest, table = xxhash.xxh3_128_digest, gear_table()
        bits = None if wanted is None else wanted.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                off, data = utf8(part.column("text"))
                at, first, cut = cuts(data, off, table)
                if not len(at):
                    continue
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                begin = np.flatnonzero(cut)  # words
                b0, doc = at[begin], text[begin]
                last = off[doc + 1]
                nxt = np.searchsorted(b0, b0 + min_bytes)  # the cut that ends the chunk, or the text's end
                end = np.where(nxt < len(b0), b0[np.minimum(nxt, len(b0) - 1)], len(data))
                b1 = np.minimum(end, last)
                w1 = np.where(b1 < last, begin[np.minimum(nxt, len(b0) - 1)], first[doc + 1])
                # of chunks that end with the text, the first one holds the others
                keep = np.ones(len(b0), bool)
                keep[1:] = (b1[1:] < last[1:]) | (b1[:-1] < last[1:])
                b0, b1, w0, w1, doc = b0[keep], b1[keep], begin[keep], w1[keep], doc[keep]
                raw = data.tobytes()
                # without white space at its end, a chunk is the same before a line's end and before a space
                half = np.frombuffer(b"".join([digest(raw[a:b].rstrip()) for a, b in zip(b0.tolist(), b1.tolist(), strict=True)]), ">i8").reshape(-1, 2).astype(np.int64)
                if bits is not None:
                    at = half[:, 0] & (FILTER_BITS - 1)
                    may = (bits[at >> 3] >> (at & 7)) & 1 == 1
                    b0, b1, w0, w1, doc, half = b0[may], b1[may], w0[may], w1[may], doc[may], half[may]
                ids = part.column("doc_id").take(pa.array(doc))
                version = np.array([xxhash.xxh32_intdigest(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint32).view(np.int32)[doc]
                base, word = off[doc], first[doc]
                for a in range(0, len(b0), 50_000):
                    s = slice(a, a + 50_000)
                    ints = [pa.array(x[s].astype(np.int32)) for x in (w0 - word, w1 - word, b0 - base, b1 - base)]
                    yield pa.record_batch([ids[s.start : s.stop], pa.array(version[s]), pa.array(half[s, 0]), pa.array(half[s, 1]), *ints], ["doc_id", "version", "hi", "lo", "w0", "w1", "b0", "b1"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return mapped(rows, each, f"doc_id {kind.simpleString()}, version int, hi long, lo long, w0 int, w1 int, b0 int, b1 int")


def bit_filter(digests: DataFrame):
    """Of FILTER_BITS bits, those that some digest's first half names: of fixed size, whatever the number of digests."""
    bit = F.col("hi").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = digests.select(F.shiftright(bit, 15).alias("row"), bit.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros((FILTER_BITS >> 15, 1 << 12), np.uint8)
    for r in rows:
        bits[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return digests.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def repeated_passages(docs: DataFrame, min_bytes: int = 64, min_words: int = 16, least_bytes: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage that another document holds too: (doc_id, start_byte, end_byte, start_word, n_words, n_chunks, first_doc_id, is_first).

    first_doc_id is the smallest document that holds its chunks; a run of repeated chunks whose first documents differ is
    a passage for each of them, and is as long as a whole for the question whether it is reported. is_first marks the
    first document's own passage, which a deduplication would keep: what it removes elsewhere stands there, or in turn in
    an earlier document yet. Digests are summed up before they are shuffled; chunks that a bit filter over the repeated
    digests rules out aren't shuffled at all, and the join of the others may be split where one digest is very frequent.
    """
    found = chunks(docs, min_bytes, id_col, text_col)
    ends = found.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    again = written(ends.where("first_doc_id < last_doc_id").select("hi", "lo", "first_doc_id"), "repeated")
    hits = chunks(docs, min_bytes, id_col, text_col, bit_filter(again)).join(again, ["hi", "lo"]).drop("hi", "lo")
    by = Window.partitionBy("doc_id", "version").orderBy("b0", "b1")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("b0") > F.max("b1").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    other = apart | (F.col("first_doc_id") != F.lag("first_doc_id").over(by))
    new = F.coalesce(F.col("b0") != F.lag("b0").over(by), F.lit(True))  # repeated rows hold each chunk again
    runs = hits.withColumns({"apart": apart.cast("int"), "other": other.cast("int"), "new": new.cast("int")}).withColumns({"run": F.sum("apart").over(so_far), "part": F.sum("other").over(so_far)})
    parts = runs.groupBy("doc_id", "version", "run", "part").agg(
        F.min("b0").cast("long").alias("start_byte"), F.max("b1").cast("long").alias("end_byte"), F.min("w0").cast("long").alias("start_word"),
        F.max("w1").cast("long").alias("end_word"), F.sum("new").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"),
    )
    run = Window.partitionBy("doc_id", "version", "run")
    long_enough = (F.max("end_word").over(run) - F.min("start_word").over(run) >= min_words) | (F.max("end_byte").over(run) - F.min("start_byte").over(run) >= least_bytes)
    # chunks overlap: a part ends where the next one begins
    nxt = lambda c: F.lead(c).over(run.orderBy("part"))
    clipped = parts.withColumn("long_enough", long_enough).withColumns({"end_byte": F.least("end_byte", nxt("start_byte")), "end_word": F.least("end_word", nxt("start_word"))}).where("long_enough")
    return clipped.select("doc_id", "start_byte", "end_byte", "start_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "n_chunks", "first_doc_id", (F.col("doc_id") == F.col("first_doc_id")).alias("is_first"))

"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of a partition's texts. Its words become symbols: a number for each word that a test window holds, 0 for
every other. A window can only lie within a run of such words as long as the shortest window, so only those runs are
indexed; each window whose words all occur is then searched backward through the wavelet ranks, its occurrences are located
from sampled positions, and the words they cover are merged into spans to remove. Documents aren't shuffled, and read once.
The benchmark goes to the tasks in blocks of bounded size, of which the driver and each task hold one at a time: with several
blocks, a task takes them in turn for every HOLD_BYTES of its texts.

Defined cases: a null or empty text has no words and isn't contaminated; items without words or without an id have no
windows; item ids that repeat are one item with the windows of all their texts; ids of documents may be null or repeated,
each row is judged for itself; a column to keep that is called like a result gives way to it; words whose hashes are equal
are told apart by their letters; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import mapped, only, slices, utf8
from scrivel.llm.fm_index import FMIndex

#: Fixed value: a word, once A-Z are lower case.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
FACTOR = 0x9E3779B97F4A7C15
#: Bytes whose sums are made at once, and bytes of text that are indexed at once: arrays of a slice's words take some twenty times as much.
PART, SLICE_BYTES = 1 << 18, 1 << 20
SPANS = "array<struct<start:int,end:int>>"
#: Windows of a block of the benchmark, and bytes of their words, at most.
BLOCK, BLOCK_BYTES = 100_000, 32 << 20
#: Bytes of text that a task holds at a time, if there are several blocks.
HOLD_BYTES = 32 << 20


def lowered() -> np.ndarray:
    """For each byte, its lower case if it belongs to a word, else 0. In UTF-8 every byte beyond ASCII does."""
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    return np.where((low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)), low, 0).astype(np.uint8)


def powers(factor: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, factor, np.uint64)))).astype(np.uint64)


class Words:
    """Word hashes of many bytes at once: sums of bytes times powers between a word's ends, brought to the same power."""

    def __init__(self):
        self.table = lowered()
        self.up, self.down = powers(FACTOR, PART), powers(pow(FACTOR, -1, 1 << 64), PART)

    def ends(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lowered bytes; where words begin and end. No word crosses a text's end."""
        low = self.table[data]
        inside = low != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[off[(off > 0) & (off < len(data))]] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        return low, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def hashes(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.uint64)
        at = 0
        while at < len(begin):  # parts of about PART bytes, between words
            first = begin[at]
            to = max(at + 1, int(np.searchsorted(end, first + PART, side="right")))
            if end[to - 1] - first > PART:  # one word longer than a part: it's no test word, unless a very odd one
                out[at] = np.uint64(int.from_bytes(hashlib.blake2b(low[first : end[at]].tobytes(), digest_size=8).digest(), "little"))
                at += 1
                continue
            part = low[first : end[to - 1]].astype(np.uint64) * self.up[: end[to - 1] - first]
            total = np.concatenate(([np.uint64(0)], np.cumsum(part, dtype=np.uint64)))
            a, b = begin[at:to] - first, end[at:to] - first
            out[at:to] = (total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64)
            at = to
        return out


class Benchmark:
    """A block of test windows: the words they hold, their symbols and the items of each window."""

    def __init__(self, windows: dict[tuple[str, ...], list[str]]):
        vocabulary = sorted({w for x in windows for w in x})
        self.symbol = {w.encode(): i for i, w in enumerate(vocabulary, 1)}
        self.sigma = len(vocabulary)
        self.items = list(windows.values())
        self.lengths = np.array([len(x) for x in windows], np.int64)
        self.shortest = int(self.lengths.min())
        self.patterns = np.zeros((len(windows), int(self.lengths.max())), np.int64)
        for i, x in enumerate(windows):
            self.patterns[i, : len(x)] = [self.symbol[w.encode()] for w in x]

    def ready(self, words: Words) -> None:
        """Sorted hashes of the vocabulary, made once. Hashes that several words have are listed apart."""
        if hasattr(self, "hashes"):
            return
        data = np.frombuffer(b" ".join(self.symbol), np.uint8)
        hashes = words.hashes(*words.ends(data, np.array([0, len(data)])))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number = hashes[order], order + 1
        again = self.hashes[1:] == self.hashes[:-1]
        self.ambiguous = np.unique(self.hashes[1:][again])

    def symbols(self, hashes: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == hashes, self.number[at], 0)
        if len(self.ambiguous):
            for i in np.flatnonzero(np.isin(hashes, self.ambiguous)).tolist():
                found[i] = self.symbol.get(low[begin[i] : end[i]].tobytes(), 0)
        return found


def windows(benchmark: DataFrame, size: int, id_col: str, text_col: str, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> Iterator[dict[tuple[str, ...], list[str]]]:
    """Each distinct window of a block with its items, block after block. The benchmark is the stated query set: it is read by the driver item by item. A window that comes again in a later block has other items there."""
    found: dict[tuple[str, ...], set[str]] = {}
    held = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    done = lambda: {x: sorted(items) for x, items in sorted(found.items())}
    for item, text in rows.toLocalIterator():
        text = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        for i in range(max(1, len(text) - size + 1) if text else 0):
            window = tuple(text[i : i + size])
            if window not in found:
                held += sum(map(len, window))
            found.setdefault(window, set()).add(item)
            if len(found) >= block or held >= block_bytes:
                yield done()
                found, held = {}, 0
    if found:
        yield done()


def covered(found: np.ndarray, text: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words some window covers; text and window of each occurrence. found: the words' symbols; text: their texts."""
    mask, none = np.zeros(len(found), bool), np.zeros(0, np.int64)
    known = found > 0
    same = known[1:] & known[:-1] & (text[1:] == text[:-1])
    heads = np.flatnonzero(known & ~np.concatenate(([False], same)))
    tails = np.flatnonzero(known & ~np.concatenate((same, [False]))) + 1
    long = tails - heads >= bench.shortest
    heads, sizes = heads[long], (tails - heads)[long]
    if not len(heads):
        return mask, none, none
    # the runs, each with a 0 after it
    to = np.cumsum(sizes + 1)
    place = np.arange(to[-1])
    run = np.searchsorted(to, place, side="right")
    word = heads[run] + place - (to - sizes - 1)[run]
    sequence = np.where(place == to[run] - 1, 0, found[np.minimum(word, len(found) - 1)])
    there = np.bincount(sequence, minlength=bench.sigma + 1) > 0
    there[0] = True  # what a shorter window is filled with
    asked = np.flatnonzero(there[bench.patterns].all(axis=1))
    if not len(asked):
        return mask, none, none
    index = FMIndex(sequence, bench.sigma)
    low, high = index.search(bench.patterns[asked], bench.lengths[asked])
    hits = np.maximum(high - low, 0)
    pattern = np.repeat(np.arange(len(hits)), hits)
    if not len(pattern):
        return mask, none, none
    rows = np.arange(len(pattern)) - np.repeat(np.cumsum(hits) - hits, hits) + low[pattern]
    at, pattern = word[index.locate(rows)], asked[pattern]
    cover = np.zeros(len(found) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + bench.lengths[pattern], -1)
    return np.cumsum(cover[:-1]) > 0, text[at], pattern


def shard(part: pa.RecordBatch, words: Words, bench: Benchmark | None) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """n_words, numbers of hit words and items of a slice's rows."""
    off, data = utf8(part.column("text"))
    low, begin, end = words.ends(data, off)
    first = np.searchsorted(begin, off)  # a text's words: first[k] to first[k + 1]
    n_words = np.diff(first)
    items: list[set] = [set() for _ in n_words]
    hit: list[list[int]] = [[] for _ in n_words]
    if len(begin) and bench:
        text = np.repeat(np.arange(len(n_words)), n_words)
        found = bench.symbols(words.hashes(low, begin, end), low, begin, end)
        while True:
            mask, texts, pattern = covered(found, text, bench)
            # equal hashes are no proof: the words of each text that was hit are compared, and its symbols mended
            wrong = False
            for k in np.unique(texts).tolist():
                here = [bench.symbol.get(w, 0) for w in BYTES.findall(low[off[k] : off[k + 1]].tobytes())]
                if not np.array_equal(here, found[first[k] : first[k + 1]]):
                    found[first[k] : first[k + 1]], wrong = here, True
            if not wrong:
                break
        for both in np.unique(texts * len(bench.items) + pattern).tolist():
            k, p = divmod(both, len(bench.items))
            items[k].update(bench.items[p])
        for k in np.unique(texts).tolist():
            hit[k] = np.flatnonzero(mask[first[k] : first[k + 1]]).tolist()
    return n_words, hit, [sorted(x) for x in items]


def merged(numbers: list[int], text: str) -> list[dict]:
    """Spans of neighbouring hit words in code points, the end exclusive: from the first word's beginning to the last one's end."""
    if not numbers:
        return []
    words = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    spans: list[dict] = []
    for i, before in zip(numbers, [-2, *numbers], strict=False):
        if i == before + 1:
            spans[-1]["end"] = words[i][1]
        else:
            spans.append({"start": words[i][0], "end": words[i][1]})
    return spans


def joined(a: tuple, b: tuple) -> tuple:
    """What two blocks of the benchmark give for the same rows."""
    union = lambda x, y: sorted({*x, *y}) if x and y else x or y
    return a[0], list(map(union, a[1], b[1])), list(map(union, a[2], b[2]))


def held_back(batches, most: int):
    """Lists of slices: one at a time, or as many as have `most` bytes of text together."""
    parts, total = [], 0
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            parts.append(part)
            total += part.get_total_buffer_size() if most else 0
            if total >= most:
                yield parts
                parts, total = [], 0
    if parts:
        yield parts


def forget(sent) -> None:
    """A broadcast value that can be read from its file again is given up until then."""
    if getattr(sent, "_path", None):
        sent.__dict__.pop("_value", None)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, at_least: int = 20, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated) for each row, and the columns `keep`.

    spans: the runs of hit words (start, end) in code points, the end exclusive. contaminated: some word is hit, and
    n_hit * at_least >= n_words.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    sent = []
    for held in windows(benchmark, size, item_col, item_text_col, block):
        sent.append(spark.sparkContext.broadcast(Benchmark(held)))
        forget(sent[-1])
    names = [f"keep_{i}" for i in range(len(keep))]
    out = ["id", *names, "n_words", "n_hit", "items", "spans"]

    def each(batches):
        only("decontamination")
        words = Words()
        for parts in held_back(batches, HOLD_BYTES if len(sent) > 1 else 0):
            found = [shard(part, words, None) for part in parts] if not sent else []
            for b in sent:
                bench = b.value
                bench.ready(words)
                now = [shard(part, words, bench) for part in parts]
                found = [joined(x, y) for x, y in zip(found, now, strict=True)] if found else now
                if len(sent) > 1:
                    forget(b)
            for part, (n_words, hit, items) in zip(parts, found, strict=True):
                spans = [merged(x, part.column("text")[i].as_py()) if x else [] for i, x in enumerate(hit)]
                results = [pa.array(n_words, pa.int64()), pa.array(list(map(len, hit)), pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                yield pa.record_batch([*(part.column(x) for x in ("id", *names)), *results], out)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(x) for c, x in zip(keep, names, strict=True)))
    schema = [f"id {kind}", *(f"{x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(keep, names, strict=True)), f"n_words long, n_hit long, items array<string>, spans {SPANS}"]
    found = mapped(rows, each, ", ".join(schema))
    hit = F.col("n_hit")
    result = {"doc_id": F.col("id"), "n_words": F.col("n_words"), "n_hit": hit, "n_items": F.size("items").cast("long"), "items": F.col("items"), "spans": F.col("spans"), "contaminated": (hit > 0) & (hit * at_least >= F.col("n_words"))}
    kept = {c: F.col(x) for c, x in zip(keep, names, strict=True)}
    return found.select(*(c.alias(x) for x, c in (kept | result).items()))

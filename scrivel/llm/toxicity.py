"""Toxicity by compression distance: separate zstandard dictionaries of toxic and of ordinary text, window by window.

Both dictionaries are made by zstandard's trainer. The ordinary one is of windows of ordinary training text; the toxic one
holds that, too, as toxic text is mostly ordinary, and before it a head of what ordinary words leave over of toxic training
text and recurs there. So what differs between a window's two compressed lengths comes from the head. How many windows of
a text are shorter under the toxic dictionary, by so many bytes or more for each of some thresholds, is weighed by a logistic
regression, calibrated on training texts that neither dictionary has seen.

Defined cases: a null or empty text is one empty window; ids may be null or repeated, each row is scored for itself; labels
that are null are not learned from, of repeated labels of one document the larger counts; without two labels of both kinds
there is nothing to learn and each score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
import warnings
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import mapped, only, scratch, slices, texts, written

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Bytes after which a window ends with the next space.
WINDOW = 64
#: Bytes at most: of the toxic head, of the ordinary dictionary, and of the windows that it is made from.
HEAD, COMMON, SAMPLES = 24_000, 400_000, 8 << 20
#: Toxic texts in which a word stands that recurs.
RECURS = 5
#: Pairs of dictionaries that are made, one of which is taken.
DRAWS = 3
#: Thresholds: bytes by which a window is shorter.
STEPS = (1, 2, 3, 4, 5, 6, 8)


def windows(text: bytes) -> list[bytes]:
    found, at, n = [], 0, len(text)
    while at < n:
        to = text.find(b" ", at + WINDOW, at + 4 * WINDOW)
        to = to if to >= 0 else min(n, at + 4 * WINDOW)
        found.append(text[at:to])
        at = to + (text[to : to + 1] == b" ")
    return found or [b""]


def compressor(dictionary: bytes, strategy: int, min_match: int):
    import zstandard

    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    rules = zstandard.ZstdCompressionParameters.from_level(3, strategy=strategy, min_match=min_match, window_log=20, write_content_size=0, write_checksum=0, write_dict_id=0)
    held.precompute_compress(compression_params=rules)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=rules).compress


class Distance:
    """Features of a text from the compressed lengths of its windows under both dictionaries.

    Each window is compressed in two ways: a thorough one whose matches may be short, which tells short words, and a fast
    one that only takes long matches, which tells compound words whose parts are common.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        self.ways = [[compressor(d, strategy, least) for d in (toxic, ordinary)] for strategy, least in ((zstandard.STRATEGY_BTOPT, 3), (zstandard.STRATEGY_DFAST, 7))]

    def features(self, text: str) -> list[float]:
        found = windows(text.lower().encode())
        n = len(found)
        gains = [np.array([len(ordinary(w)) - len(toxic(w)) for w in found]) for toxic, ordinary in self.ways]
        out = [math.log(n)]
        for d in (*gains, np.minimum(*gains)):
            over = [float((d >= q).sum()) for q in STEPS]
            out += [float(d.mean()), float(d.max()), float((d <= -2).mean()), *(x / n for x in over), *map(math.log1p, over)]
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (the last one is the constant), by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    hold = np.full(len(w), ridge * len(y))
    hold[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (p - y) + hold * w)
    return mean, spread, w


def left_over(texts: list[list[bytes]], held: set[bytes]) -> list[bytes]:
    """Of each text, the windows that recurring ordinary words leave over: runs of other words that stand in RECURS texts or more."""
    seen = Counter(w for words in texts for w in set(words))
    out = []
    for words in texts:
        run: list[bytes] = []
        for w in [*words, b""]:
            if len(w) > 2 and w not in held and seen[w] >= RECURS:
                run.append(w)
            elif run:
                out.append(b" " + b" ".join(run) + b" ")
                run = []
    return out


def trained(samples: list[bytes], size: int, share: float, segment: int, string: int = 8) -> bytes:
    """The content of a dictionary that zstandard's trainer makes: of at most `size` bytes, and of that share of the samples. Where the trainer refuses, as it does with few samples, they are the dictionary themselves."""
    import zstandard

    whole = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(size, max(1000, int(len(whole) * share))), samples, k=segment, d=string, steps=4).as_bytes()[8:]
    except (zstandard.ZstdError, ValueError):
        return whole[-size:]


def dictionaries(rows: list[tuple[str, int]], draws: int = 1):
    """Pairs of a toxic and an ordinary dictionary of training texts, as long as one another: ordinary text in both, and before it, in the toxic one, what recurs in toxic text beside. The trainer heeds the order of its windows, so there is a pair for each draw of them."""
    of = lambda k: (text.lower().encode() for text, label in rows if label == k)
    total, head = sum(map(len, of(0))), None
    once: set[bytes] = set()
    held: set[bytes] = set()
    for seed in range(1, draws + 1):
        draw = random.Random(seed)
        some: list[bytes] = []
        for text in of(0):  # one text at a time: what is held is a sample of windows, and each word once
            some += [w for w in windows(text) if draw.random() * total < SAMPLES]
            if head is None:
                words = set(WORD.findall(text))
                held |= words & once
                once |= words
        if head is None:
            head = trained(left_over([WORD.findall(text) for text in of(1)], held), HEAD, 0.9, 20)
            once.clear(), held.clear()
        draw.shuffle(some)
        ordinary = trained(some, COMMON, 0.25, 32)
        yield head + ordinary, b" " * len(head) + ordinary


class Model:
    """Learned from (text, label) rows: two in three for the dictionaries, the others to calibrate; of DRAWS pairs the one whose lengths tell the latter best."""

    def __init__(self, rows: list[tuple[str, int]]):
        parts = [[r for r in rows if (zlib.crc32(r[0].encode()) % 3 == 0) == k] for k in (False, True)]
        self.weights = None
        if any({label for _, label in part} != {0, 1} for part in parts):
            warnings.warn("too few labelled rows of both kinds: every score is 0", stacklevel=2)
            return
        y, least = np.array([label for _, label in parts[1]]), math.inf
        for toxic, ordinary in dictionaries(parts[0], DRAWS):
            measure = Distance(toxic, ordinary)
            x = np.array([measure.features(t) for t, _ in parts[1]])
            mean, spread, w = logistic(x, y)
            p = 1 / (1 + np.exp(-np.clip((x - mean) / spread @ w[:-1] + w[-1], -30, 30)))
            loss = -float(np.log(np.where(y == 1, p, 1 - p)).sum())
            if loss < least:
                least, self.toxic, self.ordinary, self.weights = loss, toxic, ordinary, (mean, spread, w)

    def scorer(self):
        if self.weights is None:
            return lambda found: [0.0] * len(found)
        measure, (mean, spread, w) = Distance(self.toxic, self.ordinary), self.weights

        def score(found: list[str]) -> list[float]:
            z = (np.array([measure.features(t) for t in found]).reshape(len(found), -1) - mean) / spread
            return (1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))).tolist()

        return score


def held_out(id_col) -> F.Column:
    """True for the fifth of the documents that is never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, most_bytes: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most `most` labelled documents, in the order of a hash of their ids, and at most `most_bytes` of text; both bound what the driver holds.

    Rows that repeat an id are one document, with the smallest of its texts.
    """
    known = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("label IS NOT NULL AND id IS NOT NULL")
    taken = known.orderBy(F.xxhash64("id"), "id").limit(most)
    # at most `most` ids and labels are broadcast, and as many texts written
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(taken), "id")
    with scratch(docs.sparkSession):
        sample = written(rows.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "sample")
        ids, total = [], 0
        for r in sample.select(F.xxhash64("id").alias("order"), "id", F.octet_length("text").alias("size")).orderBy("order", "id").collect():
            if total + r["size"] > most_bytes:  # a text that does not fit leaves room for shorter ones
                continue
            total += r["size"]
            ids.append(r["id"])
        if not ids:
            return Model([])
        kind = docs.schema[id_col].dataType.simpleString()
        chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], f"id {kind}")
        found = sample.join(F.broadcast(chosen), "id", "left_semi").select("text", "label").collect()
        return Model(sorted((r["text"], int(r["label"] > 0)) for r in found))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) for each row, and the columns `keep`. No shuffle; the model, of bounded size, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    extra = [f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    names = ["doc_id", *(f"keep_{i}" for i in range(len(keep)))]

    def each(batches):
        only("toxicity")
        score = sent.value.scorer()
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array(score(texts(part.column("text"))))
                yield pa.record_batch([*(part.column(c) for c in names), found, (found >= 0.5).astype(np.int32)], [*names, "score", "predicted"])

    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep))]
    scored = mapped(docs.select(*columns), each, ", ".join([f"doc_id {kind.simpleString()}", *extra, "score double, predicted int"]))
    return scored.select("doc_id", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "score", "predicted")

"""URL filters: rules, and for other hosts word segmentation with multinomial naive Bayes.

Concatenated host names are split into words by a unigram Viterbi, with the counts of all words of all pages' titles; each
name meets the words that occur in it by a join. What the rules decide is what naive Bayes learns from: counts of host words
and path tokens of all decided urls, hashed into `BUCKETS` places, so the model has the same size for any input.

Defined cases: a null url, or one without "://", has an empty host and path; it has no tokens, so the classes' shares decide;
with no decided url there is nothing to learn, and all others are allowed; ids may be null or repeated, each row is judged for
itself; titles may be missing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import mapped, only, written

#: Verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BUCKETS = 1 << 16
LETTERS = re.compile("[a-z]+")
#: Letters by which words are looked up in names; the rest of longer words is compared after that.
PIECE = 24
#: Bits of the filter over words: two MiB.
FILTER_BITS = 1 << 24
URL = "host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host is lower-cased in A-Z alone."""
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, decided): the longest rule that fits, and its verdict."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == name) | F.endswith("host", F.lit(f".{name}"))) & F.startswith("path", F.lit(begin))
        rule, decided = F.when(fits, name + begin).otherwise(rule), F.when(fits, verdict).otherwise(decided)
    return rows.select("*", rule.alias("rule"), decided.alias("decided"))


def title_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): counts of all words of all titles."""
    title = F.regexp_extract(F.lower(F.col(html_col)), "(?s)<title[^>]*>([^<]*)", 1)
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def split(name: str, found: list[tuple[int, str, int]], total: int) -> list[str]:
    """The likeliest split of a name into words. found: place, word and count of each word in it; a letter that no word covers costs more than any word."""
    unknown = math.log(total) + 10
    ending: dict[int, list[tuple[int, float]]] = {}
    for begin, word, n in found:
        ending.setdefault(begin + len(word), []).append((begin, math.log(total / n)))
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        at, least = end - 1, best[end - 1] + unknown
        for begin, cost in sorted(ending.get(end, ())):
            if best[begin] + cost < least:
                at, least = begin, best[begin] + cost
        best.append(least)
        back.append(at)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def word_bits(words: DataFrame):
    """A bit filter of fixed size over the words' openings of PIECE letters at most: it tells most other pieces of names beforehand."""
    bit = F.crc32(F.left("word", F.lit(PIECE)).cast("binary")).bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = words.select(F.shiftright(bit, 15).alias("row"), bit.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros((FILTER_BITS >> 15, 1 << 12), np.uint8)
    for r in rows:
        bits[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return words.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) for each distinct name (a column) of letters, split by the words that occur in it, wherever they do and however rare and long they are.

    Each name gives its pieces of at most PIECE letters; those that the filter lets through are joined with the words by
    their opening of that many letters. So neither the words nor the names are held anywhere as a whole.
    """
    spark = names.sparkSession
    words = written(words, "words")
    total = (words.agg(F.sum("n")).first()[0] or 0) + 1
    sent = word_bits(words)

    def pieces(batches):
        only("url_filter")
        bits = sent.value
        rows: list[tuple[str, int, str]] = []

        def flush():
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], ["name", "at", "piece"])
            rows.clear()
            return out

        for batch in batches:
            for name in batch.column(0).to_pylist():
                key = hashlib.sha256(name.encode()).hexdigest() if len(name) > 64 else name  # long names aren't repeated with each piece
                for m in LETTERS.finditer(name):
                    for at in range(m.start(), m.end()):
                        for end in range(at + 1, min(at + PIECE, m.end()) + 1):
                            piece = name[at:end]
                            bit = zlib.crc32(piece.encode()) & (FILTER_BITS - 1)
                            if bits[bit >> 3] >> (bit & 7) & 1:
                                rows.append((key, at, piece))
                    if len(rows) >= 20_000:
                        yield flush()
        if rows:
            yield flush()

    names = names.select("name").distinct()
    opening = words.select(F.left("word", F.lit(PIECE)).alias("piece"), "word", "n")
    found = mapped(names, pieces, "name string, at int, piece string").join(opening, "piece").groupBy("name").agg(F.collect_list(F.struct("at", "word", "n")).alias("found"))
    key = F.when(F.length("name") > 64, F.sha2("name", 256)).otherwise(F.col("name"))
    whole = names.select(key.alias("key"), "name").join(found.withColumnRenamed("name", "key"), "key", "left").select("name", "found")

    def each(batches):
        for batch in batches:
            listed = zip(batch.column("name").to_pylist(), batch.column("found").to_pylist(), strict=True)
            cut = [split(name, [(x["at"], x["word"], x["n"]) for x in found or () if name.startswith(x["word"], x["at"])], total) for name, found in listed]
            yield pa.record_batch([batch.column("name"), pa.array(cut, pa.list_(pa.string()))], ["name", "words"])

    return mapped(whole, each, "name string, words array<string>")


def with_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with host_words: those of all labels of the host. Hosts are split once each; a hot host's rows are joined with a written table, which may be split."""
    hosts = written(rows.select("host").distinct(), "hosts")
    labels = hosts.select("host", F.posexplode(F.split("host", "\\.")).alias("at", "name"))
    cut = written(segmented(labels.select("name"), words), "labels")
    known = labels.join(cut, "name").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    held = written(known.select(F.col("host").alias("of"), F.flatten(F.transform("all", lambda x: x["words"])).alias("host_words")), "host_words")
    return rows.join(held, F.col("host") == F.col("of")).drop("of")


def tokens(words: list[str], path: str) -> list[str]:
    return [f"h {w}" for w in words] + [f"p {'#' * len(t) if t.isdigit() else t}" for t in re.findall("[a-z]+|[0-9]+|[^\x00-\x7f]+", path.lower())]


def places(tokens: list[str]) -> list[int]:
    return [zlib.crc32(t.encode()) % BUCKETS for t in tokens]


class Bayes:
    """Log odds of block against allow, for each place, and before any token."""

    def __init__(self, counts: np.ndarray, urls: np.ndarray):
        smooth = counts + 1.0
        log = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.odds = log[1] - log[0]
        self.prior = math.log(urls[1] + 0.5) - math.log(urls[0] + 0.5) if urls.sum() else -1.0


def train(rows: DataFrame) -> Bayes:
    """From all urls that a rule decides. Each task sends at most two counts for each place."""

    def each(batches):
        only("url_filter")
        seen, urls = np.zeros((2, BUCKETS), np.int64), [0, 0]
        for batch in batches:
            for words, path, decided in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                label = int(decided == "block")
                urls[label] += 1
                np.add.at(seen[label], places(tokens(words, path)), 1)
        for label in (0, 1):
            held = np.flatnonzero(seen[label])
            yield pa.record_batch([pa.array(np.full(len(held) + 1, label, np.int32)), pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(seen[label][held], urls[label]))], ["label", "place", "n"])

    partial = mapped(rows.where("decided IS NOT NULL").select("host_words", "path", "decided"), each, "label int, place int, n long")
    found, urls = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for r in partial.groupBy("label", "place").agg(F.sum("n").alias("n")).collect():
        if r.place < 0:
            urls[r.label] = r["n"]
        else:
            found[r.label, r.place] = r["n"]
    return Bayes(found, urls)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) for each row; log_odds is what naive Bayes says of any url, above 0 for block."""
    rows = written(with_words(written(with_rules(pages, rules, id_col, url_col), "urls"), title_words(pages, html_col)), "judged")
    sent = pages.sparkSession.sparkContext.broadcast(train(rows))
    kind = pages.schema[id_col].dataType.simpleString()

    def each(batches):
        only("url_filter")
        model = sent.value
        for batch in batches:
            words, paths, decided = (batch.column(c).to_pylist() for c in ("host_words", "path", "decided"))
            odds = [model.prior + float(model.odds[places(tokens(w, p))].sum()) for w, p in zip(words, paths, strict=True)]
            verdict = [d or ("block" if o > 0 else "allow") for d, o in zip(decided, odds, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(odds, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "log_odds"])

    return mapped(rows, each, f"page_id {kind}, {URL}, log_odds double")

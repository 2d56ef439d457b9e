"""Token counts by byte-pair merging with a heap and a linked list; no token identifiers are made.

Defined cases: a null text counts as empty (0 tokens); ids may be null or repeated, each row is counted for
itself; columns of the input other than the two named ones are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Bounded, mapped, only, slices, texts, utf8

#: White space as the vocabulary's splitting pattern understands it.
WS = "\t-\r \x85\xa0  -     　"
#: Fixed value: the splitting pattern of this kind of byte-level vocabulary.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: A space beside other white space: there, a piece may not begin at the space.
WIDE = re.compile(f" [{WS}]|[{WS}] ")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Counter:
    """Counts tokens under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        ids = model["vocab"]
        self.first = [ids[x] for x in byte_letters()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pretokens = Bounded(lambda word: self.merged(word.encode()))
        self.pieces = Bounded(self.piece)

    def merged(self, word: bytes) -> int:
        """Tokens of one pretoken: its symbols minus its merges. The heap gives the lowest rank first, of equal ranks the leftmost."""
        symbol = [self.first[b] for b in word]
        n = left = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            if found := rank.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i))
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = rank.get((symbol[i], symbol[j]))
            if found is None or found[0] != r:
                continue  # the pair there is no longer the one that was pushed
            symbol[i], symbol[j] = found[1], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rank.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, (found[0], i))
            if (h := before[i]) >= 0 and (found := rank.get((symbol[h], symbol[i]))):
                heapq.heappush(heap, (found[0], h))
        return left

    def piece(self, piece: str) -> int:
        """Tokens of what stands after a space, with that space. Letters and a sign after them never share a pretoken."""
        if len(piece) > 1 and piece[-1] in ",." and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.pretokens[piece[-1]]
        return self.split(" " + piece)

    def split(self, text: str) -> int:
        return sum(map(self.pretokens.__getitem__, SPLIT.findall(text)))

    def plain(self, text: str) -> int:
        """Tokens of text without special strings. A space between two words begins a pretoken, so pieces cut there count for themselves."""
        if WIDE.search(text):
            return self.split(text)
        head, *rest = text.split(" ")
        return (self.split(head) if head else 0) + sum(map(self.pieces.__getitem__, rest))

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one."""
        if self.special is None or not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, self.special.split(text)))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One counter for each Python worker and vocabulary."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row. `vocabulary` is a path that every executor can open. No shuffle."""
    kind = docs.schema[id_col].dataType

    def each(batches):
        only("token_counts", counter.cache_clear)
        count = counter(vocabulary).count
        for batch in batches:
            for part in slices(batch, "text"):
                n = np.fromiter(map(count, texts(part.column("text"))), np.int64, part.num_rows)
                yield pa.record_batch([part.column("doc_id"), np.diff(utf8(part.column("text"))[0]), n, n > limit], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, each, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

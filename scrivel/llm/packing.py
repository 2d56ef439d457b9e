"""Sum-of-squares online packing of token sequences into windows of fixed length.

Defined cases: a null text is empty, so its document is the end token alone; documents longer than a window are
cut into full windows and a rest; ids may be null or repeated, each row is packed for itself; an empty table gives
no rows. Each task packs its own rows, with ids of sequences that hold the task's number.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Bounded, mapped, only, slices, texts, utf8

#: Fixed value: pretokens of the vocabulary, within ASCII and lower case.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: For each byte, whether it stands between spaces; what else is white space is left to the library.
BETWEEN = ~np.isin(np.arange(256), [9, 10, 13, 32])
#: Text bytes that are cut and encoded at once: lists of a slice's words and the library's answers take many times as much.
SLICE_BYTES = 1 << 20
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids (little-endian unsigned 32-bit) as the library gives them, for a vocabulary whose pretokens never hold white space. So what stands between spaces is encoded for itself, and the library's answers kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = Bounded(self.piece, 200_000)
        ends = [i for word, i in self.library.get_vocab().items() if word.endswith("</w>")]
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[ends] = True
        self.apart = bool(ends) and self.inner("a b") == self.inner("a") + self.inner("b")

    def inner(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[-1] in ",." and piece[:-1].lower().isalpha():
            return self.pieces[piece[:-1]] + self.pieces[piece[-1]]  # letters and signs never share a pretoken
        if piece.isascii() and not piece.isalpha() and "<|" not in piece and len(parts := PARTS.findall(piece.lower())) > 1:
            return b"".join([self.pieces[p] for p in parts])
        if piece.isalpha() and "\u03a3" not in piece and (lower := piece.lower()) != piece and lower.isalpha():
            return self.pieces[lower]  # the vocabulary is of lower case; only the sigma's depends on its neighbours
        return self.inner(piece) if piece else b""

    def turned(self) -> None:
        """Between slices, so that none loses what it needs."""
        if len(self.pieces) >= self.pieces.most:
            self.pieces.turn()

    def learn(self, odd: list[str]) -> None:
        """Brings what stands between spaces and isn't held into the cache, all at once: the library encodes many new words in one text, where each ends with an id of a word's end, which tells them apart; the same word with a capital or a sign after it follows."""
        known = self.pieces
        old = known.old
        kept = list(map(old.get, odd)) if old else [None] * len(odd)
        known.update((p, ids) for p, ids in zip(odd, kept, strict=True) if ids is not None)
        odd = [p for p, ids in zip(odd, kept, strict=True) if ids is None]
        words = {p: p.rstrip(".,").lower() for p in odd}
        new = [w for w in set(words.values()).difference(known) if w not in old and w.isalpha() and "\u03c2" not in w and len(w) <= 64]
        lists = [new[i : i + 500] for i in range(0, len(new), 500)]
        for some, found in zip(lists, self.library.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) != len(some):
                continue  # then one by one, when they are met
            data, at = ids.tobytes(), 0
            for word, end in zip(some, (4 * to).tolist(), strict=True):
                known[word] = data[at:end]
                at = end
        signs = {sign: known[sign] for sign in ",."}
        for piece, word in words.items():
            if piece == word:
                continue
            sign = signs.get(piece[-1:])
            bare = piece if sign is None else piece[:-1]
            if len(bare) == len(word) and bare.isalpha() and word.isalpha() and "\u03a3" not in bare and (ids := known.get(word)) is not None:
                known[piece] = ids if sign is None else ids + sign

    def many(self, texts: list[str]) -> list[bytes]:
        """Words are numbered as Arrow columns, so that only distinct ones become objects and are looked up; their ids are gathered by number."""
        if not self.apart:
            return [self.inner(t) for t in texts]
        off, data = utf8(pa.array(texts, pa.large_string()))
        inside = BETWEEN[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = off[:-1][off[:-1] < len(data)]
        first[heads] = inside[heads]  # no word crosses a text's end
        words = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside))
        words = pa.Array.from_buffers(pa.large_string(), len(words) - 1, [None, pa.py_buffer(words), pa.py_buffer(data[inside])]).dictionary_encode()
        code, distinct = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.turned()
        found = list(map(self.pieces.get, distinct))
        odd = [k for k, ids in enumerate(found) if ids is None]
        self.learn([distinct[k] for k in odd])
        for k in odd:
            found[k] = self.pieces[distinct[k]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[code]
        to = np.concatenate(([0], np.cumsum(n)))  # where the ids of each word begin and end
        place = np.repeat((np.cumsum(sizes) - sizes)[code] - to[:-1], n)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
        ends = 4 * to[np.searchsorted(np.flatnonzero(first), off)]
        return [ids[a:b] for a, b in itertools.pairwise(ends.tolist())]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows by fill level. A rest goes to the level (0: a new window) after which the sum over levels of the squared number of windows is smallest; ties go to the fullest."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.count = np.zeros(capacity + 1, np.int64)  # windows at each level; 0 and full ones aren't counted
        self.open: dict[int, list[list]] = {}  # level: windows, each a list of (doc, start, ids, doc_tokens)

    def sealed(self, window: list):
        """Rows of a window, which is complete."""
        sequence, offset = self.next_id, 0
        self.next_id += 1
        for doc, start, ids, tokens in window:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset
            offset += len(ids) // 4

    def place(self, doc, ids: bytes):
        tokens, cap = len(ids) // 4, self.capacity
        full = tokens // cap * cap
        for start in range(0, full, cap):
            yield from self.sealed([(doc, start, ids[4 * start : 4 * (start + cap)], tokens)])
        size = tokens - full
        if not size:
            return
        top = cap - size
        gain = 2 * self.count[size:].copy() + 1  # of one more window at level + size
        gain[top] = 0  # full: no longer counted
        gain[1:] -= 2 * self.count[1 : top + 1] - 1  # of one less at level
        gain[1:][self.count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(gain[::-1]))
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append((doc, full, ids[4 * full :], tokens))
        if level == top:
            yield from self.sealed(window)
        else:
            self.open.setdefault(level + size, []).append(window)
            self.count[level + size] += 1

    def close(self):
        """What is left open at the end: pieces of the emptiest windows are cut to fill the fullest, so that one window at most is padded."""
        left = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        spare: list = []  # pieces of emptier windows that have been taken apart
        lo, hi = 0, len(left) - 1
        while lo <= hi or spare:
            if lo <= hi:
                level, window = left[hi]
                hi -= 1
            else:
                level, window = 0, []
            gap = self.capacity - level
            while gap and (spare or lo <= hi):
                if not spare:
                    spare = left[lo][1]
                    lo += 1
                doc, start, ids, tokens = spare.pop()
                take = min(gap, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], tokens))
                if len(ids) > 4 * take:
                    spare.append((doc, start + take, ids[4 * take :], tokens))
                gap -= take
            yield from self.sealed(window)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). `vocabulary` is a path that every executor can open.

    No shuffle: a task holds its open windows alone, of which there are few at each level.
    """
    kind = docs.schema[id_col].dataType
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
    end = np.array([end_id], "<u4").tobytes()

    def each(batches):
        only("packing", encoder.cache_clear)
        ids_of = encoder(vocabulary).many
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        id_type = None
        rows: list = []

        def flush():
            columns = list(zip(*rows, strict=True))
            out = pa.record_batch([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)
            rows.clear()
            return out

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text", SLICE_BYTES):
                for doc, ids in zip(part.column("doc_id").to_pylist(), ids_of(texts(part.column("text"))), strict=True):
                    rows.extend(packer.place(doc, ids + end))
                if len(rows) >= 10_000:
                    yield flush()
        rows.extend(packer.close())
        if rows:
            yield flush()

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), each, f"doc_id {kind.simpleString()}, {SCHEMA}")

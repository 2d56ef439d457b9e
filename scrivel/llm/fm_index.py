"""An FM-index over a sequence of small integers: suffix sort, wavelet matrix over its last column, sampled positions.

The sequence is made of runs of symbols 1, 2, ... with a 0 after each; each 0 differs from every other, so no match crosses one.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling; in each round only those still tied are sorted."""
    n = len(symbols)
    zero = symbols == 0
    zeros = int(zero.sum())
    key = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + zeros)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a group's first place
    length = 1
    while True:
        alone = head & np.concatenate((head[1:], [True]))
        tied = np.flatnonzero(~alone)  # places
        if not len(tied):
            return order
        at = order[tied]
        group = rank[at]
        # a tied suffix holds no 0 within `length`, and a 0 ends the sequence: at + length is within
        pair = np.lexsort((rank[at + length], group))
        order[tied] = at = at[pair]
        group, second = group[pair], rank[at + length]
        first = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        head[tied] = first
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
        length *= 2


class Bits:
    """A bit vector that counts the ones before a place: words of 64 bits, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def at(self, place: np.ndarray) -> np.ndarray:
        return ((self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        """symbols end with 0; sigma: the largest symbol there may be. Every `sample`-th position is kept, and the first of each run, so that no way back crosses a 0."""
        n = len(symbols)
        order = suffix_array(symbols)
        last = symbols[order - 1]
        kept = (order % sample == 0) | (last == 0)
        self.kept, self.positions = Bits(kept), order[kept]
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))))
        self.levels, self.n = [], n
        for shift in reversed(range(max(1, int(sigma).bit_length()))):
            bit = (last >> shift) & 1
            bits = Bits(bit)
            zeros = n - int(bit.sum())
            self.levels.append((shift, bits, zeros))
            last = np.concatenate((last[bit == 0], last[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column before each place."""
        low, high = np.zeros_like(place), place
        for shift, bits, zeros in self.levels:
            a, b = bits.ones(low), bits.ones(high)
            one = (symbol >> shift) & 1 == 1
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of patterns (its first `length` symbols), the range of suffixes that begin with it: backward, one symbol more each step, for all patterns that are still found at once."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero(lengths > 0)
        step = 0
        while len(alive):
            symbol = patterns[alive, lengths[alive] - 1 - step]
            low[alive] = self.smaller[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.rank(symbol, high[alive])
            step += 1
            alive = alive[(low[alive] < high[alive]) & (lengths[alive] > step)]
        return low, high

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Positions of suffixes: each steps back through the last column until a kept position is met."""
        found, steps = np.empty(len(place), np.int64), np.zeros(len(place), np.int64)
        left, at = np.arange(len(place)), place.copy()
        while len(left):
            here = self.kept.at(at)
            done = left[here]
            found[done] = self.positions[self.kept.ones(at[here])] + steps[done]
            left, at = left[~here], at[~here]
            steps[left] += 1
            symbol = self.symbol(at)
            at = self.smaller[symbol] + self.rank(symbol, at)
        return found

    def symbol(self, place: np.ndarray) -> np.ndarray:
        """The last column's symbol at each place."""
        symbol = np.zeros_like(place)
        for shift, bits, zeros in self.levels:
            one = bits.at(place)
            ones = bits.ones(place)
            symbol |= one.astype(np.int64) << shift
            place = np.where(one, zeros + ones, place - ones)
        return symbol

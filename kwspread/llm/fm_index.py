"""A compressed full-text index of word sequences, and matching statistics against it.

The sequences of a shard are joined with separators; the Burrows-Wheeler transform of
their word numbers is kept as a wavelet matrix of bit vectors with block-wise ranks, so
that the rank of any word before any row takes one look-up per bit of a word number.
Backward search extends a match one word to the left. All streamed sequences advance
together, position by position, from their ends: `matching_statistics` reports for each
position the length of the longest match starting there whose interval of rows weighs at
least `least`. Where an extension is too light, the match gives way to its parent
interval (the least right-shortening that gains rows), found over the longest common
prefixes of neighbouring rows.
"""

from __future__ import annotations

import numpy as np

LCP_MOST = 255


class BitRank:
    """Bits packed into 64-bit blocks with the count of ones before each block."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8)))
        self.blocks = packed.view(np.uint64)
        ones = np.bitwise_count(self.blocks)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels, self.zeros = [], []
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            self.levels.append((bit, BitRank(ones)))
            self.zeros.append(int((~ones).sum()))
            values = np.concatenate((values[~ones], values[ones]))
        self.first = np.zeros(symbols, np.int64)
        # Where each symbol's rows begin below the last level.
        self.first = self.rank(np.arange(symbols), self.first)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[k] among the first at[k] values."""
        for (bit, ranks), zeros in zip(self.levels, self.zeros, strict=True):
            ones = ranks.ones(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at - self.first[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators make all suffixes differ."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(len(text), np.int64)
        after[: len(text) - step] = rank[step:] + 1
        key = rank * (len(text) + 2) + after
        order = np.argsort(key, kind="stable")
        told = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(told[1:] != told[:-1])))
        if rank[order[-1]] == len(text) - 1:
            return order
        step *= 2


class FMIndex:
    """Index of word-number sequences (numbers 0..symbols-1) with a weight each."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, weights: np.ndarray, symbols: int) -> None:
        n, m = len(words) + len(sizes), len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[ends] = np.arange(m)  # separators differ, so suffixes end there
        text[inside] = words + m
        order = suffix_order(text)
        last = text[order - 1] - m + 1  # word number + 1; any separator counts as 0
        self.rows = n
        self.wavelet = WaveletMatrix(np.maximum(last, 0), symbols + 1)
        counts = np.bincount(words + 1, minlength=symbols + 2)
        counts[0] = m
        self.before = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(m), sizes + 1)
        self.weight = np.concatenate(([0], np.cumsum(weights[owner[order]])))
        self._common_prefixes(text, order, m)

    def _common_prefixes(self, text: np.ndarray, order: np.ndarray, m: int) -> None:
        """Common prefix of rows k - 1 and k, and its minima over 2^j rows."""
        common = np.zeros(self.rows + 1, np.uint8)
        live = np.arange(1, self.rows)
        a, b = order[:-1], order[1:]
        depth = 0
        while len(live) and depth < LCP_MOST:
            same = (text[a] == text[b]) & (text[a] >= m)
            live, a, b = live[same], a[same] + 1, b[same] + 1
            depth += 1
            common[live] = depth
        self.common = [common]
        step = 1
        while 2 * step <= len(common):
            wide = self.common[-1]
            self.common.append(np.minimum(wide[:-step], wide[step:]) if len(wide) > step else wide)
            step *= 2

    def extend(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the matches lengthened by `word` to the left (-1: not in the index)."""
        symbol = np.maximum(word + 1, 0)
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        start = self.before[symbol]
        lo, hi = start + both[: len(lo)], start + both[len(lo) :]
        return lo, np.where(word < 0, lo, hi)

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval and the length of its common prefix."""
        table = self.common
        depth = np.maximum(table[0][lo], table[0][hi])
        lo, hi = lo.copy(), hi.copy()
        for level in reversed(range(len(table))):
            step, least = 1 << level, table[level]
            at = lo - step + 1  # rows at..lo join if their common prefixes reach depth
            go = (at >= 1) & (least[np.clip(at, 0, len(least) - 1)] >= depth)
            lo = np.where(go, lo - step, lo)
            go = (hi + step <= self.rows) & (least[np.clip(hi, 0, len(least) - 1)] >= depth)
            hi = np.where(go, hi + step, hi)
        root = depth == 0
        return np.where(root, 0, lo), np.where(root, self.rows, hi), depth.astype(np.int64)


def matching_statistics(index: FMIndex, words: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """For each position of the streamed sequences (one after the other): length of the
    longest match that starts there and weighs `least` or more."""
    out = np.zeros(len(words), np.int64)
    ends = np.cumsum(sizes)
    lo = np.zeros(len(sizes), np.int64)
    hi = np.full(len(sizes), index.rows, np.int64)
    depth = np.zeros(len(sizes), np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    longest = -np.sort(-sizes)
    for step in range(int(sizes.max(initial=0))):
        todo = by_size[: np.searchsorted(-longest, -step, "left")]  # sequences longer than step
        word = words[ends[todo] - 1 - step]
        while len(todo):
            a, b = index.extend(lo[todo], hi[todo], word)
            fits = index.weight[b] - index.weight[a] >= least
            on = todo[fits]
            lo[on], hi[on], depth[on] = a[fits], b[fits], depth[on] + 1
            todo, word = todo[~fits], word[~fits]
            stuck = (hi[todo] - lo[todo] == index.rows)
            lost = todo[stuck]
            depth[lost] = 0
            todo, word = todo[~stuck], word[~stuck]
            if len(todo):
                lo[todo], hi[todo], depth[todo] = index.parent(lo[todo], hi[todo])
        active = by_size[: np.searchsorted(-longest, -step, "left")]
        out[ends[active] - 1 - step] = depth[active]
    return out

"""Many keywords at once: a multi-pattern automaton over Arrow batches.

The dictionary is compiled into one transition table over the bytes that occur in it:
a trie whose missing arcs follow the failure links. States that end a keyword come last,
so a hit is one comparison. Texts are cut into strips of equal length that overlap by the
longest keyword less one byte; all strips of a batch advance together, one table look-up
per byte whatever the size of the dictionary. A dictionary whose table would pass
TABLE_CELLS is cut into several tables, each with its own walk over the texts; results
don't depend on the cut.

UTF-8 needs no decoding here: a keyword's bytes occur in a text's bytes exactly where the
keyword occurs in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TABLE_CELLS = 16 << 20
STRIP = 256
SLICE_BYTES = 4 << 20


class Automaton:
    """Transition table of some keywords (bytes, none empty); hits carry their numbers."""

    def __init__(self, words: Sequence[bytes], numbers: Sequence[int]) -> None:
        used = sorted(set(b"".join(words)))
        self.classes = np.zeros(256, np.uint8 if len(used) < 255 else np.int16)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = self.width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        depths = [0]
        for word, number in zip(words, numbers, strict=True):
            node = 0
            for c in self.classes[list(word)].tolist():
                step = children[node].get(c)
                if step is None:
                    step = children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                    depths.append(depths[node] + 1)
                node = step
            ends[node].append(number)
        self.longest = max(depths)
        n = len(children)
        table, fail = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        order = np.argsort(depths, kind="stable")
        level_ends = np.searchsorted(np.array(depths)[order], np.arange(self.longest + 2))
        for level in range(self.longest + 1):
            nodes = order[level_ends[level] : level_ends[level + 1]]
            arcs = [(node, c, child) for node in nodes.tolist() for c, child in children[node].items()]
            if level:
                table[nodes] = table[fail[nodes]]
            if arcs:
                at, by, to = np.array(arcs).T
                fail[to] = table[at, by] if level else 0
                table[at, by] = to
        # Nearest state that ends a keyword: the state itself or along its failure links.
        closes = np.array([bool(e) for e in ends])
        nearest = np.where(closes, np.arange(n), 0)
        for level in range(1, self.longest + 1):
            nodes = order[level_ends[level] : level_ends[level + 1]]
            nearest[nodes] = np.where(closes[nodes], nodes, nearest[fail[nodes]])
        hit = nearest > 0
        place = np.empty(n, np.int64)  # states with a hit last, shallow ones (the busy ones) first
        place[np.concatenate((order[~hit[order]], order[hit[order]]))] = np.arange(n)
        self.first_hit = int((~hit).sum()) * width
        self.start = int(place[0]) * width
        moved = np.empty_like(table)
        moved[place] = place[table] * width
        self.table = moved.reshape(-1)
        # Keywords of a state, and the next shorter state that ends some.
        self.state_of = np.zeros(n, np.int64)
        self.state_of[place] = nearest
        self.shorter = nearest[fail]
        sizes = np.array([len(e) for e in ends])
        self.word_start, self.word_count = np.cumsum(sizes) - sizes, sizes
        self.words = np.array([x for e in ends for x in e], np.int64)

    def states(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pairs (text << 32 | state) of the texts data[start : start + size] and the
        hit states met in them, each once."""
        strip = max(STRIP, self.longest)
        per_text = np.maximum(1, -(-sizes // strip))
        text = np.repeat(np.arange(len(sizes)), per_text)
        inside = (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * strip
        length = np.minimum(sizes[text] - inside, strip + self.longest - 1)
        order = np.argsort(-length, kind="stable")
        text, length, at = text[order], length[order], (starts[text] + inside)[order]
        coded = self.classes[data]
        state = np.full(len(text), self.start, np.int64)
        active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
        found = []
        for step, n in enumerate(active.tolist()):
            now = state[:n]
            now += coded[at[:n] + step]
            now[:] = self.table[now]
            hits = np.flatnonzero(now >= self.first_hit)
            if len(hits):
                found.append(text[hits] << 32 | now[hits] // self.width)
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def hits(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and keyword number of all hits, in any order, perhaps repeated."""
        pairs = self.states(data, starts, sizes)
        text, state = pairs >> 32, self.state_of[pairs & 0xFFFFFFFF]
        texts, words = [], []
        while len(state):
            count = self.word_count[state]
            total = int(count.sum())
            shift = np.repeat(self.word_start[state] - (np.cumsum(count) - count), count)
            texts.append(np.repeat(text, count))
            words.append(self.words[shift + np.arange(total)])
            state = self.shorter[state]
            text, state = text[state > 0], state[state > 0]
        if not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(texts), np.concatenate(words)


class Dictionary:
    """Keywords in order, compiled into as few tables as their size allows."""

    def __init__(self, needles: Sequence[str], cells: int = TABLE_CELLS) -> None:
        raw = [n.encode() for n in needles]
        width = len(set(b"".join(raw))) + 1
        self.size, self.tables = len(raw), []
        # Neighbours in byte order share beginnings, so they share states.
        order = sorted(range(len(raw)), key=raw.__getitem__)
        group: list[int] = []
        states = 1
        for k in order:
            if group and (states + len(raw[k])) * width > cells:
                self._close(raw, group)
                group, states = [], 1
            group.append(k)
            states += len(raw[k])
        if group:
            self._close(raw, group)

    def _close(self, raw: list[bytes], group: list[int]) -> None:
        self.tables.append(Automaton([raw[k] for k in group], group))

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and keyword number of all hits, each once, by text and dictionary order.
        A null text has none."""
        sizes = pc.binary_length(texts.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            data = np.frombuffer(b"".join(x for x in texts.slice(at, to - at).cast(pa.large_binary()).to_pylist() if x), np.uint8)
            own = sizes[at:to]
            for table in self.tables:
                text, word = table.hits(data, np.cumsum(own) - own, own)
                out.append((text + at) * self.size + word)
            at = to
        pairs = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        return pairs // max(1, self.size), pairs % max(1, self.size)


_COMPILED: dict[str, Dictionary] = {}


def compiled(needles: tuple[str, ...]) -> Dictionary:
    """A worker compiles a dictionary once and keeps the last few."""
    key = hashlib.md5("\0".join(needles).encode()).hexdigest()
    if key not in _COMPILED:
        while len(_COMPILED) >= 4:
            _COMPILED.pop(next(iter(_COMPILED)))
        _COMPILED[key] = Dictionary(needles)
    return _COMPILED[key]


def first_hits(texts: pa.Array, needles: tuple[str, ...], keywords: pa.Array) -> pa.Array:
    """The keyword that comes first in the dictionary of those in each text, or null."""
    text, word = compiled(needles).hits(texts)
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    chosen = np.full(len(texts), -1)
    chosen[text[first]] = word[first]
    return keywords.take(pa.array(chosen, mask=chosen < 0))


def all_hits(texts: pa.Array, needles: tuple[str, ...], keywords: pa.Array) -> pa.Array:
    """Lists of all keywords in each text, in dictionary order; null for a null text."""
    text, word = compiled(needles).hits(texts)
    offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), keywords.take(pa.array(word)))
    return pc.if_else(texts.is_valid(), lists, pa.scalar(None, lists.type))

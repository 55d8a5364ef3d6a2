"""Operator 4: byte-pair encoding and decoding by a tokenization automaton.

The automaton's states are the tokens last read, its arcs the tokens that may follow, so
that exactly the sequences that byte-pair merging produces are its paths. It starts with
one state and an arc per byte and is rebuilt by one gadget per merge (u, v) -> w, in
merge order: the state after u loses its arc v; every state with an arc u gets an arc w;
the state after w starts as a copy of the state after v as it is at that moment. Copies
are shared instead of made: a state keeps its own lost arcs with the merge that took
them, and refers to the state it was copied from with the time of the copy. So arc t
leaves state p unless some merge (s, x) took it, with s on p's chain of right parts
while s was p's end, and x on t's chain of left parts before x became part of more
(`AutomatonTables.blocked`). A token whose own merge finds no arc stays dead.

Encoding a pre-split word reads a byte trie of the arc labels from every position and
keeps, per prefix, the one token that ends it: the label whose arc leaves the state of
the prefix before it. All words of a batch advance together, one table look-up per step.
Decoding emits the bytes of each arc label.

Texts are cut into chunks (a space and what follows up to the next white space), which
is where the pre-split of byte-level vocabularies may cut, too. A worker remembers the
chunks it has met, at most MAX_CHUNKS at once.

Defined results: null and empty texts have no tokens; strings of added tokens are taken
as these tokens, wherever they stand; texts of any length are encoded whole; repeated
rows get equal results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kwspread.llm.common import Pool, Slots, segment_sums, text_slices, worker_cache
from kwspread.llm.word_tokens import byte_letters

MAX_CHUNKS = 350_000
#: Words that advance together; bounds the working arrays.
BATCH_WORDS = 20_000
#: Text that a worker handles at a time.
SLICE = 2 << 20
#: White space, and the pre-split of byte-level vocabularies.
SPACE = "\t-\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
_WORDS = regex.compile(PRE_SPLIT)
_CHUNKS = re.compile(r" ?[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+(?![^\x20\x09-\x0d])|[\x20\x09-\x0d]")
#: The commonest chunk: Latin letters and marks that the pre-split always parts.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?%#$&*|]*)")
#: White space that the chunk pattern does not know; such texts are pre-split whole.
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
NEVER = np.int32(1 << 30)


class AutomatonTables:
    """The compiled automaton of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocab = told["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        to_byte = {letter: b for b, letter in enumerate(byte_letters())}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for token, n in vocab.items():
            if token not in self.added:
                self.labels[n] = bytes(to_byte[c] for c in token)
        for token, n in self.added.items():
            self.labels[n] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self._gadgets([(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], size)
        singles = {label[0]: n for n, label in enumerate(self.labels) if len(label) == 1}
        live = [n for n in range(size) if self.labels[n] and (self.rank[n] >= 0 or singles.get(self.labels[n][0]) == n)]
        self._trie([n for n in live if n not in self.added.values()])
        self.length = np.fromiter(map(len, self.labels), np.int32, size)

    def _gadgets(self, merges: list[tuple[int, int, int]], size: int) -> None:
        """Apply the merges in order. `rank` is the time of a token's merge (-1: a byte or
        dead), `left`/`right` its parts, `lost` the pairs (state, arc) with their time."""
        self.rank = np.full(size, -1, np.int32)
        self.left = np.arange(size, dtype=np.int32)
        self.right = np.arange(size, dtype=np.int32)
        order = sorted(range(len(merges)), key=lambda k: merges[k][:2])
        keys = np.array([merges[k][0] << 20 | merges[k][1] for k in order], np.int64)
        self.lost_keys, self.lost_time = keys, np.array(order, np.int32)
        bytes_or_made = {n for n, label in enumerate(self.labels) if len(label) == 1}
        for time, (u, v, w) in enumerate(merges):
            if u in bytes_or_made and v in bytes_or_made and self.rank[w] < 0 and len(self.labels[w]) > 1:
                self.rank[w], self.left[w], self.right[w] = time, u, v
                bytes_or_made.add(w)
        # A merge whose arc is gone by its own time makes no token.
        made = np.flatnonzero(self.rank >= 0)
        gone = self.blocked(self.left[made], self.right[made], before=self.rank[made])
        self.rank[made[gone]] = -1

    def _lost(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """When state s itself loses arc x (NEVER: it does not)."""
        key = s.astype(np.int64) << 20 | x
        at = np.minimum(np.searchsorted(self.lost_keys, key), len(self.lost_keys) - 1)
        return np.where(self.lost_keys[at] == key, self.lost_time[at], NEVER)

    def blocked(self, states: np.ndarray, arcs: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether arc t is absent from state p, for each pair.

        Walks back in time through what stood on both sides of the border: the later of
        the two ends is undone to its inner part, whose arcs counted up to that time.
        """
        s, x = states.astype(np.int32), arcs.astype(np.int32)
        out = np.zeros(len(s), bool)
        state_until = np.full(len(s), NEVER, np.int32) if before is None else before.astype(np.int32)
        arc_until = state_until.copy()
        live = np.arange(len(s))
        while len(live):
            a, b = s[live], x[live]
            time = self._lost(a, b)
            taken = (time < state_until[live]) & (time <= arc_until[live])
            out[live[taken]] = True
            ra, rb = self.rank[a], self.rank[b]
            go = ~taken & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            on, off = live[undo], live[~undo]
            state_until[on], s[on] = np.minimum(state_until[on], ra[undo]), self.right[a[undo]]
            arc_until[off], x[off] = np.minimum(arc_until[off], rb[~undo]), self.left[b[~undo]]
        return out

    def _trie(self, tokens: list[int]) -> None:
        """Byte trie of the labels: next[node, byte] (0: none) and the token at a node."""
        children: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for n in sorted(tokens, key=lambda n: self.labels[n]):
            node = 0
            for b in self.labels[n]:
                key = (node, b)
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = n
        self.token_at = np.array(token_at, np.int32)
        inner = np.unique(np.array([k[0] for k in children], np.int64))
        self.row = np.zeros(len(token_at), np.int32)  # row 0 of `next` is empty
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.zeros((len(inner) + 1, 256), np.int32)
        for (node, b), child in children.items():
            self.next[self.row[node], b] = child

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words one after the other, and the number of each word's."""
        parts = [self._encode(words[k : k + BATCH_WORDS]) for k in range(0, len(words), BATCH_WORDS)]
        ids, sizes = zip(*parts, strict=True) if parts else ([np.empty(0, np.int32)], [np.empty(0, np.int32)])
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        end_of = np.repeat(first + size, size)
        start_of = np.repeat(first, size)
        at, node, step = np.arange(len(raw)), np.zeros(len(raw), np.int32), 0
        starts, ends, tokens = [], [], []
        while len(at):
            node = self.next[self.row[node], raw[at + step]]
            step += 1
            keep = node > 0
            at, node = at[keep], node[keep]
            token = self.token_at[node]
            hit = token >= 0
            starts.append(at[hit])
            ends.append(at[hit] + step)
            tokens.append(token[hit])
            keep = at + step < end_of[at]
            at, node = at[keep], node[keep]
        start, end, token = map(np.concatenate, (starts or [raw], ends or [raw], tokens or [raw]))
        # Prefixes by length: the state before each label is known when its turn comes.
        origin = start_of[start] if len(raw) else start
        order = np.argsort(end - origin, kind="stable")
        start, end, token, origin = start[order], end[order], token[order], origin[order]
        turns = np.searchsorted(end - origin, np.arange(1, int(size.max(initial=0)) + 2))
        state = np.full(len(raw) + 1, -1, np.int32)  # by the position of a prefix's last byte
        count = np.zeros(len(raw) + 1, np.int32)
        for lo, hi in zip(turns[:-1], turns[1:], strict=True):
            a, b, t = start[lo:hi], end[lo:hi] - 1, token[lo:hi]
            whole = a == origin[lo:hi]
            p = state[a - 1]
            pair, back = np.unique(p[~whole].astype(np.int64) << 20 | t[~whole], return_inverse=True)
            free = whole.copy()
            free[~whole] = ~self.blocked(pair >> 20, pair & 0xFFFFF)[back]
            state[b[free]] = t[free]
            count[b[free]] = np.where(whole, 0, count[a - 1])[free] + 1
        sizes = np.where(size > 0, count[first + size - 1], 0)
        out = np.empty(int(sizes.sum()), np.int32)
        slot = np.cumsum(sizes)
        at = (first + size - 1)[size > 0]
        slot, left = slot[size > 0], sizes[size > 0]
        while len(at):
            slot, left = slot - 1, left - 1
            out[slot] = state[at]
            at = at - self.length[state[at]]
            go = left > 0
            at, slot, left = at[go], slot[go], left[go]
        return out, sizes


class ByteRows:
    """Byte strings in one array, gathered by number."""

    def __init__(self, rows: list[bytes]) -> None:
        self.pool = Pool(np.uint8)
        self.pool.extend(np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, len(rows)))

    def joined(self, numbers: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Of consecutive runs of numbers, each run's strings joined."""
        flat, size = self.pool.gather(numbers)
        whole, ends = flat.tobytes(), np.cumsum(segment_sums(size, counts)).tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _pre_split(chunk: str) -> list[str]:
    if m := _PLAIN.fullmatch(chunk):
        return [m[1], m[2]] if m[2] else [chunk]
    return _WORDS.findall(chunk)


class Codec:
    """Encodes and decodes texts; remembers the chunks it has met."""

    def __init__(self, path: str) -> None:
        self.tables = AutomatonTables(path)
        self.added = re.compile("|".join(map(re.escape, sorted(self.tables.added, key=len, reverse=True))) or "(?!)")
        self.digits = ByteRows([b"%d," % n for n in range(len(self.tables.labels))])
        self.labels = ByteRows(self.tables.labels)
        self._forget()

    def _forget(self) -> None:
        self.slots, self.pool = Slots(), Pool(np.int32)
        self.decimal: list[bytes] = []
        self.decoded: list[bytes] = []

    def _chunks(self, text: str) -> list[str]:
        out, at = [], 0
        for m in chain(self.added.finditer(text), (None,)):
            part = text[at : m.start() if m else len(text)]
            out += (_WORDS if _WIDE_SPACE.search(part) else _CHUNKS).findall(part)
            if m:
                out.append(m[0])
                at = m.end()
        return out

    def _describe(self, chunks: list[str]) -> None:
        """Encode new chunks: their words, each distinct word once."""
        added = self.tables.added
        words = [[c] if c in added else _pre_split(c) for c in chunks]
        per_chunk = np.fromiter(map(len, words), np.int64, len(words))
        numbered = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        plain = [w for w in distinct if w not in added]
        ids, sizes = self.tables.encode([w.encode() for w in plain])
        pool = Pool(np.int32)
        if len(plain) == len(distinct):
            pool.extend(ids, sizes)
        else:
            each = dict(zip(plain, np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
            rows = [each.get(w, np.array([added.get(w, 0)], np.int32)) for w in distinct]
            pool.extend(np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows)))
        flat, size = pool.gather(numbered.indices.to_numpy())
        sizes = segment_sums(size, per_chunk)
        self.pool.extend(flat, sizes)
        self.decimal += self.digits.joined(flat, sizes)
        self.decoded += self.labels.joined(flat, sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every chunk, and the number of chunks of each text."""
        if len(self.slots) > MAX_CHUNKS:
            self._forget()
        chunks = [self._chunks(t) for t in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = pa.array(list(chain.from_iterable(chunks)), pa.string()).dictionary_encode()
        rows, new = self.slots.numbered(flat)
        if new:
            self._describe(new)
        return rows, counts

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        rows, counts = self.encode(texts)
        flat, size = self.pool.gather(rows)
        return np.split(flat, np.cumsum(segment_sums(size, counts))[:-1]) if texts else []

    def decode(self, ids) -> str:
        return b"".join([self.tables.labels[n] for n in ids]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file."""
    return worker_cache(("codec", path), lambda: Codec(path))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from text_slices(batch, most=SLICE)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in _slices(batches):
            rows, counts = c.encode([t or "" for t in batch.column("text").to_pylist()])
            n_tokens = segment_sums(c.pool.size[rows], counts)
            slots, at = rows.tolist(), 0
            ids, texts = [], []
            for n in counts.tolist():
                own = slots[at : at + n]
                at += n
                ids.append(hashlib.sha256(b"".join([c.decimal[k] for k in own])[:-1]).hexdigest())
                text = b"".join([c.decoded[k] for k in own]).decode("utf-8", "replace")
                texts.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in _slices(batches):
            ids = c.ids([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def codec_digest(docs: DataFrame, path: str) -> DataFrame:
    """Digests of every text's ids and of the text that they decode to."""
    return docs.select("doc_id", "text").mapInArrow(
        _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

"""Operator 13: secrets by base patterns and a linear-chain conditional random field.

Base spans are the leftmost non-overlapping matches of three patterns that are long
enough. Beside them a field tags every token of every text as begin, inside or outside of
a secret. Tokens are the maximal runs of bytes that are neither white space nor one of
the marks of `_GAPS`. A token's score for a tag is the sum of what its own shape, the
words before and after it, the gaps on both sides and the file as a whole weigh; moves
between tags weigh, too, and Viterbi picks the best tags of a text. Decoded segments that
overlap no base span are added as kind `secret`.

Decoding is exact without walking every token. A segment can only pay where a token's
score (with the best move into it) beats `outside`; from such a seed the best segment can't
reach beyond tokens whose scores add up to less than all that moves and a changed tag can
give back. Viterbi runs over these stretches, everything else is outside (`stretches`).

The weights are fitted by gradient steps on the likelihood of tags in at most
SAMPLE_SNIPPETS stretches of at most 2 * REACH characters: around base matches of all
documents, and at three places of SAMPLE_DOCS documents (the least by a hash of doc_id).
Gold are the values of base matches other than mere digits. Each example with a secret
comes twice, once with its key word and value exchanged for made-up ones, so that the
field learns the neighbourhood and the shape and not the patterns' own list of words.
Without examples nothing is added.

Defined results: null and empty texts have no spans; offsets count code points; each
repeated row is judged by itself; rows without doc_id are judged, too; an empty table
gives an empty table; other columns are ignored or, when masking, kept.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwspread.llm.common import Slots, text_slices, utf8, worker_cache

KINDS = ("assign", "access", "hex", "secret")
#: The patterns of the contract, and the least length of each (for the
#: first that of its value, group 2).
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Matches of `[0-9a-f]+` are maximal runs, so the least length can stand in the pattern.
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}
#: What a text with a base match must hold, for Spark's own regular expressions.
_HINT = "(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"

REACH = 160
SAMPLE_SNIPPETS = 800
SAMPLE_DOCS = 150
STEPS = 60
RATE = 0.3
SHRINK = 0.03
MAX_KNOWN = 300_000
#: Key words and alphabets of made-up examples.
KEY_WORDS = "password passwd pwd secret token api_key apikey access_key private_key auth_token client_secret credential bearer".split()
_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALL = _LOWER + _LOWER.upper() + _DIGITS
_ALPHABETS = (_ALL, _ALL + "+/", _ALL + "-_", _LOWER.upper() + _DIGITS, _LOWER + _DIGITS, _DIGITS + "ABCDEF", _DIGITS + "abcdef")
_KEY_BEFORE = re.compile(r"(password|passwd|secret|token|api_?key)(?=[\"'\x20:=]*\Z)", re.I | re.A)

B, I, O = 0, 1, 2  # noqa: E741
Span = tuple[int, int, int]  # start, kind, end

_GAPS = np.zeros(256, bool)
_GAPS[list(b" \t\n\v\f\r\"'`,;:=<>()[]{}|&*$%#!?^")] = True
_SIGN, _QUOTE, _LINE = (np.isin(np.arange(256), list(x)) for x in (b"=:", b"\"'`", b"\n\r"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_HEX_BYTE = np.isin(np.arange(256), list(b"0123456789abcdef"))
_KEY_PARTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_CODE = np.isin(np.arange(256), list(b"=:{}[]<>_/;"))
EDGE = 16  # gap code at the ends of a text


def base_matches(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[Span]:
    """Base spans by start, then kind, of the kinds that are looked for."""
    found: list[Span] = []
    if kinds[0]:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if kinds[1]:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if kinds[2]:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _kinds(texts: list[bytes], tokens: Tokens) -> list[tuple[bool, bool, bool]]:
    """Which patterns can match in each text: bytes that every match of one holds."""
    edge = np.flatnonzero(np.diff(_HEX_BYTE[tokens.data], prepend=False, append=False))
    long = edge[::2][edge[1::2] - edge[::2] >= 16]
    hexes = set((np.searchsorted(tokens.text_start, long, "right") - 1).tolist())
    out = []
    for k, raw in enumerate(texts):
        low = raw.lower()  # ASCII letters only
        out.append((any(w in low for w in _KEY_PARTS), b"AKIA" in raw, k in hexes))
    return out


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the values of base matches stand (the gold of the field)."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(a, b) for a, kind, b in base_matches(text) if kind and not text[a:b].isdigit()]
    return sorted(found)


def _charset(word: str) -> str:
    if not word.isascii():
        return "wide"
    if word.isdigit():
        return "digits"
    if re.fullmatch("[0-9a-f]+", word) and any(c.isdigit() for c in word):
        return "hex"
    if word.isalpha():
        return "lower" if word.islower() else "upper" if word.isupper() else "title" if word.istitle() else "letters"
    if re.fullmatch("[A-Za-z0-9]+", word):
        return "mixed"
    return "mail" if "@" in word else "marked"


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", word[:64]))))[:6]


def _signature(word: str) -> tuple:
    """What the features of a word itself depend on."""
    n = len(word)
    size = next((k for k in (3, 7, 11, 15, 23, 39) if n <= k), 99)
    if word.isascii() and word.isalpha() and word.islower():
        return "lower", size, 0, "a" if n >= 8 else "", 10 * len(set(word[:40])) // min(n, 40) if n >= 8 else 0
    sort = _charset(word)
    changes = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(word[:64], word[1:64]))
    told = n >= 8 and sort != "wide"
    return sort, size, min(changes, 8), _shape(word) if told else "", 10 * len(set(word[:40])) // min(n, 40) if told else 0


def own_features(word: str) -> list[str]:
    return _spelled(_signature(word))


def _spelled(signature: tuple) -> list[str]:
    sort, size, changes, shape, variety = signature
    out = [f"k {sort}", f"k {sort} {size}", f"size {size}", f"c {changes} {size}"]
    return out + [f"s {shape}", f"d {variety} {size}"] if shape else out


def near_features(side: str, word: str) -> list[str]:
    """Features that a word gives to the token after (`p`) or before (`n`) it."""
    bare = word.lower().strip(".-_/@~+")[:32]
    return [f"{side} {bare}", f"{side} tail {_PARTS.split(bare)[-1]}", f"{side} {_charset(word)}"]


_PARTS = re.compile("[_.-]")


class Tokens:
    """Tokens of texts (UTF-8), their gaps, and the file code of each text."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data, self.text_start = data, np.cumsum(sizes + 1) - sizes - 1
        inside = ~_GAPS[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        n = len(self.start)
        ends = np.cumsum(self.end - self.start)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        packed = data[inside].tobytes()
        self.words = pa.Array.from_buffers(
            pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed)]
        ).dictionary_encode()
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        first = np.ones(n + 1, bool)  # token i is the first of its text; n stands for the end
        first[1:n] = self.text[1:] != self.text[:-1]
        self.first = first
        gap = np.full(n + 1, EDGE, np.int64)
        between = np.flatnonzero(~first)
        for bit, table in ((1, _SIGN), (2, _QUOTE), (4, _LINE)):
            total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
            gap[between] += bit * (total[self.start[between]] > total[self.end[between - 1]])
        gap[between] += 8 * (self.start[between] - self.end[between - 1] == 1) - EDGE
        self.gap = gap
        self.file = self._files(sizes)

    def _files(self, sizes: np.ndarray) -> np.ndarray:
        """0..63 of each text: how many digits, code marks and line ends it has."""
        code = np.zeros(len(sizes), np.int64)
        for table, steps in ((_DIGIT, (0.005, 0.03, 0.15)), (_CODE, (0.002, 0.01, 0.05)), (_LINE, (0.002, 0.01, 0.03))):
            total = np.concatenate(([0], np.cumsum(table[self.data], dtype=np.int64)))
            count = total[self.text_start + sizes] - total[self.text_start]
            code = code * 4 + np.searchsorted(steps, count / np.maximum(sizes, 1))
        return code


class Field:
    """Weights of the field: `rows` by feature (begin, inside, outside) and moves."""

    def __init__(self, rows: dict[str, np.ndarray], moves: np.ndarray) -> None:
        self.rows, self.moves = rows, moves
        self.mark = hashlib.md5(b"".join(rows[f].tobytes() for f in sorted(rows)) + moves.tobytes()).hexdigest()
        self.spelled: dict[tuple, np.ndarray] = {}
        self.gap_left, self.gap_right = (self._table(s, 2 * EDGE) for s in ("gl", "gr"))
        self.file = self._table("f", 64)
        self.none = {s: self._sum([f"{s} none"]) for s in "pn"}

    def _table(self, name: str, n: int) -> np.ndarray:
        return np.array([self._sum([f"{name} {k}"]) for k in range(n)])

    def _sum(self, features: list[str]) -> np.ndarray:
        out = np.zeros(3)
        for f in features:
            if (row := self.rows.get(f)) is not None:
                out += row
        return out

    def word_scores(self, word: bytes) -> np.ndarray:
        """Scores of a word itself, for the token after it and for the one before it."""
        w = word.decode()
        mark = _signature(w)
        own = self.spelled.get(mark)
        if own is None:
            own = self.spelled[mark] = self._sum(_spelled(mark))
        return np.concatenate([own, self._sum(near_features("p", w)), self._sum(near_features("n", w))])

    def emissions(self, tokens: Tokens, file: np.ndarray | None = None) -> np.ndarray:
        known = worker_cache(("secret words", self.mark), lambda: [Slots(), np.empty((0, 9))])
        if len(known[0]) > MAX_KNOWN:
            known[:] = [Slots(), np.empty((0, 9))]
        at, new = known[0].numbered(tokens.words)
        if new:
            known[1] = np.concatenate((known[1], np.array([self.word_scores(w) for w in new])))
        scores = known[1][at]
        out = scores[:, :3] + self.gap_left[tokens.gap[:-1]] + self.gap_right[tokens.gap[1:]]
        out += self.file[(tokens.file if file is None else file)[tokens.text]]
        first = tokens.first
        out[1:] += np.where(first[1:-1, None], self.none["p"], scores[:-1, 3:6])
        out[:1] += self.none["p"]
        out[:-1] += np.where(first[1:-1, None], self.none["n"], scores[1:, 6:9])
        out[-1:] += self.none["n"]
        return out


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a stretch with `outside` (or the ends of the text) around it."""
    m = moves.tolist()
    best, back = [-np.inf, -np.inf, 0.0], []
    for row in scores.tolist():
        step, now = [], []
        for tag in (B, I, O):
            p = max((B, I, O), key=lambda q: best[q] + m[q][tag])
            step.append(p)
            now.append(best[p] + m[p][tag] + row[tag])
        back.append(step)
        best = now
    tag = max((B, I, O), key=lambda q: best[q] + m[q][O])
    tags = []
    for step in reversed(back):
        tags.append(tag)
        tag = step[tag]
    return tags[::-1]


def stretches(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """Token ranges outside of which every token of the best tagging is `outside`."""
    if not len(scores):
        return []
    free = moves[np.isfinite(moves)]
    room = float(free.max() - free.min())
    stay = moves[O, O]
    gain = scores[:, :2].max(axis=1) - scores[:, O] + max(moves[:, :2].max() - stay, 0.0)
    leave = max(moves[:2, O].max() - stay, 0.0)
    seeds = np.flatnonzero(gain > -leave)
    if not len(seeds):
        return []
    barrier = -(4 * room + max(0.0, float((scores[:, I] - scores[:, B]).max())) + leave)
    edges = np.flatnonzero(first)  # ends with the end of all texts
    out: list[list[int]] = []
    for s in seeds.tolist():
        text = bisect_right(edges, s)
        low, high, total = s, s + 1, 0.0
        if out and s < out[-1][1]:
            low = out[-1][0]
        while not (out and s < out[-1][1]) and low > edges[text - 1] and total >= barrier:
            low -= 1
            total += min(float(gain[low]), 0.0)
        total = 0.0
        while high < edges[text] and total >= barrier:
            total += min(float(gain[high]), 0.0)
            high += 1
        if out and low < out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def decode(tokens: Tokens, scores: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """First and last token of the segments of the best tagging."""
    segments = []
    for a, b in stretches(scores, tokens.first, moves):
        begin = None
        for k, tag in enumerate([*viterbi(scores[a:b], moves), O], a):
            if tag != I and begin is not None:
                segments.append((begin, k - 1))
                begin = None
            if tag == B:
                begin = k
    return segments


def find_secrets(texts: list[bytes], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of every text (UTF-8), in code points."""
    if not texts:
        return []
    tokens = Tokens(texts)
    base = [base_matches(t.decode(), kinds) if any(kinds) else [] for t, kinds in zip(texts, _kinds(texts, tokens), strict=True)]
    added: list[list[Span]] = [[] for _ in texts]
    if field is not None and len(tokens.start):
        for i, j in decode(tokens, field.emissions(tokens), field.moves):
            k = int(tokens.text[i])
            origin = int(tokens.text_start[k])
            a, b = int(tokens.start[i]) - origin, int(tokens.end[j]) - origin
            raw = texts[k]
            b = a + len(raw[a:b].rstrip(b".")) or b
            while raw[b : b + 1] == b"=":
                b += 1
            a, b = len(raw[:a].decode()), len(raw[:b].decode())
            if all(b <= x or a >= y for x, _, y in base[k]):
                added[k].append((a, 3, b))
    return list(zip(base, added, strict=True))


# Fitting.


def _snippets(ids: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            out: tuple[list, ...] = ([], [], [])
            raw = utf8(batch.column("text"))
            files = Tokens(raw).file if raw else ()
            for doc, text, file in zip(batch.column("doc_id").to_pylist(), raw, files, strict=True):
                text = text.decode()
                at = [(a + b) // 2 for a, b in secret_values(text)]
                if doc in ids:
                    at += [random.Random(f"{doc}:{k}").randrange(len(text) + 1) for k in range(3)]
                for k in at:
                    a, b = max(0, k - REACH), k + REACH
                    a = a and text.find(" ", a, k) + 1 or a  # cut between words where there are some
                    cut = text.rfind(" ", k, b) if b < len(text) else -1
                    out[0].append(f"{hashlib.md5(f'{doc}:{k}'.encode()).hexdigest()}")
                    out[1].append(text[a : cut if cut > k else b])
                    out[2].append(int(file))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["mark", "snippet", "file"])

    return run


def sample_snippets(docs: DataFrame) -> list[tuple[str, int]]:
    """At most SAMPLE_SNIPPETS stretches of text, with the code of their file."""
    own = docs.select("doc_id", "text")
    least = own.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    ids = [r[0] for r in least.collect()]
    hinted = F.col("text").rlike(_HINT)
    chosen = own.where(hinted | F.col("doc_id").isin(ids) if ids else hinted)
    found = chosen.mapInArrow(_snippets(frozenset(ids)), "mark string, snippet string, file long")
    rows = found.orderBy("mark", "snippet").limit(SAMPLE_SNIPPETS).collect()
    return [(r["snippet"], r["file"]) for r in rows]


def _made_up(text: str, values: list[tuple[int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with other key words and values, and where the values stand now."""
    out, found, done = "", [], 0
    for a, b in values:
        if a < done:
            continue
        chars = rng.choice(_ALPHABETS)
        value = "".join(rng.choice(chars) for _ in range(rng.choice((14, 20, 24, 32, 40))))
        out += _KEY_BEFORE.sub(rng.choice(KEY_WORDS), text[done:a])
        found.append((len(out), len(out) + len(value)))
        out, done = out + value, b
    return out + text[done:], found


def _tags(text: str, values: list[tuple[int, int]], tokens: Tokens) -> np.ndarray:
    raw = text.encode()
    place = np.cumsum([(c & 0xC0) != 0x80 for c in raw]) - 1 if raw else np.empty(0, np.int64)
    tags = np.full(len(tokens.start), O)
    starts = place[tokens.start] if len(tokens.start) else place
    for a, b in values:
        held = np.flatnonzero((starts >= a) & (starts < b))
        tags[held] = I
        tags[held[:1]] = B
    return tags


def _features(tokens: Tokens, file: int) -> list[list[str]]:
    words = [w.decode() for w in tokens.words.to_pylist()]
    out = []
    for k, w in enumerate(words):
        left = near_features("p", words[k - 1]) if k else ["p none"]
        right = near_features("n", words[k + 1]) if k + 1 < len(words) else ["n none"]
        out.append([*own_features(w), *left, *right, f"gl {tokens.gap[k]}", f"gr {tokens.gap[k + 1]}", f"f {file}"])
    return out


def fit_field(snippets: list[tuple[str, int]]) -> Field | None:
    """Weights by full gradient steps (scaled by their past squares) on the likelihood."""
    rng, examples = random.Random(13), []
    for text, file in snippets:
        values = secret_values(text)
        for own, where in [(text, values), *([_made_up(text, values, rng)] if values else [])]:
            tokens = Tokens([own.encode()])
            if len(tokens.start):
                examples.append((_features(tokens, file), _tags(own, where, tokens)))
    if not any((tags != O).any() for _, tags in examples):
        return None
    often = Counter(f for rows, _ in examples for row in rows for f in row)
    names = {f: k for k, f in enumerate(sorted(f for f, n in often.items() if n > 1), 1)}
    most = max(len(f) for rows, _ in examples for f in rows)
    longest = max(len(tags) for _, tags in examples)
    n = len(examples)
    at = np.zeros((n, longest, most), np.int32)  # 0: no feature
    gold = np.zeros((n, longest, 3))
    live = np.zeros((n, longest), bool)
    for e, (rows, tags) in enumerate(examples):
        live[e, : len(tags)] = True
        gold[e, np.arange(len(tags)), tags] = 1
        for t, row in enumerate(rows):
            at[e, t, : len(row)] = [names.get(f, 0) for f in row]
    weights, moves = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    past_w, past_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    barred = np.zeros((3, 3))
    barred[O, I] = -1e9
    before = np.concatenate([np.zeros((n, 1, 3)), gold[:, :-1]], axis=1)
    before[:, 0, O] = 1
    seen = np.einsum("ntp,ntq->pq", before * live[:, :, None], gold)
    flat = at.reshape(-1)
    for _ in range(STEPS):
        emit = weights[at].sum(axis=2)
        share, pairs = _expected(emit, moves + barred, live)
        miss = (gold - share) * live[:, :, None]
        grad = np.stack([np.bincount(flat, np.repeat(miss[:, :, q].reshape(-1), most), len(weights)) for q in range(3)], axis=1)
        grad = grad - SHRINK * weights
        grad[0] = 0
        past_w += grad**2
        weights += RATE * grad / np.sqrt(past_w)
        step = seen - pairs - SHRINK * moves
        past_m += step**2
        moves = moves + RATE * step / np.sqrt(past_m)
    moves[O, I] = -np.inf
    return Field({f: weights[k] for f, k in names.items()}, moves)


def _expected(emit: np.ndarray, moves: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags of every token, and expected moves, of all examples together."""
    n, longest, _ = emit.shape
    forward, backward = np.zeros((longest, n, 3)), np.zeros((longest, n, 3))
    state = np.full((n, 3), -1e9)
    state[:, O] = 0
    start = state
    for t in range(longest):
        step = np.logaddexp.reduce(state[:, :, None] + moves, axis=1) + emit[:, t]
        state = np.where(live[:, t, None], step, state)
        forward[t] = state
    total = np.logaddexp.reduce(state, axis=1)
    state = np.zeros((n, 3))
    pairs = np.zeros((3, 3))
    for t in range(longest - 1, -1, -1):
        backward[t] = state
        ahead = emit[:, t] + state
        left = forward[t - 1] if t else start
        share = np.exp(left[:, :, None] + moves + ahead[:, None, :] - total[:, None, None])
        pairs += (share * live[:, t, None, None]).sum(axis=0)
        step = np.logaddexp.reduce(moves + ahead[:, None, :], axis=2)
        state = np.where(live[:, t, None], step, state)
    share = np.exp(forward + backward - total[None, :, None]).transpose(1, 0, 2)
    return share, pairs


# Over tables.


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and hash of the base spans, and all spans, of every document."""
    docs = docs.select("doc_id", "text")
    field = fit_field(sample_snippets(docs))
    names = [c.split()[0] for c in DIGEST.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            found = find_secrets(utf8(batch.column("text")), field)
            counts = [Counter(k for _, k, _ in base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)],
                    pa.array([hashlib.sha256(span_text(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([span_text(base + added) for base, added in found], pa.string()),
                ],
                schema=schema,
            )

    return docs.mapInArrow(run, DIGEST)


def mask(text: str, spans: list[Span]) -> str:
    """Replace each maximal stretch of spans by <secret>."""
    out, done = [], 0
    for a, _, b in sorted(spans):
        if a >= done:
            out += [text[done:a], "<secret>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The same rows with all secrets of `text` replaced; other columns are kept."""
    field = fit_field(sample_snippets(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            texts = batch.column("text").to_pylist()
            found = find_secrets([(t or "").encode() for t in texts], field)
            clean = [t if t is None else mask(t, base + added) for t, (base, added) in zip(texts, found, strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)

"""Operator 7: quality of a document by random-indexing word vectors and a small network.

Every word gives two symbols: its bucket (hash of the word, A-Z lower-cased) and its
shape (letters, digits and other characters run by run, with a mark if the word repeats
the one before). Random indexing gives each symbol a sparse +-1 index vector; the vector
of a symbol is its own plus the sum of the index vectors of the symbols around it in all
documents, scaled to length one. These sums are whole numbers, added up per task, then per
symbol (`context_sums`); one row per symbol reaches the driver, whatever the input. A
document is the mean of the vectors of its shapes beside the mean of those of its words. A
two-layer network (tanh, then logistic) gives the score; its temperature is fitted on
training rows that it has not seen.

Network and temperature are fitted on the driver from at most MAX_TRAIN labelled documents of at most MAX_TRAIN_CHARS characters each: the least by a hash of doc_id, so
the choice does not depend on partitions, and no row that is held out (crc32 of the
doc_id as text, modulo 5, is 0). Everything else covers all rows and whole texts. As the
first layer is linear in the mean, scoring adds up rows of one table (symbol x hidden).

Defined results: null and empty texts have the zero vector and get the network's score
of it; labels with a null quality are ignored, contradicting ones count as they come;
without training rows of both labels every score is 0.5; equal texts get equal scores;
an empty table gives an empty table. Other columns pass only where asked for.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwspread.llm.common import Slots, split_words, text_slices

MAX_TRAIN = 4_000
MAX_TRAIN_CHARS = 50_000
DIM = 48
HIDDEN = 16
#: Rows of the symbol table: shapes, then words.
SHAPES, WORDS = 1 << 12, 1 << 14
NONZERO = 6
AROUND = 2
CHUNK = 100_000
EPOCHS = 120
SEED = 20240501
REJECT_BELOW = 0.3
MAX_KNOWN = 400_000

_CLASSES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 5, is 0 (a null doc_id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _symbol_rows(word: str) -> tuple[int, int, int]:
    raw = word.encode()
    shape = _RUN.sub(rb"\1", raw.translate(_CLASSES))
    return (
        zlib.crc32(shape) % SHAPES,
        zlib.crc32(shape + b"=") % SHAPES,
        SHAPES + zlib.crc32(raw.lower()) % WORDS,
    )


class Symbols:
    """Rows of the symbol table for the words of texts; a worker keeps words it has met."""

    def __init__(self) -> None:
        self.slots, self.rows = Slots(), np.empty((0, 3), np.int32)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shape row and word row of each word, and the number of words of each text."""
        if len(self.slots) > MAX_KNOWN:
            self.__init__()
        words, counts = split_words(texts)
        at, new = self.slots.numbered(words)
        if new:
            self.rows = np.concatenate((self.rows, np.array([_symbol_rows(w) for w in new], np.int32)))
        same = np.zeros(len(at), bool)
        same[1:] = at[1:] == at[:-1]
        starts = np.cumsum(counts) - counts
        same[starts[counts > 0]] = False
        rows = self.rows[at]
        return np.where(same, rows[:, 1], rows[:, 0]), rows[:, 2], counts


def index_vectors(rng: np.random.Generator) -> np.ndarray:
    table = np.zeros((SHAPES + WORDS, DIM), np.float32)
    at = rng.random((len(table), DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    signs = rng.choice(np.array([-1, 1], np.float32), at.shape)
    np.put_along_axis(table, at, signs, axis=1)
    return table


def add_contexts(total: np.ndarray, shape: np.ndarray, word: np.ndarray, counts: np.ndarray, index: np.ndarray) -> None:
    """Add to each symbol's row the index vectors of the symbols within AROUND words of its
    occurrences. The last row of `index` is zero and stands between texts. Words are taken
    CHUNK at a time, so memory does not follow the length of a text."""
    gap = len(index) - 1
    place = np.arange(len(shape)) + AROUND * (np.repeat(np.arange(len(counts)), counts) + 1)
    size = len(shape) + AROUND * (len(counts) + 1)
    padded = []
    for rows in (shape, word):
        line = np.full(size, gap, np.uint16)
        line[place] = rows
        padded.append(line)
    for lo in range(AROUND, size - AROUND, CHUNK):
        hi = min(lo + CHUNK, size - AROUND)
        own = sum(index[line[lo - AROUND : hi + AROUND]] for line in padded)
        near = sum(own[AROUND + step : AROUND + step + hi - lo] for step in range(-AROUND, AROUND + 1) if step)
        for line in padded:
            rows = line[lo:hi]
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            total[rows[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int32)


SUMS = "symbol int, sums binary"


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors(np.random.default_rng(SEED)).astype(np.int8)
    index = np.vstack((index, np.zeros((1, DIM), np.int8)))
    total, symbols = np.zeros(index.shape, np.int64), Symbols()
    for batch in chain.from_iterable(map(text_slices, batches)):
        add_contexts(total, *symbols.of(batch.column("text")), index)
    yield _sum_rows(total[:-1])


def _sum_rows(total: np.ndarray) -> pa.RecordBatch:
    met = np.flatnonzero(total.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([r.tobytes() for r in total[met]], pa.binary())], ["symbol", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((SHAPES + WORDS, DIM), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4_096):
            part = batch.slice(at, 4_096)
            sums = np.frombuffer(b"".join(part.column("sums").to_pylist()), np.int64).reshape(-1, DIM)
            np.add.at(total, part.column("symbol").to_numpy(), sums)
    yield _sum_rows(total)


def context_sums(docs: DataFrame) -> np.ndarray:
    """Per symbol the sum of the index vectors around it in all texts. A task sends at most
    one row per symbol, and a symbol's rows are added up as they come."""
    parts = docs.select("text").mapInArrow(_context_rows, SUMS)
    table = parts.repartition("symbol").mapInArrow(_add_up, SUMS).toArrow()  # a row per symbol
    total = np.zeros((SHAPES + WORDS, DIM), np.int64)
    if table.num_rows:
        total[table.column("symbol").to_numpy()] = np.frombuffer(b"".join(table.column("sums").to_pylist()), np.int64).reshape(-1, DIM)
    return total


def symbol_vectors(sums: np.ndarray) -> np.ndarray:
    """Index vectors plus those of the neighbours, scaled to one."""
    total = index_vectors(np.random.default_rng(SEED)) + sums
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def _pool(table: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over each text (no words: zero)."""
    out = np.zeros((len(counts), table.shape[1]))
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):  # whole texts, about CHUNK words at a time
        base = ends[at] - counts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        some = np.flatnonzero(counts[at:to] > 0) + at
        if len(some):
            starts = (ends - counts)[some] - base
            out[some] = np.add.reduceat(table[rows[base : ends[to - 1]]], starts, axis=0) / counts[some, None]
        at = to
    return out


def _forward(z: np.ndarray, net: dict) -> np.ndarray:
    return np.tanh(z + net["b1"]) @ net["w2"] + net["b2"]


def fit_network(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict:
    """Two layers by Adam on class-balanced cross entropy; the last fifth sets the
    temperature."""
    cut = max(1, len(y) // 5)
    fit_x, fit_y, cal_x, cal_y = x[cut:], y[cut:], x[:cut], y[:cut]
    net = {
        "w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 0.3, HIDDEN),
        "b2": np.zeros(()),
    }
    if not 0 < fit_y.sum() < len(fit_y):
        return {k: np.zeros_like(v) for k, v in net.items()} | {"t": 1.0}
    m, v = ({k: np.zeros_like(p) for k, p in net.items()} for _ in range(2))
    weight = np.where(fit_y > 0, 0.5 / fit_y.mean(), 0.5 / (1 - fit_y.mean()))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit_y))
        for at in np.array_split(order, max(1, len(order) // 256)):
            step += 1
            hidden = np.tanh(fit_x[at] @ net["w1"] + net["b1"])
            error = (1 / (1 + np.exp(-(hidden @ net["w2"] + net["b2"]))) - fit_y[at]) * weight[at] / len(at)
            back = np.outer(error, net["w2"]) * (1 - hidden**2)
            grads = {"w1": fit_x[at].T @ back, "b1": back.sum(0), "w2": hidden.T @ error, "b2": error.sum()}
            for k, g in grads.items():
                g = g + 1e-4 * net[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net[k] = net[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logits = _forward(cal_x @ net["w1"], net)
    loss = lambda t: np.mean(np.logaddexp(0, np.where(cal_y > 0, -1, 1) * logits / t))
    return net | {"t": float(min(np.geomspace(0.5, 8, 33), key=loss))}


def fit_quality(texts: pa.Array, quality: np.ndarray, sums: np.ndarray) -> dict:
    """Model of labelled texts: `table` (symbol x hidden), layers and temperature; `sums`
    are those of the corpus."""
    rng = np.random.default_rng(SEED)
    shape, word, counts = Symbols().of(texts)
    vectors = symbol_vectors(sums)
    x = np.hstack((_pool(vectors, shape, counts), _pool(vectors, word, counts)))
    net = fit_network(x, quality.astype(float), rng)
    table = np.vstack((vectors[:SHAPES] @ net["w1"][:DIM], vectors[SHAPES:] @ net["w1"][DIM:]))
    return net | {"table": table.astype(np.float32)}


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> pa.Table:
    """text, quality of the training sample, in the order of a hash of doc_id."""
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", "quality")
    chosen = known.orderBy(order, "doc_id", "quality").limit(most)
    rows = docs.select("doc_id", "text").where(F.length("text") <= MAX_TRAIN_CHARS)
    # `chosen` has at most `most` rows of two numbers.
    picked = rows.join(F.broadcast(chosen), "doc_id")
    return picked.orderBy(order, "doc_id", "quality", "text").limit(most).select("text", "quality").toArrow()


def score_quality(docs: DataFrame, labels: DataFrame, out: str = "score") -> DataFrame:
    """`docs` (at least doc_id, text) with a column `out`, the score."""
    sample = training_rows(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(
        fit_quality(sample.column("text").combine_chunks(), sample.column("quality").to_numpy(), context_sums(docs))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, symbols = model.value, Symbols()
        for batch in chain.from_iterable(map(text_slices, batches)):
            shape, word, counts = symbols.of(batch.column("text"))
            z = _pool(net["table"], shape, counts) + _pool(net["table"], word, counts)
            logits = _forward(z, net) / net["t"]
            yield batch.append_column(out, pa.array(1 / (1 + np.exp(-logits)), pa.float64()))

    if out in docs.columns:
        raise ValueError(f"docs has a column {out!r}; name another one for the score")
    return docs.mapInArrow(score, docs.withColumn(out, F.lit(0.0)).schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", "text"), labels)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"),
    )

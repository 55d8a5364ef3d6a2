"""Operator 8: best-fit decreasing packing of documents into fixed windows.

1. Each document is encoded whole and given its end id. Documents longer than a window
   are first cut into full windows; the rest of a document is one piece. Only the
   description of a piece (document, start, length, checksum of its ids) goes on, so no
   text and no ids are shuffled.
2. Pieces are dealt into groups of about `group_pieces` by a hash of (doc_id, start) and
   each group is packed by best-fit decreasing: pieces in falling length go to the open
   window with the least room that still holds them. A segment tree over the remaining
   capacities 0..window finds that capacity in O(log window).

A group holds thousands of windows and leaves about one of them partly filled, so the
padding does not depend on how many groups there are. A window whose fill is a power of
two needs no padding; others are padded to `window`.

Defined results: a null or empty text is a piece of the end id alone; documents that
repeat a doc_id are packed as separate documents; an empty table gives no pieces; other
columns are ignored. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwspread.llm.common import materialise, text_slices
from kwspread.llm.word_tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
GROUP_PIECES = 8_000
#: Room for the windows of one group in a sequence id.
SEQUENCES_PER_GROUP = 1 << 32


def _cut(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in chain.from_iterable(map(text_slices, batches)):
            flat, size = enc.encode(batch.column("text"))
            ids = np.insert(flat, np.cumsum(size), end_id).astype("<u4")
            size = size + 1
            at = np.cumsum(size) - size
            pieces = -(-size // window)
            doc = np.repeat(np.arange(len(size)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, size[doc] - start)
            first = at[doc] + start
            sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(size[doc], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


class CapacityTree:
    """Segment tree over capacities 0..window: a node is true if an open window below it
    has that much room. `tightest(n)` is the least capacity >= n in use, or -1."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.used = bytearray(2 * self.size)

    def set(self, capacity: int, used: bool) -> None:
        tree, node = self.used, capacity + self.size
        tree[node] = used
        node >>= 1
        while node:
            now = tree[2 * node] | tree[2 * node + 1]
            if tree[node] == now:
                return
            tree[node] = now
            node >>= 1

    def tightest(self, length: int) -> int:
        tree, node = self.used, length + self.size
        while not tree[node]:  # up to the first subtree on the right that is in use
            while node & 1:
                node >>= 1
                if node <= 1:
                    return -1
            node += 1
            if not tree[node]:
                continue
        while node < self.size:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece (lengths 1..window)."""
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    tree, open_at = CapacityTree(window), [[] for _ in range(window + 1)]
    count = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        room = tree.tightest(n)
        if room < 0:
            at, room = count, window
            count += 1
        else:
            at = open_at[room].pop()
            if not open_at[room]:
                tree.set(room, False)
        sequence[k], offset[k] = at, window - room
        if left := room - n:
            if not open_at[left]:
                tree.set(left, True)
            open_at[left].append(at)
    return sequence, offset


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int, end_id: int) -> DataFrame:
    """Pieces of at most `window` tokens: doc_id, start, length, ids_crc32, doc_tokens."""
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer_path, window, end_id), PIECES)


def pack_pieces(pieces: DataFrame, window: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces (a materialised table: it is counted first)."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        sequence, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.drop(columns="pack_group").assign(
            sequence_id=int(key[0]) * SEQUENCES_PER_GROUP + sequence, offset=offset
        )

    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).alias("pack_group")
    return pieces.select("*", spread).groupBy("pack_group").applyInPandas(pack, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    return pack_pieces(materialise(cut_documents(docs, tokenizer_path, window, end_id), "pieces"), window)

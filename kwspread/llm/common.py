"""Helpers shared by the operators: scratch tables, the word rule, per-worker caches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwspread.operators.batches import give_back, text_slices  # noqa: F401 (operators take both from here)
from kwspread.session import ensure_checkpoint_dir

#: Fixed value: a word is a maximal run of characters other than space and \t..\r.
#: `bytes.split()` cuts UTF-8 at exactly these ASCII characters.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that what is computed
    once is read by several branches and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def native_words(col: str = "text") -> Column:
    """The words of a text as an array, JVM-side (null: empty array)."""
    return F.filter(F.split(text_or_empty(col), WORD_GAP), lambda w: w != "")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+lens[0]-1, starts[1].. one after the other."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    return shift + np.arange(total)


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts one after the other, dictionary encoded, and the number of
    words of each text (null: none)."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    words = lists.flatten()
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if blank.any():  # at the ends of a text only
        counts -= segment_sums(blank, counts)
        words = words.filter(pa.array(~blank))
    return words.dictionary_encode(), counts


class Slots(dict):
    """Numbers distinct words in order of first sight."""

    def numbered(self, words: pa.DictionaryArray) -> tuple[np.ndarray, list[str]]:
        """The number of each word, and the words that are new."""
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self]
        self.update(zip(new, range(len(self), len(self) + len(new))))
        slots = np.fromiter(map(self.__getitem__, distinct), np.int32, len(distinct))
        return slots[words.indices.to_numpy()], new


_WORKER_CACHE: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps between tasks. Only the operator that ran last keeps
    its memory, so stages that follow one another in a worker don't add up."""
    if key not in _WORKER_CACHE:
        _WORKER_CACHE.clear()
        give_back()
        _WORKER_CACHE[key] = make()
    return _WORKER_CACHE[key]


class Pool:
    """Growing ragged table: row k holds values[start[k] : start[k] + size[k]]."""

    def __init__(self, dtype) -> None:
        self.values = np.empty(1 << 16, dtype)
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int32)
        self.rows = self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate((a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)))

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        rows, used = self.rows + len(sizes), self.used + len(values)
        self.values = self._room(self.values, used)
        self.start, self.size = self._room(self.start, rows), self._room(self.size, rows)
        self.values[self.used : used] = values
        self.size[self.rows : rows] = sizes
        self.start[self.rows : rows] = self.used + np.cumsum(sizes) - sizes
        self.rows, self.used = rows, used

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated values of the rows, and the size of each."""
        size = self.size[rows]
        return self.values[ragged(self.start[rows], size)], size


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of the given (possibly zero) lengths."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]

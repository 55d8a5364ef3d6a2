"""Work on rows in a stated order without gathering a key into one task.

Tables are dealt by ranges of (key, order), so a key with any number of rows is spread
over as many partitions as it needs. What a partition needs to know of the ones before
it is one row each (`carried`), as only its first key can have begun earlier: that many
rows go through the driver, never more than partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kwspread.llm.common import materialise

#: Joined items that travel as one row.
CHUNK_BYTES = 1 << 20


def in_ranges(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows sorted by the columns, dealt over partitions by ranges of them."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def part() -> int:
    """Number of this task's partition; ranges grow with it."""
    return TaskContext.get().partitionId()


def carried(table: DataFrame, key: str, values: list[str], fold=np.add) -> dict[int, tuple]:
    """For each part whose first key began in an earlier part: that key and what the
    earlier parts of it give in `values`, running folds by key within a part.

    `table` has the columns part, key, at (grows along a part's key) and the values."""
    last = F.max(F.struct(key, "at", *values)).alias("last")
    told = table.groupBy("part").agg(F.min(F.struct(key)).alias("first"), last).orderBy("part").collect()
    out: dict[int, tuple] = {}
    open_key, total = object(), None
    for r in told:
        first, end = r["first"][0], r["last"]
        before = total if first == open_key else None
        if before is not None:
            out[r["part"]] = (first, before)
        total = np.array(end[2:], np.int64)
        if before is not None and end[0] == first:
            total = fold(total, before)
        open_key = end[0]
    return out


def with_carried(table: DataFrame, key: str, values: list[str], fold=np.add) -> DataFrame:
    """The table with `values` folded over all parts (key, part and values are longs)."""
    before = carried(table, key, values, fold)
    if not before:
        return table
    names = [f"{v}_before" for v in values]
    rows = [(p, k, *map(int, v)) for p, (k, v) in before.items()]
    spark = table.sparkSession
    told = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["part", key, *names]))
    joined = table.join(F.broadcast(told), ["part", key], "left")  # a row per partition at most
    whole = [
        (F.col(v).bitwiseXOR(F.coalesce(b, F.lit(0))) if fold is np.bitwise_xor else F.col(v) + F.coalesce(b, F.lit(0))).alias(v)
        for v, b in zip(values, names, strict=True)
    ]
    return joined.select(*[whole[values.index(c)] if c in values else c for c in table.columns])


def _running(columns: list[str], key: str, values: list[str], fold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now, total, at = part(), object(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            own = [batch.column(v).to_numpy() for v in values]
            heads = np.flatnonzero(np.diff(keys)) + 1
            sums = [np.empty(len(keys), np.int64) for _ in values]
            places = np.empty(len(keys), np.int64)
            for a, b in zip([0, *heads.tolist()], [*heads.tolist(), len(keys)], strict=True):
                if keys[a] != now:
                    now, total, at = keys[a], None, 0
                for x, s in zip(own, sums, strict=True):
                    s[a:b] = fold.accumulate(x[a:b])
                if total is not None:
                    for t, s in zip(total, sums, strict=True):
                        s[a:b] = fold(s[a:b], t)
                total = [s[b - 1] for s in sums]
                places[a:b] = at + np.arange(1, b - a + 1)
                at += b - a
            added = [pa.array(np.full(len(keys), here)), pa.array(places), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], [*columns, "part", "at", *(f"all_{v}" for v in values)])

    return run


def running(df: DataFrame, key: str, order: list[str], values: list[str], fold=np.add) -> DataFrame:
    """The rows with all_<value>: the fold of the key's values (longs) up to the row."""
    columns = df.columns
    more = [T.StructField(c, T.LongType()) for c in ("part", "at", *(f"all_{v}" for v in values))]
    told = in_ranges(df, [key, *order]).mapInArrow(_running(columns, key, values, fold), T.StructType([*df.schema.fields, *more]))
    told = materialise(told, "running")
    return with_carried(told, key, [f"all_{v}" for v in values], fold).drop("part", "at")


def _joined(separator: bytes, kind: pa.DataType):
    """Digests of the keys that lie within a partition, joined chunks of its two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, k = part(), 0
        now, met, held, size, cut = None, 0, [], 0, False

        def row(sha: str | None, chunk: bytes | None) -> tuple:
            nonlocal k
            k += 1
            return now, here, k, sha, chunk

        for batch in batches:
            out = []
            names, items = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for name, item in zip(names, items, strict=True):
                if not met or name != now:
                    if held:
                        whole = separator.join(held)
                        # The first key of a partition may have begun in an earlier one.
                        open_start = met == 1 or cut
                        out.append(row(None, whole) if open_start else row(hashlib.sha256(whole).hexdigest(), None))
                    now, met, held, size, cut = name, met + 1, [], 0, False
                held.append(item)
                size += len(item) + len(separator)
                if size > CHUNK_BYTES:
                    out.append(row(None, separator.join(held)))
                    held, size, cut = [], 0, True
            yield _table(out, kind)
        if held:
            yield _table([row(None, separator.join(held))], kind)

    return run


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "part", "k", "sha256", "chunk"])


def _hash_chunks(separator: bytes, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for key, chunk in zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(chunk)
                else:
                    digest.update(separator)
                    digest.update(chunk)
            yield _pairs(out, kind)
        if digest is not None:
            yield _pairs([(now, digest.hexdigest())], kind)

    return run


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string()), strict=True)], ["key", "sha256"])


def joined_sha256(df: DataFrame, key: str, order: list[str], item: str, separator: str) -> DataFrame:
    """key (long or string), sha256 of the key's items (strings) joined in order.

    Keys within a range partition are hashed there. The first and last key of a partition
    may go on in others: their items travel joined, in chunks, and are hashed in order by
    one task per key that holds one chunk at a time (a SHA-256 is sequential)."""
    gap = separator.encode()
    ddl, kind = ("string", pa.string()) if isinstance(df.schema[key].dataType, T.StringType) else ("long", pa.int64())
    rows = in_ranges(df.select(F.col(key).alias("key"), item, *order), ["key", *order]).select("key", item)
    told = rows.mapInArrow(_joined(gap, kind), f"key {ddl}, part long, k long, sha256 string, chunk binary")
    told = materialise(told, "digests")
    open_ends = told.where("chunk IS NOT NULL").select("key", "part", "k", "chunk")
    ends = open_ends.repartition("key").sortWithinPartitions("key", "part", "k").mapInArrow(_hash_chunks(gap, kind), f"key {ddl}, sha256 string")
    return told.where("sha256 IS NOT NULL").select("key", "sha256").union(ends)

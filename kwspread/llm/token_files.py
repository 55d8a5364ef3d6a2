"""Operator 10: token ids as Parquet list columns, read back selectively.

`write_token_files` lays documents out in ascending doc_id order over files: a range
exchange on doc_id deals the texts, each task encodes its range and writes it through
Spark's Parquet writer with

- `ids`: list<int>, dictionary encoded by pages (`ids="dictionary"`) or, with
  `ids="delta"`, DELTA_BINARY_PACKED by the version 2 writer;
- `doc_id`, `part`, `local_start`, `n_tokens`: metadata columns with their own
  encoding, so that a reader of metadata touches no ids;
- row groups and pages of stated sizes, with column and offset indexes (written by
  default), so that a filter on doc_id reads only the pages it needs.

`local_start` counts the ids before a document in its own file; `read_token_files` adds
the totals of the files before it (one row per file, so the broadcast is bounded by the
number of files, not of documents).

Defined results: a null text has no ids but the end id; an empty table gives an empty
table; documents that repeat a doc_id follow one another ordered by their text; a null
doc_id comes first. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kwspread.llm.common import scratch_path, text_slices
from kwspread.llm.word_tokens import encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10


def _encode_sorted(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in chain.from_iterable(map(text_slices, batches)):
            flat, size = enc.encode(batch.column("text"))
            ends = np.cumsum(size)
            ids = np.insert(flat, ends, end_id).astype(np.int32)
            size = size + 1
            ends = np.cumsum(size)
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.full(len(size), part), pa.int32()),
                    pa.array(before + ends - size, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids)),
                ],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            before += int(size.sum())

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    ids: str = "dictionary",
    partitions: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode `docs` (doc_id, text) and write the token files below `path`."""
    if ids not in ("dictionary", "delta"):
        raise ValueError("ids must be 'dictionary' or 'delta'")
    docs = docs.select("doc_id", "text")
    dealt = docs.repartitionByRange(partitions, "doc_id") if partitions else docs.repartitionByRange("doc_id")
    rows = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(_encode_sorted(tokenizer_path, end_id), SCHEMA)
    (
        rows.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#ids.list.element", str(ids == "dictionary").lower())
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .parquet(path)
    )


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: `start` counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per file: the running total needs one ordered task over that many rows.
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(rows: DataFrame) -> DataFrame:
    """Replace the ids by their checksum (unsigned crc32 over little-endian 32-bit ids)."""
    return rows.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_digest(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_digest(read_token_files(spark, path))

"""Edge I/O: landed CSV in, Parquet between stages, CSV/partitioned dumps out
(S1-S5, S7, S13-S17).

CSV is read with an explicit all-string schema (no inference), header, RFC-4180
quoting with embedded newlines, BOM-tolerant header. Files are grouped by their own
header, each group is read on its own, and the groups are united **by name**: a single
multi-file CSV read maps columns by position and would corrupt rows.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import re
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kwspread.sources import folders
from kwspread.sources.adapters import union_by_name_conformed

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "mode": "PERMISSIVE",
}


def string_schema(cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


#: A header is looked for in this much of a file's start, more if its first record is longer.
HEADER_BYTES = 1 << 16
#: Files whose headers are read at a time.
HEADER_THREADS = 16


@dataclass(frozen=True)
class CsvFile:
    """A listed file: its full path, size, header (None: none found) and why there is none."""

    path: str
    bytes: int
    header: tuple[str, ...] | None
    reason: str | None


def list_csv(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """Full path and size of the .csv files below folders, files or globs (`**` stands for
    any folders), sorted by path. The listing reads no contents."""
    jvm, found = spark.sparkContext._jvm, {}
    for path in paths:
        base, deep, rest = path.partition("**")
        pattern = rest.rsplit("/", 1)[-1] if deep else "*"
        where = jvm.org.apache.hadoop.fs.Path(base.rstrip("/") or "/" if deep else path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        roots = [fs.getFileStatus(where)] if fs.exists(where) else list(fs.globStatus(where) or [])
        for root in roots:
            files = fs.listFiles(root.getPath(), True)
            while files.hasNext():
                f = files.next()
                name = f.getPath().getName()
                inner = f.getPath().toString()[len(root.getPath().toString()) :]
                hidden = any(part[:1] in ("_", ".") for part in inner.split("/"))
                if name.lower().endswith(".csv") and fnmatch.fnmatch(name, pattern or "*") and not hidden:
                    found[f.getPath().toString()] = f.getLen()
    return sorted(found.items())


def _first_record(spark: SparkSession, path: str, size: int) -> list[str] | None:
    """Cells of the first CSV record, from the start of the file only."""
    most = HEADER_BYTES
    while True:
        data = folders.read_bytes(spark, path, most)
        whole = len(data) < most or len(data) >= size
        text = data.decode("utf-8-sig", "ignore" if not whole else "replace")
        records = csv.reader(io.StringIO(text, newline=""))
        record = next(records, None)
        if whole or next(records, None) is not None:  # the first one ends before another begins
            return record
        most *= 4


def csv_files(spark: SparkSession, paths: Sequence[str]) -> list[CsvFile]:
    """Every .csv file with its header; `reason` is `empty` or `unreadable` where it has
    none. Only the starts of the files are read, on the driver as any file listing is."""

    def look(file: tuple[str, int]) -> CsvFile:
        path, size = file
        try:
            cells = _first_record(spark, path, size) if size else None
        except Exception as e:  # a file that can't be opened is told, not fatal
            return CsvFile(path, size, None, f"unreadable: {type(e).__name__}")
        if not cells or not any(c.strip() for c in cells):
            return CsvFile(path, size, None, "empty")
        return CsvFile(path, size, tuple(c.strip() for c in cells), None)

    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        return list(pool.map(look, list_csv(spark, paths)))


def literal_glob(path: str) -> str:
    """The glob that matches the path itself: readers take paths for globs."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def decoded_path() -> Column:
    """The full path of the file a row comes from, as a listing tells it (the engine's own
    column writes a space as %20, % as %25, and file:/// for file:/)."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def read_csv_layout(spark: SparkSession, path: str | Sequence[str], cols: Sequence[str] | None = None,
                    src_col: str | None = "src_file", ignore_corrupt: bool = False,
                    malformed_col: str | None = None, path_col: str | None = None,
                    files: Sequence[CsvFile] | None = None) -> DataFrame:
    """CSV files below `path` (folders, files or globs), all strings. Every file is
    read by its own header and the groups are united by name; `cols` selects and orders the
    columns (absent ones are null). `src_col` = base name of the file a row came from,
    `path_col` = its full path. `malformed_col` keeps the text of rows that don't fit their
    header (else they fill what columns they can). Files without a header give no rows; see
    `skipped_files`. With `ignore_corrupt` files that can't be read to the end are cut
    short. `files` is a listing made before (`csv_files`)."""
    paths = [path] if isinstance(path, str) else list(path)
    files = csv_files(spark, paths) if files is None else files
    if not files:
        raise FileNotFoundError(f"no CSV files below {paths}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        if f.header:
            groups.setdefault(f.header, []).append(f.path)
    parts = []
    for header, own in groups.items() or [((), [])]:
        schema = string_schema([*header, *([malformed_col] if malformed_col else [])])
        reader = spark.read.options(**CSV_OPTIONS).option("ignoreCorruptFiles", str(ignore_corrupt).lower())
        if malformed_col:
            reader = reader.option("columnNameOfCorruptRecord", malformed_col)
        # A BOM is part of the first header cell; an explicit schema replaces the header.
        part = reader.schema(schema).csv([literal_glob(p) for p in own]) if own else spark.createDataFrame([], schema)
        for name, value in ((src_col, lambda: F.element_at(F.split(decoded_path(), "/"), -1)), (path_col, decoded_path)):
            if name:
                part = part.withColumn(name, value() if own else F.lit(None).cast("string"))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if cols is None:
        return out
    extra = [c for c in (malformed_col, src_col, path_col) if c and c not in cols]
    present = set(out.columns)
    return out.select(
        *[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in cols], *extra
    )


def skipped_files(spark: SparkSession, path: str | Sequence[str], rows: DataFrame, path_col: str = "path",
                  files: Sequence[CsvFile] | None = None) -> DataFrame:
    """Files below `path` of which `rows` (read with `path_col`) holds nothing: path,
    bytes, reason (`empty`, `unreadable: ...`, `no rows`)."""
    files = csv_files(spark, [path] if isinstance(path, str) else list(path)) if files is None else files
    listed = spark.createDataFrame([(f.path, f.bytes, f.reason) for f in files], "path string, bytes long, reason string")
    seen = rows.select(F.col(path_col).alias("path")).distinct()
    return listed.join(seen, "path", "left_anti").select("path", "bytes", F.coalesce("reason", F.lit("no rows")).alias("reason"))


def read_csv_union(spark: SparkSession, layouts: Mapping[str, str | Sequence[str]] | Iterable[str],
                   src_col: str = "src_file", cols: Sequence[str] | None = None) -> DataFrame:
    """S3: one read per layout, then union by column name (missing -> null)."""
    paths = list(layouts.values()) if isinstance(layouts, Mapping) else list(layouts)
    if not paths:
        raise FileNotFoundError("no CSV inputs")
    parts = [read_csv_layout(spark, p, src_col=src_col) for p in paths]
    return union_by_name_conformed(parts, cols)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Stage boundary (S13/S14/S16): Parquet, optionally partitioned (e.g. run_day)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def with_run_day(df: DataFrame, run_day: str | None = None) -> DataFrame:
    """The run's day (UTC; today by default) as the partition column `run_day`."""
    day = F.lit(run_day).cast("date") if run_day else F.to_date(F.convert_timezone(None, F.lit("UTC"), F.now()))
    return df.withColumn("run_day", day)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), bom: bool = False) -> None:
    """Export edge (S13/S15): header CSV, RFC-4180 quoting; one folder per partition
    value when `partition_by` is given (platform / keyword / day dumps). `bom` puts a
    byte order mark before each file's header, as spreadsheet programs want it."""
    if bom and df.columns and df.columns[0] not in partition_by:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    w = df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_ordered(df: DataFrame, path: str, group: Sequence[str], order: Sequence[str], rows_per_file: int = 1_000_000,
                  fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Dumps per group in order. Rows are dealt over the tasks by ranges of
    (group, order), so a hot group is written by many tasks and a small one by one; within
    a group's folder the names of the files follow the order, and a file holds at most
    `rows_per_file` rows. A group has one file per task that holds some of it and one more
    per `rows_per_file` rows."""
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    w = ranged.write.mode(mode).option("maxRecordsPerFile", str(rows_per_file)).partitionBy(*group)
    if fmt == "csv":
        w = w.option("header", "true").option("quote", '"').option("escape", '"')
    w.format(fmt).save(path)


def read_ordered(spark: SparkSession, path: str, schema: T.StructType, group: Sequence[str]) -> DataFrame:
    """The rows of a Parquet dump of `write_ordered` with `position`, their place in their
    group by file name and place in the file."""
    rows = spark.read.schema(schema).parquet(path)
    placed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    # A file's rows before it: sizes are one row a file, so no group is sorted for this.
    sizes = placed.groupBy(*group, "file").agg((F.max("at") + 1).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*group).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, "file", F.coalesce(ahead, F.lit(0)).alias("start"))
    return placed.join(starts, [*group, "file"]).withColumn("position", F.col("start") + F.col("at") + 1).drop("file", "at", "start")


#: A dictionary file is read up to this size.
DICTIONARY_BYTES = 64 << 20


def load_keywords(path_or_text: str, key: str = "keywords", spark: SparkSession | None = None) -> list[str]:
    """Ordered keyword list under `keywords:` in a YAML file (or YAML text); entries
    stripped, blanks removed, empty list refused. With a session the path may lie in any
    store that the cluster reads; without one it is a file of this machine."""
    import os

    import yaml

    text = path_or_text
    if "\n" not in path_or_text:
        if spark is not None and folders.exists(spark, path_or_text):
            text = folders.read_bytes(spark, path_or_text, DICTIONARY_BYTES).decode("utf-8-sig")
        elif spark is None and os.path.exists(path_or_text):
            text = open(path_or_text, encoding="utf-8-sig").read()
    data = yaml.safe_load(text) or {}
    found = data.get(key) if isinstance(data, dict) else None
    kws = [str(k).strip() for k in (found or []) if k is not None and str(k).strip()]
    if not kws:
        raise ValueError(f"no keywords under {key!r}")
    return kws


def keyword_table(spark: SparkSession, keywords: Sequence[str]) -> DataFrame:
    """Dictionary as a table (ord, keyword) for joins or reports."""
    return spark.createDataFrame(list(enumerate(keywords)), "ord int, keyword string")

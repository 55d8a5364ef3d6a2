"""Shared plan helpers: size-checked broadcast of derived lookups, total-order dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kwspread.session import ensure_checkpoint_dir

# A derived lookup (first hits per group, matched videos, ...) is broadcast only when
# its materialised row count and its estimated size are within these bounds; above
# them the join stays a shuffle join that AQE can split when keys are skewed.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024
_STRING_BYTES = 48  # assumed average for strings / binary in the size estimate


def estimated_row_bytes(dt: T.DataType) -> int:
    """Rough in-memory width of one value of `dt` (strings at an assumed average)."""
    if isinstance(dt, T.StructType):
        return sum(estimated_row_bytes(f.dataType) for f in dt.fields) + 8
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return 16 * _STRING_BYTES
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return _STRING_BYTES
    return 8


def bounded_lookup(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Materialise a small derived table once (reliable checkpoint in the session's
    shared checkpoint folder), count it, and mark it for broadcast only when both its
    row count and its estimated size (rows x schema width) are under the bounds.

    The checkpoint cuts lineage, so the consumer does not recompute the aggregate
    and a lost executor re-reads the checkpoint files instead of re-scanning input.
    """
    ensure_checkpoint_dir(df.sparkSession)
    frozen = df.checkpoint(eager=True)
    n = frozen.count()
    small = n <= max_rows and n * estimated_row_bytes(frozen.schema) <= max_bytes
    return F.broadcast(frozen) if small else frozen


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that feeds several branches of one plan once, to the
    session's shared checkpoint folder (reliable checkpoint: lineage is cut and a lost
    executor re-reads files instead of re-running scans and text matching). Without
    it each branch recomputes the whole subtree."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Guard for CPU-heavy text stages: when a scan yields fewer partitions than the
    cluster has task slots (one large row group, a handful of files), spread the rows
    round-robin over `defaultParallelism` partitions first. On large inputs the scan
    already has far more splits than slots and this is a no-op, so text is never
    shuffled at scale just to add parallelism."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access (e.g. Spark Connect): leave as is
        return df
    return df.repartition(slots) if n < slots else df


def compute_once(df: DataFrame, keep: Sequence[str], named: dict[str, Column]) -> DataFrame:
    """Evaluate expensive per-row expressions exactly once. The values come out of a
    generator (inline of a one-element array of structs): later filters on them stay
    above the generator instead of being substituted back into the scan, and joins
    that stream this side read the generated values instead of re-running them."""
    s = F.struct(*[e.alias(n) for n, e in named.items()])
    return df.select(*keep, F.inline(F.array(s)))


def with_nonnull(df: DataFrame, expr: Column, name: str) -> DataFrame:
    """Add `name` = expr and keep only rows where it is not null, evaluating `expr`
    once. A plain `where(name IS NOT NULL)` is rewritten by the optimizer into the
    filter *and* the projection, so an expensive matcher would run twice per row;
    carrying the value through a generator (explode of a one-element array, empty
    when null) keeps a single evaluation."""
    return df.select("*", F.explode(F.when(expr.isNotNull(), F.array(expr))).alias(name))


def order_key(cols: Sequence[str], nulls_last: bool = True) -> Column:
    """Ascending sort key as a struct; nulls last via an is-null flag per column."""
    parts = []
    for i, c in enumerate(cols):
        if nulls_last:
            parts.append(F.col(c).isNull().alias(f"n{i}"))
        parts.append(F.col(c).alias(f"v{i}"))
    return F.struct(*parts)


def keep_first(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Keep the first row of each key under a total order (deterministic, unlike
    dropDuplicates). Written as a min_by aggregate, so it is partially aggregated
    before the shuffle: a key holding a third of all rows arrives as one row per
    map task, not as one giant sorted window partition."""
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order_key(order_cols)).alias("__first"))
    return agg.select(*[F.col(c) if c in keys else F.col(f"__first.{c}") for c in df.columns])


#: Beyond this n the planner's own partial limit does not apply (its default threshold).
PLANNED_LIMIT = 1000
SALTS = 64


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """row_number() <= n per group, for any n.

    Catalyst plans a partial WindowGroupLimit before the shuffle for n up to
    PLANNED_LIMIT. Beyond that a group is first dealt over SALTS slices by a hash of the
    row and cut to n rows in each: a group holding a third of the rows is sorted in
    slices by many tasks, and its last window sees at most SALTS * n rows."""
    name = rank_col or "__rn"

    def limited(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)

    if n > PLANNED_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        df = limited(df.withColumn("__salt", salt), [*keys, "__salt"]).drop(name, "__salt")
    out = limited(df, keys)
    return out if rank_col else out.drop(name)


def conform(df: DataFrame, cols: Sequence[str], default: str | None = "") -> DataFrame:
    """Create absent columns (as `default`) and fix the column order."""
    present = set(df.columns)
    return df.select(
        *[F.col(c) if c in present else F.lit(default).cast("string").alias(c) for c in cols]
    )


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    """Refuse before any work when required columns are absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df

"""First-presence bracket (A13, SURVEY §2.13) and the "any hit among the newest N"
test it relies on (M11, W8).

exists(k, c) = some top-level comment, among the newest `max_comments` of one of the
newest `max_videos` videos found for keyword k and published before c, contains a
keyword of the list. The bisection narrows [start, end] while high - low > 2 days,
at most `iters` times; `high` moves on true, `low` on false; never true -> high null.

Execution, as one plan: a bisection can only ask about the times of a grid that its
parameters fix. Videos are counted per keyword and grid cell, with the place of the
cell's newest hit (partial aggregates; a keyword with a third of all videos is a few
thousand numbers). exists(k, c) follows from the cells before c, and the bisection is a
fold over that array, row by row. Nothing passes through the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwspread.functions.match import all_matches_array
from kwspread.operators.common import bounded_lookup, materialize

# Fixed values of the reference: stop when the bracket is at most 2 days wide;
# 18 steps by default (16 on its command line); 120 videos x 15 pages of 100.
MIN_WIDTH = dt.timedelta(days=2)
DEFAULT_ITERS = 18
DEFAULT_MAX_VIDEOS = 120
DEFAULT_MAX_COMMENTS = 15 * 100

_EPOCH = dt.datetime(1970, 1, 1)


def _epoch_col():
    return F.lit(_EPOCH).cast("timestamp_ntz")


def to_us(ts) -> "F.Column":
    """TIMESTAMP_NTZ -> microseconds since epoch (zone-free)."""
    return F.timestamp_diff("MICROSECOND", _epoch_col(), ts.cast("timestamp_ntz"))


def newest_n_any(rows: DataFrame, n: int, hit_col: str, video_col: str = "video_id",
                 ts_col: str = "date", id_col: str = "comment_id") -> DataFrame:
    """video_col, has_hit: is any hit among the video's newest n rows?

    Equivalent to `row_number() <= n` (newest first, ties by the smaller id, missing
    dates last) then `bool_or`, written as two aggregates so it holds for any n and any
    skew: the newest hit per video (partial aggregate), then the number of rows at least
    as new as that hit (partial aggregate after a size-checked broadcast join). A video
    is a hit iff that count is <= n."""
    age = F.struct(F.col(ts_col).isNull().alias("u"), (-to_us(F.col(ts_col))).alias("t"), F.col(id_col).alias("i"))
    newest_hit = rows.where(F.col(hit_col)).groupBy(video_col).agg(F.min(age).alias("__h"))
    rank = (
        rows.select(video_col, age.alias("__k"))
        .join(bounded_lookup(newest_hit), video_col, "inner")
        .where(F.col("__k") <= F.col("__h"))
        .groupBy(video_col)
        .agg(F.count(F.lit(1)).alias("__rank"))
    )
    all_videos = rows.select(video_col).distinct()
    return all_videos.join(rank, video_col, "left").select(
        video_col, F.coalesce(F.col("__rank") <= n, F.lit(False)).alias("has_hit")
    )


def found_videos(videos: DataFrame, video_hits: DataFrame, keywords: Sequence[str], ci: bool = True,
                 hits_col: str | None = None) -> DataFrame:
    """keyword, video_id, pub_us, hit: videos found by searching each keyword in the
    metadata (M10), with the video's hit flag (false when it has no comments)."""
    arr = F.col(hits_col) if hits_col else all_matches_array(F.col("title"), keywords, ci=ci)
    f = videos.select("video_id", to_us(F.col("published_at")).alias("pub_us"), F.explode(arr).alias("keyword"))
    f = f.join(video_hits.withColumnRenamed("has_hit", "hit"), "video_id", "left")
    return f.select("keyword", "video_id", "pub_us", F.coalesce("hit", F.lit(False)).alias("hit"))


def _us(t: dt.datetime) -> int:
    d = t - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _list(values: Sequence, kind: str) -> Column:
    """A long list as one literal (its elements hold no commas)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def grid_times(start: dt.datetime, end: dt.datetime, iters: int) -> list[dt.datetime]:
    """All times that a bisection of [start, end] can stop at or ask about: halving until
    at most MIN_WIDTH wide or `iters` times. 2^steps + 1 of them, a parameter's size."""
    times = [start, end]
    for _ in range(iters):
        if max(b - a for a, b in zip(times, times[1:])) <= MIN_WIDTH:
            break
        middle = [a + (b - a) / 2 for a, b in zip(times, times[1:])]
        times = sorted(times + middle)
    return times


def _cell(pub_us: Column, inner: list[int]) -> Column:
    """How many of the sorted inner grid times are <= pub_us, by binary search."""
    steps = [1 << k for k in reversed(range(max(1, len(inner).bit_length())))]
    times = _list(inner, "bigint") if inner else F.array().cast("array<bigint>")
    jump = lambda p, s: F.when(F.get(times, p + s - 1) <= pub_us, p + s).otherwise(p)
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), jump)


def presence_cells(found: DataFrame, times: list[dt.datetime]) -> DataFrame:
    """keyword, cells: per grid cell that has videos, in time order, the number of its
    videos and how many of them are newer than its newest hit (null: no hit). Two partial
    aggregates; a keyword has at most as many cells as the grid."""
    key = F.struct((-F.col("pub_us")).alias("age"), F.col("video_id").alias("id"))
    rows = found.select("keyword", "hit", key.alias("key"), _cell(F.col("pub_us"), [_us(t) for t in times[1:-1]]).alias("cell"))
    cells = rows.groupBy("keyword", "cell").agg(F.count("*").alias("n"), F.min(F.when(F.col("hit"), F.col("key"))).alias("newest"))
    newer = (
        rows.select("keyword", "cell", "key").join(cells.select("keyword", "cell", "newest"), ["keyword", "cell"])
        .where(F.col("newest").isNotNull())
        .groupBy("keyword", "cell").agg(F.count_if(F.col("key") < F.col("newest")).alias("newer"))
    )
    told = cells.join(newer, ["keyword", "cell"], "left").select("keyword", F.struct("cell", "n", "newer").alias("c"))
    return told.groupBy("keyword").agg(F.array_sort(F.collect_list("c")).alias("cells"))


def _exists(cells: Column, at: Column, max_videos: int) -> Column:
    """Is a hit among the newest `max_videos` videos before grid time `at`? The newest
    hit's rank is carried over the cells in time order."""
    rank = F.aggregate(
        F.filter(cells, lambda c: c["cell"] < at),
        F.lit(None).cast("long"),
        lambda r, c: F.when(c["newer"].isNotNull(), c["newer"] + 1).otherwise(r + c["n"]),
    )
    return F.coalesce(rank <= max_videos, F.lit(False))


def bracket(found: DataFrame, keywords: Sequence[str], start: dt.datetime, end: dt.datetime,
            max_videos: int = DEFAULT_MAX_VIDEOS, iters: int = DEFAULT_ITERS) -> DataFrame:
    """One row per keyword: the bisection's bracket, its trace and number of steps."""
    times = grid_times(start, end, iters)
    steps = (len(times) - 1).bit_length() - 1
    days = _list([t.date().isoformat() for t in times], "string")
    words = found.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keywords) if k], "keyword string")
    rows = words.join(presence_cells(found, times), "keyword", "left").withColumn(
        "cells", F.coalesce("cells", F.array().cast("array<struct<cell:int,n:bigint,newer:bigint>>"))
    )

    def step(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        asked = F.struct(middle.alias("at"), _exists(F.col("cells"), middle, max_videos).alias("seen"))

        def moved(q: Column) -> Column:
            note = F.concat(F.lit("('"), F.get(days, q["at"]), F.lit("', "), F.initcap(q["seen"].cast("string")), F.lit(")"))
            return F.struct(
                F.when(q["seen"], s["lo"]).otherwise(q["at"]).alias("lo"),
                F.when(q["seen"], q["at"]).otherwise(s["hi"]).alias("hi"),
                (s["seen"] | q["seen"]).alias("seen"),
                F.array_append(s["trace"], note).alias("trace"),
            )

        # A lambda variable holds the answer, so it is computed once a step.
        return F.get(F.transform(F.array(asked), moved), F.lit(0))

    begin = F.struct(
        F.lit(0).alias("lo"), F.lit(len(times) - 1).alias("hi"), F.lit(False).alias("seen"),
        F.array().cast("array<string>").alias("trace"),
    )
    turns = F.sequence(F.lit(1), F.lit(steps)) if steps else F.array().cast("array<int>")
    rows = rows.select("keyword", F.aggregate(turns, begin, step).alias("s"))
    us = _list([_us(t) for t in times], "bigint")
    low, high = F.get(days, F.col("s.lo")), F.get(days, F.col("s.hi"))
    width = F.floor((F.get(us, F.col("s.hi")) - F.get(us, F.col("s.lo"))) / 86_400_000_000)
    return rows.select(
        "keyword",
        F.col("s.seen").alias("found_presence"),
        low.cast("date").alias("lower_bound_no_presence"),
        F.when(F.col("s.seen"), high.cast("date")).alias("upper_bound_presence"),
        F.when(F.col("s.seen"), width.cast("long")).alias("window_days"),
        F.concat(F.lit("["), F.array_join("s.trace", ", "), F.lit("]")).alias("trace"),
        F.lit(steps).cast("long").alias("steps"),
    )


def first_presence(spark: SparkSession, found: DataFrame, keywords: Sequence[str], start: dt.datetime,
                   end: dt.datetime, max_videos: int = DEFAULT_MAX_VIDEOS, iters: int = DEFAULT_ITERS) -> DataFrame:
    """Bracket per keyword plus the uncapped exact answer (earliest hit video), as one
    plan. `found` is written once, since three aggregates read it."""
    found = materialize(found)
    exact = found.where(F.col("hit")).groupBy("keyword").agg(
        F.timestamp_add("MICROSECOND", F.min("pub_us"), _epoch_col()).alias("exact_first_presence")
    )
    return bracket(found, keywords, start, end, max_videos, iters).join(exact, "keyword", "left")

"""Candidate pool: keyword x period search, channel uploads, provenance merge,
hydration, sampling (J4, J9, J13, D1, D7, D8, A8, A9, F12-F14, O1, W1-W6).

The keyword x period theta join is written without any join: the dictionary and the
period list are small driver-side parameters, so each video computes the array of
(keyword, period) pairs it satisfies -- its dictionary hits times the periods that hold
its date, both array literals filtered once per row -- and explodes it. The fan-out per
video is bounded by |keywords| x |periods|, the plan by |keywords| + |periods|.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.functions import text as X
from kwspread.operators.common import bounded_lookup, keep_first, top_n_per_group

# Sampling defaults of the reference (N per keyword, seed).
SAMPLE_N = 20
SAMPLE_SEED = 42


def parse_periods(periods: Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    """'a,b' split at the first comma and stripped; a missing comma is an error."""
    out = []
    for p in periods:
        if isinstance(p, tuple):
            a, b = p
        else:
            if "," not in p:
                raise ValueError(f"period without comma: {p!r}")
            a, b = p.split(",", 1)
        a, b = a.strip(), b.strip()
        if not a or not b:
            raise ValueError(f"bad period: {p!r}")
        out.append((a, b))
    return out


def keyword_period_tags(videos: DataFrame, keywords: Sequence[str], periods: Sequence[tuple[str, str]],
                        text_col: str = "title", ts_col: str = "published_at", ci: bool = True) -> DataFrame:
    """J9 + M9 + M10 + F12: one row per (video, keyword, period) hit:
    video_id, ord (keyword-major, period-minor insertion order), tag."""
    arr = _tag_structs(keywords, periods, text_col, ts_col, ci)
    return videos.select("video_id", F.explode(arr).alias("t")).select("video_id", "t.ord", "t.tag")


def channel_tags(videos: DataFrame, channels: DataFrame, base_ord: int) -> DataFrame:
    """J13 + F12: uploads of the resolved channels (channels: channel_id, ch_ord)."""
    j = videos.select("video_id", "channel_id").join(channels, "channel_id", "inner")
    return j.select(
        "video_id",
        (F.lit(base_ord) + F.col("ch_ord")).alias("ord"),
        X.provenance_tag_channel(F.col("channel_id")).alias("tag"),
    )


def merge_provenance(tags: DataFrame) -> DataFrame:
    """Per video, distinct tags in first-insertion order, ';'-joined.
    The group is bounded by |keywords| x |periods| + |channels|."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "tag")))
    return tags.groupBy("video_id").agg(
        F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["tag"])), ";").alias("source"),
        F.min("ord").alias("first_ord"),
    )


def _period_bounds(periods: Sequence[tuple[str, str]]) -> Column:
    """The periods as an array literal of (position, start, end, bounds). Each bound is
    read once on the driver; one that is no ISO date or date-time is an error."""

    def bound(text: str) -> Column:
        try:
            value = dt.datetime.fromisoformat(text)
        except ValueError:
            raise ValueError(f"bad period bound: {text!r}") from None
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")

    rows = [
        F.struct(F.lit(k).alias("at"), F.lit(s).alias("s"), F.lit(e).alias("e"), bound(s).alias("lo"), bound(e).alias("hi"))
        for k, (s, e) in enumerate(periods)
    ]
    return F.array(*rows)


def _tag_structs(keywords: Sequence[str], periods: Sequence[tuple[str, str]],
                 text_col: str = "title", ts_col: str = "published_at", ci: bool = True,
                 hits_col: str | None = None) -> Column:
    """Array of struct(ord, tag) for the (keyword, period) pairs this row satisfies, in
    order; periods are half-open (the end date's midnight is excluded). `hits_col` holds
    the row's keywords where they were matched before."""
    kws = [k for k in keywords if k]
    if not kws or not periods:
        return F.array().cast("array<struct<ord:int,tag:string>>")
    hits = F.col(hits_col) if hits_col else M.all_matches_array(F.col(text_col), kws, ci=ci)
    ts = F.col(ts_col).cast("timestamp_ntz")
    held = F.filter(_period_bounds(periods), lambda p: (ts >= p["lo"]) & (ts < p["hi"]))

    def tag(k: Column, p: Column) -> Column:
        order = (F.array_position(F.lit(kws), k).cast("int") - 1) * len(periods) + p["at"]
        return F.struct(order.alias("ord"), X.provenance_tag_keyword(k, p["s"], p["e"]).alias("tag"))

    # Periods and hits are bound once per row, then combined.
    bound_once = F.array(F.struct(held.alias("ps"), hits.alias("ks")))
    both = F.transform(bound_once, lambda b: F.flatten(F.transform(b["ks"], lambda k: F.transform(b["ps"], lambda p: tag(k, p)))))
    return F.get(both, F.lit(0))


def candidate_pool(videos: DataFrame, keywords: Sequence[str], periods: Sequence[tuple[str, str]],
                   channels: DataFrame | None = None, unique_videos: bool = True,
                   title_col: str = "title", hits_col: str | None = None) -> DataFrame:
    """D1 + D8 + A8: keyword pool then channel pool, keyed by video, provenance merged
    in first-insertion order. Output keeps the candidates schema.

    With one row per video (a video table), every tag of a video is computed from that
    row, so the pool is a narrow projection: the channel list joins as a size-checked
    broadcast lookup and nothing (least of all the title text) is shuffled. When a
    video may repeat (landed search results), tags are merged by a per-video group
    bounded by |keywords| x |periods| + |channels|, and the first row supplies the
    metadata (first writer wins)."""
    kws = list(dict.fromkeys(k for k in keywords if k))
    pers = list(dict.fromkeys(periods))
    cols = ("video_id", "channel_id", "channel_name", title_col, "published_at")
    v = videos.select(*cols, _tag_structs(kws, pers, title_col, hits_col=hits_col).alias("__tags"))
    if channels is not None:
        lookup = bounded_lookup(channels.select("channel_id", F.col("ch_ord").alias("__ch_ord")))
        own = F.struct(
            (F.lit(len(kws) * len(pers)) + F.col("__ch_ord")).cast("int").alias("ord"),
            X.provenance_tag_channel(F.col("channel_id")).alias("tag"),
        )
        v = v.join(lookup, "channel_id", "left").withColumn(
            "__tags", F.when(F.col("__ch_ord").isNotNull(), F.array_append("__tags", own)).otherwise(F.col("__tags"))
        )
    # A generator evaluates the tags once per row, before the filter on them.
    v = v.select(*cols, F.explode(F.when(F.size("__tags") > 0, F.array(F.col("__tags")))).alias("__tags"))
    if not unique_videos:
        # The first writer is the row with the least tag position, then the earliest date.
        first = keep_first(
            v.withColumn("__ord", F.array_min(F.transform("__tags", lambda x: x["ord"]))).drop("__tags"),
            ["video_id"], ["__ord", "published_at", "channel_id", "channel_name", title_col],
        )
        merged = merge_provenance(v.select("video_id", F.explode("__tags").alias("t")).select("video_id", "t.ord", "t.tag"))
        return merged.join(first, "video_id").select(*cols, "source")
    return v.select(*cols, F.array_join(F.transform("__tags", lambda x: x["tag"]), ";").alias("source"))


def resolved_channels(raw_inputs: DataFrame, raw_col: str = "raw", ord_col: str = "doc_id") -> DataFrame:
    """Resolve channel inputs; unresolved ones are skipped. Output: channel_id, ch_ord
    (input order of the first input that resolved to it)."""
    r = raw_inputs.select(X.channel_id_from(F.col(raw_col)).alias("channel_id"), F.col(ord_col).alias("__o"))
    r = r.where(F.col("channel_id").isNotNull()).groupBy("channel_id").agg(F.min("__o").alias("ch_ord"))
    return r


def unresolved_channels(raw_inputs: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Inputs that did not resolve (warned and skipped by the reference)."""
    return raw_inputs.where(X.channel_id_from(F.col(raw_col)).isNull())


def explode_picked(pool: DataFrame) -> DataFrame:
    """W4 + F13: one row per (video, picked keyword) from the provenance text."""
    return pool.select("*", F.explode(X.keywords_from_provenance(F.col("source"))).alias("picked_by_keyword"))


def sample_per_keyword(exploded: DataFrame, mode: str = "oldest", n: int = SAMPLE_N, seed: int = SAMPLE_SEED,
                       ts_col: str = "published_at") -> DataFrame:
    """W1-W3 + D7: per keyword, one row per video, then the N oldest / newest
    (unparsable dates last, ties by video_id) or a seeded hash sample of min(N, size)."""
    one = keep_first(exploded, ["picked_by_keyword", "video_id"], [ts_col, *[c for c in exploded.columns if c not in
                     ("picked_by_keyword", "video_id", ts_col)]])
    if mode == "oldest":
        order = [F.col(ts_col).asc_nulls_last(), F.col("video_id").asc()]
    elif mode == "newest":
        order = [F.col(ts_col).desc_nulls_last(), F.col("video_id").asc()]
    elif mode == "random":
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("video_id").cast("string")))
        order = [key.asc(), F.col("video_id").asc()]
    else:
        raise ValueError(mode)
    return top_n_per_group(one, ["picked_by_keyword"], order, n)


def hydrate(cands: DataFrame, meta: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Left lookup; a metadata value overrides only when non-empty; metadata of
    unknown ids is ignored (meta: video_id + `new_<col>` columns)."""
    j = cands.join(meta, "video_id", "left")
    out = j
    for c in cols:
        out = out.withColumn(c, X.first_nonempty(F.col(f"new_{c}"), F.col(c)))
    return out.drop(*[f"new_{c}" for c in cols])


def latest_per_channel(videos: DataFrame, n: int, ts_col: str = "published_at") -> DataFrame:
    """Newest N uploads per channel."""
    return top_n_per_group(
        videos, ["channel_id"], [F.col(ts_col).desc_nulls_last(), F.col("video_id").asc()], n, rank_col="rank"
    )


def sorted_for_export(cands: DataFrame, ts_col: str = "published_at") -> DataFrame:
    """O1: candidates oldest first, unparsable dates last, ties by video_id. Only at
    the sink: a global sort is a range-partitioned shuffle, never done mid-plan."""
    return cands.orderBy(F.col(ts_col).asc_nulls_last(), F.col("video_id").asc())

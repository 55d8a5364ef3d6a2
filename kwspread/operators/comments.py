"""Comment scanning: transcript gate, reply scan, resume, caps, enrichment, attribution
(J1-J3, J5, J6, J10, M11, M13, W6-W9, D5, D6, A10-A12, A14, A15, I2).

The reference's two stages (transcript gate, then comment scan) are one plan here:
the gate is a semi-join, "already stored" is an anti-join, caps are per-group
`row_number() <= N` (partial WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.functions import text as X
from kwspread.operators.common import bounded_lookup, top_n_per_group
from kwspread.sources.landed_scan import STATUS_DONE

# Fixed values of the reference: transcript language preference and the default caps.
DEFAULT_LANGS = ("ko", "en")
MATCHES_PER_VIDEO = {"channel": 500, "search": 300}
PAGES_PER_VIDEO = {"channel": 20, "bisect": 15}
COMMENTS_PER_PAGE = 100


def gate_semi(comments: DataFrame, gate: DataFrame, key: str = "video_id") -> DataFrame:
    """Keep comments of gated videos. The gate (distinct ids) is materialised once
    and broadcast under a row bound; otherwise a shuffled semi-join (AQE splits skew)."""
    return comments.join(bounded_lookup(gate.select(key).distinct()), key, "left_semi")


def prefer_language(available: DataFrame, langs: Sequence[str], video_col: str, lang_col: str = "lang",
                    tiebreak: str | None = None) -> DataFrame:
    """Per video, the available item whose language comes first in `langs`."""
    pos = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col(lang_col))
    cand = available.where(pos > 0)
    key = F.struct(pos.alias("p"), *( [F.col(tiebreak).alias("t")] if tiebreak else []))
    others = [c for c in available.columns if c != video_col]
    return cand.groupBy(video_col).agg(F.min_by(F.struct(*others), key).alias("__b")).select(
        video_col, *[F.col(f"__b.{c}").alias(c) for c in others]
    )


def _known(keys: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The batch's keys that are stored. Where the batch's keys are few (checked) they are
    sent to the store, which is filtered where it is read: a store far larger than the
    batch is not shuffled, and no more rows than the batch has leave it. Otherwise both
    sides are shuffled."""
    return stored.select(key).join(bounded_lookup(keys.select(key)), key, "left_semi")


def new_only(rows: DataFrame, stored: DataFrame, key: str = "comment_id") -> DataFrame:
    """Drop ids already stored, and duplicates within the batch."""
    fresh = rows.dropDuplicates([key])
    return fresh.join(_known(fresh, stored, key), key, "left_anti")


def resume_todo(videos: DataFrame, progress: DataFrame, key: str = "video_id") -> DataFrame:
    """Only videos whose progress status is 'done' are skipped; errors are retried."""
    done = progress.where(F.col("status") == STATUS_DONE)
    return videos.join(_known(videos, done, key), key, "left_anti")


def scan_stats(rows: DataFrame, keywords: Sequence[str], ci: bool = True, stored: DataFrame | None = None) -> DataFrame:
    """Per video threads scanned, threads with a reply count and an id, new matches
    (top + reply): distinct ids with a hit that are not among the stored ones."""
    top = F.col("comment_level") == "top"
    seen = rows.groupBy("video_id").agg(
        F.count_if(top).cast("long").alias("scanned_threads"),
        F.count_if(top & (F.col("total_reply_count") > 0) & (F.col("comment_id") != "")).cast("long").alias("reply_parents"),
    )
    hits = rows.where(M.any_match(F.col("text"), keywords, ci=ci) & (F.col("comment_id") != ""))
    hits = hits.select("video_id", "comment_id").distinct()
    if stored is not None:
        hits = hits.join(stored.select("comment_id"), "comment_id", "left_anti")
    fresh = hits.groupBy("video_id").agg(F.count("*").alias("n"))
    return seen.join(fresh, "video_id", "left").select(
        "video_id", "scanned_threads", "reply_parents", F.coalesce("n", F.lit(0)).cast("long").alias("new_matches"))


def _newest_first(ts_col: str, id_col: str) -> list[Column]:
    return [F.col(ts_col).desc_nulls_last(), F.col(id_col).asc()]


def cap_after_match(rows: DataFrame, n: int, keyword_col: str, video_col: str = "video_id",
                    ts_col: str = "date", id_col: str = "comment_id") -> DataFrame:
    """Match first, then keep the newest N matching comments per video."""
    hits = rows.where(F.col(keyword_col).isNotNull())
    return top_n_per_group(hits, [video_col], _newest_first(ts_col, id_col), n)


def cap_before_match(rows: DataFrame, n: int, keyword_col: str, video_col: str = "video_id",
                     ts_col: str = "date", id_col: str = "comment_id") -> DataFrame:
    """Scan only the newest N comments per video, then match."""
    newest = top_n_per_group(rows, [video_col], _newest_first(ts_col, id_col), n)
    return newest.where(F.col(keyword_col).isNotNull())


def video_has_keyword(rows: DataFrame, n: int, keyword_col: str, video_col: str = "video_id",
                      ts_col: str = "date", id_col: str = "comment_id") -> DataFrame:
    """Any hit among each video's newest N comments."""
    newest = top_n_per_group(rows, [video_col], _newest_first(ts_col, id_col), n)
    return newest.groupBy(video_col).agg(F.bool_or(F.col(keyword_col).isNotNull()).alias("has_keyword"))


def distinct_ids_head(ids: DataFrame, id_expr: Column, ord_col: str, n: int) -> DataFrame:
    """D6 + W9: normalise ids, drop blanks, keep each id's first position, first N
    (n = 0 means all). The head is a top-N by position (TakeOrderedAndProject)."""
    norm = ids.select(id_expr.alias("video_id"), F.col(ord_col).alias("__o")).where(F.col("video_id") != "")
    first = norm.groupBy("video_id").agg(F.min("__o").alias("first_pos"))
    if n and n > 0:
        return first.orderBy("first_pos", "video_id").limit(n)
    return first


def enrich(comments: DataFrame, videos: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every hit gets video metadata (N+1 metadata calls become one equi-join)."""
    return comments.join(videos.select("video_id", *cols), "video_id", "left")


def search_attribution(videos: DataFrame, comments: DataFrame, queries: Sequence[str], per_query: int,
                       keyword_col: str = "keyword", ts_col: str = "published_at",
                       hits_col: str | None = None) -> DataFrame:
    """J10 + W6: videos found per query (metadata search, newest `per_query`), their
    comments matched against *all* keywords; one comment can appear under several
    queries and `query` may differ from `keyword`."""
    qs = [q for q in queries if q]
    found_arr = F.col(hits_col) if hits_col else M.all_matches_array(F.col("title"), qs, ci=True)
    found = videos.select("video_id", ts_col, F.explode(found_arr).alias("query"))
    found = top_n_per_group(found, ["query"], [F.col(ts_col).desc_nulls_last(), F.col("video_id").asc()], per_query)
    hits = comments.where(F.col(keyword_col).isNotNull())
    # At most len(queries) * per_query rows; broadcast if that is small, so the comment
    # side is not shuffled on a possibly hot video key.
    return hits.join(bounded_lookup(found.select("query", "video_id")), "video_id", "inner")


def run_totals(progress: DataFrame) -> DataFrame:
    """One row of run totals over the progress log."""
    return progress.agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_if(F.col("status") == STATUS_DONE).cast("long").alias("videos_done"),
        F.count_if(F.col("status") != STATUS_DONE).cast("long").alias("videos_failed"),
        F.coalesce(F.sum("scanned_threads"), F.lit(0)).cast("long").alias("scanned_threads"),
        F.coalesce(F.sum("new_matches"), F.lit(0)).cast("long").alias("new_matches"),
    )

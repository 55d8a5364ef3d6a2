"""Landed responses of a comment scan: one parse per page, rejected pages kept (S9, S10,
S19, I2, I4).

A landed page is a row of

  video_id, parent_id (null for a page of threads, else the thread it lists replies of),
  page_no, http_status (null: no answer), body (JSON text), fetched_at

`split_pages` parses every page once. Each page leaves a trace: its items (`row`), or one
line that says it had none (`empty`), or that it was rejected, why, and its body
(`rejected`). What a scan gathered before a page failed stays. `write_split` writes all
three from one pass, a folder each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.operators.common import keep_first

#: Status values of the progress log.
STATUS_DONE, STATUS_HTTP_ERROR, STATUS_ERROR = "done", "http_error", "error"

_TEXTS = "textDisplay:string, publishedAt:string, authorDisplayName:string, likeCount:bigint"
#: One schema for pages of threads and of replies.
PAGE = (
    "items array<struct<id:string, snippet:struct<totalReplyCount:int, "
    f"topLevelComment:struct<id:string, snippet:struct<{_TEXTS}>>, {_TEXTS}>>>, cut_page string"
)
OUTCOMES = ("row", "empty", "rejected")
PAGE_COLS = ["video_id", "parent_id", "page_no", "fetched_at"]


def split_pages(pages: DataFrame) -> DataFrame:
    """outcome, reason, the page's columns, the item's columns (null but for rows) and the
    body (rejected pages only).

    A page is rejected as `http_error` (an answer other than 2xx), `no_answer` (no status
    or no body) or `malformed` (the body is no JSON page, such as a cut one)."""
    parsed = pages.select(
        *PAGE_COLS, "http_status", "body",
        F.from_json("body", PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "cut_page"}).alias("p"),
    )
    reason = (
        F.when(~F.col("http_status").between(200, 299), F.lit("http_error"))
        .when(F.col("http_status").isNull() | (F.trim(F.coalesce("body", F.lit(""))) == ""), F.lit("no_answer"))
        .when(F.col("p").isNull() | F.col("p.cut_page").isNotNull(), F.lit("malformed"))
    )
    told = parsed.select(*PAGE_COLS, "body", reason.alias("reason"), F.col("p.items").alias("items"))
    # Pages without items come through explode_outer with a null item.
    items = F.when(F.col("reason").isNull(), F.filter("items", lambda x: x.isNotNull()))
    rows = told.select(*PAGE_COLS, "reason", F.when(F.col("reason").isNotNull(), F.col("body")).alias("body"), F.explode_outer(items).alias("it"))
    top = F.col("parent_id").isNull()
    said = F.when(top, F.col("it.snippet.topLevelComment.snippet")).otherwise(
        F.struct(*[F.col(f"it.snippet.{c}").alias(c) for c in ("textDisplay", "publishedAt", "authorDisplayName", "likeCount")])
    )
    own_id = F.when(top, F.col("it.snippet.topLevelComment.id")).otherwise(F.col("it.id"))
    here = F.col("it").isNotNull()
    text = lambda c: F.when(here, F.coalesce(said[c], F.lit("")))
    return rows.select(
        F.when(F.col("reason").isNotNull(), F.lit("rejected")).when(here, F.lit("row")).otherwise(F.lit("empty")).alias("outcome"),
        "reason", *PAGE_COLS,
        F.when(here, F.when(top, F.lit("top")).otherwise(F.lit("reply"))).alias("comment_level"),
        F.when(here, F.coalesce(own_id, F.lit(""))).alias("comment_id"),
        text("textDisplay").alias("text"),
        text("publishedAt").alias("published_at"),
        text("authorDisplayName").alias("author_name"),
        F.when(here, F.coalesce(said["likeCount"], F.lit(0))).cast("long").alias("like_count"),
        F.when(here & top, F.coalesce(F.col("it.snippet.totalReplyCount"), F.lit(0))).cast("long").alias("total_reply_count"),
        "body",
    )


def write_split(pages: DataFrame, path: str, mode: str = "overwrite") -> dict[str, DataFrame]:
    """Write items, empty and rejected pages from one pass; readers by outcome."""
    split = split_pages(pages)
    split.write.mode(mode).partitionBy("outcome").parquet(path)
    schema = split.schema
    whole = pages.sparkSession.read.schema(schema).parquet(path)
    return {o: whole.where(F.col("outcome") == o) for o in OUTCOMES}


def scanned_comments(rows: DataFrame) -> DataFrame:
    """Top-level rows, and replies of threads with a reply count and an id."""
    top = rows.where("comment_level = 'top'")
    gate = top.where("total_reply_count > 0 AND comment_id <> ''").select(F.col("comment_id").alias("parent_id")).distinct()
    return top.unionByName(rows.where("comment_level = 'reply'").join(gate, "parent_id", "left_semi"))


def new_matches(rows: DataFrame, keywords: Sequence[str], stored: DataFrame | None = None, ci: bool = True) -> DataFrame:
    """Matched rows with an id that is not among the stored ones, each id once (the row
    fetched first)."""
    hits = rows.withColumn("matched_keyword", M.first_match(F.col("text"), keywords, ci=ci))
    hits = hits.where(F.col("matched_keyword").isNotNull() & (F.col("comment_id") != ""))
    hits = keep_first(hits, ["comment_id"], ["fetched_at", "video_id", "page_no"])
    return hits if stored is None else hits.join(stored.select("comment_id"), "comment_id", "left_anti")


def progress_rows(split: DataFrame, keywords: Sequence[str], stored: DataFrame | None = None, ci: bool = True) -> DataFrame:
    """One row per scanned video: status, counts, elapsed_sec and ts.

    `split` has the three outcomes. A video is `done` unless a page was rejected: then it
    is `http_error` or `error` by its first rejected page (thread pages come before reply
    pages), and its counts are 0, as a run that raised tells them. A scanned video without
    comments is done; a video without a landed page was not scanned and has no row.
    elapsed_sec is the time between the first and the last page, ts that of the last."""
    failed = F.when(F.col("outcome") == "rejected", F.struct(F.col("parent_id").isNotNull().alias("l"), "parent_id", "page_no"))
    threads = F.col("comment_level") == "top"
    seen = split.groupBy("video_id").agg(
        F.min_by("reason", failed).alias("reason"),
        F.count_if(threads).cast("long").alias("threads"),
        F.count_if(threads & (F.col("total_reply_count") > 0) & (F.col("comment_id") != "")).cast("long").alias("parents"),
        F.min("fetched_at").alias("begun"), F.max("fetched_at").alias("ended"),
    )
    rows = scanned_comments(split.where("outcome = 'row'"))
    fresh = new_matches(rows, keywords, stored, ci).groupBy("video_id").agg(F.count("*").alias("fresh"))
    status = (
        F.when(F.col("reason").isNull(), F.lit(STATUS_DONE))
        .when(F.col("reason") == "http_error", F.lit(STATUS_HTTP_ERROR))
        .otherwise(F.lit(STATUS_ERROR))
    )
    counted = lambda c: F.when(F.col("reason").isNull(), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    spent = F.timestamp_diff("MICROSECOND", F.col("begun"), F.col("ended")) / 1e6
    return seen.join(fresh, "video_id", "left").select(
        "video_id", status.alias("status"),
        counted(F.col("threads")).alias("scanned_threads"),
        counted(F.col("parents")).alias("reply_parents"),
        counted(F.col("fresh")).alias("new_matches"),
        F.round(spent, 2).alias("elapsed_sec"),
        F.date_format("ended", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("ts"),
    )

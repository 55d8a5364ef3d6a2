"""Landed API responses (raw JSON pages) -> flat rows.

The collectors' network calls are not rebuilt; their responses are assumed landed as
one JSON page per record. Flattening is `from_json` with a fixed schema + `explode`,
all JVM-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwspread.functions import text as X

_SNIP = "struct<textDisplay:string, publishedAt:string, authorDisplayName:string, likeCount:bigint>"

# Fixed schemas of the landed pages.
THREADS_PAGE = (
    "items array<struct<snippet:struct<totalReplyCount:int, "
    f"topLevelComment:struct<id:string, snippet:{_SNIP}>>>>, nextPageToken string"
)
REPLIES_PAGE = f"items array<struct<id:string, snippet:{_SNIP}>>, nextPageToken string"
SEARCH_PAGE = (
    "items array<struct<id:struct<videoId:string>, snippet:struct<title:string, channelId:string, "
    "channelTitle:string, publishedAt:string>>>, nextPageToken string"
)
PLAYLIST_PAGE = (
    "items array<struct<contentDetails:struct<videoId:string, videoPublishedAt:string>, "
    "snippet:struct<title:string, channelId:string, channelTitle:string, publishedAt:string>>>, nextPageToken string"
)
VIDEOS_PAGE = (
    "items array<struct<id:string, snippet:struct<title:string, channelId:string, channelTitle:string, "
    "publishedAt:string>>>, nextPageToken string"
)
NEWS_PAGE = "items array<struct<title:string, description:string, originallink:string, link:string, pubDate:string>>"
TRANSCRIPT = "array<struct<text:string, start:double, duration:double>>"

REPLIES_PER_PAGE = 100


def _items(pages: DataFrame, json_col: str, ddl: str, keep: list[str]) -> DataFrame:
    parsed = pages.select(*keep, F.from_json(F.col(json_col), ddl).alias("p"))
    return parsed.select(*keep, F.explode_outer("p.items").alias("it")).where(F.col("it").isNotNull())


def malformed_pages(pages: DataFrame, json_col: str = "page") -> DataFrame:
    """Quarantine: the pages whose text is no JSON document (truncated, cut, blank); the
    flatteners give no rows for them."""
    return pages.where(F.try_parse_json(F.col(json_col)).isNull())


def flatten_thread_pages(pages: DataFrame, json_col: str = "page", video_col: str = "video_id") -> DataFrame:
    """Top-level comments. id cast to string, missing text -> '', missing counts -> 0."""
    it = _items(pages, json_col, THREADS_PAGE, [video_col])
    top = F.col("it.snippet.topLevelComment")
    return it.select(
        F.col(video_col).alias("video_id"),
        F.coalesce(top["id"].cast("string"), F.lit("")).alias("comment_id"),
        F.coalesce(top["snippet"]["textDisplay"], F.lit("")).alias("text"),
        F.coalesce(top["snippet"]["publishedAt"], F.lit("")).alias("published_at"),
        F.coalesce(top["snippet"]["authorDisplayName"], F.lit("")).alias("author_name"),
        F.coalesce(top["snippet"]["likeCount"], F.lit(0)).alias("like_count"),
        F.coalesce(F.col("it.snippet.totalReplyCount"), F.lit(0)).cast("long").alias("total_reply_count"),
    )


def flatten_reply_pages(pages: DataFrame, json_col: str = "page", parent_col: str = "parent_id") -> DataFrame:
    """Reply rows carrying the parent id they were listed under."""
    it = _items(pages, json_col, REPLIES_PAGE, [parent_col])
    return it.select(
        F.col(parent_col).alias("parent_id"),
        F.coalesce(F.col("it.id").cast("string"), F.lit("")).alias("comment_id"),
        F.coalesce(F.col("it.snippet.textDisplay"), F.lit("")).alias("text"),
        F.coalesce(F.col("it.snippet.publishedAt"), F.lit("")).alias("published_at"),
        F.coalesce(F.col("it.snippet.authorDisplayName"), F.lit("")).alias("author_name"),
        F.coalesce(F.col("it.snippet.likeCount"), F.lit(0)).alias("like_count"),
    )


def comment_rows(top: DataFrame, replies: DataFrame) -> DataFrame:
    """S9+S10+F16+M12: one flat table of top-level and reply rows. Replies are taken
    only under threads with reply count > 0 and a non-empty id, whether or not the top
    comment matched anything."""
    gate = top.where((F.col("total_reply_count") > 0) & (F.col("comment_id") != "")).select(
        F.col("comment_id").alias("parent_id"), "video_id"
    )
    rep = replies.join(gate, "parent_id", "inner")
    cols = ["video_id", "comment_id", "parent_id", "comment_level", "text", "published_at", "author_name", "like_count",
            "total_reply_count"]
    t = top.withColumn("parent_id", F.lit("")).withColumn("comment_level", F.lit("top"))
    r = rep.withColumn("comment_level", F.lit("reply")).withColumn("total_reply_count", F.lit(None).cast("long"))
    return t.select(*cols).unionByName(r.select(*cols))


def flatten_video_pages(pages: DataFrame, kind: str, json_col: str = "page") -> DataFrame:
    """Search / playlist / videos pages -> video rows with a non-empty id;
    published time = contentDetails.videoPublishedAt, else snippet.publishedAt, else ''."""
    ddl = {"search": SEARCH_PAGE, "playlist": PLAYLIST_PAGE, "videos": VIDEOS_PAGE}[kind]
    it = _items(pages, json_col, ddl, [])
    if kind == "search":
        vid = F.col("it.id.videoId")
        pub = X.first_nonempty(F.col("it.snippet.publishedAt"))
    elif kind == "playlist":
        vid = F.col("it.contentDetails.videoId")
        pub = X.first_nonempty(F.col("it.contentDetails.videoPublishedAt"), F.col("it.snippet.publishedAt"))
    else:
        vid = F.col("it.id")
        pub = X.first_nonempty(F.col("it.snippet.publishedAt"))
    out = it.select(
        vid.alias("video_id"),
        X.first_nonempty(F.col("it.snippet.channelId")).alias("channel_id"),
        X.first_nonempty(F.col("it.snippet.channelTitle")).alias("channel_name"),
        X.first_nonempty(F.col("it.snippet.title")).alias("title"),
        pub.alias("published_at"),
    )
    return out.where(F.col("video_id").isNotNull() & (F.col("video_id") != ""))


def flatten_news_pages(pages: DataFrame, json_col: str = "page", query_col: str = "query") -> DataFrame:
    """News search items; missing fields -> ''."""
    it = _items(pages, json_col, NEWS_PAGE, [query_col])
    f = lambda n: F.coalesce(F.col(f"it.{n}"), F.lit("")).alias(n)
    return it.select(F.col(query_col).alias("query"), f("title"), f("description"), f("originallink"),
                     f("link"), f("pubDate"))


def transcript_text(segments_json) -> "F.Column":
    """Transcript array landed as JSON -> segment texts joined with one space."""
    arr = F.from_json(segments_json, TRANSCRIPT)
    return F.array_join(F.transform(arr, lambda s: F.coalesce(s["text"], F.lit(""))), " ")


# ------------------------------------------------------------ landing (test data)

def land_thread_pages(threads: DataFrame) -> DataFrame:
    """Render thread rows as landed API pages: one thread page per top-level comment
    (video_id, page) and reply pages of at most 100 items per parent (parent_id, page).
    Groups are bounded by the page size, never by a thread's size."""
    reply_counts = threads.where(F.col("turn") > 0).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_rep"))
    top = threads.where(F.col("turn") == 0).join(reply_counts, "video_id", "left")
    snip = lambda: F.struct(
        F.col("text").alias("textDisplay"),
        F.lit(None).cast("string").alias("publishedAt"),
        F.col("role").alias("authorDisplayName"),
        F.length("text").cast("long").alias("likeCount"),
    )
    item = F.struct(
        F.struct(
            F.coalesce(F.col("n_rep"), F.lit(0)).cast("int").alias("totalReplyCount"),
            F.struct(F.col("comment_id").alias("id"), snip().alias("snippet")).alias("topLevelComment"),
        ).alias("snippet")
    )
    thread_pages = top.select("video_id", F.to_json(F.struct(F.array(item).alias("items"))).alias("page"))
    rep = threads.where(F.col("turn") > 0).withColumn(
        "page_no", F.floor((F.col("turn") - 1) / REPLIES_PER_PAGE)
    )
    rep_items = rep.groupBy("parent_id", "page_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").alias("k"), F.struct(F.col("comment_id").alias("id"), snip().alias("snippet")).alias("v")))).alias("its")
    )
    reply_pages = rep_items.select(
        "parent_id", "page_no", F.to_json(F.struct(F.transform("its", lambda x: x["v"]).alias("items"))).alias("page")
    )
    return thread_pages, reply_pages

"""Adapter views over the driver's tables, in Spark and as SQL text.

The driver tables carry text without time (`documents`) and time without text
(`events`); the views combine them into the reference's shapes:

  obs      comment observations: one row per event, text taken from a document.
           The keyword is matched on `documents` *before* the join, and only the
           md5 of the text travels, so the fan-out join moves narrow rows.
  cand     candidate videos: one per document, published at an event's time.
  threads  comment threads: `conversations`, turn 0 = top-level, turn > 0 = reply.

Every SQL snippet here is the DuckDB oracle's version of the same view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.plans import sql_match as Q
from kwspread.operators.common import compute_once, spread

# The keyword dictionary of the registered queries, in dictionary
# order (order decides the "first" hit).
KW = ("license", "que", "und", "that")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of a text-heavy table, spread over the task slots when the scan is
    coarser than the cluster (see `operators.common.spread`)."""
    return spread(table(spark, sf_dir, name).select(*cols))


def _count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, from the Parquet footers; one number reaches the driver."""
    return table(spark, sf_dir, name).count()


#: What a query may ask of a document's text; each costs one look at the text.
TEXT_VALUES = ("keyword", "keyword_cs", "text_md5")


def keyed_documents(spark: SparkSession, sf_dir: str, kw=KW, need=TEXT_VALUES) -> DataFrame:
    d = text_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    values = {
        "keyword": lambda: M.first_match(F.col("text"), kw, ci=True),
        "keyword_cs": lambda: M.first_match(F.col("text"), kw, ci=False),
        "text_md5": lambda: F.md5("text"),
    }
    # The values come out of a generator (compute_once), which column pruning can't
    # enter: only what is asked for is put in. Once per document, before any fan-out.
    return compute_once(d, ["doc_id", "lang", "source"], {n: values[n]() for n in need})


def obs(spark: SparkSession, sf_dir: str, kw=KW, need=TEXT_VALUES) -> DataFrame:
    """comment_id, video_id, date (timestamp_ntz), platform, source, doc_id and the
    values of the text that are asked for: keyword, keyword_cs, text_md5"""
    n_docs = _count(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    # Keyed documents are narrow (no text) and computed once per document; at scale
    # this is a sort-merge join on doc_id (AQE splits a hot document), on small
    # inputs the planner broadcasts the smaller side.
    d = keyed_documents(spark, sf_dir, kw, need)
    j = e.join(d, F.pmod(e.event_id, F.lit(n_docs)) == d.doc_id, "inner")
    return j.select(
        F.col("event_id").alias("comment_id"),
        F.col("user_id").alias("video_id"),
        F.col("ts").alias("date"),
        F.col("lang").alias("platform"),
        "source",
        *need,
        "doc_id",
    )


def channel_id_of(source) -> "F.Column":
    """Resolved channel id of a document source: 'UC' + upper(md5(source))."""
    return F.concat(F.lit("UC"), F.upper(F.md5(source)))


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, channel_id, channel_name, title (whole document text), published_at"""
    n_docs = _count(spark, sf_dir, "documents")
    n_ev = _count(spark, sf_dir, "events")
    step = n_ev // n_docs
    d = text_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    j = d.join(e, e.event_id == d.doc_id * F.lit(step), "inner")
    return j.select(
        F.col("doc_id").alias("video_id"),
        channel_id_of(F.col("source")).alias("channel_id"),
        F.col("source").alias("channel_name"),
        F.col("text").alias("title"),
        F.col("ts").alias("published_at"),
    )


def cand_keyed(spark: SparkSession, sf_dir: str, kw=KW, need=("title_md5", "title_hits")) -> DataFrame:
    """`cand` without its text: title_hits (keywords in the title, dictionary order) and
    title_md5, as asked for, are computed on `documents`, so only narrow columns go
    through the join."""
    step = _count(spark, sf_dir, "events") // _count(spark, sf_dir, "documents")
    d = text_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    values = {
        "title_md5": lambda: F.md5(F.coalesce("text", F.lit(""))),
        "title_hits": lambda: M.all_matches_array(F.col("text"), kw, ci=True),
    }
    d = compute_once(d, ["doc_id", "source"], {n: values[n]() for n in need})
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    j = d.join(e, e.event_id == d.doc_id * F.lit(step), "inner")
    return j.select(
        F.col("doc_id").alias("video_id"),
        channel_id_of(F.col("source")).alias("channel_id"),
        F.col("source").alias("channel_name"),
        *need,
        F.col("ts").alias("published_at"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, turn, role, text, comment_id, parent_id, comment_level"""
    c = table(spark, sf_dir, "conversations")
    cid = F.col("conv_id").cast("string")
    return c.select(
        F.col("conv_id").alias("video_id"),
        "turn",
        "role",
        "text",
        F.concat_ws(":", cid, F.col("turn").cast("string")).alias("comment_id"),
        F.when(F.col("turn") == 0, F.lit("")).otherwise(F.concat(cid, F.lit(":0"))).alias("parent_id"),
        F.when(F.col("turn") == 0, F.lit("top")).otherwise(F.lit("reply")).alias("comment_level"),
    )


# ---------------------------------------------------------------- SQL (oracle)

def sql_keyed_documents(kw=KW) -> str:
    return f"""docs_kw AS (
  SELECT doc_id, lang, source, md5(text) AS text_md5,
         {Q.sql_first_match('text', kw, True)} AS keyword,
         {Q.sql_first_match('text', kw, False)} AS keyword_cs
  FROM documents)"""


def sql_obs(kw=KW) -> str:
    return sql_keyed_documents(kw) + """,
obs AS (
  SELECT e.event_id AS comment_id, e.user_id AS video_id, e.ts AS date, d.lang AS platform,
         d.source AS source, d.keyword, d.keyword_cs, d.text_md5, d.doc_id
  FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS doc_key FROM events) e
  JOIN docs_kw d ON e.doc_key = d.doc_id)"""


SQL_CAND = """cand AS (
  SELECT d.doc_id AS video_id, 'UC' || upper(md5(d.source)) AS channel_id, d.source AS channel_name,
         d.text AS title, e.ts AS published_at
  FROM (SELECT *, doc_id * ((SELECT count(*) FROM events) // (SELECT count(*) FROM documents)) AS event_key
        FROM documents) d
  JOIN events e ON e.event_id = d.event_key)"""

SQL_THREADS = """threads AS (
  SELECT conv_id AS video_id, turn, role, text,
         CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS comment_id,
         CASE WHEN turn = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) || ':0' END AS parent_id,
         CASE WHEN turn = 0 THEN 'top' ELSE 'reply' END AS comment_level
  FROM conversations)"""

"""Registered diffusion queries over `obs`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.operators import diffusion as D
from kwspread.operators.common import materialize
from kwspread.plans import sql_match as Q
from kwspread.plans import views as V
from kwspread.plans.registry import register
from kwspread.sources import adapters as A

# Parameter of the registered first-meaningful-week queries (the reference default
# is 5; a larger value makes the threshold bite on the driver's data).
THRESHOLD = 676
WINDOW_DAYS = 7
MCOL = D.meaningful_col(THRESHOLD)


def hits(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return V.obs(spark, sf_dir, need=["keyword", *more]).where(F.col("keyword").isNotNull())


SQL_HITS = "WITH " + V.sql_obs() + ",\nhits AS (SELECT * FROM obs WHERE keyword IS NOT NULL)"
SQL_WEEKLY = SQL_HITS + """,
weekly AS (SELECT keyword, CAST(date_trunc('week', date) AS DATE) AS week, count(*) AS n,
                  min(date) AS first_in_week
           FROM hits GROUP BY 1, 2)"""


@register("weekly_counts", SQL_WEEKLY + """
SELECT keyword, week, n,
       strftime(week, '%Y-%m-%d') || '/' || strftime(week + INTERVAL 6 DAY, '%Y-%m-%d') AS week_label
FROM weekly""")
def weekly_counts(spark, sf_dir):
    """Keyword comments per Monday-week."""
    return D.weekly_counts(hits(spark, sf_dir)).select("keyword", "week", "n", "week_label")


@register("first_observed", SQL_HITS + """
SELECT keyword, min(date) AS first_observed_date FROM hits GROUP BY keyword""")
def first_observed(spark, sf_dir):
    """A1: first observed date per keyword."""
    return D.first_observed(hits(spark, sf_dir))


@register("first_meaningful_week", SQL_WEEKLY + f"""
SELECT keyword, min(CASE WHEN n >= {THRESHOLD} THEN week END) AS {MCOL} FROM weekly GROUP BY keyword""")
def first_meaningful_week(spark, sf_dir):
    """A3: earliest week with n >= threshold (null when none)."""
    return D.first_meaningful_week(D.weekly_counts(hits(spark, sf_dir)), THRESHOLD)


SQL_PEAK = """peak AS (
  SELECT keyword, week AS peak_week, n AS peak_n FROM (
    SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, week ASC) AS rn FROM weekly)
  WHERE rn = 1)"""


@register("peak_week", SQL_WEEKLY + ",\n" + SQL_PEAK + "\nSELECT keyword, peak_week, peak_n FROM peak")
def peak_week(spark, sf_dir):
    """A4: week with the most keyword comments; earliest week on ties."""
    return D.peak_week(D.weekly_counts(hits(spark, sf_dir)))


@register("keyword_summary", SQL_WEEKLY + ",\n" + SQL_PEAK + f"""
SELECT w.keyword, min(w.first_in_week) AS first_observed_date,
       min(CASE WHEN w.n >= {THRESHOLD} THEN w.week END) AS {MCOL},
       any_value(p.peak_week) AS peak_week, any_value(p.peak_n) AS peak_n
FROM weekly w JOIN peak p USING (keyword) GROUP BY w.keyword""")
def keyword_summary(spark, sf_dir):
    """A5: first seen, first meaningful week and peak week per keyword in one aggregate."""
    return D.keyword_summary(hits(spark, sf_dir), THRESHOLD)


@register("weekly_pivot", SQL_WEEKLY + "\nSELECT week, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN keyword = '{k}' THEN n END), 0) AS BIGINT) AS {k}" for k in V.KW
) + " FROM weekly GROUP BY week")
def weekly_pivot(spark, sf_dir):
    """Week x keyword wide table, zero-filled; weeks without any hit are absent."""
    return D.weekly_pivot(D.weekly_counts(hits(spark, sf_dir)), V.KW)


@register("first_hits", SQL_HITS + """
SELECT platform, keyword,
       arg_min(date, (date, comment_id)) AS first_date,
       arg_min(source, (date, comment_id)) AS first_source,
       arg_min(video_id, (date, comment_id)) AS video_id,
       arg_min(text_md5, (date, comment_id)) AS first_text_md5
FROM hits GROUP BY platform, keyword""")
def first_hits(spark, sf_dir):
    """First appearance per platform x keyword (id column = video_id)."""
    h = hits(spark, sf_dir, "text_md5")
    out = D.first_hits(h, text_col="text_md5", tiebreak=("comment_id",))
    return out.withColumnRenamed("first_text", "first_text_md5")


SQL_STARTS = SQL_HITS + """,
starts AS (SELECT platform, keyword, min(date) AS st FROM hits GROUP BY platform, keyword)"""


@register("first_window", SQL_STARTS + f"""
SELECT h.comment_id, h.platform, h.keyword, h.date, s.st AS window_start,
       s.st + INTERVAL {WINDOW_DAYS} DAY AS window_end
FROM hits h JOIN starts s USING (platform, keyword)
WHERE h.date >= s.st AND h.date < s.st + INTERVAL {WINDOW_DAYS} DAY""")
def first_window(spark, sf_dir):
    """Comments within N days of each platform x keyword first appearance."""
    out = D.first_window(hits(spark, sf_dir), WINDOW_DAYS)
    return out.select("comment_id", "platform", "keyword", "date", "window_start", "window_end")


@register("first_day_dump", SQL_STARTS + """
SELECT h.comment_id, h.platform, h.keyword, h.date, CAST(s.st AS DATE) AS first_day
FROM hits h JOIN starts s USING (platform, keyword)
WHERE CAST(h.date AS DATE) = CAST(s.st AS DATE)""")
def first_day_dump(spark, sf_dir):
    """Comments on the calendar day of the first appearance."""
    out = D.first_day(hits(spark, sf_dir))
    return out.select("comment_id", "platform", "keyword", "date", "first_day")


# ----------------------------------------------------------- merge / dedup family
# Two collector outputs derived from `obs`, in the two comment dialects the merge
# step reads: the channel collector (no `query`) and the search collector (`query`,
# and its dates keep a trailing 'Z'). Every comment appears in both.

MERGED_COLS = ["src_file", "date", "platform", "source", "keyword", "video_id", "text", "query"]


def collector_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = materialize(V.obs(spark, sf_dir))  # both collector files derive from it
    return A.union_by_name_conformed(
        [
            A.p4_from_obs(o, with_query=False).withColumn("src_file", F.lit("youtube_collect.csv")),
            A.p4_from_obs(o, with_query=True).withColumn("src_file", F.lit("youtube_search_collect.csv")),
        ],
        MERGED_COLS,
    )


SQL_MERGED = "WITH " + V.sql_obs() + """,
merged AS (
  SELECT 'youtube_collect.csv' AS src_file, strftime(date, '%Y-%m-%dT%H:%M:%S') AS date, platform, source,
         coalesce(keyword_cs, '') AS keyword, CAST(video_id AS VARCHAR) AS video_id, text_md5 AS text,
         CAST(NULL AS VARCHAR) AS query
  FROM obs
  UNION ALL
  SELECT 'youtube_search_collect.csv', strftime(date, '%Y-%m-%dT%H:%M:%S') || 'Z', platform, source,
         coalesce(keyword_cs, ''), CAST(video_id AS VARCHAR), text_md5, coalesce(keyword, '')
  FROM obs)"""

SQL_MERGED_CLEAN = SQL_MERGED + """,
clean AS (
  SELECT src_file, try_cast(replace(trim(date), 'Z', '') AS TIMESTAMP) AS date, trim(platform) AS platform,
         source, trim(keyword) AS keyword, video_id, trim(text) AS text, query
  FROM merged)"""


@register("merge_union_by_name", SQL_MERGED + "\nSELECT * FROM merged")
def merge_union_by_name(spark, sf_dir):
    """Union of dialects by column name; absent columns become null/''."""
    return collector_outputs(spark, sf_dir)


@register("merge_clean_dedup", SQL_MERGED_CLEAN + """
SELECT src_file, date, platform, source, keyword, video_id, text, query FROM (
  SELECT *, row_number() OVER (PARTITION BY date, video_id, keyword, text ORDER BY src_file) AS rn
  FROM clean WHERE date IS NOT NULL)
WHERE rn = 1""")
def merge_clean_dedup(spark, sf_dir):
    """Parse, drop bad dates, strip, keep earliest per (date, video, keyword, text)."""
    m = collector_outputs(spark, sf_dir)
    c = A.clean_merged(m)
    out = D.dedup_earliest(c, D.key_columns(D.MERGE_KEY, c), tiebreak=("src_file",))
    return out.select(*MERGED_COLS)


@register("dedup_id_aware", SQL_MERGED_CLEAN + """
SELECT src_file, date, platform, source, keyword, video_id, text, query FROM (
  SELECT *, row_number() OVER (PARTITION BY date, platform, video_id, keyword, text ORDER BY src_file) AS rn
  FROM clean WHERE date IS NOT NULL AND keyword <> '' AND text <> '')
WHERE rn = 1""")
def dedup_id_aware(spark, sf_dir):
    """D3/M6: drop blank keyword/text, dedup on date, platform, id column, keyword, text."""
    m = collector_outputs(spark, sf_dir)
    c = D.clean_hits(A.clean_merged(m), text_col="text")
    out = D.dedup_earliest(c, D.key_columns(D.ID_AWARE_KEY, c), tiebreak=("src_file",))
    return out.select(*MERGED_COLS)


@register("comments_canonical_union", "WITH " + V.sql_obs() + ",\n" + V.SQL_THREADS + """
SELECT CAST(NULL AS VARCHAR) AS comment_id, CAST(NULL AS VARCHAR) AS parent_id,
       CAST(NULL AS VARCHAR) AS comment_level, platform, source, CAST(video_id AS VARCHAR) AS video_id,
       keyword_cs AS keyword, CAST(NULL AS VARCHAR) AS query, date AS published_at, text_md5,
       CAST(NULL AS BIGINT) AS like_count
FROM obs WHERE keyword_cs IS NOT NULL
UNION ALL
SELECT comment_id, parent_id, comment_level, 'youtube', 'threads', CAST(video_id AS VARCHAR),
       """ + Q.sql_first_match("text", V.KW, True) + """,
       NULL, NULL, md5(trim(replace(text, chr(10), ' '))), CAST(length(text) AS BIGINT)
FROM threads
WHERE """ + Q.sql_first_match("text", V.KW, True) + " IS NOT NULL")
def comments_canonical_union(spark, sf_dir):
    """Comment dialects (collector P4, thread scan P2) mapped to one canonical schema."""
    return A.canonical_union(V.obs(spark, sf_dir, need=["keyword_cs", "text_md5"]), V.threads(spark, sf_dir), V.KW)


@register("distinct_videos_sketched", SQL_HITS + """
SELECT keyword, count(DISTINCT video_id) AS n_videos, count(DISTINCT comment_id) AS n_comments, true AS within_bound FROM hits GROUP BY keyword""")
def distinct_videos_sketched(spark, sf_dir):
    """Weekly sketches of videos and comments add up to estimates within the stated
    error of the exact counts."""
    h = materialize(hits(spark, sf_dir).select("keyword", "date", "video_id", "comment_id"))
    exact = h.groupBy("keyword").agg(F.count_distinct("video_id").alias("n_videos"), F.count_distinct("comment_id").alias("n_comments"))
    for id_col, n in (("video_id", "n_videos"), ("comment_id", "n_comments")):
        told = D.sketched_distinct(D.weekly_sketches(h, id_col)).withColumnRenamed("n_estimated", f"{n}_estimated")
        exact = exact.join(told, "keyword")
    near = lambda n: F.abs(F.col(f"{n}_estimated") - F.col(n)) <= F.ceil(F.col(n) * D.SKETCH_ERROR)
    return exact.select("keyword", "n_videos", "n_comments", (near("n_videos") & near("n_comments")).alias("within_bound"))

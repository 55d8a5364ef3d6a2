"""Registered queries that run the streaming jobs over landed files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kwspread.operators import diffusion as D
from kwspread.plans import sql_match as Q
from kwspread.plans import views as V
from kwspread.plans.registry import register
from kwspread.session import ensure_checkpoint_dir
from kwspread.streaming import ingest as S

#: Landed lines that are cut in the middle, by rule (modulus, remainder of doc_id), and
#: documents that are landed twice.
CUT_LINES, TWICE = (97, 5), (10, 0)
LANDED_FILES = 6
DELAY_DAYS = 7


def land_comments(spark, sf_dir, folder):
    """Candidate titles landed as comments, in an order unlike that of their times."""
    rows = V.cand(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("video_id").cast("string")).alias("comment_id"), F.lit("").alias("parent_id"),
        F.lit("top").alias("comment_level"), F.col("channel_name").alias("video_id"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("published_at"), F.col("title").alias("text"),
        F.col("video_id").alias("k"),
    )
    line = F.to_json(F.struct("comment_id", "parent_id", "comment_level", "video_id", "published_at", "text"))
    cut = F.col("k") % CUT_LINES[0] == CUT_LINES[1]
    twice = F.when((F.col("k") % TWICE[0] == TWICE[1]) & ~cut, 2).otherwise(1)
    lines = rows.select(F.when(cut, F.expr("left(comment_id, 1) || ' {'")).otherwise(line).alias("value"),
                        F.explode(F.sequence(F.lit(1), twice)).alias("copy"), F.md5(F.col("k").cast("string")).alias("o"))
    lines.repartitionByRange(LANDED_FILES, "copy", "o").select("value").write.text(folder)


@register("stream_weekly_counts", "WITH " + V.SQL_CAND + f""",
hits AS (SELECT {Q.sql_first_match('title', V.KW, True)} AS keyword, published_at AS date FROM cand
         WHERE video_id % {CUT_LINES[0]} <> {CUT_LINES[1]})
SELECT keyword, CAST(date_trunc('week', date) AS DATE) AS week, count(*) AS n
FROM hits WHERE keyword IS NOT NULL GROUP BY ALL
UNION ALL
SELECT '(rejected lines)', NULL, count(*) FROM cand WHERE video_id % {CUT_LINES[0]} = {CUT_LINES[1]}""")
def stream_weekly_counts(spark, sf_dir):
    """Files landed out of order, with repeated and cut lines, through both streams:
    weeks that the watermark closed, weeks still open in state and late rows add up to
    the batch counts."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    land_comments(spark, sf_dir, f"{base}/landing")
    S.start_comment_ingest(spark, f"{base}/landing", f"{base}/comments", f"{base}/ck-comments", V.KW,
                           max_files_per_trigger=2, delay_days=DELAY_DAYS).awaitTermination()
    S.start_weekly_counts(spark, f"{base}/comments", f"{base}/counts", f"{base}/ck-counts", DELAY_DAYS,
                          max_files_per_trigger=2).awaitTermination()
    closed = spark.read.schema("keyword string, week date, n long").parquet(f"{base}/counts")
    late = spark.read.schema(S.STORED_SCHEMA + ", late boolean").parquet(f"{base}/comments").where("late")
    late = D.weekly_counts(late.select(F.col("matched_keyword").alias("keyword"), F.col("published_at").alias("date")))
    counts = closed.unionByName(S.open_weeks(spark, f"{base}/ck-counts")).unionByName(late.select("keyword", "week", "n"))
    rejected = S.progress_table(spark, f"{base}/comments").agg(F.sum("rejected").alias("n"))
    return counts.groupBy("keyword", "week").agg(F.sum("n").alias("n")).unionByName(
        rejected.select(F.lit("(rejected lines)").alias("keyword"), F.lit(None).cast("date").alias("week"), "n"))

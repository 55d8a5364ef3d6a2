"""Registered queries over landed and exported files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kwspread.operators import diffusion as D
from kwspread.operators.common import require_columns
from kwspread.plans import views as V
from kwspread.plans.diffusion_queries import SQL_MERGED, SQL_STARTS, WINDOW_DAYS, collector_outputs, hits
from kwspread.plans.registry import register
from kwspread.session import ensure_checkpoint_dir
from kwspread.sources import csv_edge as E
from kwspread.sources import folders
from kwspread.sources import landed_json as J

CSV_COLS = ["date", "platform", "source", "keyword", "video_id", "text", "note", "query"]
#: Folders of the two collectors, with names that paths have to carry unharmed.
CHANNEL_DIR, SEARCH_DIR = "channel data 100%", "search+more [1]"


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def land_csv(spark, sf_dir, base):
    """The two collector outputs as CSV files: two headers, one with a byte order mark,
    equal file names in both folders, quotes and line ends in cells, and two files
    without rows."""
    rows = collector_outputs(spark, sf_dir).withColumn("note", F.concat(F.lit('a "b",\n'), "platform"))
    own = rows.where("src_file = 'youtube_collect.csv'").select("date", "platform", "source", "keyword", "video_id", "text", "note")
    found = rows.where("src_file <> 'youtube_collect.csv'").select("note", "query", "date", "platform", "source", "keyword", "video_id", "text")
    for df, name, bom in ((own, CHANNEL_DIR, True), (found, SEARCH_DIR, False)):
        E.write_csv(df.repartition(3, "platform", "video_id"), f"{base}/{name}", bom=bom)
        files = [f for f in folders.children(spark, f"{base}/{name}") if f.startswith("part-")]
        for k, old in enumerate(files):
            folders.rename(spark, f"{base}/{name}/{old}", f"{base}/{name}/out {k}.csv")
    folders.write_bytes(spark, f"{base}/deep/out 0.csv", b"")
    folders.write_bytes(spark, f"{base}/deep/head.csv", b"date,text\n")


@register("csv_read_back", SQL_MERGED + f"""
SELECT CASE WHEN src_file = 'youtube_collect.csv' THEN '{CHANNEL_DIR}' ELSE '{SEARCH_DIR}' END AS folder,
       date, platform, source, nullif(keyword, '') AS keyword, video_id, text, 'a "b",' || chr(10) || platform AS note,
       nullif(query, '') AS query, CAST(NULL AS VARCHAR) AS reason
FROM merged
UNION ALL SELECT 'deep/out 0.csv', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'empty'
UNION ALL SELECT 'deep/head.csv', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no rows'""")
def csv_read_back(spark, sf_dir):
    """CSV written and read back by name, with lineage by full path, and
    the files without rows told."""
    base = scratch(spark, "csv")
    land_csv(spark, sf_dir, base)
    files = E.csv_files(spark, [base])
    rows = E.read_csv_layout(spark, base, cols=CSV_COLS, src_col=None, path_col="path", files=files)
    rows = require_columns(rows, ["date", "keyword", "text"], "collector files")
    skipped = E.skipped_files(spark, base, rows, files=files)
    folder = F.element_at(F.split("path", "/"), -2)
    short = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    told = skipped.select(short.alias("folder"), *[F.lit(None).cast("string").alias(c) for c in CSV_COLS], "reason")
    return rows.select(folder.alias("folder"), *CSV_COLS, F.lit(None).cast("string").alias("reason")).unionByName(told)


@register("ordered_dump", SQL_STARTS + f""",
win AS (SELECT h.platform, h.keyword, h.date, h.comment_id
        FROM hits h JOIN starts s USING (platform, keyword)
        WHERE h.date >= s.st AND h.date < s.st + INTERVAL {WINDOW_DAYS} DAY)
SELECT platform, keyword, date, comment_id,
       row_number() OVER (PARTITION BY platform, keyword ORDER BY date, comment_id) AS position
FROM win""")
def ordered_dump(spark, sf_dir):
    """The first-appearance window dumped per platform and keyword in order, and
    the order read back from the files."""
    path = scratch(spark, "dump")
    out = D.first_window(hits(spark, sf_dir), WINDOW_DAYS).select("platform", "keyword", "date", "comment_id")
    E.write_ordered(out, path, ["platform", "keyword"], ["date", "comment_id"], rows_per_file=500)
    return E.read_ordered(spark, path, out.schema, ["platform", "keyword"])


# Landed search, playlist, metadata and news pages (S11, S12), by rule from the tables:
# every tenth page is cut, every seventh item lacks fields.
def _video_pages(spark, sf_dir):
    c = V.cand(spark, sf_dir)
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    poor = F.col("video_id") % 7 == 3
    vid = F.when(F.col("video_id") % 31 != 4, F.col("video_id").cast("string"))
    snippet = F.struct(
        F.when(~poor, F.md5("title")).alias("title"), F.col("channel_id").alias("channelId"),
        F.when(~poor, F.col("channel_name")).alias("channelTitle"), F.when(~poor, stamp).alias("publishedAt"),
    )
    kind = F.element_at(F.array(F.lit("search"), F.lit("playlist"), F.lit("videos")), (F.col("video_id") % 3 + 1).cast("int"))
    item = (
        F.when(kind == "search", F.to_json(F.struct(F.struct(vid.alias("videoId")).alias("id"), snippet.alias("snippet"))))
        .when(kind == "playlist", F.to_json(F.struct(
            F.struct(vid.alias("videoId"), F.when(poor, stamp).alias("videoPublishedAt")).alias("contentDetails"), snippet.alias("snippet"))))
        .otherwise(F.to_json(F.struct(vid.alias("id"), snippet.alias("snippet"))))
    )
    listed = c.select(kind.alias("kind"), F.floor(F.col("video_id") / 30).alias("page_no"), F.col("video_id").alias("k"), item.alias("item"))
    items = listed.groupBy("kind", "page_no").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("its"))  # ten a page
    page = F.concat(F.lit('{"items": ['), F.array_join(F.transform("its", lambda x: x["item"]), ", "), F.lit("]}"))
    pages = items.select("kind", "page_no", page.alias("page"))
    return pages.select("kind", F.when(F.col("page_no") % 10 == 9, F.expr("left(page, 40)")).otherwise(F.col("page")).alias("page"))


@register("flatten_video_pages", "WITH " + V.SQL_CAND + """
SELECT CASE video_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'playlist' ELSE 'videos' END AS kind,
       CAST(video_id AS VARCHAR) AS video_id, channel_id,
       CASE WHEN video_id % 7 <> 3 THEN channel_name ELSE '' END AS channel_name,
       CASE WHEN video_id % 7 <> 3 THEN md5(title) ELSE '' END AS title,
       CASE WHEN video_id % 7 <> 3 OR video_id % 3 = 1 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS published_at
FROM cand WHERE (video_id // 30) % 10 <> 9 AND video_id % 31 <> 4""")
def flatten_video_pages(spark, sf_dir):
    """Landed search, playlist and metadata pages -> video rows with an id; cut pages
    give none."""
    pages = _video_pages(spark, sf_dir)
    parts = [
        J.flatten_video_pages(pages.where(F.col("kind") == k), k).select(F.lit(k).alias("kind"), "*")
        for k in ("search", "playlist", "videos")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("flatten_news_pages", """
SELECT 'q' || CAST(page_id % 5 AS VARCHAR) AS query, coalesce(url, '') AS link,
       CASE WHEN page_id % 4 <> 1 THEN md5(html) ELSE '' END AS title,
       CASE WHEN page_id % 3 = 0 THEN 'http://origin.example/' || CAST(page_id AS VARCHAR) ELSE '' END AS originallink,
       '' AS description, CAST(page_id AS VARCHAR) AS "pubDate"
FROM pages WHERE (page_id // 50) % 10 <> 9""")
def flatten_news_pages(spark, sf_dir):
    """Landed news search pages -> items; missing fields are empty."""
    p = V.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    item = F.to_json(F.struct(
        F.when(F.col("page_id") % 4 != 1, F.md5("html")).alias("title"), F.col("url").alias("link"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://origin.example/"), F.col("page_id").cast("string"))).alias("originallink"),
        F.col("page_id").cast("string").alias("pubDate"),
    ))
    listed = p.select((F.col("page_id") % 5).alias("q"), F.floor(F.col("page_id") / 50).alias("n"), "page_id", item.alias("item"))
    items = listed.groupBy("q", "n").agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("its"))  # ten a page
    text = F.concat(F.lit('{"items": ['), F.array_join(F.transform("its", lambda x: x["item"]), ","), F.lit("]}"))
    pages = items.select("n", F.concat(F.lit("q"), F.col("q").cast("string")).alias("query"), text.alias("page"))
    pages = pages.select("query", F.when(F.col("n") % 10 == 9, F.expr("left(page, 25)")).otherwise(F.col("page")).alias("page"))
    return J.flatten_news_pages(pages).select("query", "link", "title", "originallink", "description", "pubDate")


RUN_DAYS = ("2024-01-05", "2024-01-06")


@register("append_by_run_day", "WITH " + V.sql_obs() + f"""
SELECT CAST(run_day AS DATE) AS run_day, keyword, count(*) AS n FROM (
  SELECT '{RUN_DAYS[0]}' AS run_day, keyword FROM obs WHERE keyword IS NOT NULL AND comment_id % 2 = 0
  UNION ALL SELECT '{RUN_DAYS[1]}', keyword FROM obs WHERE keyword IS NOT NULL AND comment_id % 3 = 0)
GROUP BY ALL""")
def append_by_run_day(spark, sf_dir):
    """Two runs appended under their own day, matched with a dictionary file of
    the cluster's store, counted from what was written."""
    base = scratch(spark, "runs")
    listed = "".join(f"  - ' {k} '\n" for k in V.KW)
    folders.write_bytes(spark, f"{base}/keywords.yaml", f"keywords:\n{listed}  - ''\n".encode())
    kws = tuple(E.load_keywords(f"{base}/keywords.yaml", spark=spark))
    found = V.obs(spark, sf_dir, kws, need=["keyword"]).where(F.col("keyword").isNotNull()).select("comment_id", "keyword")
    for day, n in zip(RUN_DAYS, (2, 3), strict=True):
        rows = E.with_run_day(found.where(F.col("comment_id") % n == 0), day)
        E.write_parquet(rows, f"{base}/table", mode="append", partition_by=["run_day"])
    stored = spark.read.schema("comment_id long, keyword string, run_day date").parquet(f"{base}/table")
    return stored.groupBy("run_day", "keyword").agg(F.count("*").alias("n"))

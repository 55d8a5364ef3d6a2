"""Registered candidate-pool queries over `cand`."""

from __future__ import annotations

from pyspark.sql import functions as F

from kwspread.functions import text as X
from kwspread.functions import timefmt as T
from kwspread.operators import candidates as C
from kwspread.plans import views as V
from kwspread.plans.matching_queries import SQL_RAW_CHANNEL, raw_channel_input
from kwspread.plans.registry import register

# Parameters of the registered queries: two overlapping search periods, caps.
PERIODS = [("2024-01-01", "2024-01-16"), ("2024-01-10", "2024-01-31")]
LATEST_N = 30


def channel_inputs(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", raw_channel_input(F.col("source"), F.col("lang")).alias("raw"))


def pool(spark, sf_dir):
    videos = V.cand_keyed(spark, sf_dir)
    chans = C.resolved_channels(channel_inputs(spark, sf_dir))
    return C.candidate_pool(videos, V.KW, PERIODS, chans, title_col="title_md5", hits_col="title_hits")


def pool_out(p):
    return p.select(
        "video_id", "channel_id", "channel_name", "title_md5",
        F.date_format("published_at", T.ISO_Z).alias("published_at"), "source",
    )


_KW_VALUES = ", ".join(f"({i}, '{k}')" for i, k in enumerate(V.KW))
_PER_VALUES = ", ".join(f"({i}, '{s}', '{e}')" for i, (s, e) in enumerate(PERIODS))
_NTAGS = len(V.KW) * len(PERIODS)

SQL_POOL = "WITH " + V.SQL_CAND + f""",
kw(kord, kw) AS (VALUES {_KW_VALUES}),
per(pord, s, e) AS (VALUES {_PER_VALUES}),
kwtags AS (
  SELECT c.video_id, kord * {len(PERIODS)} + pord AS ord, kw, 'keyword:' || kw || '@' || s || '..' || e AS tag
  FROM cand c, kw, per
  WHERE contains(lower(c.title), lower(kw))
    AND c.published_at >= CAST(s AS TIMESTAMP) AND c.published_at < CAST(e AS TIMESTAMP)),
chans AS (
  SELECT channel_id, min(doc_id) AS ch_ord FROM (
    SELECT doc_id, CASE WHEN starts_with(trim(raw), 'UC') AND length(trim(raw)) >= 10 THEN trim(raw)
                        ELSE nullif(regexp_extract(trim(raw), '(UC[A-Za-z0-9_-]{{10,}})', 1), '') END AS channel_id
    FROM (SELECT doc_id, {SQL_RAW_CHANNEL} AS raw FROM documents))
  WHERE channel_id IS NOT NULL GROUP BY channel_id),
chtags AS (
  SELECT c.video_id, {_NTAGS} + ch.ch_ord AS ord, 'channel:' || c.channel_id AS tag
  FROM cand c JOIN chans ch USING (channel_id)),
tags AS (SELECT video_id, ord, tag FROM kwtags UNION ALL SELECT video_id, ord, tag FROM chtags),
merged AS (SELECT video_id, string_agg(tag, ';' ORDER BY ord) AS source, count(*) AS n_tags
           FROM tags GROUP BY video_id),
pool AS (
  SELECT c.video_id, c.channel_id, c.channel_name, md5(c.title) AS title_md5,
         strftime(c.published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at, m.source, c.published_at AS pts
  FROM merged m JOIN cand c USING (video_id)),
picked AS (
  SELECT DISTINCT p.video_id, p.channel_id, p.published_at, p.pts, t.kw AS picked_by_keyword
  FROM pool p JOIN kwtags t USING (video_id))"""


@register("candidate_pool", SQL_POOL + """
SELECT video_id, channel_id, channel_name, title_md5, published_at, source FROM pool""")
def candidate_pool(spark, sf_dir):
    """Keyword x period search pool union channel uploads, provenance-merged."""
    return pool_out(pool(spark, sf_dir))


@register("provenance_merge", SQL_POOL + "\nSELECT video_id, source, n_tags FROM merged")
def provenance_merge(spark, sf_dir):
    """Distinct provenance tags per video in first-insertion order."""
    p = pool(spark, sf_dir)
    return p.select("video_id", "source", F.size(F.split("source", ";")).cast("long").alias("n_tags"))


@register("provenance_parse", SQL_POOL + """
SELECT video_id, coalesce(string_agg(picked_by_keyword, ';' ORDER BY kord), '') AS picked_keywords
FROM (SELECT DISTINCT p.video_id, t.kw AS picked_by_keyword, t.kord
      FROM pool p LEFT JOIN (SELECT video_id, kw, kord FROM kwtags JOIN kw USING (kw)) t USING (video_id))
GROUP BY video_id""")
def provenance_parse(spark, sf_dir):
    """keywords back out of the ';'-joined provenance text (ordered, distinct)."""
    p = pool(spark, sf_dir)
    return p.select("video_id", F.array_join(X.keywords_from_provenance(F.col("source")), ";").alias("picked_keywords"))


def _sample(spark, sf_dir, mode):
    ex = C.explode_picked(pool(spark, sf_dir))
    s = C.sample_per_keyword(ex, mode)
    return s.select("picked_by_keyword", "video_id", "channel_id",
                    F.date_format("published_at", T.ISO_Z).alias("published_at"))


def _sql_sample(order):
    return SQL_POOL + f"""
SELECT picked_by_keyword, video_id, channel_id, published_at FROM (
  SELECT *, row_number() OVER (PARTITION BY picked_by_keyword ORDER BY {order}) AS rn FROM picked)
WHERE rn <= {C.SAMPLE_N}"""


@register("sample_oldest", _sql_sample("pts ASC NULLS LAST, video_id"))
def sample_oldest(spark, sf_dir):
    """N oldest candidates per picked keyword (nulls last, ties by id)."""
    return _sample(spark, sf_dir, "oldest")


@register("sample_newest", _sql_sample("pts DESC NULLS LAST, video_id"))
def sample_newest(spark, sf_dir):
    """N newest candidates per picked keyword."""
    return _sample(spark, sf_dir, "newest")


@register("sample_random", _sql_sample(f"md5('{C.SAMPLE_SEED}:' || CAST(video_id AS VARCHAR)), video_id"))
def sample_random(spark, sf_dir):
    """Seeded, engine-independent hash sample of min(N, size) per keyword."""
    return _sample(spark, sf_dir, "random")


@register("videos_per_keyword", SQL_POOL + """
SELECT picked_by_keyword, count(DISTINCT video_id) AS n_videos FROM picked GROUP BY picked_by_keyword""")
def videos_per_keyword(spark, sf_dir):
    """Distinct candidate videos per picked keyword."""
    ex = C.explode_picked(pool(spark, sf_dir))
    return ex.groupBy("picked_by_keyword").agg(F.count_distinct("video_id").alias("n_videos"))


# Page metadata used to hydrate candidates (page_id = video id).
def page_meta(spark, sf_dir):
    p = V.text_table(spark, sf_dir, "pages", "page_id", "html")
    return p.select(
        F.col("page_id").alias("video_id"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", r"&copy; ([^ <]+)", 1).alias("new_channel_name"),
    ).withColumn("new_title_md5", F.when(F.col("title") != "", F.md5("title")).otherwise(F.lit(""))).drop("title")


@register("hydrate_coalesce", "WITH " + V.SQL_CAND + r""",
meta AS (SELECT page_id AS video_id,
                regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS new_title,
                regexp_extract(html, '&copy; ([^ <]+)', 1) AS new_channel_name FROM pages)
SELECT c.video_id, md5(coalesce(nullif(m.new_title, ''), nullif(c.title, ''), '')) AS title_md5,
       coalesce(nullif(m.new_channel_name, ''), nullif(c.channel_name, ''), '') AS channel_name
FROM cand c LEFT JOIN meta m USING (video_id)""")
def hydrate_coalesce(spark, sf_dir):
    """Non-empty metadata overrides; missing metadata keeps the old values."""
    h = C.hydrate(V.cand_keyed(spark, sf_dir, need=["title_md5"]), page_meta(spark, sf_dir), ["title_md5", "channel_name"])
    return h.select("video_id", "title_md5", "channel_name")


@register("channel_uploads", SQL_POOL + """
SELECT c.video_id, c.channel_id, c.published_at FROM cand c JOIN chans USING (channel_id)""")
def channel_uploads(spark, sf_dir):
    """All uploads of the channels whose inputs resolve; unresolved inputs skipped."""
    chans = C.resolved_channels(channel_inputs(spark, sf_dir))
    v = V.cand(spark, sf_dir).select("video_id", "channel_id", "published_at")
    return v.join(chans, "channel_id", "left_semi").select("video_id", "channel_id", "published_at")


@register("latest_videos_per_channel", "WITH " + V.SQL_CAND + f"""
SELECT video_id, channel_id, published_at, rank FROM (
  SELECT video_id, channel_id, published_at,
         row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC NULLS LAST, video_id) AS rank
  FROM cand) WHERE rank <= {LATEST_N}""")
def latest_videos_per_channel(spark, sf_dir):
    """Newest N uploads per channel."""
    v = V.cand(spark, sf_dir).select("video_id", "channel_id", "published_at")
    return C.latest_per_channel(v, LATEST_N).select("video_id", "channel_id", "published_at", F.col("rank").cast("long"))

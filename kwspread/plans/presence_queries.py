"""Registered first-presence bracket query (A13) over `cand` + `obs`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kwspread.operators import presence as PR
from kwspread.operators.common import materialize
from kwspread.plans import views as V
from kwspread.plans.registry import register

# Parameters of the registered query (the reference's command-line defaults for
# videos, pages and steps; a search range around the driver's data).
START, END = dt.datetime(2020, 1, 1), dt.datetime(2024, 3, 1)
MAX_VIDEOS = 120
MAX_COMMENTS = PR.DEFAULT_MAX_COMMENTS
ITERS = 16

_KW_VALUES = ", ".join(f"({i}, '{k}')" for i, k in enumerate(V.KW))


def found(spark, sf_dir):
    o = materialize(V.obs(spark, sf_dir, need=["keyword_cs"]).select(  # read three times by newest_n_any
        F.col("doc_id").alias("video_id"), "comment_id", "date", F.col("keyword_cs").isNotNull().alias("hit")
    ))
    hits = PR.newest_n_any(o, MAX_COMMENTS, "hit")
    return PR.found_videos(V.cand_keyed(spark, sf_dir, need=["title_hits"]), hits, V.KW, hits_col="title_hits")


SQL_BRACKET = "WITH RECURSIVE " + V.sql_obs() + ",\n" + V.SQL_CAND + f""",
kw(kord, kw) AS (VALUES {_KW_VALUES}),
ranked AS (SELECT doc_id AS video_id, keyword_cs,
                  row_number() OVER (PARTITION BY doc_id ORDER BY date DESC, comment_id) AS rn FROM obs),
vh AS (SELECT video_id, bool_or(keyword_cs IS NOT NULL) AS hit FROM ranked WHERE rn <= {MAX_COMMENTS} GROUP BY video_id),
found AS (SELECT kw AS keyword, c.video_id, c.published_at, coalesce(vh.hit, false) AS hit
          FROM cand c JOIN kw ON contains(lower(c.title), lower(kw)) LEFT JOIN vh USING (video_id)),
st(keyword, it, low, high, seen, trace) AS (
  SELECT kw, 0, TIMESTAMP '{START:%Y-%m-%d %H:%M:%S}', TIMESTAMP '{END:%Y-%m-%d %H:%M:%S}', false, '' FROM kw
  UNION ALL
  SELECT keyword, it + 1,
         CASE WHEN ex THEN low ELSE mid END, CASE WHEN ex THEN mid ELSE high END, seen OR ex,
         trace || CASE WHEN it = 0 THEN '' ELSE ', ' END || '(''' || strftime(mid, '%Y-%m-%d') || ''', '
               || CASE WHEN ex THEN 'True' ELSE 'False' END || ')'
  FROM (
    SELECT s.*, m.mid,
           (SELECT coalesce(bool_or(hit), false) FROM (
              SELECT hit FROM found f WHERE f.keyword = s.keyword AND f.published_at < m.mid
              ORDER BY f.published_at DESC, f.video_id LIMIT {MAX_VIDEOS})) AS ex
    FROM st s, LATERAL (SELECT make_timestamp(epoch_us(s.low) + (epoch_us(s.high) - epoch_us(s.low)) // 2) AS mid) m
    WHERE s.it < {ITERS} AND s.high - s.low > INTERVAL 2 DAY)),
fin AS (SELECT * FROM st WHERE (keyword, it) IN (SELECT (keyword, max(it)) FROM st GROUP BY keyword)),
exact AS (SELECT keyword, min(published_at) AS exact_first_presence FROM found WHERE hit GROUP BY keyword)
SELECT f.keyword, f.seen AS found_presence, CAST(f.low AS DATE) AS lower_bound_no_presence,
       CASE WHEN f.seen THEN CAST(f.high AS DATE) END AS upper_bound_presence,
       CASE WHEN f.seen THEN CAST((epoch_us(f.high) - epoch_us(f.low)) // 86400000000 AS BIGINT) END AS window_days,
       '[' || f.trace || ']' AS trace, CAST(f.it AS BIGINT) AS steps, e.exact_first_presence
FROM fin f LEFT JOIN exact e USING (keyword)"""


@register("first_presence_bracket", SQL_BRACKET)
def first_presence_bracket(spark, sf_dir):
    """Bisection on time for each keyword's first presence (capped, heuristic as
    in the reference), plus the uncapped exact earliest hit."""
    return PR.first_presence(spark, found(spark, sf_dir), V.KW, START, END, MAX_VIDEOS, ITERS)

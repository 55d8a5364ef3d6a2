"""Registered page queries (M8, F15, D4, S18, S19) over `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.operators import pages as P
from kwspread.plans import sql_match as Q
from kwspread.plans import views as V
from kwspread.plans.registry import register

# Parameters of the registered queries: the news domain tested by substring, and
# the selector priority lists (first selector with any hit wins).
DOMAIN = "example.com"
TEXT_SELECTORS = ("div.comment", "article p", "div.ad")
DATE_SELECTORS = ("span.date", "b")


def news_rows(spark, sf_dir):
    """A news-search result per page: link = page URL, originallink = the publisher
    host named in the page footer, title from <title>."""
    p = V.text_table(spark, sf_dir, "pages", "page_id", "url", "html")
    host = F.regexp_extract("html", r"&copy; ([^ <]+)", 1)
    return p.select(
        F.col("page_id").alias("ord"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        F.when(host != "", F.concat(F.lit("https://"), host, F.lit("/"))).alias("originallink"),
    )


@register("url_filter_prefer_dedup", f"""
SELECT ord, link, originallink, naver_url, md5(title) AS title_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY naver_url ORDER BY ord) AS rn FROM (
    SELECT *, CASE WHEN coalesce(contains(link, '{DOMAIN}'), false) THEN link ELSE originallink END AS naver_url
    FROM (SELECT page_id AS ord, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url AS link,
                 CASE WHEN regexp_extract(html, '&copy; ([^ <]+)', 1) <> ''
                      THEN 'https://' || regexp_extract(html, '&copy; ([^ <]+)', 1) || '/' END AS originallink
          FROM pages)
    WHERE coalesce(contains(link, '{DOMAIN}'), false) OR coalesce(contains(originallink, '{DOMAIN}'), false)))
WHERE rn = 1""")
def url_filter_prefer_dedup(spark, sf_dir):
    """On-domain links, preferred URL, first row per preferred URL."""
    out = P.news_links(news_rows(spark, sf_dir), DOMAIN)
    return out.select("ord", "link", "originallink", "naver_url", F.md5("title").alias("title_md5"))


# The oracle knows nothing of selectors: the driver's pages have one article of <p>
# blocks (some unclosed, ended by the next <p>), and <b> only inside those. It cuts the
# article at "<p>" and each block at "</p>", and takes <b> up to the end of its block.
_SQL_PLAIN = """trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&middot;', chr(183)), '&amp;', '&'), '\\s+', ' ', 'g'))"""

_SQL_BLOCKS = f"""loaded AS (
  SELECT page_id, url, string_split(string_split(string_split(html, '<article>')[2], '</article>')[1], '<p>')[2:] AS raw
  FROM pages WHERE contains(lower(html), '</html>')),
blocks AS (
  SELECT page_id, url, CAST(i - 1 AS INTEGER) AS pos, string_split(raw[i], '</p>')[1] AS block
  FROM (SELECT *, unnest(generate_series(1, len(raw))) AS i FROM loaded)),
bold AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos,
         {_SQL_PLAIN.format("string_split(string_split(block, '<b>')[2], '</b>')[1]")} AS date
  FROM blocks WHERE contains(block, '<b>')),
texts AS (SELECT page_id, url, pos, block, {_SQL_PLAIN.format('block')} AS text FROM blocks)"""


@register("page_extract_first_selector", "WITH " + _SQL_BLOCKS + f"""
SELECT page_id, url, pos, md5(text) AS text_md5, date, keyword FROM (
  SELECT t.page_id, t.url, t.pos, t.text, coalesce(b.date, '') AS date, {Q.sql_first_match('t.text', V.KW, False)} AS keyword
  FROM texts t LEFT JOIN bold b ON b.page_id = t.page_id AND b.pos = t.pos WHERE t.text <> '')
WHERE keyword IS NOT NULL""")
def page_extract_first_selector(spark, sf_dir):
    """Comments from loaded pages by selector priority, positional date
    pairing, case-sensitive keyword filter."""
    p = V.text_table(spark, sf_dir, "pages", "page_id", "url", "html").where(~P.page_failed(F.col("html")))
    rows = P.extract_first_selector(p, TEXT_SELECTORS, DATE_SELECTORS, keep=("page_id", "url"))
    hits = P.keyword_filter(rows, V.KW)
    return hits.select("page_id", "url", "pos", F.md5("text").alias("text_md5"), "date", "keyword")


@register("page_error_rows", """
SELECT page_id, url, '' AS keyword, '' AS comment_text, '' AS comment_date_raw,
       'page did not finish loading' AS error
FROM pages WHERE NOT coalesce(contains(lower(html), '</html>'), false)""")
def page_error_rows(spark, sf_dir):
    """Failed pages become quarantine rows with an error and blank fields."""
    return P.error_rows(V.table(spark, sf_dir, "pages"))


@register("page_extract_nested", "WITH " + _SQL_BLOCKS + f"""
SELECT page_id, url, pos, md5(text) AS text_md5, date, keyword FROM (
  SELECT page_id, url, pos, text, {Q.sql_first_match('text', V.KW, False)} AS keyword,
         CASE WHEN contains(block, '<b>') THEN {_SQL_PLAIN.format("string_split(string_split(block, '<b>')[2], '</b>')[1]")} ELSE '' END AS date
  FROM texts WHERE text <> '')
WHERE keyword IS NOT NULL""")
def page_extract_nested(spark, sf_dir):
    """S18 in containers: paragraphs of the article, each with its own bold lead."""
    p = V.text_table(spark, sf_dir, "pages", "page_id", "url", "html").where(~P.page_failed(F.col("html")))
    rows = P.extract_nested(p, ("p",), DATE_SELECTORS, container="article p", keep=("page_id", "url"))
    hits = P.keyword_filter(rows, V.KW)
    return hits.select("page_id", "url", "pos", F.md5("text").alias("text_md5"), "date", "keyword")

"""Registered matching and scalar-function queries (M1-M4, F1-F10) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.functions import text as X
from kwspread.functions import timefmt as T
from kwspread.operators.common import with_nonnull
from kwspread.plans import sql_match as Q
from kwspread.plans import views as V
from kwspread.plans.registry import register


def _docs(spark, sf_dir, *cols):
    cols = cols or ("doc_id", "lang", "source", "text")
    return V.text_table(spark, sf_dir, "documents", *cols)


@register("match_first_ci", f"SELECT doc_id, {Q.sql_first_match('text', V.KW, True)} AS keyword FROM documents")
def match_first_ci(spark, sf_dir):
    """M1: first dictionary keyword in the lower-cased text (null when none)."""
    return _docs(spark, sf_dir).select("doc_id", M.first_match(F.col("text"), V.KW, ci=True).alias("keyword"))


@register("match_first_cs", f"SELECT doc_id, {Q.sql_first_match('text', V.KW, False)} AS keyword FROM documents")
def match_first_cs(spark, sf_dir):
    """M2: first dictionary keyword, case-sensitive."""
    return _docs(spark, sf_dir).select("doc_id", M.first_match(F.col("text"), V.KW, ci=False).alias("keyword"))


@register("match_all", f"SELECT doc_id, {Q.sql_all_matches('text', V.KW, True)} AS matched_keywords FROM documents")
def match_all(spark, sf_dir):
    """All keywords in dictionary order, ';'-joined ('' when none)."""
    return _docs(spark, sf_dir).select(
        "doc_id", M.all_matches_joined(F.col("text"), V.KW, ci=True).alias("matched_keywords")
    )


@register("keyword_comments", f"""SELECT doc_id, keyword, lang, source FROM (
  SELECT doc_id, lang, source, {Q.sql_first_match('text', V.KW, True)} AS keyword FROM documents)
WHERE keyword IS NOT NULL""")
def keyword_comments(spark, sf_dir):
    """M4: keep only rows with a hit (match first, then drop)."""
    d = with_nonnull(_docs(spark, sf_dir), M.first_match(F.col("text"), V.KW, ci=True), "keyword")
    return d.select("doc_id", "keyword", "lang", "source")


# DuckDB's RE2 spells Python's whitespace class explicitly.
_RE2_SPACE = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"


@register("text_clean", f"""SELECT doc_id, md5(c) AS clean_md5, CAST(length(c) AS BIGINT) AS clean_len FROM (
  SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_RE2_SPACE}+', ' ', 'g')) AS c FROM documents)""")
def text_clean(spark, sf_dir):
    """F8: whitespace runs (Unicode) -> one space, stripped; whole texts."""
    c = X.clean_ws(F.col("text"))
    return _docs(spark, sf_dir).select(
        "doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("clean_len")
    )


@register("comment_text_normalise", f"""SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS comment_id,
  md5(regexp_replace(replace(text, chr(10), ' '), '^{_RE2_SPACE}+|{_RE2_SPACE}+$', '', 'g')) AS text_md5
FROM conversations""")
def comment_text_normalise(spark, sf_dir):
    """newline -> space, then strip."""
    t = V.threads(spark, sf_dir)
    return t.select("comment_id", F.md5(X.newline_to_space(F.col("text"))).alias("text_md5"))


# Landed timestamps arrive in several textual forms; the form is chosen per event
# type so every row of `events` is exercised.
def _raw_ts(ts, kind):
    return (
        F.when(kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "error", F.concat(F.date_format(ts + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


_SQL_RAW_TS = """CASE event_type
    WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 'error' THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00'
    ELSE strftime(ts, '%Y-%m-%d') END"""


@register("iso_utc_format", f"""SELECT event_id, raw,
  strftime(CASE WHEN regexp_matches(raw, '[0-9](Z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$')
                THEN timezone('UTC', try_cast(raw AS TIMESTAMPTZ))
                ELSE try_cast(raw AS TIMESTAMP) END, '%Y-%m-%dT%H:%M:%SZ') AS iso
FROM (SELECT event_id, {_SQL_RAW_TS} AS raw FROM events)""")
def iso_utc_format(spark, sf_dir):
    """lenient parse of mixed forms (naive = UTC, zoned -> UTC), RFC3339 'Z' output."""
    e = V.table(spark, sf_dir, "events")
    raw = e.select("event_id", _raw_ts(F.col("ts"), F.col("event_type")).alias("raw"))
    return raw.select("event_id", "raw", T.iso_utc(F.col("raw")).alias("iso"))


# Fixed patterns of the page-number id chain: query parameter, then /<lang>/<n>.
PAGE_ID_PATTERNS = (r"[?&]page=([0-9]+)", r"/[a-z]{2}/([0-9]+)")


@register("id_from_url", """SELECT page_id, url, coalesce(
    nullif(regexp_extract(trim(url), '[?&]page=([0-9]+)', 1), ''),
    nullif(regexp_extract(trim(url), '/[a-z]{2}/([0-9]+)', 1), ''),
    trim(url)) AS extracted_id
FROM pages""")
def id_from_url(spark, sf_dir):
    """F1 chain on page URLs: first pattern with a match wins, else the stripped input."""
    p = V.table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", "url", X.extract_by_chain(F.trim(F.col("url")), PAGE_ID_PATTERNS).alias("extracted_id"))


def raw_channel_input(source, lang):
    """The forms users pass for a channel: bare id, channel URL, handle URL, handle."""
    cid = V.channel_id_of(source)
    return (
        F.when(lang == "en", cid)
        .when(lang == "fr", F.concat(F.lit("https://www.youtube.com/channel/"), cid, F.lit("/videos")))
        .when(lang == "de", F.concat(F.lit("https://youtube.com/@"), source, F.lit("/featured")))
        .otherwise(F.concat(F.lit(" @"), source))
    )


SQL_RAW_CHANNEL = """CASE lang
    WHEN 'en' THEN 'UC' || upper(md5(source))
    WHEN 'fr' THEN 'https://www.youtube.com/channel/UC' || upper(md5(source)) || '/videos'
    WHEN 'de' THEN 'https://youtube.com/@' || source || '/featured'
    ELSE ' @' || source END"""

SQL_CHANNEL_NORMALISE = f"""SELECT doc_id, raw,
  CASE WHEN starts_with(trim(raw), 'UC') AND length(trim(raw)) >= 10 THEN trim(raw)
       ELSE nullif(regexp_extract(trim(raw), '(UC[A-Za-z0-9_-]{{10,}})', 1), '') END AS channel_id,
  CASE WHEN contains(trim(raw), 'youtube.com/@') THEN '@' || regexp_extract(trim(raw), 'youtube\\.com/@([^/]*)', 1)
       WHEN starts_with(trim(raw), '@') THEN trim(raw)
       WHEN NOT starts_with(trim(raw), 'UC') THEN '@' || trim(raw) END AS handle,
  starts_with(trim(raw), 'UC') AS is_channel_id
FROM (SELECT doc_id, {SQL_RAW_CHANNEL} AS raw FROM documents)"""


@register("channel_id_normalise", SQL_CHANNEL_NORMALISE)
def channel_id_normalise(spark, sf_dir):
    """Resolve channel ids from raw inputs, parse handles, flag valid ids."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", raw_channel_input(F.col("source"), F.col("lang")).alias("raw"))
    r = F.col("raw")
    return d.select(
        "doc_id", "raw",
        X.channel_id_from(r).alias("channel_id"),
        X.handle_from(r).alias("handle"),
        X.is_channel_id(r).alias("is_channel_id"),
    )


# A dictionary of several hundred entries, by rule: all pairs of these letters.
LARGE_KW = tuple(a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "aeiounrstlhdcmp")


@register("match_large_dictionary", f"""
SELECT doc_id, {Q.sql_first_match('text', LARGE_KW, False)} AS keyword, md5({Q.sql_all_matches('text', LARGE_KW, True)}) AS all_md5
FROM documents""")
def match_large_dictionary(spark, sf_dir):
    """M1-M3 with 390 keywords."""
    return _docs(spark, sf_dir).select(
        "doc_id",
        M.first_match(F.col("text"), LARGE_KW, ci=False).alias("keyword"),
        F.md5(M.all_matches_joined(F.col("text"), LARGE_KW, ci=True)).alias("all_md5"),
    )


# Syllables by rule: one, two and three of these (fixed values) give 9,723 keywords of
# two to six letters, in this order.
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()


def syllable_keywords() -> list[str]:
    ones = SYLLABLES
    twos = [a + b for a in ones for b in ones]
    return ones + twos + [a + b for a in twos for b in ones]


_SYL = "[" + ", ".join(f"'{s}'" for s in SYLLABLES) + "]"


@register("match_dictionary_10k", f"""
WITH s AS (SELECT unnest({_SYL}) AS w, unnest(range({len(SYLLABLES)})) AS o),
kw AS (SELECT list(w ORDER BY n, k) AS kws FROM (
  SELECT w, 1 AS n, o AS k FROM s
  UNION ALL SELECT a.w || b.w, 2, a.o * 100 + b.o FROM s a, s b
  UNION ALL SELECT a.w || b.w || c.w, 3, a.o * 10000 + b.o * 100 + c.o FROM s a, s b, s c)),
hit AS (SELECT doc_id, text, list_filter(kws, lambda k: contains(lower(text), k)) AS ci,
               list_filter(list_reverse(kws), lambda k: contains(text, k)) AS cs
        FROM documents, kw)
SELECT doc_id, CASE WHEN text <> '' THEN cs[1] END AS last_keyword,
       CAST(coalesce(len(ci), 0) AS BIGINT) AS n_keywords, md5(coalesce(array_to_string(ci, ';'), '')) AS all_md5
FROM hit""")
def match_dictionary_10k(spark, sf_dir):
    """M1-M3, M10 with 9,723 keywords of mixed lengths: one pass of the automaton per text
    and case. `last_keyword` is the first hit of the reversed dictionary, case-sensitive."""
    kws = syllable_keywords()
    found = _docs(spark, sf_dir).select(
        "doc_id",
        M.first_match(F.col("text"), kws[::-1], ci=False).alias("last_keyword"),
        M.all_matches_array(F.col("text"), kws, ci=True).alias("found"),
    )
    return found.select("doc_id", "last_keyword", F.size("found").cast("long").alias("n_keywords"),
                        F.md5(F.array_join("found", ";")).alias("all_md5"))

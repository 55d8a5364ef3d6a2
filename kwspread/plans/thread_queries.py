"""Registered thread / comment-scan queries (S9, S10, J1-J3, J5, J6, J10, M11-M13,
W6-W9, D5, D6, A10-A12, A15, I2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.functions import text as X
from kwspread.operators import comments as C
from kwspread.operators import transcripts as TR
from kwspread.operators.common import materialize
from kwspread.plans import sql_match as Q
from kwspread.plans import views as V
from kwspread.plans.registry import register
from kwspread.session import ensure_checkpoint_dir
from kwspread.sources import landed_json as J
from kwspread.sources import landed_scan as S

# Parameters of the registered queries.
CAP_N = 20            # matched / scanned comments per video
NEWEST_SCAN_N = 30    # comments examined per video for the existence test
HEAD_N = 50           # distinct ids kept by the head operator
LANGS = ("de", "en")  # transcript language preference
SEARCH_PER_QUERY = 30  # newest videos kept per search query


def flat_rows(spark, sf_dir):
    """Thread rows landed as API JSON pages, flattened back (S9 + S10 + M12)."""
    thread_pages, reply_pages = J.land_thread_pages(V.threads(spark, sf_dir))
    top = J.flatten_thread_pages(thread_pages)
    rep = J.flatten_reply_pages(reply_pages)
    return J.comment_rows(top, rep)


SQL_FLAT = "WITH " + V.SQL_THREADS + """,
flat AS (
  SELECT t.* FROM threads t
  WHERE t.turn = 0 OR EXISTS (SELECT 1 FROM threads p WHERE p.video_id = t.video_id AND p.turn = 0))"""


@register("flatten_threads", SQL_FLAT + """
SELECT video_id, comment_id, parent_id, comment_level, md5(coalesce(text, '')) AS text_md5,
       CAST(length(text) AS BIGINT) AS like_count, sha256(role) AS author_hash
FROM flat""")
def flatten_threads(spark, sf_dir):
    """Landed thread and reply pages -> one flat table (top + reply)."""
    r = flat_rows(spark, sf_dir)
    return r.select("video_id", "comment_id", "parent_id", "comment_level", F.md5("text").alias("text_md5"),
                    "like_count", F.sha2("author_name", 256).alias("author_hash"))


_CI = Q.sql_first_match("text", V.KW, True)
_RE2_SPACE = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"


@register("reply_matches", SQL_FLAT + f"""
SELECT video_id, matched_keyword, comment_level, comment_id, parent_id,
       md5(regexp_replace(replace(text, chr(10), ' '), '^{_RE2_SPACE}+|{_RE2_SPACE}+$', '', 'g')) AS text_md5
FROM (SELECT *, {_CI} AS matched_keyword FROM flat) WHERE matched_keyword IS NOT NULL""")
def reply_matches(spark, sf_dir):
    """Matched top-level comments and replies (a reply is kept under a
    non-matching parent)."""
    r = flat_rows(spark, sf_dir).withColumn("matched_keyword", M.first_match(F.col("text"), V.KW, ci=True))
    r = r.where(F.col("matched_keyword").isNotNull() & (F.col("comment_id") != ""))
    return r.select("video_id", "matched_keyword", "comment_level", "comment_id", "parent_id",
                    F.md5(X.newline_to_space(F.col("text"))).alias("text_md5"))


@register("enrich_comments", "WITH " + V.sql_obs() + ",\n" + V.SQL_CAND + """
SELECT o.comment_id, o.keyword_cs AS keyword, o.video_id, md5(c.title) AS video_title_md5,
       c.channel_id, c.published_at AS video_published_at
FROM obs o LEFT JOIN cand c USING (video_id) WHERE o.keyword_cs IS NOT NULL""")
def enrich_comments(spark, sf_dir):
    """Every keyword comment gets its video's title, channel and publish time."""
    o = V.obs(spark, sf_dir, need=["keyword_cs"]).where(F.col("keyword_cs").isNotNull())
    v = V.cand_keyed(spark, sf_dir, need=["title_md5"]).select("video_id", F.col("title_md5").alias("video_title_md5"), "channel_id",
                                     F.col("published_at").alias("video_published_at"))
    e = C.enrich(o, v, ["video_title_md5", "channel_id", "video_published_at"])
    return e.select("comment_id", F.col("keyword_cs").alias("keyword"), "video_id", "video_title_md5",
                    "channel_id", "video_published_at")


_KW_VALUES = ", ".join(f"({i}, '{k}')" for i, k in enumerate(V.KW))


@register("query_vs_keyword", "WITH " + V.sql_obs() + ",\n" + V.SQL_CAND + f""",
kw(kord, kw) AS (VALUES {_KW_VALUES}),
found AS (
  SELECT query, video_id FROM (
    SELECT kw AS query, c.video_id,
           row_number() OVER (PARTITION BY kw ORDER BY c.published_at DESC NULLS LAST, c.video_id) AS rn
    FROM cand c, kw WHERE contains(lower(c.title), lower(kw)))
  WHERE rn <= {SEARCH_PER_QUERY})
SELECT f.query, o.comment_id, o.doc_id AS video_id, o.keyword_cs AS keyword
FROM obs o JOIN found f ON o.doc_id = f.video_id WHERE o.keyword_cs IS NOT NULL""")
def query_vs_keyword(spark, sf_dir):
    """Comments found through query q but matched against all keywords; a
    comment's video is its document here (doc_id = candidate video id)."""
    o = V.obs(spark, sf_dir, need=["keyword_cs"]).select("comment_id", F.col("doc_id").alias("video_id"), F.col("keyword_cs").alias("keyword"))
    out = C.search_attribution(V.cand_keyed(spark, sf_dir, need=["title_hits"]), o, V.KW, SEARCH_PER_QUERY, hits_col="title_hits")
    return out.select("query", "comment_id", "video_id", "keyword")


def segments(spark, sf_dir):
    """Transcript segments: the user turns of each conversation, by turn."""
    return V.threads(spark, sf_dir).where(F.col("role") == "user").select("video_id", "turn", "text")


def transcript_matches(spark, sf_dir):
    """A11 via per-segment and boundary matching (no per-video concatenation)."""
    hits = TR.transcript_keyword_hits(segments(spark, sf_dir), V.KW)
    return hits.withColumn("has_transcript", F.lit(True))


SQL_TRANSCRIPTS = "WITH " + V.SQL_THREADS + """,
tr AS (SELECT video_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS transcript, count(*) AS n_segments
       FROM threads WHERE role = 'user' GROUP BY video_id)"""
_ALL_TR = Q.sql_all_matches("transcript", V.KW, True)
SQL_MATCHED = SQL_TRANSCRIPTS + f""",
mv AS (SELECT video_id, matched_keywords, true AS has_transcript FROM (
         SELECT video_id, {_ALL_TR} AS matched_keywords FROM tr) WHERE matched_keywords <> '')"""


@register("transcript_assemble", SQL_TRANSCRIPTS + """
SELECT video_id, n_segments, md5(transcript) AS transcript_md5 FROM tr""")
def transcript_assemble(spark, sf_dir):
    """A10: ordered segments joined with a space, one transcript per video."""
    t = TR.assemble_transcripts(segments(spark, sf_dir))
    return t.select("video_id", "n_segments", F.md5("transcript").alias("transcript_md5"))


CHUNK_SEGMENTS = 2  # small, so that the driver's conversations have several chunks


@register("transcript_chunks", "WITH " + V.SQL_THREADS + f""",
placed AS (SELECT video_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY video_id ORDER BY turn) - 1 AS pos
           FROM threads WHERE role = 'user')
SELECT video_id, CAST(pos // {CHUNK_SEGMENTS} AS BIGINT) AS chunk_no, count(*) AS n_segments,
       md5(string_agg(text, ' ' ORDER BY pos)) AS chunk_md5
FROM placed GROUP BY ALL""")
def transcript_chunks(spark, sf_dir):
    """A10 for any length: transcripts assembled in ordered chunks."""
    c = TR.transcript_chunks(segments(spark, sf_dir), chunk=CHUNK_SEGMENTS)
    return c.select("video_id", "chunk_no", "n_segments", F.md5("chunk_text").alias("chunk_md5"))


@register("matched_videos", SQL_MATCHED + "\nSELECT video_id, matched_keywords, has_transcript FROM mv")
def matched_videos(spark, sf_dir):
    """Videos whose transcript contains any keyword, with all hits (matches
    may span segments; found without concatenating transcripts)."""
    return transcript_matches(spark, sf_dir)


SQL_GATED = SQL_MATCHED + ",\n" + V.sql_obs() + """,
gated AS (SELECT comment_id, video_id, keyword FROM obs
          WHERE keyword IS NOT NULL AND video_id IN (SELECT video_id FROM mv))"""


def _ci_hits(spark, sf_dir):
    return V.obs(spark, sf_dir, need=["keyword"]).where(F.col("keyword").isNotNull()).select("comment_id", "video_id", "keyword")


def gated(spark, sf_dir, hits=None):
    hits = _ci_hits(spark, sf_dir) if hits is None else hits
    return C.gate_semi(hits, transcript_matches(spark, sf_dir))


@register("transcript_gate_semi", SQL_GATED + "\nSELECT * FROM gated")
def transcript_gate_semi(spark, sf_dir):
    """Stage 2 scans comments only of videos whose transcript matched."""
    return gated(spark, sf_dir)


@register("transcript_coverage", SQL_TRANSCRIPTS + ",\n" + V.SQL_CAND + f"""
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN tr.video_id IS NULL THEN 'no_transcript'
              WHEN {Q.sql_any_match('tr.transcript', V.KW, True)} THEN 'hit' ELSE 'no_hit' END AS status
  FROM cand c LEFT JOIN tr USING (video_id)) GROUP BY status""")
def transcript_coverage(spark, sf_dir):
    """Candidate videos by transcript status (hit / no_hit / no_transcript)."""
    s = TR.transcript_status(V.cand(spark, sf_dir), segments(spark, sf_dir), transcript_matches(spark, sf_dir))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_LANG_LIST = "[" + ", ".join(f"'{x}'" for x in LANGS) + "]"


@register("prefer_language", f"""
SELECT source, lang, doc_id, text_md5 FROM (
  SELECT source, lang, doc_id, md5(text) AS text_md5,
         row_number() OVER (PARTITION BY source ORDER BY list_position({_LANG_LIST}, lang), doc_id) AS rn
  FROM documents WHERE list_position({_LANG_LIST}, lang) IS NOT NULL)
WHERE rn = 1""")
def prefer_language(spark, sf_dir):
    """Per video (document source), the transcript in the first preferred language."""
    d = V.text_table(spark, sf_dir, "documents", "source", "lang", "doc_id", "text").select(
        "source", "lang", "doc_id", F.md5("text").alias("text_md5"))
    return C.prefer_language(d, LANGS, "source", tiebreak="doc_id").select("source", "lang", "doc_id", "text_md5")


@register("new_comments_anti", SQL_GATED + """
SELECT comment_id, video_id, keyword FROM obs
WHERE keyword IS NOT NULL AND comment_id NOT IN (SELECT comment_id FROM gated)""")
def new_comments_anti(spark, sf_dir):
    """A full scan appending to the gated run's output skips stored ids."""
    hits = materialize(_ci_hits(spark, sf_dir))  # scanned and gated: read twice
    return C.new_only(hits, gated(spark, sf_dir, hits))


def stored_comments(spark, sf_dir):
    """Ids an earlier, transcript-gated run stored."""
    found = flat_rows(spark, sf_dir).where(M.any_match(F.col("text"), V.KW) & (F.col("comment_id") != ""))
    return C.gate_semi(found.select("video_id", "comment_id"), transcript_matches(spark, sf_dir)).select("comment_id")


SQL_SCAN = SQL_MATCHED + """,
flat AS (
  SELECT t.* FROM threads t
  WHERE t.turn = 0 OR EXISTS (SELECT 1 FROM threads p WHERE p.video_id = t.video_id AND p.turn = 0)),
has_reply AS (SELECT DISTINCT video_id FROM threads WHERE turn > 0)"""


@register("scan_stats", SQL_SCAN + f"""
SELECT f.video_id,
       CAST(count(*) FILTER (WHERE turn = 0) AS BIGINT) AS scanned_threads,
       CAST(count(*) FILTER (WHERE turn = 0 AND f.video_id IN (SELECT video_id FROM has_reply)) AS BIGINT) AS reply_parents,
       CAST(count(DISTINCT comment_id) FILTER (WHERE {_CI} IS NOT NULL
            AND f.video_id NOT IN (SELECT video_id FROM mv)) AS BIGINT) AS new_matches
FROM flat f GROUP BY f.video_id""")
def scan_stats(spark, sf_dir):
    """Per video threads scanned, threads with replies, matches not stored before."""
    return C.scan_stats(flat_rows(spark, sf_dir), V.KW, stored=stored_comments(spark, sf_dir))


# A landed scan with failures, by rule (video_id): no answer but 403, thread pages cut in
# the middle, reply pages cut in the middle. A page lands 0.75 s after the one before.
HTTP_403, CUT_THREADS, CUT_REPLIES = (11, 4), (7, 3), (13, 5)


def landed_scan(spark, sf_dir):
    threads, replies = J.land_thread_pages(V.threads(spark, sf_dir))
    pages = threads.select("video_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("page_no"), "page").unionByName(
        replies.select(F.split("parent_id", ":")[0].cast("long").alias("video_id"), "parent_id", F.col("page_no").cast("int").alias("page_no"), "page"))
    rule = lambda r: F.col("video_id") % r[0] == r[1]
    cut = F.when(F.col("parent_id").isNull(), rule(CUT_THREADS)).otherwise(rule(CUT_REPLIES))
    millis = F.col("video_id") * 1000 + F.when(F.col("parent_id").isNull(), 0).otherwise((F.col("page_no") + 1) * 750)
    return pages.select(
        "video_id", "parent_id", "page_no",
        F.when(rule(HTTP_403), 403).otherwise(200).alias("http_status"),
        F.when(rule(HTTP_403), F.lit(None).cast("string")).when(cut, F.expr("left(page, length(page) div 2)")).otherwise(F.col("page")).alias("body"),
        (F.expr("TIMESTAMP_NTZ '2024-05-01 00:00:00'") + F.make_dt_interval(secs=millis / 1000)).alias("fetched_at"),
    )


def split_scan(spark, sf_dir):
    """The landed scan parsed once; its three parts are folders of one table."""
    parts = S.write_split(landed_scan(spark, sf_dir), f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}")
    return parts["row"].unionByName(parts["empty"]).unionByName(parts["rejected"])


SQL_LANDED = SQL_SCAN + """,
pages AS (
  SELECT DISTINCT video_id, turn > 0 AS reply, CASE WHEN turn > 0 THEN (turn - 1) // 100 ELSE 0 END AS page_no,
         CASE WHEN video_id % 11 = 4 THEN 'http_error'
              WHEN (turn = 0 AND video_id % 7 = 3) OR (turn > 0 AND video_id % 13 = 5) THEN 'malformed' END AS reason
  FROM threads),
landed AS (
  SELECT t.*, p.reason, p.page_no FROM threads t
  JOIN pages p ON p.video_id = t.video_id AND p.reply = (t.turn > 0)
   AND p.page_no = CASE WHEN t.turn > 0 THEN (t.turn - 1) // 100 ELSE 0 END)"""


@register("quarantine_pages", SQL_LANDED + """
SELECT 'row' AS outcome, CAST(NULL AS VARCHAR) AS reason, video_id, nullif(parent_id, '') AS parent_id,
       CAST(page_no AS INTEGER) AS page_no, comment_id, md5(coalesce(text, '')) AS text_md5,
       CAST(coalesce(length(text), 0) AS BIGINT) AS like_count
FROM landed WHERE reason IS NULL
UNION ALL
SELECT 'rejected', reason, video_id, CASE WHEN reply THEN video_id || ':0' END, CAST(page_no AS INTEGER), NULL, NULL, NULL
FROM pages WHERE reason IS NOT NULL""")
def quarantine_pages(spark, sf_dir):
    """A scan with cut and failed pages, parsed once into rows and rejected
    pages; what was gathered beside a failed page stays."""
    return split_scan(spark, sf_dir).select("outcome", "reason", "video_id", "parent_id", "page_no", "comment_id",
                                            F.md5("text").alias("text_md5"), "like_count")


SQL_PROGRESS = SQL_LANDED + f""",
told AS (
  SELECT video_id,
         CASE WHEN bool_or(reason = 'http_error') THEN 'http_error' WHEN bool_or(reason IS NOT NULL) THEN 'error' ELSE 'done' END AS status,
         video_id + coalesce(min(CASE WHEN reply THEN (page_no + 1) * 0.75 ELSE 0 END), 0) AS begun,
         video_id + max(CASE WHEN reply THEN (page_no + 1) * 0.75 ELSE 0 END) AS ended
  FROM pages GROUP BY video_id),
counts AS (
  SELECT video_id, count(*) FILTER (WHERE turn = 0) AS threads,
         count(*) FILTER (WHERE turn = 0 AND video_id IN (SELECT video_id FROM has_reply)) AS parents,
         count(DISTINCT comment_id) FILTER (WHERE {_CI} IS NOT NULL AND video_id NOT IN (SELECT video_id FROM mv)) AS fresh
  FROM flat GROUP BY video_id),
progress AS (
  SELECT t.video_id, status,
         CAST(CASE WHEN status = 'done' THEN coalesce(threads, 0) ELSE 0 END AS BIGINT) AS scanned_threads,
         CAST(CASE WHEN status = 'done' THEN coalesce(parents, 0) ELSE 0 END AS BIGINT) AS reply_parents,
         CAST(CASE WHEN status = 'done' THEN coalesce(fresh, 0) ELSE 0 END AS BIGINT) AS new_matches,
         round(CAST(ended - begun AS DOUBLE), 2) AS elapsed_sec,
         strftime(TIMESTAMP '2024-05-01 00:00:00' + to_milliseconds(CAST(ended * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS ts
  FROM told t LEFT JOIN counts USING (video_id))"""


def progress(spark, sf_dir):
    return S.progress_rows(split_scan(spark, sf_dir), V.KW, stored=stored_comments(spark, sf_dir))


@register("progress_log", SQL_PROGRESS + "\nSELECT * FROM progress")
def progress_log_q(spark, sf_dir):
    """Per scanned video status (done / http_error / error), counts, elapsed and time."""
    return progress(spark, sf_dir)


@register("resume_todo_anti", SQL_PROGRESS + ",\n" + V.SQL_CAND + """
SELECT video_id FROM cand WHERE video_id NOT IN (SELECT video_id FROM progress WHERE status = 'done')""")
def resume_todo_anti(spark, sf_dir):
    """A resumed run skips only videos logged 'done'; errors are retried."""
    return C.resume_todo(V.cand(spark, sf_dir).select("video_id"), progress(spark, sf_dir))


def _obs_cs(spark, sf_dir):
    return V.obs(spark, sf_dir, need=["keyword_cs"]).select("video_id", "comment_id", F.col("keyword_cs").alias("keyword"), "date")


def _sql_top(where_before: str, where_after: str, n: int) -> str:
    return "WITH " + V.sql_obs() + f"""
SELECT video_id, comment_id, keyword_cs AS keyword, date FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY date DESC NULLS LAST, comment_id) AS rn
  FROM obs WHERE {where_before})
WHERE rn <= {n} AND {where_after}"""


@register("cap_after_match", _sql_top("keyword_cs IS NOT NULL", "true", CAP_N))
def cap_after_match(spark, sf_dir):
    """Filter then limit — newest N *matching* comments per video."""
    return C.cap_after_match(_obs_cs(spark, sf_dir), CAP_N, "keyword").select("video_id", "comment_id", "keyword", "date")


@register("cap_before_match", _sql_top("true", "keyword_cs IS NOT NULL", CAP_N))
def cap_before_match(spark, sf_dir):
    """Limit then filter — newest N comments per video, then matched."""
    return C.cap_before_match(_obs_cs(spark, sf_dir), CAP_N, "keyword").select("video_id", "comment_id", "keyword", "date")


@register("video_has_keyword", "WITH " + V.sql_obs() + f"""
SELECT video_id, bool_or(keyword_cs IS NOT NULL) AS has_keyword FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY date DESC NULLS LAST, comment_id) AS rn FROM obs)
WHERE rn <= {NEWEST_SCAN_N} GROUP BY video_id""")
def video_has_keyword(spark, sf_dir):
    """Does any of a video's newest N comments contain a keyword."""
    return C.video_has_keyword(_obs_cs(spark, sf_dir), NEWEST_SCAN_N, "keyword")


@register("distinct_ids_head", "WITH " + V.sql_obs() + f"""
SELECT video_id, min(date) AS first_pos FROM (
  SELECT coalesce(nullif(regexp_extract(s, '[?&]v=([A-Za-z0-9_-]{{6,}})', 1), ''),
                  nullif(regexp_extract(s, 'youtu\\.be/([A-Za-z0-9_-]{{6,}})', 1), ''),
                  nullif(regexp_extract(s, 'embed/([A-Za-z0-9_-]{{6,}})', 1), ''), s) AS video_id, date
  FROM (SELECT trim(CAST(video_id AS VARCHAR)) AS s, date FROM obs))
WHERE video_id <> '' GROUP BY video_id ORDER BY first_pos, video_id LIMIT {HEAD_N}""")
def distinct_ids_head(spark, sf_dir):
    """Ids normalised, blanks dropped, first position kept, first N ids."""
    o = V.obs(spark, sf_dir, need=[])
    return C.distinct_ids_head(o, X.video_id_from(F.col("video_id").cast("string")), "date", HEAD_N)


@register("run_totals", SQL_PROGRESS + """
SELECT CAST(count(*) AS BIGINT) AS videos,
       CAST(count(*) FILTER (WHERE status = 'done') AS BIGINT) AS videos_done,
       CAST(count(*) FILTER (WHERE status <> 'done') AS BIGINT) AS videos_failed,
       CAST(coalesce(sum(scanned_threads), 0) AS BIGINT) AS scanned_threads,
       CAST(coalesce(sum(new_matches), 0) AS BIGINT) AS new_matches
FROM progress""")
def run_totals(spark, sf_dir):
    """Totals of a scan run (videos done / failed, threads, new matches)."""
    return C.run_totals(progress(spark, sf_dir))

"""Dialect adapters: each comment dialect of the reference mapped by a pure `select`
to the canonical comments schema (S6, S8), plus union-by-name (S3)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.functions import text as X
from kwspread.functions import timefmt as T
from kwspread.operators.common import conform

# Columns the merge step requires (P4 dialect), in order.
MERGE_REQUIRED = ("date", "platform", "source", "keyword", "text")

# Canonical comments schema, as (name, type).
CANONICAL = (
    ("comment_id", "string"),
    ("parent_id", "string"),
    ("comment_level", "string"),
    ("platform", "string"),
    ("source", "string"),
    ("video_id", "string"),
    ("keyword", "string"),
    ("query", "string"),
    ("published_at", "timestamp_ntz"),
    ("text_md5", "string"),
    ("like_count", "bigint"),
)


def union_by_name_conformed(parts: Sequence[DataFrame], cols: Sequence[str] | None = None) -> DataFrame:
    """S3: union by column name, missing columns -> null; optional final column order."""
    if not parts:
        raise ValueError("no inputs to union")
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.select(*cols) if cols else u


def p4_from_obs(obs: DataFrame, with_query: bool) -> DataFrame:
    """Collector dialect P4 (`date` text without zone, `keyword` case-sensitive hit,
    blank when none); the search collector adds `query` and keeps a 'Z' suffix."""
    date_txt = F.date_format(F.col("date"), "yyyy-MM-dd'T'HH:mm:ss")
    cols = [
        (F.concat(date_txt, F.lit("Z")) if with_query else date_txt).alias("date"),
        "platform",
        "source",
        F.coalesce(F.col("keyword_cs"), F.lit("")).alias("keyword"),
        F.col("video_id").cast("string").alias("video_id"),
        F.col("text_md5").alias("text"),
    ]
    if with_query:
        cols.append(F.coalesce(F.col("keyword"), F.lit("")).alias("query"))
    return obs.select(*cols)


def clean_merged(df: DataFrame, observation=None) -> DataFrame:
    """Per-file cleaning of the merge step: required columns added as '', lenient date
    parse with null dates dropped, keyword/text/platform stripped."""
    cols = list(df.columns) + [c for c in MERGE_REQUIRED if c not in df.columns]
    out = conform(df, cols).withColumn("date", T.lenient_ts(F.col("date")))
    if observation is not None:
        # Rows lost to unparsable dates are counted, not silently dropped (metrics
        # arrive with the first action on the result).
        out = out.observe(observation, F.count(F.lit(1)).alias("rows_in"),
                          F.count_if(F.col("date").isNull()).alias("unparsable_dates"))
    return (
        out.where(F.col("date").isNotNull())
        .withColumn("keyword", X.str_strip(F.col("keyword")))
        .withColumn("text", X.str_strip(F.col("text")))
        .withColumn("platform", X.str_strip(F.col("platform")))
    )


def to_canonical(df: DataFrame, mapping: dict) -> DataFrame:
    """Project any dialect onto CANONICAL; absent fields become typed nulls."""
    out = []
    for name, typ in CANONICAL:
        expr = mapping.get(name)
        if expr is None:
            out.append(F.lit(None).cast(typ).alias(name))
        else:
            c = F.col(expr) if isinstance(expr, str) else expr
            out.append(c.cast(typ).alias(name))
    return df.select(*out)


def p4_canonical(obs: DataFrame) -> DataFrame:
    """Collector rows (case-sensitive hits only) -> canonical."""
    hits = obs.where(F.col("keyword_cs").isNotNull())
    return to_canonical(
        hits,
        {
            "platform": "platform",
            "source": "source",
            "video_id": "video_id",
            "keyword": "keyword_cs",
            "published_at": "date",
            "text_md5": "text_md5",
        },
    )


def p2_canonical(threads: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Thread-scan rows (P1/P2: case-insensitive hits, newline->space text) -> canonical."""
    kw = M.first_match(F.col("text"), keywords, ci=True)
    t = threads.withColumn("__kw", kw).where(F.col("__kw").isNotNull())
    return to_canonical(
        t,
        {
            "comment_id": "comment_id",
            "parent_id": "parent_id",
            "comment_level": "comment_level",
            "platform": F.lit("youtube"),
            "source": F.lit("threads"),
            "video_id": "video_id",
            "keyword": "__kw",
            "text_md5": F.md5(X.newline_to_space(F.col("text"))),
            "like_count": F.length("text"),
        },
    )


def canonical_union(obs: DataFrame, threads: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return p4_canonical(obs).unionByName(p2_canonical(threads, keywords))

"""Transcripts of any length (A10, A11, A15): positions, chunks, keyword hits.

A transcript is its segments in order, joined with one space. No operator here gathers a
video: positions come from counts per range of (video, order), keyword hits from segments
and the short strings around their borders, and the text itself is joined in chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.operators.common import materialize

#: Segments of a chunk of assembled text.
CHUNK = 1_000


def with_positions(rows: DataFrame, order_col: str = "turn", video_col: str = "video_id", name: str = "pos") -> DataFrame:
    """Add the dense position (0, 1, ...) of each row in its video's order.

    Rows are dealt by ranges of (video, order) and numbered within (video, range); counts
    per (video, range), one row each, give the offsets. A video holding a third of all rows
    lies in many ranges, so no task numbers more than a range of it. `rows` should be
    narrow: they are written once and sorted."""
    ranged = rows.repartitionByRange(video_col, order_col).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged)  # the parts must stay what they are for both branches
    counts = ranged.groupBy(video_col, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(video_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(video_col).alias("__v"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(video_col, "__part").orderBy(order_col)) - 1
    placed = ranged.withColumn("__rn", inside)
    joined = placed.join(offsets, F.col(video_col).eqNullSafe(F.col("__v")) & (F.col("__part") == F.col("__p")))
    return joined.select(*rows.columns, (F.col("__off") + F.col("__rn")).cast("long").alias(name))


def transcript_chunks(segments: DataFrame, order_col: str = "turn", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A10 for any length: video_id, chunk_no, n_segments, chunk_text. The transcript is the
    chunks of a video in order, joined with one space. Segments must be unique by
    (video_id, order); missing text counts as ''. Positions are found on the keys alone,
    and the texts meet them by key, so a hot video's text is spread over all tasks."""
    places = with_positions(segments.select("video_id", order_col), order_col)
    texts = segments.select("video_id", order_col, F.coalesce(text_col, F.lit("")).alias("__t"))
    placed = texts.join(places, ["video_id", order_col])
    item = F.struct(F.col("pos").alias("k"), F.col("__t").alias("t"))
    return placed.groupBy("video_id", F.floor(F.col("pos") / chunk).cast("long").alias("chunk_no")).agg(
        F.count("*").alias("n_segments"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), " ").alias("chunk_text"),
    )


def assemble_transcripts(segments: DataFrame, video_col: str = "video_id", order_col: str = "turn",
                         text_col: str = "text") -> DataFrame:
    """A10: one row per video with its whole transcript, put together from the chunks. Only
    for transcripts that fit a row; `transcript_chunks` has no such bound."""
    own = segments.select(F.col(video_col).alias("video_id"), order_col, F.col(text_col).alias("text"))
    chunks = transcript_chunks(own, order_col)
    piece = F.struct(F.col("chunk_no").alias("k"), F.col("chunk_text").alias("t"))
    return chunks.groupBy("video_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["t"]), " ").alias("transcript"),
        F.sum("n_segments").alias("n_segments"),
    )


def transcript_keyword_hits(segments: DataFrame, keywords: Sequence[str], video_col: str = "video_id",
                            order_col: str = "turn", text_col: str = "text", ci: bool = True) -> DataFrame:
    """A11 without assembling transcripts: video_id, matched_keywords (dictionary order,
    ';'-joined) for videos with at least one hit.

    A keyword either lies inside one segment or spans a separator. Each segment is matched
    on its own, where it is read; each separator gets a boundary string made of the (L-1)
    characters before it and the (L-1) after it (L = longest keyword), built from at most
    L-1 neighbouring segments on each side. Only these ends are numbered and moved. Exact:
    every boundary string is a substring of the transcript and every spanning occurrence
    lies inside one."""
    kws = [k for k in dict.fromkeys(keywords) if k]
    needles = [k.lower() if ci else k for k in kws]
    text = F.coalesce(F.col(text_col), F.lit(""))
    seg = segments.select(F.col(video_col).alias("video_id"), F.col(order_col).alias("__o"), (F.lower(text) if ci else text).alias("t"))
    parts = [seg.select("video_id", F.col("t").alias("m"))]
    span = max(len(n) for n in needles) - 1 if needles else 0
    if span > 0:
        # Only the last (first) `span` characters of a segment can matter as context.
        ends = seg.select("video_id", "__o", F.expr(f"right(t, {span})").alias("tail"), F.expr(f"left(t, {span})").alias("head"))
        ends = with_positions(ends, "__o")
        # Each segment offers itself as left context (d = 0..span-1 positions back from
        # the separator) and as right context (d = 1..span positions ahead of it).
        offs = F.array(
            *[F.struct(F.lit("L").alias("side"), F.lit(d).alias("d")) for d in range(span)],
            *[F.struct(F.lit("R").alias("side"), F.lit(d).alias("d")) for d in range(1, span + 1)],
        )
        ctx = ends.select("video_id", "pos", "tail", "head", F.explode(offs).alias("o")).select(
            "video_id",
            F.when(F.col("o.side") == "L", F.col("pos") + F.col("o.d")).otherwise(F.col("pos") - F.col("o.d")).alias("anchor"),
            F.col("o.side").alias("side"), F.col("o.d").alias("d"),
            F.when(F.col("o.side") == "L", F.col("tail")).otherwise(F.col("head")).alias("t"),
        ).where(F.col("anchor") >= 0)
        grouped = ctx.groupBy("video_id", "anchor").agg(
            F.collect_list(F.struct("side", "d", "t")).alias("c")  # at most 2 * span items
        )
        left_items = F.filter("c", lambda x: x["side"] == "L")
        right_items = F.filter("c", lambda x: x["side"] == "R")
        # left: farthest first (d descending); right: nearest first (d ascending)
        left_txt = F.array_join(F.transform(F.reverse(F.array_sort(left_items)), lambda x: x["t"]), " ")
        right_txt = F.array_join(F.transform(F.array_sort(right_items), lambda x: x["t"]), " ")
        boundary = F.concat(F.expr(f"right(__l, {span})"), F.lit(" "), F.expr(f"left(__r, {span})"))
        b = (
            grouped.where(F.size(right_items) > 0)
            .select("video_id", left_txt.alias("__l"), right_txt.alias("__r"))
            .select("video_id", boundary.alias("m"))
        )
        parts.append(b)
    texts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Hits as dictionary entries: at most |dictionary| distinct ones per video.
    found = F.explode(M.all_matches_array(F.col("m"), list(dict.fromkeys(needles)), ci=False))
    hits = texts.select("video_id", found.alias("needle")).distinct()
    per_video = hits.groupBy("video_id").agg(F.collect_list("needle").alias("found"))
    entries = F.arrays_zip(F.lit(needles).alias("n"), F.lit(kws).alias("k"))
    own = F.transform(F.filter(entries, lambda e: F.array_contains(F.col("found"), e["n"])), lambda e: e["k"])
    return per_video.select("video_id", F.array_join(own, ";").alias("matched_keywords"))


def matched_videos(transcripts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """A11 over assembled transcripts: video_id, matched_keywords, has_transcript."""
    mk = F.nullif(M.all_matches_joined(F.col("transcript"), keywords, ci=True), F.lit(""))
    # kept through a generator so the matcher runs once per (long) transcript
    found = transcripts.select("video_id", F.explode(F.when(mk.isNotNull(), F.array(mk))).alias("matched_keywords"))
    return found.withColumn("has_transcript", F.lit(True))


def transcript_status(videos: DataFrame, segments: DataFrame, hits: DataFrame) -> DataFrame:
    """Per video 'hit' / 'no_hit' / 'no_transcript' from the videos having any
    segment and the videos with a keyword hit (both one row per video)."""
    have = segments.select("video_id").distinct()
    t = have.join(hits.select("video_id", F.lit(True).alias("__h")), "video_id", "left").select(
        "video_id", F.coalesce(F.col("__h"), F.lit(False)).alias("__hit"))
    j = videos.select("video_id").join(t, "video_id", "left")
    status = (
        F.when(F.col("__hit").isNull(), F.lit("no_transcript"))
        .when(F.col("__hit"), F.lit("hit"))
        .otherwise(F.lit("no_hit"))
    )
    return j.select("video_id", status.alias("status"))

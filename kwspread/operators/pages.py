"""Article pages: URL filter / preferred URL / dedup, selector-priority comment
extraction, error quarantine (M8, F15, D4, S18, S19).

Extraction parses each page once, whole, into an element tree (`html_select`) in Arrow
batches, a few MB of pages at a time (a worker's memory follows these, not the batch):
first selector with any hit wins, texts and dates are paired by position, or inside a
container element. This is the only Python-on-executor operator here. A page
that the parser rejects gives no comments but a quarantine row; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.functions import text as X
from kwspread.operators.batches import text_slices
from kwspread.operators.common import keep_first, with_nonnull


def news_links(pages: DataFrame, domain: str) -> DataFrame:
    """M8 + F15 + D4: keep rows where link or originallink is on the domain (substring),
    choose link if on the domain else originallink, dedup by the chosen URL keeping
    the first in input order (`ord`)."""
    on = X.on_domain(F.col("link"), domain) | X.on_domain(F.col("originallink"), domain)
    chosen = pages.where(on).withColumn("naver_url", X.preferred_url(F.col("link"), F.col("originallink"), domain))
    return keep_first(chosen, ["naver_url"], ["ord"])


def _comment_batches(batches: Iterator[pa.RecordBatch], text_selectors: Sequence[str], date_selectors: Sequence[str],
                     container: str | None, keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of `_parsed`, a batch per few MB of pages."""
    from kwspread.operators.html_select import extract_pairs

    for batch in chain.from_iterable(text_slices(b, "__html") for b in batches):
        at, pos, texts, dates, errors = [], [], [], [], []
        for k, html in enumerate(batch.column("__html").to_pylist()):
            try:
                pairs = extract_pairs(html or "", text_selectors, date_selectors, container)
                rows = [(i, t, d, None) for i, (t, d) in enumerate(pairs) if t]
            except (AssertionError, ValueError, NotImplementedError) as e:  # what the tokenizer raises
                rows = [(None, None, None, f"{type(e).__name__}: {e}")]
            for row in rows:
                at.append(k)
                for column, value in zip((pos, texts, dates, errors), row, strict=True):
                    column.append(value)
        kept = batch.select(list(keep)).take(pa.array(at, pa.int64()))
        found = [pa.array(pos, pa.int32())] + [pa.array(c, pa.string()) for c in (texts, dates, errors)]
        yield pa.RecordBatch.from_arrays([*kept.columns, *found], [*keep, "pos", "text", "date", "error"])


def _parsed(pages: DataFrame, text_selectors: Sequence[str], date_selectors: Sequence[str],
            container: str | None, keep: Sequence[str], html_col: str) -> DataFrame:
    """keep..., pos, text, date, error: a row per comment (error null), and one per page
    that could not be parsed (only error set)."""
    keep = tuple(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _comment_batches(batches, text_selectors, date_selectors, container, keep)

    src = pages.select(*keep, F.col(html_col).alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("__html").schema.fields)
    return src.mapInArrow(run, f"{fields}, pos int, text string, date string, error string")


def extract_first_selector(pages: DataFrame, text_selectors: Sequence[str], date_selectors: Sequence[str],
                           html_col: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Rows (keep..., pos, text, date) of the first selector with any hit, dates
    paired by position; missing date -> ''."""
    return _parsed(pages, tuple(text_selectors), tuple(date_selectors), None, keep, html_col).where("error IS NULL").drop("error")


def extract_nested(pages: DataFrame, text_selectors: Sequence[str], date_selectors: Sequence[str],
                   container: str | None = None, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """S18 inside container elements: each one's own text and date."""
    return _parsed(pages, tuple(text_selectors), tuple(date_selectors), container, keep, "html").where("error IS NULL").drop("error")


def keyword_filter(rows: DataFrame, keywords: Sequence[str], text_col: str = "text") -> DataFrame:
    """M2 (case-sensitive, first in dictionary order) + M4: keep hits only."""
    return with_nonnull(rows, M.first_match(F.col(text_col), keywords, ci=False), "keyword")


def page_failed(html: Column) -> Column:
    """A page whose document did not finish loading (no closing html tag)."""
    return F.coalesce(~F.lower(html).contains("</html>"), F.lit(True))


def error_rows(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One quarantine row per failed page (not loaded, or rejected by the parser):
    blank keyword/text/date + error."""
    loaded = pages.where(~page_failed(F.col("html")))
    rejected = _parsed(loaded, (), (), None, keep, "html").where("error IS NOT NULL").select(*keep, "error")
    unloaded = pages.where(page_failed(F.col("html"))).select(*keep, F.lit("page did not finish loading").alias("error"))
    blank = [F.lit("").alias(c) for c in ("keyword", "comment_text", "comment_date_raw")]
    return unloaded.unionByName(rejected).select(*keep, *blank, "error")

"""Keyword matching as Column expressions.

Short dictionaries are a chain of `contains` tests in generated code. Longer ones go
through a multi-pattern automaton over Arrow batches (`functions.automaton`), one pass per
text whatever their size; rows and order are the same. Dictionary order decides the
"first" hit, not the position in the text. Blank keywords are skipped. For `ci` text and
keywords are lowered, the text by the engine on both ways.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kwspread.functions import automaton

#: Longest dictionary that stays in generated code, one test per keyword.
CHAIN = 32


def clean_keywords(keywords: Sequence[str]) -> list[str]:
    """Strip and drop blanks, keep order (CLI / YAML dictionary rule)."""
    out = []
    for k in keywords:
        if k is None:
            continue
        k = str(k).strip()
        if k:
            out.append(k)
    return out


def _prepared(text: Column, keywords: Sequence[str], ci: bool) -> tuple[Column, list[str], list[str]]:
    kws = [k for k in keywords if k]
    return (F.lower(text), kws, [k.lower() for k in kws]) if ci else (text, kws, kws)


def _scanner(find, returns: str, needles: list[str], keywords: list[str]):
    """A vectorised function from text to what `find` gives for the dictionary."""
    order, names = tuple(needles), tuple(keywords)

    def scan(texts: pa.Array) -> pa.Array:
        return find(texts, order, pa.array(names, pa.string()))

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, returns)


def first_match(text: Column, keywords: Sequence[str], ci: bool = True) -> Column:
    """First dictionary keyword contained in `text`; null when none or text empty."""
    text, kws, needles = _prepared(text, keywords, ci)
    if not kws:
        return F.lit(None).cast("string")
    if len(kws) > CHAIN:
        return _scanner(automaton.first_hits, "string", needles, kws)(text)
    chain = F
    for n, k in zip(needles, kws, strict=True):
        chain = chain.when(text.contains(n), F.lit(k))
    return chain


def all_matches_array(text: Column, keywords: Sequence[str], ci: bool = True) -> Column:
    """All hits as an array (dictionary order). Use for exploding to (row, keyword)."""
    text, kws, needles = _prepared(text, keywords, ci)
    none = F.array().cast("array<string>")
    if not kws:
        return none
    if len(kws) > CHAIN:
        return F.coalesce(_scanner(automaton.all_hits, "array<string>", needles, kws)(text), none)
    return F.array_compact(_marked(text, kws, needles))


def _marked(text: Column, kws: list[str], needles: list[str]) -> Column:
    """The dictionary as an array with null for every keyword that is not in the text."""
    return F.array(*[F.when(text.contains(n), F.lit(k)) for n, k in zip(needles, kws, strict=True)])


def all_matches_joined(text: Column, keywords: Sequence[str], ci: bool = True, sep: str = ";") -> Column:
    """All dictionary keywords contained in `text`, dictionary order, `sep`-joined ('' if none)."""
    lowered, kws, needles = _prepared(text, keywords, ci)
    if 0 < len(kws) <= CHAIN:
        return F.array_join(_marked(lowered, kws, needles), sep)  # leaves nulls out
    return F.array_join(all_matches_array(text, keywords, ci), sep)


def any_match(text: Column, keywords: Sequence[str], ci: bool = True) -> Column:
    """Whether `text` contains a keyword; false for a null text."""
    return first_match(text, keywords, ci).isNotNull()

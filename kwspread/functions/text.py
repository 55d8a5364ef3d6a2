"""String helpers as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   video id:   query parameter "v=", then "youtu.be/", then "embed/", id = [A-Za-z0-9_-]{6,}
#   channel id: prefix "UC", at least 10 characters; embedded form UC[A-Za-z0-9_-]{10,}
#   handle:     "youtube.com/@<handle>"
VIDEO_ID_PATTERNS = (
    r"[?&]v=([A-Za-z0-9_-]{6,})",
    r"youtu\.be/([A-Za-z0-9_-]{6,})",
    r"embed/([A-Za-z0-9_-]{6,})",
)
CHANNEL_ID_PATTERN = r"(UC[A-Za-z0-9_-]{10,})"
HANDLE_PATTERN = r"youtube\.com/@([^/]*)"

# Python's str.strip()/\s also cover U+001C-U+001F; Spark's (?U)\s does not.
UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"


# Python's whitespace set (str.isspace), derived by rule; the highest is U+3000.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(c: Column) -> Column:
    """Python-like strip(): remove leading/trailing Unicode whitespace. `btrim` with
    an explicit character set stays in codegen (no regex per row)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def nonblank(c: Column) -> Column:
    """'' -> null (so that coalesce treats empty as missing)."""
    return F.nullif(c, F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    """`a or b or ""`: first value that is neither null nor empty."""
    return F.coalesce(*[nonblank(c) for c in cols], F.lit(""))


def extract_by_chain(s: Column, patterns, fallback: Column | None = None) -> Column:
    """First pattern (in order) with a match wins; else the fallback (default: input)."""
    parts = [nonblank(F.regexp_extract(s, p, 1)) for p in patterns]
    return F.coalesce(*parts, s if fallback is None else fallback)


def video_id_from(url_or_id: Column) -> Column:
    """F1 extract_video_id: strip; v= / youtu.be/ / embed/; else the stripped input; null -> ''."""
    s = py_strip(F.coalesce(url_or_id, F.lit("")))
    return extract_by_chain(s, VIDEO_ID_PATTERNS)


def channel_id_from(s_raw: Column) -> Column:
    """F2 resolve_channel_id (pure part): UC... as-is (len>=10), else embedded UC id, else null."""
    s = py_strip(s_raw)
    return (
        F.when(s.startswith("UC") & (F.length(s) >= 10), s)
        .otherwise(nonblank(F.regexp_extract(s, CHANNEL_ID_PATTERN, 1)))
    )


def handle_from(s_raw: Column) -> Column:
    """youtube.com/@h/... -> @h; @h -> @h; other non-UC input -> '@'+s; UC ids -> null."""
    s = py_strip(s_raw)
    return (
        F.when(s.contains("youtube.com/@"), F.concat(F.lit("@"), F.regexp_extract(s, HANDLE_PATTERN, 1)))
        .when(s.startswith("@"), s)
        .when(~s.startswith("UC"), F.concat(F.lit("@"), s))
    )


def is_channel_id(s_raw: Column) -> Column:
    """F3 require_channel_id: stripped value starts with UC."""
    return F.coalesce(py_strip(s_raw).startswith("UC"), F.lit(False))


def clean_ws(c: Column, unicode: bool = True) -> Column:
    """F8 clean(): non-string/null -> ''; runs of whitespace -> one space; strip."""
    pat = UNICODE_SPACE if unicode else r"\s+"
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), pat, " "))


def newline_to_space(c: Column) -> Column:
    """replace('\\n', ' ').strip()."""
    return py_strip(F.translate(F.coalesce(c, F.lit("")), "\n", " "))


def str_strip(c: Column) -> Column:
    """F10 astype(str).strip(), with null kept as null (deliberate fix of 'nan')."""
    return py_strip(c)


def provenance_tag_keyword(kw: Column, start: Column, end: Column) -> Column:
    """F12 keyword:{kw}@{start}..{end}"""
    return F.concat(F.lit("keyword:"), kw, F.lit("@"), start, F.lit(".."), end)


def provenance_tag_channel(channel_id: Column) -> Column:
    return F.concat(F.lit("channel:"), channel_id)


def keywords_from_provenance(source: Column) -> Column:
    """';'-split, strip, keep `keyword:` parts matching ^keyword:(.+?)@.+, strip,
    strip '"' then "'", ordered distinct (first occurrence kept). Non-string -> []."""
    parts = F.transform(F.split(F.coalesce(source, F.lit("")), ";"), lambda p: py_strip(p))
    tagged = F.filter(parts, lambda p: p.startswith("keyword:") & p.rlike(r"^keyword:(.+?)@.+"))
    kws = F.transform(
        tagged,
        lambda p: F.regexp_replace(
            F.regexp_replace(py_strip(F.regexp_extract(p, r"^keyword:(.+?)@.+", 1)), "^\"+|\"+$", ""),
            "^'+|'+$",
            "",
        ),
    )
    return F.array_distinct(kws)


def preferred_url(link: Column, originallink: Column, domain: str) -> Column:
    """link if it is on the domain, else originallink."""
    return F.when(on_domain(link, domain), link).otherwise(originallink)


def on_domain(url: Column, domain: str) -> Column:
    """M8: plain substring test anywhere in the URL; null -> false."""
    return F.coalesce(url.contains(domain), F.lit(False))

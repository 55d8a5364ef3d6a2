"""Operator 6 (DataFrame functions only): homomorphic multiset hash of a document.

A document is a multiset of paragraphs: its lines that are not empty, long lines cut every
`PIECE` characters; a line's last piece carries the line end (which the last line is given,
too), so a cut piece differs from a line of the same characters. Each paragraph is hashed to a wide vector, and the fingerprint is the sum of
these vectors, entry by entry modulo powers of two:

- 4 entries modulo 2^62 hold the full hashes; they decide equality;
- 124 small entries hold single hash bits (a count each; two of them share one long, 31
  bits each, which no text's number of paragraphs passes);
- one entry counts the paragraphs.

Sums do not depend on the order of paragraphs, and a paragraph is inserted or deleted by
adding or subtracting its vector (`insert`, `delete`). With n paragraphs, 2 c - n over
the small entries c is a sum of random +-1 vectors, so the cosine of two documents'
entries estimates the shared share of their paragraphs: `likeness`, 1 for equal
fingerprints, and clipped to 0..1.

`edited_pairs` puts each document beside the next one by ascending doc_id without a
global window: documents are dealt into ranges that begin at actual doc_ids, and the
first document of a range is copied to the end of the range before. Texts are shuffled
once. Range starts are approximate quantiles (at most MAX_RANGES numbers).

Defined results: null texts count as empty; an empty document has the zero fingerprint,
is equal (1.0) to another empty one and has likeness 0 to all others; a null doc_id
comes first; equal doc_ids are ordered by text; a single document is its own next one;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kwspread.llm.common import text_or_empty

PIECE = 64
WIDE = 4
MOD_WIDE = (1 << 62) - 1
FIELD = 31
#: One bit in each of the two fields of a packed long.
BITS = 1 | 1 << FIELD
#: Hashes whose bits feed the small entries.
SMALL = 2
#: Longs of a fingerprint: wide entries, paragraph count, packed small entries.
LONGS = WIDE + 1 + SMALL * FIELD
DOCS_PER_RANGE = 2_000
MAX_RANGES = 10_000


def _sum(values: Column, part) -> Column:
    """Sum of part(value) modulo 2^62, without overflow."""
    mod = lambda x: x.bitwiseAND(F.lit(MOD_WIDE))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: mod(a + mod(part(x))))


def _seeded(seed: int):
    return lambda piece: F.xxhash64(piece, F.lit(seed))


def fingerprint_columns(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`, the fingerprint (array of LONGS longs) of the text column."""
    hashes = [f"{out}_h{k}" for k in range(WIDE)]
    df = df.withColumn(f"{out}_p", F.regexp_extract_all(F.concat(F.col(text), F.lit("\n")), F.lit(f"([^\\n]{{1,{PIECE}}}\\n?)"), F.lit(1)))
    df = df.withColumns(
        {h: F.transform(f"{out}_p", _seeded(k)) for k, h in enumerate(hashes)}
    )
    entries = [_sum(F.col(h), lambda x: x) for h in hashes] + [F.size(f"{out}_p").cast("long")]
    for h in hashes[:SMALL]:
        for shift in range(FIELD):
            entries.append(
                _sum(F.col(h), lambda x, s=shift: F.shiftrightunsigned(x, s).bitwiseAND(F.lit(BITS)))
            )
    return df.withColumn(out, F.array(*entries)).drop(f"{out}_p", *hashes)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def insert(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two multisets of paragraphs."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MOD_WIDE)))


def delete(a: Column, b: Column) -> Column:
    """Fingerprint of `a` without the paragraphs of `b` (which it must hold)."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MOD_WIDE)))


def _signs(fingerprint: Column) -> Column:
    """The small entries as sums of +-1: 2 c - n."""
    n = F.get(fingerprint, F.lit(WIDE))
    packed = F.slice(fingerprint, WIDE + 2, SMALL * FIELD)
    one = F.lit((1 << FIELD) - 1)
    field = lambda x, k: F.shiftrightunsigned(x, k * FIELD).bitwiseAND(one)
    return F.flatten(
        F.transform(packed, lambda x: F.array(*[(2 * field(x, k) - n).cast("double") for k in range(2)]))
    )


def likeness_columns(df: DataFrame, base: str, others: dict[str, str]) -> DataFrame:
    """Add for each (out: fingerprint) the likeness of `base` to it."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    prints = [base, *others.values()]
    df = df.withColumns({f"{p}_s": _signs(F.col(p)) for p in prints})
    df = df.withColumns({f"{p}_n": dot(F.col(f"{p}_s"), F.col(f"{p}_s")) for p in prints})
    out = {}
    for name, p in others.items():
        norm = F.sqrt(F.col(f"{base}_n") * F.col(f"{p}_n"))
        cosine = dot(F.col(f"{base}_s"), F.col(f"{p}_s")) / F.when(norm > 0, norm)
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0))))
        out[name] = F.when(F.col(base) == F.col(p), F.lit(1.0)).otherwise(clipped)
    return df.withColumns(out).drop(*[f"{p}_{x}" for p in prints for x in "sn"])


def edited_pairs(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty), carried columns, and those of the next document as
    next_<name>."""
    cols = ("text", *carry)
    stats = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("least")).first()
    ranges = max(1, min(MAX_RANGES, stats["n"] // DOCS_PER_RANGE))
    cuts = [k / ranges for k in range(1, ranges)]
    inner = docs.agg(F.percentile_approx("doc_id", cuts, 100 * ranges)).first()[0] if cuts and stats["ids"] else []
    nulls = stats["ids"] < stats["n"]
    least = stats["least"]
    starts = sorted({x for x in inner or [] if x != least} | ({least} if nulls and least is not None else set()))
    # Range k holds the ids from starts[k - 1] on; range 0 begins at the first row.
    at = F.lit(starts).cast("array<bigint>")
    found = _rank(starts)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    opens = F.coalesce(F.array_contains(at, F.col("doc_id")), F.lit(False)) | first
    rows = docs.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(found).cast("int"))
    before = F.when(F.col("range") == 0, F.lit(len(starts))).otherwise(F.col("range") - 1)
    own = F.struct(F.lit(0).alias("tail"), F.col("range").alias("range"))
    copy = F.struct(F.lit(1).alias("tail"), before.alias("range"))
    rows = rows.withColumn("at", F.explode(F.when(opens, F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select("doc_id", *cols, "at.tail", "at.range")
    w = Window.partitionBy("range").orderBy("tail", F.col("doc_id").asc_nulls_first(), "text")
    nexts = {f"next_{c}": F.lead(c).over(w) for c in cols}
    return rows.withColumns(nexts).where("tail = 0").drop("tail", "range")


def _rank(starts: list[int], group: int = 100) -> Column:
    """How many of the sorted starts are <= doc_id: first among every `group`-th, then
    inside the group, so about 2 * sqrt(MAX_RANGES) comparisons a row."""
    array = lambda x: F.lit(x).cast("array<bigint>")
    count = lambda xs: F.size(F.filter(xs, lambda s: s <= F.col("doc_id")))
    if len(starts) <= group:
        return count(array(starts))
    groups = [starts[k : k + group] for k in range(0, len(starts), group)]
    whole = F.greatest(count(array([g[0] for g in groups])) - 1, F.lit(0))
    return whole * group + count(F.get(F.array(*[array(g) for g in groups]), whole))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = fingerprint_columns(rows, "text", "own")
    rows = edited_pairs(rows, carry=("own",))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited",
        F.concat(F.col("text").substr(F.lit(1), (F.length("text") - half)), F.col("next_text").substr(F.lit(1), half)),
    )
    rows = fingerprint_columns(rows, "edited", "edit")
    rows = likeness_columns(rows, "own", {"near_edited": "edit", "near_next": "next_own"})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )

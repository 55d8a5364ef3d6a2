"""Operator 9 (DataFrame functions only): quality rules judged per host.

1. Every document gets its counts and the rules it fails. Two base rules reject a
   document outright (fewer than 10 words; over 20 % of its words inside repeated
   5-word windows). Two softer rules (symbols, repeated lines) only raise suspicion.
2. Failures are added up per host (partial sums before the exchange, so a host with a
   third of the rows costs no more than others). The failure rate f/n of a rule on a
   host is shrunk to (f + a) / (n + a + b); the beta prior (a, b) of each rule is fitted
   to the hosts by the method of moments. Only these few numbers reach the driver.
3. A host whose shrunk rate exceeds `host_rate` for some rule is suspect. Verdicts are
   joined back: on a suspect host, documents that fail any rule go; clean documents of a
   suspect host and suspicious documents of other hosts stay.

5-word windows are compared by 64-bit hashes within one document. Documents with no
equal pair of hashes (one hash-set pass) are done; others sort their windows.

Defined results: null and empty texts have no words and fail the first base rule; a null
host is a host of its own; each repeated row is judged separately; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwspread.operators.common import bounded_lookup
from kwspread.llm.common import WORD_GAP, materialise, native_words, text_or_empty

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: Soft rules: symbols per 100 word characters, repeated lines per 100 lines.
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 30
HOST_RATE = 0.5
RULES = ("base_failed", "fails_symbols", "fails_lines")
#: Weight limits of a fitted prior, in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Replace `grams` by n_repeat_words, the words covered by windows whose hash occurs
    twice or more. Each step is a column of its own: a lambda evaluates what it names
    once per element."""
    distinct = F.size(F.array_distinct("grams")) == F.size("grams")
    pairs = F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("sorted", F.when(~distinct, F.array_sort(pairs))).drop("grams")
    same = lambda r, k: F.coalesce(F.get("sorted", k)["h"] == r["h"], F.lit(False))
    marked = F.transform("sorted", lambda r, k: F.when(same(r, k - 1) | same(r, k + 1), r["i"]))
    df = df.withColumn("starts", F.sort_array(F.filter(marked, lambda i: i.isNotNull()))).drop("sorted")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end")),
        lambda a, i: F.struct(
            (a["covered"] + i + WINDOW - F.greatest(a["end"], i)).alias("covered"), (i + WINDOW).alias("end")
        ),
        lambda a: a["covered"].cast("long"),
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")


def document_counts(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = docs.select(
        "doc_id",
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        native_words().alias("w"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    step = step.select(
        "doc_id",
        "host",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    gram = lambda i: F.xxhash64(*[F.get(F.col("wh"), i + k) for k in range(WINDOW)])
    some = F.size("wh") >= WINDOW
    none = F.array().cast("array<bigint>")
    step = step.withColumn(
        "grams", F.when(some, F.transform(F.sequence(F.lit(0), F.size("wh") - WINDOW), gram)).otherwise(none)
    ).drop("wh")
    return _with_repeat_words(step)


def failed_rules(counts: DataFrame) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return counts.withColumns(
        {
            "base_failed": base,
            "fails_symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars"),
            "fails_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"),
        }
    )


def host_verdicts(judged: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """host, n, <rule>_rate (shrunk), suspect."""
    fails = [F.sum(F.col(r).cast("long")).alias(r) for r in RULES]
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), *fails)
    moments = [m for r in RULES for m in (F.avg(F.col(r) / F.col("n")), F.var_pop(F.col(r) / F.col("n")))]
    fitted = hosts.agg(*[m.alias(f"m{k}") for k, m in enumerate(moments)]).first()
    rates = {}
    for k, rule in enumerate(RULES):
        mean, var = fitted[2 * k] or 0.0, fitted[2 * k + 1] or 0.0
        weight = mean * (1 - mean) / var - 1 if var > 0 else PRIOR_WEIGHT[1]
        weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
        rates[f"{rule}_rate"] = (F.col(rule) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    suspect = F.greatest(*rates.values()) > host_rate
    return hosts.select("host", "n", *[v.alias(k) for k, v in rates.items()], suspect.alias("suspect"))


def host_rules(docs: DataFrame, host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """Counts, failed rules, `host`, `suspect` and `kept` per document."""
    judged = materialise(failed_rules(document_counts(docs, host_col)), "host-rules")
    # Written and counted first: broadcast if small, else both sides are plain shuffles, so a
    # hot host's rows can be split.
    verdicts = bounded_lookup(host_verdicts(judged, host_rate).select("host", "suspect"))
    soft = F.col("suspect") & (F.col("fails_symbols") | F.col("fails_lines"))
    return judged.join(verdicts, "host").withColumn("kept", ~F.col("base_failed") & ~soft)


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

_WORD = WORD_GAP.replace("[", "[^", 1)
_MOMENTS = ", ".join(
    f"avg({r} / n) AS {r}_m, var_pop({r} / n) AS {r}_v" for r in RULES
)
_PRIORS = ", ".join(
    f"{r}_m AS {r}_m, CASE WHEN {r}_v > 0 THEN least(greatest({r}_m * (1 - {r}_m) / {r}_v - 1, {PRIOR_WEIGHT[0]}), "
    f"{PRIOR_WEIGHT[1]}) ELSE {PRIOR_WEIGHT[1]} END AS {r}_w"
    for r in RULES
)
_RATES = ", ".join(f"({r} + {r}_m * {r}_w) / (n + {r}_w)" for r in RULES)

#: The same result in DuckDB, written from the definition (windows as word lists).
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents),
g AS (SELECT rid, i, w[i + 1 : i + 5] AS gram FROM (SELECT rid, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, gram FROM g GROUP BY ALL HAVING count(*) > 1),
cover AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM g JOIN twice USING (rid, gram)) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN cover USING (rid) LEFT JOIN lines USING (rid)),
j AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
         100 * n_symbols > {MAX_SYMBOL_PCT} * word_chars AS fails_symbols,
         100 * n_dup_lines > {MAX_DUP_LINE_PCT} * n_lines AS fails_lines
  FROM c),
h AS (SELECT host, count(*) AS n, {", ".join(f"sum({r}::INT) AS {r}" for r in RULES)} FROM j GROUP BY host),
p AS (SELECT {_PRIORS} FROM (SELECT {_MOMENTS} FROM h)),
v AS (SELECT host, greatest({_RATES}) > {HOST_RATE} AS suspect FROM h, p)
SELECT {", ".join(RESULT[:-1])},
       NOT base_failed AND NOT (suspect AND (fails_symbols OR fails_lines)) AS kept
FROM j JOIN v USING (host)
"""

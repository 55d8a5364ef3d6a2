"""Operator 2: URL verdicts by rules and, where none fits, by a learned model.

Rules are `host/path` prefixes with a verdict; a rule fits its host and all subdomains if
the url's path starts with the rule's path, and the longest fitting rule wins (JVM-side
expressions). All other urls are judged by logistic regression on hashed character
n-grams (3 to 5) of host and path, each normalised by the number of its n-grams. The
model is fitted on a small table of labelled urls, at most `max_labelled` of them (the
least by a hash of the url, so that the choice does not depend on partitions); they are
the only rows that reach the driver. Scoring works on Arrow batches: rolling n-gram
hashes over the bytes of a whole batch, one sum per url.

Defined results: a null url, or one without `://`, has empty host and path and fits no
rule; it is scored like any other; without labelled urls of both verdicts every score is
0.5 and the verdict `allow`; rows are judged one by one, so repeated rows get equal
results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
MAX_LABELLED = 10_000
STEPS = 80
BLOCK_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rules = list[tuple[str, str]]


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path."""
    part = lambda k: F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return df.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def fitting_rule(rules: Rules) -> Column:
    """The longest fitting rule's prefix, or null."""
    found = F.lit(None).cast("string")
    for prefix, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        cut = prefix.index("/")
        host, path = prefix[:cut], prefix[cut:]
        own = (F.col("host") == host) | F.col("host").endswith("." + host)
        found = F.when(own & F.col("path").startswith(path), F.lit(prefix)).otherwise(found)
    return found


def _gram_buckets(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all urls, and the index of the url of each."""
    size = np.fromiter(map(len, urls), np.int64, len(urls))
    raw = np.frombuffer(b"".join(urls), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(urls)), size)
    room = np.cumsum(size)[owner] - np.arange(len(raw)) if len(raw) else np.empty(0, np.int64)
    buckets, owners = [], []
    for n in GRAMS:
        whole = np.flatnonzero(room >= n)
        h = np.full(len(whole), n, np.uint64)
        for k in range(n):
            h = (h ^ raw[whole + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        buckets.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[whole])
    return np.concatenate(buckets), np.concatenate(owners)


def _marked(hosts: list, paths: list) -> list[bytes]:
    """Host and path with marks that keep their n-grams apart."""
    return [f"\x02{h}\x03\x04{p}\x05".encode() for h, p in zip(hosts, paths, strict=True)]


def _scores(urls: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    buckets, owners = _gram_buckets(urls)
    total = np.bincount(owners, weights[buckets], len(urls))
    count = np.maximum(np.bincount(owners, minlength=len(urls)), 1)
    return 1 / (1 + np.exp(-(total / np.sqrt(count) + bias)))


def fit_url_model(hosts: list, paths: list, blocked: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression by gradient steps with momentum."""
    weights, bias = np.zeros(BUCKETS), 0.0
    y = np.asarray(blocked, float)
    if not 0 < y.sum() < len(y):
        return weights, bias
    buckets, owners = _gram_buckets(_marked(hosts, paths))
    scale = 1 / np.sqrt(np.maximum(np.bincount(owners, minlength=len(y)), 1))
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    speed, bias_speed = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        z = np.bincount(owners, weights[buckets], len(y)) * scale + bias
        error = (1 / (1 + np.exp(-z)) - y) * balance
        speed = 0.9 * speed - 4.0 * np.bincount(buckets, (error * scale)[owners], BUCKETS)
        bias_speed = 0.9 * bias_speed - 4.0 * error.sum()
        weights, bias = weights + speed, bias + bias_speed
    return weights, float(bias)


def labelled_urls(urls: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """At most `most` distinct urls (host, path, blocked), by the order of a hash."""
    distinct = urls.select("host", "path", "blocked").distinct()
    return distinct.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(most)


def judge_urls(
    pages: DataFrame, rules: Rules, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages (page_id, url).

    `labelled` holds url and blocked (boolean); by default the urls of `pages` that a
    rule decides are the labelled ones.
    """
    judged = url_parts(pages.select("page_id", "url")).withColumn("rule", fitting_rule(rules))
    decided = F.create_map(*[F.lit(x) for rule in rules for x in rule])[F.col("rule")]
    if labelled is None:
        known = judged.where(F.col("rule").isNotNull()).select("host", "path", (decided == "block").alias("blocked"))
    else:
        known = url_parts(labelled.where("blocked IS NOT NULL")).select("host", "path", "blocked")
    sample = labelled_urls(known, max_labelled).toPandas()
    weights, bias = fit_url_model(list(sample["host"]), list(sample["path"]), sample["blocked"].to_numpy(bool))
    model = pages.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            urls = _marked(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield batch.append_column("score", pa.array(_scores(urls, w, b), pa.float64()))

    scored = judged.drop("url").mapInArrow(score, "page_id long, host string, path string, rule string, score double")
    learned = F.when(F.col("score") > BLOCK_AT, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(decided, learned).alias("verdict"), "score")

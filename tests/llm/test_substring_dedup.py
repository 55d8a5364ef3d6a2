"""Substring dedup (1) and its index against plain counts of windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import NASTY, documents

from kwspread.llm import substring_dedup as S
from kwspread.llm.fm_index import FMIndex, matching_statistics


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    shared, short = text(60), text(34)
    texts = [text(rng.randrange(1, 150)) for _ in range(30)]
    texts += [f"{text(rng.randrange(40))} {shared}\n{text(rng.randrange(40))}" for _ in range(40)]
    texts += [f"{text(5)} {short} {text(5)}" for _ in range(3)]
    texts += [text(50) + " " + shared[: len(shared) // 2] + " " + shared, "a " * 200, "a b " * 60, texts[0], texts[1]]
    texts += [texts[5]] * 12
    return [(k + 100, t) for k, t in enumerate(texts)] + [(r[0], r[1]) for r in NASTY]


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_equals_window_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)  # 2: anchors of the shared passage are cut into windows
    monkeypatch.setattr(S, "SEGMENTS_PER_SHARD", 20)
    rows = corpus()
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows])
    got = sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark, empty):
    assert S.substring_digest(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(1, long), (1, "x " + long), (None, long + " y"), (2, None), (2, None), (3, "z")]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows])
    got = sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str)
    assert got == brute(rows)
    kept = S.remove_repeats(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.text) for r in kept.collect()) == sorted(["", "x", "y", "None", "None", "z"])


def test_matching_statistics_equal_counts():
    rng = np.random.default_rng(2)
    for _ in range(12):
        m, symbols = int(rng.integers(1, 8)), int(rng.integers(2, 6))
        sizes, weights = rng.integers(1, 14, m), rng.integers(1, 3, m)
        words = rng.integers(0, symbols, sizes.sum())
        index = FMIndex(words, sizes, weights, symbols)
        texts = [tuple(x.tolist()) for x in np.split(words, np.cumsum(sizes)[:-1])]
        asked = rng.integers(-1, symbols, 30)
        for least in (1, 2, 3):
            want = []
            for i in range(30):
                n = 0
                while i + n < 30:
                    p = tuple(asked[i : i + n + 1].tolist())
                    found = sum(
                        int(w) for t, w in zip(texts, weights, strict=True) for j in range(len(t)) if t[j : j + n + 1] == p
                    )
                    if found < least:
                        break
                    n += 1
                want.append(n)
            assert matching_statistics(index, asked, np.array([30]), least).tolist() == want


def test_windows_with_unlike_sides(spark):
    """Windows shared at text ends and with unlike neighbours, among many chance anchors."""
    rng = random.Random(12)
    few = lambda n: " ".join(rng.choice(["a", "b", "c"]) for _ in range(n))
    texts = [few(rng.randrange(0, 90)) for _ in range(60)]
    for n in (34, 35, 36, 49, 64):
        shared = few(n)
        texts += [shared, shared + " x " + few(30), few(30) + " y " + shared, few(3) + " z " + shared + " q " + few(20)]
    rows = list(enumerate(texts))
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows])
    assert sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str) == brute(rows)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = " ".join(f"w{k}" for k in range(50))
    docs = documents(spark, [(1, long, "en", "a", 1), (2, "x " + long, "en", "a", 1), (3, "z", "en", "a", 1)])
    docs = docs.withColumn("repeat_row", F.lit("own")).withColumn("repeat_hits", F.col("doc_id") * 2).withColumn("anchor", F.lit(None).cast("int"))
    kept = S.remove_repeats(docs)
    assert kept.schema == docs.schema
    assert sorted((r.text, r.repeat_row, r.repeat_hits) for r in kept.collect()) == [("", "own", 2), ("x", "own", 4), ("z", "own", 6)]


def test_segments_repeated_on_end_are_one_row(spark):
    """Narrow rows follow the documents, not how often a line or word pair stands in them."""
    import pyarrow as pa

    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    line = text(40)
    texts = [f"{text(20)} {'left right ' * n}{text(20)}" for n in (400, 400, 30, 19)]
    texts += [f"{text(9)} {(line + ' ') * n}{text(9)}" for n in (1, 60)] + ["x " * 34, "x " * 35, "y " * 36, text(80)]
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "text": texts})
    (rows,) = S._anchor_rows(iter([batch]))
    assert rows.num_rows < 15 * len(texts)
    places = [at for row in rows.to_pylist() for at in (row["at"], *(row["more"] or ()))]
    windows = sum(max(0, len(t.split()) - S.WINDOW + 1) for t in texts)
    assert sum(at % 64 for at in places) == windows  # every window in exactly one of them
    (none,) = S._anchor_rows(iter([batch.slice(6, 1)]))
    assert none.num_rows == 0
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    assert sorted((tuple(r) for r in S.substring_digest(docs).collect()), key=str) == brute(list(enumerate(texts)))

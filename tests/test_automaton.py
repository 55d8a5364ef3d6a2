"""The multi-pattern automaton against plain containment."""

import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kwspread.functions import automaton as A
from kwspread.functions import match as M

PIECES = st.text(alphabet="abcäß日 ;", max_size=6)


def plain(texts, needles):
    return [None if t is None else [k for k in needles if k in t] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcäß日 ;", max_size=40)), max_size=8), st.lists(PIECES.filter(bool), min_size=1, max_size=12))
def test_hits_are_containment(texts, needles):
    column, names = pa.array(texts, pa.string()), pa.array(needles)
    want = plain(texts, needles)
    assert A.all_hits(column, tuple(needles), names).to_pylist() == want
    assert A.first_hits(column, tuple(needles), names).to_pylist() == [(w or [None])[0] for w in want]


def some_dictionary(rng, n):
    out = {}
    while len(out) < n:
        out["".join(rng.choices("abcdefghijklmnop", k=rng.choice([2, 3, 6, 9, 14, 40])))] = None
    return list(out)


def test_several_tables_and_long_texts():
    rng = random.Random(1)
    needles = some_dictionary(rng, 900)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=n)) + needles[n % 900] for n in (0, 1, 255, 256, 257, 511, 5_000, 70_000)]
    pairs = [A.Dictionary(needles, cells=c).hits(pa.array(texts)) for c in (A.TABLE_CELLS, 4_000)]
    assert len(A.Dictionary(needles, cells=4_000).tables) > 5
    assert all((a == b).all() for a, b in zip(*pairs, strict=True))
    found = [[needles[w] for t, w in zip(*pairs[0], strict=True) if t == k] for k in range(len(texts))]
    assert found == plain(texts, needles)


def test_sliced_arrays_and_empty_batches():
    column = pa.array(["xx", None, "ab", "", "cab"]).slice(1)
    assert A.all_hits(column, ("ab", "c"), pa.array(["AB", "C"])).to_pylist() == [None, ["AB"], [], ["AB", "C"]]
    assert A.all_hits(pa.array([], pa.string()), ("ab",), pa.array(["ab"])).to_pylist() == []


def test_time_hardly_grows_with_the_dictionary():
    rng = random.Random(2)
    texts = pa.array(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2_000)) for _ in range(2_000)])
    spent = {}
    for n in (100, 10_000):
        needles = tuple("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice([6, 8, 11, 20]))) for _ in range(n))
        A.compiled(needles)
        spent[n] = min(_timed(texts, needles) for _ in range(3))
    assert spent[10_000] < 4 * spent[100]  # a hundred times the keywords


def _timed(texts, needles):
    t0 = time.perf_counter()
    A.compiled(needles).hits(texts)
    return time.perf_counter() - t0


@pytest.mark.parametrize("ci", [True, False])
@pytest.mark.parametrize("n", [1, M.CHAIN, M.CHAIN + 1, 10_000])
def test_columns_agree_on_both_sides_of_the_chain(spark, n, ci):
    rng = random.Random(n)
    kws = some_dictionary(rng, n - 1) + ["Ökonom"]
    rows = [(k, t) for k, t in enumerate([None, "", "ÖKONOM", "Ökonom aus", *("".join(rng.choices("abcdefghijklmnopABC ", k=60)) + rng.choice(kws).upper()[: k % 7] + rng.choice(kws) for k in range(40))])]
    df = spark.createDataFrame(rows, "k int, text string")
    got = df.select("k", M.first_match(F.col("text"), kws, ci).alias("f"), M.all_matches_array(F.col("text"), kws, ci).alias("a"),
                    M.all_matches_joined(F.col("text"), kws, ci).alias("j"), M.any_match(F.col("text"), kws, ci).alias("y")).collect()
    for r in got:
        text = rows[r.k][1]
        low = (lambda s: s.lower()) if ci else (lambda s: s)
        want = [k for k in kws if text and low(k) in low(text)]
        assert (r.f, r.a, r.j, r.y) == ((want or [None])[0], want, ";".join(want), bool(want))

"""Near duplicates (3) against all pairs of shingle sets."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from kwspread.llm import components as components_module
from kwspread.llm import lsh_forest as L
from kwspread.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width=4):
    sets = {i: shingle_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(rng, n, base, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    passage = text(60)
    texts = [text(rng.randrange(1, 200)) for _ in range(60)]
    texts += [passage + " " + text(rng.randrange(5, 90)) for _ in range(60)]
    texts += near_copies(rng, 260, text(180), 7)  # a crowd larger than one part
    texts += near_copies(rng, 40, text(90), 4)
    texts += [texts[3]] * 30 + ["One two three", "one TWO three", "one two", None, "", " \n", "a b c d", "A b c D"]
    rows = list(enumerate(texts))
    got = L.near_duplicates(documents(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == brute(rows)


def test_odd_rows(spark, nasty, empty):
    assert L.near_duplicates(empty).count() == 0
    got = {r.doc_id: r for r in L.near_duplicates(nasty).collect()}
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0
    assert got[6].component_id == 5 and not got[6].kept and got[5].kept
    rows = [(1, "a b c d e f", "en", "a", 1), (1, "x y z u v w", "en", "a", 1), (2, "x y z u v w", "en", "a", 1),
            (0, "a b c d e f", "en", "a", 1), (None, "a b c d e f", "en", "a", 1)]
    got = L.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(0, 0), (1, 0), (1, 0), (2, 0)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


@pytest.mark.parametrize("edges_per_task", [500_000, 7])
def test_components_of_paths_and_stars(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(components_module, "EDGES_PER_TASK", edges_per_task)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(50)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_crowded_region_keeps_pairs_linear():
    keys = np.tile(np.arange(L.MAX_DEPTH + 1, dtype=np.uint32), (5000, 1))
    a, b = L.neighbour_pairs(keys, np.zeros((5000, 16), np.uint8))
    assert len(a) <= 16 * 5000
    assert set(range(1, 5000)) <= set(b[a == 0])  # all of them through the centre


def test_crowded_family_of_templates_equals_all_pairs(spark):
    """Two variants per slot: thousands of texts share regions, few share a centre."""
    rng = random.Random(11)
    slots = [[" ".join(f"s{k}v{v}x{j}" for j in range(3)) for v in (0, 1)] for k in range(120)]
    texts = list(dict.fromkeys(" ".join(s[rng.random() < 0.06] for s in slots) for _ in range(2200)))
    rows = list(enumerate(texts))
    got = L.near_duplicates(documents(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()
    sets = [shingle_set(t) for t in texts]
    names = {s: k for k, s in enumerate(set().union(*sets))}
    inside = np.zeros((len(sets), len(names)), np.float32)
    for k, s in enumerate(sets):
        inside[k, [names[x] for x in s]] = 1
    shared, size = inside @ inside.T, inside.sum(1)
    linked = 100 * shared >= 80 * (size[:, None] + size[None, :] - shared)
    want = np.arange(len(sets))
    while True:
        least = np.where(linked, want[None, :], len(sets)).min(1)
        if (least == want).all():
            break
        want = least
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want.tolist()))


def test_regions_are_whole_over_cuts(spark, monkeypatch):
    """Links that the fast walk leaves out are found, here because it finds none."""
    monkeypatch.setattr(L, "candidate_pairs", lambda classes: classes.sparkSession.createDataFrame([], "u long, v long"))
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(30)]
    texts += near_copies(rng, 60, texts[0], 5) + near_copies(rng, 20, texts[1], 3)
    rows = list(enumerate(texts))
    got = L.near_duplicates(documents(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == brute(rows)


def test_shingle_width_is_a_parameter(spark):
    """Five scattered words of 200 changed: 177/217 by four words, 171/221 by five."""
    words = [f"w{k}" for k in range(200)]
    far, near = list(words), list(words)
    for k in range(20, 200, 40):
        far[k] = f"x{k}"
    near[20] = "y"
    docs = documents(spark, [(i, " ".join(t), "en", "a", 1) for i, t in enumerate((words, far, near))])
    groups = lambda width: [r.component_id for r in L.near_duplicates(docs, width).orderBy("doc_id").collect()]
    assert groups(4) == [0, 0, 0] and groups(5) == [0, 1, 0]


def boilerplate(rng, n):
    """Pages with a common frame, similarity 0.6 to each other: none is linked."""
    frame = " ".join(f"f{k}" for k in range(153))
    return [frame + " " + " ".join(f"p{i}x{rng.randrange(10**6)}" for _ in range(50)) for i in range(n)]


def test_boilerplate_pages_meet_nobody(spark, monkeypatch):
    """Rows compared in step 4 stay in proportion to the pages."""
    met = {}
    real = L._across
    for n in (200, 1_000):
        compared = []

        def counting(rows, values, exact):
            sizes = rows.groupBy("owner").agg(F.count("*").alias("n"), F.countDistinct("component").alias("c")).where("c > 1")
            compared.append(sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0])
            return real(rows, values, exact)

        monkeypatch.setattr(L, "_across", counting)
        rows = list(enumerate(boilerplate(random.Random(n), n)))
        got = L.near_duplicates(documents(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()
        assert all(r.component_id == r.doc_id for r in got)
        met[n] = sum(compared) / n
    assert met[1_000] <= 2 * met[200] + 2


def test_beginnings_of_similar_sets_meet():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, L.BUCKETS)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.1, 0.2])]
        b = np.unique(np.concatenate((b, rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64))))
        if len(b) and L.similar(a, b):
            assert np.intersect1d(L.beginning(a, counts), L.beginning(b, counts)).size

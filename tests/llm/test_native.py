"""Fingerprints (6) against a plain version, host rules (9) against their definition."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from conftest_llm import NASTY, documents
from oracle import duck
from pyspark.sql import functions as F

from kwspread.llm import fingerprints as P
from kwspread.llm import host_rules as H
from kwspread.llm.queries import op9_host_rules

SMALL = "/root/testdata/sf0.001"
MOD = 1 << 62




def pieces_of(text):
    return re.findall(r"[^\n]{1,64}\n?", text + "\n")


def plain_vector(text, hashes):
    return [hashes[p] for p in pieces_of(text)]


def likeness(a, b):
    def signs(rows):
        return [sum(2 * (h[k] >> (s + 31 * j) & 1) - 1 for h in rows) for k in range(2) for s in range(31) for j in range(2)]

    if Counter(map(tuple, a)) == Counter(map(tuple, b)):
        return 1.0
    x, y = signs(a), signs(b)
    norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(u * v for u, v in zip(x, y, strict=True)) / norm)) if norm else 0.0


def test_fingerprints_equal_plain_version(spark):
    docs = documents(spark).unionByName(
        spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"), allowMissingColumns=True
    )
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    nexts = [rows[(k + 1) % len(rows)][1] for k in range(len(rows))]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), n in zip(rows, nexts, strict=True)]
    pieces = {p for t in [t for _, t in rows] + edited for p in pieces_of(t)}
    df = spark.createDataFrame([(p,) for p in pieces], "p string")
    told = df.select("p", *[F.xxhash64("p", F.lit(k)).alias(f"h{k}") for k in range(P.WIDE)]).collect()
    hashes = {r.p: [r[f"h{k}"] & (2**64 - 1) for k in range(P.WIDE)] for r in told}
    got = {r.doc_id: r for r in P.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    for (i, t), n, e in zip(rows, nexts, edited, strict=True):
        r = got[i]
        a, b, c = (plain_vector(x, hashes) for x in (t, e, n))
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        wide = "".join(f"{sum(h[k] for h in a) % MOD:016x}" for k in range(P.WIDE)) + f"{len(a):016x}"
        assert r.fingerprint.startswith(wide) and len(r.fingerprint) == 16 * P.LONGS
        assert abs(r.near_edited - likeness(a, b)) < 1e-9 and abs(r.near_next - likeness(a, c)) < 1e-9


def test_counts_of_very_long_texts_do_not_run_over(spark):
    """Proportional multisets of more than 2 ** 20 lines, and lines in other order."""
    rows = [(1, "a\n" * 1_048_566), (2, "a\n" * 1_050_576), (3, "b\na"), (4, "a\nb\n")]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows]).select("doc_id", "text")
    got = {r.doc_id: r for r in P.fingerprint_documents(docs).collect()}
    assert abs(got[1].near_next - 1) < 1e-9 and abs(got[1].near_edited - 1) < 1e-9
    assert got[1].fingerprint != got[2].fingerprint and got[3].fingerprint == got[4].fingerprint and got[3].near_next == 1.0


def test_a_cut_piece_is_no_line(spark):
    long = "a" * 64
    docs = documents(spark, [(1, long + "b", "en", "a", 1), (2, long + "\nb", "en", "a", 1)]).select("doc_id", "text")
    got = {r.doc_id: r for r in P.fingerprint_documents(docs).collect()}
    assert got[1].fingerprint != got[2].fingerprint and got[1].near_next < 1


def test_ranges_and_ties_give_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(P, "DOCS_PER_RANGE", 3)
    rows = [(None, "n2"), (None, "n1")] + [(k // 2 if k < 10 else k, f"t{k % 7}{k}") for k in range(40)]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows]).select("doc_id", "text")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((str(i), t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    got = sorted((str(r.doc_id), r.text, r.next_text) for r in P.edited_pairs(docs).collect())
    assert got == want
    one = documents(spark, NASTY[4:5]).select("doc_id", "text")
    assert [r.next_text for r in P.edited_pairs(one).collect()] == [NASTY[4][1]]
    assert P.fingerprint_documents(docs.where("doc_id < -5")).count() == 0


def test_insert_and_delete(spark):
    df = spark.createDataFrame([("a\nb\nc", "c\na", "b")], "x string, y string, z string")
    for c in "xyz":
        df = P.fingerprint_columns(df, c, f"f{c}")
    r = df.select("fx", P.insert(F.col("fy"), F.col("fz")).alias("sum"), "fy", P.delete(F.col("fx"), F.col("fz")).alias("rest")).first()
    assert r["sum"] == r.fx and r.rest == r.fy


def test_host_rules_equal_sql(spark):
    want = duck(SMALL).sql(H.SQL).fetchall()
    got = [tuple(r) for r in op9_host_rules(spark, SMALL).collect()]
    assert sorted(got) == sorted(want)


def repeat_words(words):
    grams = defaultdict(list)
    for k in range(len(words) - 4):
        grams[tuple(words[k : k + 5])].append(k)
    return len({p for at in grams.values() if len(at) > 1 for k in at for p in range(k, k + 5)})


def test_host_rules_of_odd_rows(spark, nasty, empty):
    bad = [(200 + k, "###$$$ %%% *** words &&& here ||| and <<< there >>> so " + str(k), "en", "spam", 1) for k in range(60)]
    fine = [(300 + k, "one plain line of good words that nobody would call bad " + str(k), "en", h, 1) for k, h in enumerate(["spam"] + ["ok"] * 40)]
    docs = nasty.unionByName(documents(spark, bad + fine))
    got = {r.doc_id: r for r in H.host_rules(docs).collect()}
    for i, t, *_ in NASTY:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeat_words(words))
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
    assert all(not got[i].kept and not got[i].base_failed for i, *_ in bad)  # failing rows of a bad host go
    assert all(got[i].kept for i, *_ in fine)  # clean rows stay, on any host
    assert H.host_rules(empty).count() == 0

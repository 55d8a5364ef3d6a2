"""Quality scores (7) by held-out accuracy, url verdicts (2) by the rules as written."""

import zlib

import numpy as np
import pyarrow as pa
from conftest_llm import NASTY, documents

from kwspread.llm import quality as Q
from kwspread.llm import url_filter as U
from kwspread.llm.queries import URL_RULES, op2_url_filter, op7_quality_network

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = op7_quality_network(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and labels.get(r.doc_id) is not None:
            right.append(r.predicted == labels[r.doc_id])
    assert len(right) > 40 and np.mean(right) >= 0.97


def test_quality_of_odd_rows(spark, nasty, empty):
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0), (4, 1, 0), (4, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.score for r in Q.quality_digest(nasty, labels).collect()}
    assert len(rows) == len(NASTY) and rows[5] == rows[6] and rows[1] == rows[2] == rows[3]
    assert Q.quality_digest(empty, labels).count() == 0
    none = labels.where("doc_id < 0")
    assert {r.score for r in Q.quality_digest(nasty, none).collect()} == {0.5}
    kept = Q.score_quality(documents(spark, NASTY[:2]), none, out="other")
    assert kept.columns[-1] == "other"


def plain_sums(texts, index):
    shape, word, counts = Q.Symbols().of(pa.array(texts, pa.string()))
    want = np.zeros(index.shape, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    for i in range(len(doc)):
        for j in range(max(0, i - Q.AROUND), min(len(doc), i + Q.AROUND + 1)):
            if i != j and doc[i] == doc[j]:
                for row in (shape[i], word[i]):
                    want[row] += (index[shape[j]] + index[word[j]]).astype(np.int64)
    return want


def test_contexts_equal_plain_sums(monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 7)
    texts = ["a b c a b", None, "a", "b c b a a a", "x y z " * 9]
    index = Q.index_vectors(np.random.default_rng(1))
    padded = np.vstack((index, np.zeros((1, Q.DIM)))).astype(np.int8)
    total = np.zeros(padded.shape, np.int64)
    shape, word, counts = Q.Symbols().of(pa.array(texts, pa.string()))
    Q.add_contexts(total, shape, word, counts, padded)
    assert (total[:-1] == plain_sums(texts, index)).all()
    pooled = Q._pool(index, word, counts)
    assert np.allclose(pooled[3], index[word[6:12]].mean(axis=0)) and not pooled[1].any()


def test_context_sums_cover_all_documents(spark, nasty, empty):
    docs = nasty.select("doc_id", "text").repartition(4)
    index = Q.index_vectors(np.random.default_rng(Q.SEED))
    want = plain_sums([r.text for r in docs.collect()], index)
    assert (Q.context_sums(docs) == want).all() and want.any()
    assert not Q.context_sums(empty).any()
    vectors = Q.symbol_vectors(want)
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1) and np.allclose(vectors[0], (index[0] + want[0]) / np.linalg.norm(index[0] + want[0]))


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        p for p, _ in URL_RULES
        if (host == p.split("/")[0] or host.endswith("." + p.split("/")[0])) and path.startswith(p[p.index("/") :])
    ]
    return host, path, max(fits, key=len, default=None)


def test_rules_equal_plain_rules(spark):
    odd = [
        None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/q#f",
        "http://example.com/en", "http://example.com?x=/en/", "http://net/es/", "ftp://x.net/fr/1?y", "http://xnet/es/", "a\nb://x.NET/fr/\n",
        "http://ÄB.com/é", "://://com/", "http://example.com/de/", "http://example.com/de/",
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(odd)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in U.judge_urls(pages, URL_RULES).collect()}
    for k, u in enumerate(odd):
        assert (got[k].host, got[k].path, got[k].rule) == plain_rule(u), u
        if got[k].rule:
            assert got[k].verdict == dict(URL_RULES)[got[k].rule]
        else:
            assert got[k].verdict in ("allow", "block")
    assert U.judge_urls(pages.where("page_id < 0"), URL_RULES).count() == 0


def test_learned_verdicts(spark):
    rows = op2_url_filter(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    hosts = [f"h{k}.shop.example" if k % 2 else f"h{k}.news.example" for k in range(400)]
    paths = [f"/buy/{k}" if k % 2 else f"/story/{k}" for k in range(400)]
    blocked = np.arange(400) % 2 == 1
    weights, bias = U.fit_url_model(hosts[:300], paths[:300], blocked[:300])
    scores = U._scores(U._marked(hosts[300:], paths[300:]), weights, bias)
    assert ((scores > 0.5) == blocked[300:]).mean() >= 0.97

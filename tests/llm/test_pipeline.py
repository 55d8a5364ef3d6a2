"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import public_tokenizers
import pytest
from test_lsh_forest import brute as near_groups
from test_personal_data import brute as base_spans
from test_substring_dedup import brute as repeats
from tokenizers import Tokenizer

import corpus_pipeline as C

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(C.materialise(stage(spark, out[-1], SMALL), "stage"))
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert all(r.n_chars == len(r.text) for r in df.collect() if r.text is not None)


def test_quality_keeps_good_and_drops_bad(spark, stages):
    left = {r.doc_id for r in stages[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    right = [(d in left) == (q == 1) for d, q in labels.items()]
    assert sum(right) >= 0.97 * len(right)
    before = dict(texts(stages[0]))
    assert all(before[d] == t for d, t in texts(stages[1]))


def test_near_copies_and_repeats(stages):
    before = texts(stages[1])
    kept = {i for i, (_, _, k) in near_groups(before, 5).items() if k}  # five words in a stage
    assert {d for d, _ in texts(stages[2])} == kept
    removed = {r[0]: r[2] for r in repeats(texts(stages[2]))}
    after = dict(texts(stages[3]))
    for d, t in texts(stages[2]):
        assert len(after[d].split(" ")) if not removed[d] else len(after[d].split()) == len(t.split()) - removed[d]
        assert removed[d] or after[d] == t


def test_personal_data_is_gone(stages):
    before = dict(texts(stages[3]))
    for d, t in texts(stages[4]):
        spans = base_spans(before[d])
        assert (t == before[d]) or "<" in t
        for a, _, b in spans:
            assert before[d][a:b] not in t or before[d].count(before[d][a:b]) == 0


def test_run_packs_all_tokens(spark, stages):
    t = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    t.no_padding()
    t.no_truncation()
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in texts(stages[4])}
    got = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert C.run(spark, SMALL).count() == stages[5].count()

"""Every stage of the pipeline on odd rows and clashing columns."""

import pytest
from conftest_llm import NASTY, documents
from pyspark.sql import functions as F

import corpus_pipeline as C

SMALL = "/root/testdata/sf0.001"
CLASHES = "score stage_quality_score out node set component row part bin key spans repeat_row repeat_hits anchor mask host label quality kept".split()


def odd(spark):
    long = " ".join(f"w{k % 977}" for k in range(120_000))
    rows = [*NASTY, (None, "no id here at all", "en", "z", 17), (None, None, None, None, None), (5, "another text under one id", "en", "b", 25),
            (50, long, "en", "b", len(long)), (51, long, "de", "c", len(long)), (52, "call +1 (212) 555-0123 or me@x.org", "en", "b", 34)]
    return documents(spark, rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_odd_rows(spark, name, stage):
    docs = C.materialise(odd(spark), "odd")
    out = stage(spark, docs, SMALL)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    before = {}
    for r in docs.collect():
        before.setdefault(r.doc_id, []).append(r)
    for r in rows:
        own = [b for b in before[r.doc_id] if all(r[c] == b[c] for c in (*CLASHES, "lang", "source"))]
        assert own
        assert r.text is None or r.n_chars == len(r.text) or any(r.text == b.text for b in own)
    kept = [(r.doc_id, r.text) for r in rows]
    if name == "near-duplicate removal":
        ids = [d for d, _ in kept]
        assert 51 not in ids and 50 in ids and 6 not in ids and ids.count(None) == 2
    elif name == "substring dedup":
        assert len(kept) == docs.count() and {t for d, t in kept if d in (50, 51)} == {""}
    elif name == "personal data":
        assert (52, "call <phone> or <email>") in kept and len(kept) == docs.count()


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_empty_table(spark, name, stage):
    docs = odd(spark).where("false")
    out = stage(spark, docs, SMALL)
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)

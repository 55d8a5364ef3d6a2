"""The tokenization automaton (4) against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from conftest_llm import NASTY, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kwspread.llm.bpe_automaton import codec, codec_digest, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
ODD = [
    "aaaaaaaaa aaaa a\xa0\n\n b  c\n d  ",
    "tab\t\tx  y \n\n\nz　 q don't 'll''s <|endoftext|><|endoftext|> x",
    "日本語のテキスト 한국어 ñ́   \x85x \x1c y",
    " lead", "trail ", "\n", " ", "''''s", "\U0001f600" * 40, "ab" * 900,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_digest_equals_library(spark, library):
    docs = documents(spark, NASTY + [(100 + k, t, "en", "a", 1) for k, t in enumerate(ODD)])
    real = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    docs = docs.unionByName(real, allowMissingColumns=True)
    got = {r.doc_id: r for r in codec_digest(docs, PATH).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[r.doc_id][1:] == (len(ids), sha(",".join(map(str, ids))), sha(text)), r.doc_id


def test_ids_and_empty_table(spark, library, empty):
    rows = encode_documents(documents(spark), PATH).collect()
    for r, (_, text, *_) in zip(sorted(rows), NASTY, strict=True):
        assert r.ids == library.encode(text or "", add_special_tokens=False).ids
        assert codec(PATH).decode(r.ids) == (text or "")
    assert codec_digest(empty, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aehtin o.,'\n sé \U0001f600"), max_size=40))
def test_any_text(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    assert codec(PATH).ids([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_every_token_is_reached_by_its_own_label():
    tables = codec(PATH).tables
    made = [n for n in range(len(tables.labels)) if tables.rank[n] >= 0]
    ids, sizes = tables.encode([tables.labels[n] for n in made])
    assert (sizes == 1).all() and ids.tolist() == made

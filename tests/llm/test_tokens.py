"""Packing (8) and token files (10) against the tokenizers library run on whole texts."""

import glob
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest_llm import NASTY, documents
from tokenizers import Tokenizer

from kwspread.llm.packing import CapacityTree, best_fit_decreasing, pack_documents
from kwspread.llm.token_files import read_token_files, token_files_digest, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def corpus(spark):
    docs = documents(spark)
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs.unionByName(real.selectExpr("doc_id + 1000 AS doc_id", "text"), allowMissingColumns=True)


def test_token_files_equal_library(spark, library):
    docs = corpus(spark)
    got = {r.doc_id: r for r in token_files_digest(docs, PATH, 1).collect()}
    start = 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = [*library(r.text), 1]
        assert got[r.doc_id][1:] == (start, len(ids), crc(ids)), r
        start += len(ids)


@pytest.mark.parametrize("kind", ["dictionary", "delta"])
def test_token_files_layout_and_repeats(spark, scratch, kind, library):
    rows = NASTY[3:6] + [(5, "another", "en", "a", 1), (5, None, "en", "a", 1), (None, "no id", "en", "a", 1)]
    path = f"{scratch}/{kind}"
    write_token_files(documents(spark, rows), path, PATH, 1, ids=kind, partitions=2)
    back = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None, 4, 5, 5, 5, 6]
    texts = ["no id", NASTY[3][1], None, "another", "same text twice here", "same text twice here"]
    assert [r.ids for r in back] == [[*library(t), 1] for t in texts]
    large = documents(spark, [(k, "again and again " * 400, "en", "a", 1) for k in range(20)])
    write_token_files(large, f"{path}-large", PATH, 1, ids=kind, partitions=1)
    meta = pq.ParquetFile(glob.glob(f"{path}-large/*.parquet")[-1]).metadata.row_group(0)
    ids = meta.column(meta.num_columns - 1)
    assert ("DELTA_BINARY_PACKED" in ids.encodings) == (kind == "delta")
    assert ids.has_offset_index


def test_empty_tables(spark, empty):
    assert token_files_digest(empty, PATH, 1).count() == 0
    assert pack_documents(empty, PATH).count() == 0


def test_packing_invariants(spark, library):
    docs = corpus(spark)
    rows = pack_documents(docs, PATH, window=512).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d in docs.select("doc_id", "text").collect():
        ids, at = [*library(d.text), 2], 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(by_seq) <= total / 512 * 1.02 + 1


def test_best_fit_equals_linear_scan():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 400)
    sequence, offset = best_fit_decreasing(lengths, 64)
    room, count = {}, 0
    for k in np.argsort(-lengths, kind="stable"):
        fits = [c for c in room.values() if c >= lengths[k]]
        at = sequence[k]
        if not fits:
            assert at == count and offset[k] == 0
            room[at] = 64
            count += 1
        else:
            assert room[at] == min(fits) and offset[k] == 64 - room[at]
        room[at] -= lengths[k]


def test_capacity_tree():
    tree = CapacityTree(10)
    for c in (0, 3, 10):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (0, 1, 3, 4, 10)] == [0, 3, 3, 10, 10]
    tree.set(10, False)
    assert tree.tightest(4) == -1

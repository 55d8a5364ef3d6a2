"""Operator 13: base spans by the patterns as written, decoding against whole texts and
all taggings, and made-up secrets that the patterns miss."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from kwspread.llm import secrets_field as S

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


PIECES = ["token", "=", " ", ":", "'", '"', "PassWord", "secret", "api_key", "APIKEY", "AKIA", "ABCDEF123456", "0123456789abcdef", "deadbeef", "é", "ſecret", "\n", "x" * 12, "toKen", "=="]


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    for _ in range(3_000):
        text = "".join(rng.choices(PIECES, k=rng.randrange(1, 14)))
        assert S.base_matches(text) == plain_base(text), text
        assert [b for b, _ in S.find_secrets([text.encode(), b"x"], None)] == [plain_base(text), []]


WORDS = "the of an ordinary text with some words that mean little, and a number 12 or 1999. Mail a.b@c.example or see www.example.com/x".split()


def made(rng, key="token", chars="0123456789abcdef", n=40):
    value = "".join(rng.choices(chars, k=n))
    before, after = (" ".join(rng.choices(WORDS, k=rng.randrange(3, 40))) for _ in range(2))
    return f'{before} {key} = "{value}" {after}', value


@pytest.fixture(scope="module")
def field():
    rng = random.Random(2)
    texts = [made(rng)[0] for _ in range(80)] + [" ".join(rng.choices(WORDS, k=60)) for _ in range(80)]
    return S.fit_field([(t, 0) for t in texts])


def test_secrets_beyond_the_patterns(field):
    rng = random.Random(3)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hit, extra = 0, 0
    for k in range(60):
        key = ["pwd", "credential", "access_key", "bearer"][k % 4]
        text, value = made(rng, key, alnum, 24)
        (base, added), = S.find_secrets([text.encode()], field)
        assert not base
        hit += [text[a:b] for a, _, b in added] == [value]
        (_, wrong), = S.find_secrets([" ".join(rng.choices(WORDS, k=200)).encode()], field)
        extra += len(wrong)
    assert hit >= 54 and extra <= 1


def test_stretches_decode_as_whole_texts(field):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in range(n)).encode() for n in rng.integers(0, 40, 200)]
    tokens = S.Tokens(texts)
    for spread in (0.3, 1.0, 4.0):
        scores = rng.normal(0, spread, (len(tokens.start), 3))
        scores[:, S.O] += rng.choice([0, 3 * spread, 8 * spread], len(scores))
        moves = rng.normal(0, 1, (3, 3))
        moves[S.O, S.I] = -np.inf
        whole = []
        edges = np.flatnonzero(tokens.first)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            begin = None
            for k, tag in enumerate([*S.viterbi(scores[a:b], moves), S.O], int(a)):
                if tag != S.I and begin is not None:
                    whole.append((begin, k - 1))
                    begin = None
                if tag == S.B:
                    begin = k
        assert S.decode(tokens, scores, moves) == whole


def test_viterbi_is_the_best_of_all_taggings():
    rng = np.random.default_rng(5)
    for n in range(1, 7):
        scores, moves = rng.normal(0, 2, (n, 3)), rng.normal(0, 1, (3, 3))
        moves[S.O, S.I] = -np.inf

        def worth(tags):
            path = [S.O, *tags, S.O]
            return sum(moves[p, q] for p, q in zip(path, path[1:], strict=False)) + sum(scores[k, t] for k, t in enumerate(tags))

        best = max(product(range(3), repeat=n), key=worth)
        assert worth(S.viterbi(scores, moves)) == pytest.approx(worth(best))


def test_digest_and_mask(spark, nasty, empty):
    rng = random.Random(6)
    extra = [(10_000 + k, made(rng)[0]) for k in range(30)] + [(20_000, None), (None, "AKIA" + "A1" * 8), (20_001, ""), (20_002, "word " * 200_000 + "token: abcdefghijklmno")]
    docs = nasty.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    for r in S.secrets_digest(docs).collect():
        found = [plain_base(t) for t in texts[r["doc_id"]]]
        told = [(hashlib.sha256(S.span_text(b).encode()).hexdigest(), *[sum(k == x for _, k, _ in b) for x in range(3)]) for b in found]
        assert (r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) in told
        assert any(set(S.span_text(b).split(",")) - {""} <= set(r["spans"].split(",")) for b in found)
    masked = S.mask_secrets(docs.withColumn("secret", docs.text)).collect()
    assert len(masked) == docs.count()
    assert all(r["text"] is None or not plain_base(r["text"]) for r in masked)
    assert S.secrets_digest(empty).collect() == []

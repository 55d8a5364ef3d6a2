"""Personal data (5) against the four patterns as written."""

import hashlib
import random
import re

from conftest_llm import documents

from kwspread.llm import personal_data as P

SMALL = "/root/testdata/sf0.001"
PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                12 <= len(d) <= 19 and luhn(d),
                9 <= len(d) <= 15,
            )[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


ODD = [
    "a.b@c.d@e.f x@y z@@q.r @a.b _@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111",
    "+1 (569) 555-6633 4795326016703902 end +49 30 1234567. +1-2",
    "é 😀 me@x.org 4111111111111111é",
    "9" * 3000 + "." + "1" * 5000 + ".2.3",
    "a" * 4000 + "@" + "b." * 2000,
]


def test_base_spans_equal_patterns(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    weights = P.starting_weights()
    for text in texts:
        base, added = P.find_spans(text, weights)
        assert base == brute(text)
        assert all(y <= a or x >= b for x, _, y in added for a, _, b in base)


def test_field_parts_joined_entities():
    weights = P.fit_field(["call +1 (316) 555-2121 or 12 ab 4111111111111111, me@x.org 1.2.3.4"] * 20)
    _, added = P.find_spans("le +1 (569) 555-6633 4795326016703902 x", weights)
    assert P.span_text(added) == "phone:3:20,card:21:37"
    _, added = P.find_spans('token = "2e3f4255d83c6d187955b52107db48ee2bc368f3" 12 345 678', weights)
    assert added == []
    assert P.redact("me@x.org 1.2.3.4!", [(0, 0, 8), (9, 1, 16)]) == "<email> <ip>!"


def test_digest_of_odd_rows(spark, nasty, empty):
    rows = [(100 + k, t, "en", "a", 1) for k, t in enumerate(ODD)] + [(100, None, "en", "a", 1)]
    docs = nasty.unionByName(documents(spark, rows))
    got = P.personal_data_digest(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id < 100 or r.doc_id > 100:
            text = {100 + k: t for k, t in enumerate(ODD)}.get(r.doc_id)
            want = brute(text)
            assert r.base_sha256 == hashlib.sha256(P.span_text(want).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
    assert P.personal_data_digest(empty).count() == 0
    kept = P.redact_documents(docs)
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_field_takes_numbers_of_many_parts():
    weights = P.starting_weights()
    card = " ".join("4111111111111111")
    # Before 4795326016703902 the last 67 of the second number would be a valid card's start.
    for phone, other in (("+1 (212) 555 - 01 23", "4795326016703902"), ("+49 (0) 30 - 123 45 67", "378282246310005")):
        text = f"le {phone} {other} x"
        found = [(text[a:b], k) for a, k, b in P.find_spans(text, weights)[1]]
        assert found == [(phone, 3), (other, 2)]
    text = f"le +1 (569) 555-6633 {card} x"
    assert [(text[a:b], k) for a, k, b in P.find_spans(text, weights)[1]] == [("+1 (569) 555-6633", 3), (card, 2)]


def field():
    return P.fit_field([])


def test_numbers_that_no_pattern_touches():
    weights = field()
    for text in ("(212) 555-0123", "0049 30 1234567", "212-555-0123", "123-45-6789"):
        base, added = P.find_spans(f"call {text} now", weights)
        assert base == [] and added == [(5, P.PHONE, 5 + len(text))], text
        assert P.redact(f"call {text} now", added) == "call <phone> now"
    for text in ("2024-01-15 10.20.30", "id 1234567890", "1 000 000 000", "3.14159 2.71828", "1990-1995 2001-2003", "12 345 678 901", "9" * 5_000):
        assert P.find_spans(text, weights) == ([], []), text


def test_planted_numbers_are_found_and_others_left():
    rng = random.Random(99)
    weights, words = field(), "the of an and with some text that has no number in it".split()
    hit = planted = wrong = 0
    for _ in range(400):
        text, gold = P._made_up(rng)
        before = " ".join(rng.choices(words, k=8)) + " "
        base, added = P.find_spans(before + text + " " + " ".join(rng.choices(words, k=8)), weights)
        want = {(a + len(before), k, b + len(before)) for a, k, b in gold}
        found = set(base) | set(added)
        planted += len(want)
        hit += len(want & found)
        wrong += len({(a, b) for a, _, b in found} - {(a, b) for a, _, b in want})
    assert hit >= 0.93 * planted and wrong <= 0.06 * planted


def test_decode_is_the_best_of_all_segmentations():
    rng = random.Random(3)
    weights = {k: v + rng.gauss(0, 1) for k, v in P.starting_weights().items()}
    for text in ("+1 212 5550", "(21) 345-67", "4111 111 9 2", "1.2.3.4 123456789", "12-34 56-789"):
        text += "77"
        borders, segments = P._segments(text, 0, len(text))
        scores = P._scored(text, borders, segments, weights)
        by_start = {}
        for s, score in zip(segments, scores, strict=True):
            by_start.setdefault(s[0], []).append((s, score))

        def every(i):
            if i == len(borders) - 1:
                yield 0.0, ()
            for (a, j, kind), score in by_start.get(i, ()):
                for total, rest in every(j):
                    yield score + total, ((borders[a], kind, borders[j]), *rest)

        total, best = max(every(0), key=lambda x: x[0])
        got = P.decode(text, 0, len(text), weights)
        assert got == [s for s in best if s[1] >= 0]

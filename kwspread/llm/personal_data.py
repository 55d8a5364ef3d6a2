"""Operator 5: personal data by base patterns and a semi-Markov conditional random field.

Base spans are the leftmost non-overlapping matches of four patterns that pass their
check (range of address parts, digit count, Luhn sum). The field looks at the rest of
every text: at all stretches of digits and what parts them, and at what raw matches cover
(a pattern that swallows two entities at once, `+1 (569) 555-6633 4795326016703902`, fails
its check and is dropped), less the base spans. Its positions are atoms (runs of digits,
runs of letters, single other characters). A segment is one atom outside any entity, a
number of up to MAX_DIGITS digits however parted (card or phone), a raw address or a raw
email. Features of the whole span (its check, its groups of digits, how it begins, what
parts it, its edges) score it, and dynamic programming over the atoms picks the best
boundaries and kinds together. Base spans always stay; a decoded span is added if it
passes its kind's check and has clean edges.

The weights are fitted by gradient steps on the likelihood of stretches, shrunk towards
stated starting weights: MADE_UP made-up ones (numbers in common ways of writing, and
dates, decimals, ranges and bare numbers that are none), and at most SAMPLE_REGIONS
stretches of at most SAMPLE_DOCS documents (the least by a hash of doc_id, of at most
SAMPLE_CHARS characters each) whose base spans tell them. All patterns and the field are
linear in the text.

Defined results: null and empty texts have no spans; offsets count code points; each
repeated row is judged by itself; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract. Possessive runs and the look-behind only
#: save backtracking. An email is searched from its @, see `_emails`.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_SOME = re.compile(r"[0-9@]")

#: Digits in a row, parted by up to three of NUMBER_PARTS.
_STRETCH = re.compile(r"[+(]{0,2}[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+")
_DIGITS = re.compile("[0-9]+")

#: Digits of a number at most (those of a card), and of a stretch that is looked at.
MAX_DIGITS = 19
LEAST_DIGITS = 9
EMAIL, ADDRESS, CARD, PHONE = range(4)
MADE_UP = 800
NUMBER_PARTS = frozenset(" ().-")
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 20_000
SAMPLE_REGIONS = 300
EPOCHS = 8
STEP = 0.05
SHRINK = 0.02

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> list[tuple[int, int]]:
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append((start, done))
        at = text.find("@", at + 1)
    return found


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _passes(kind: int, span: str) -> bool:
    """The check of a raw match."""
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    digits = _digits(span)
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def raw_matches(text: str) -> list[Span]:
    if not _SOME.search(text):
        return []
    raw = [(a, 0, b) for a, b in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        raw += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return sorted(raw)


def regions(raw: list[Span]) -> list[tuple[int, int]]:
    """Stretches covered by overlapping or touching raw matches."""
    out: list[list[int]] = []
    for a, _, b in raw:
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_FULL = (_EMAIL, _IP, _CARD, _PHONE)


def segment_features(text: str, a: int, b: int, kind: int) -> dict[str, float]:
    """Features of the span as one entity; `kind` -1 is an atom outside."""
    span = text[a:b]
    if kind < 0:
        sort = "digits" if span[0].isdigit() else "letters" if span.isalpha() else "other"
        return {f"out {sort}": 1.0, "out long": float(sort == "digits" and len(span) >= 7)}
    name = KINDS[kind]
    before, after = text[a - 1 : a], text[b : b + 1]
    clean = not (before.isalnum() or before in ("+", "@")) + (after.isalnum() or after == "@")
    out = {
        name: 1.0,
        f"{name} valid" if _sound(kind, span) else f"{name} invalid": 1.0,
        f"{name} clean" if clean else f"{name} torn": 1.0,
        f"{name} wide": float("  " in span),
        f"{name} digits {min(len(_digits(span)) // 3, 7)}": 1.0,
    }
    if kind >= CARD:
        groups = [len(g) for g in _DIGITS.findall(span)]
        begins = "plus" if span[0] == "+" else "bracket" if span[0] == "(" else "zeros" if span[:2] == "00" and span[2:3] not in ("0", " ") else "digit"
        parts = "".join(sorted(set(span) & NUMBER_PARTS)) or "none"
        out |= {
            f"{name} {begins}": 1.0,
            f"{name} {begins} groups {'-'.join(map(str, groups[:6]))}": 1.0,
            f"{name} groups {min(len(groups), 6)}": 1.0,
            f"{name} parts {parts}": 1.0,
            f"{name} short groups": float(sum(g < 2 for g in groups)),
            f"{name} {begins} after digits": float(before in NUMBER_PARTS and text[a - 2 : a - 1].isdigit()),
            f"{name} {begins} before digits": float(after in NUMBER_PARTS and text[b + 1 : b + 2].isdigit()),
        }
    return out


def _sound(kind: int, span: str) -> bool:
    """The check of a kind, whatever way a number is written."""
    if kind <= ADDRESS:
        return bool(_FULL[kind].fullmatch(span)) and _passes(kind, span)
    return _passes(kind, span) and span.count("(") == span.count(")")


def starting_weights() -> dict[str, float]:
    weights = {"out digits": -0.5, "out letters": 0.0, "out other": 0.0, "out long": -1.0}
    for name in KINDS:
        weights |= {name: -1.0, f"{name} valid": 4.0, f"{name} invalid": -8.0, f"{name} clean": 0.5, f"{name} torn": -6.0}
    # A number that neither begins as an international one nor is parted tells little.
    return weights | {"phone digit": -4.0, "phone bracket": -1.0, "phone zeros": -2.0, "phone parts none": -4.0}


def _segments(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Atom borders of a region and its candidate segments (from, to, kind) by border."""
    borders = [m.start() for m in _ATOM.finditer(text, a, b)] + [b]
    at = {x: k for k, x in enumerate(borders)}
    fixed: dict[int, list[tuple[int, int]]] = {}
    for kind, matches in ((EMAIL, [(a + x, a + y) for x, y in _emails(text[a:b])]), (ADDRESS, [m.span() for m in _IP.finditer(text, a, b)])):
        for x, y in matches:
            if x in at and y in at:
                fixed.setdefault(at[x], []).append((at[y], kind))
    found = []
    for i in range(len(borders) - 1):
        found.append((i, i + 1, -1))
        found += [(i, j, kind) for j, kind in fixed.get(i, ())]
        first = text[borders[i]]
        if first not in "+(" and not "0" <= first <= "9":
            continue
        digits = 0  # numbers go on as far as their check allows, whatever parts them
        for j in range(i + 1, len(borders)):
            atom = text[borders[j - 1] : borders[j]]
            if "0" <= atom[0] <= "9":
                digits += len(atom)
                if digits > MAX_DIGITS:
                    break
                if digits >= LEAST_DIGITS:
                    found += [(i, j, kind) for kind in (CARD, PHONE)]
            elif atom not in NUMBER_PARTS and not (atom == "+" and j == i + 1):
                break
    return borders, found


def _scored(text: str, borders: list[int], segments: list, weights: dict[str, float]) -> list[float]:
    get = weights.get
    return [
        sum(get(k, 0.0) * v for k, v in segment_features(text, borders[i], borders[j], kind).items())
        for i, j, kind in segments
    ]


def decode(text: str, a: int, b: int, weights: dict[str, float]) -> list[Span]:
    """Best entities of a region."""
    borders, segments = _segments(text, a, b)
    best = [0.0] + [-math.inf] * (len(borders) - 1)
    back: list = [None] * len(borders)
    for (i, j, kind), score in zip(segments, _scored(text, borders, segments, weights), strict=True):
        if best[i] + score > best[j]:  # segments come by growing start
            best[j], back[j] = best[i] + score, (i, kind)
    spans, j = [], len(borders) - 1
    while j > 0:
        i, kind = back[j]
        if kind >= 0:
            spans.append((borders[i], kind, borders[j]))
        j = i
    return spans[::-1]


def _gradient(text: str, a: int, b: int, gold: set, weights: dict[str, float]) -> Counter:
    """Observed minus expected features of one region."""
    borders, segments = _segments(text, a, b)
    scores = _scored(text, borders, segments, weights)
    n = len(borders)
    forward, backward = np.full(n, -np.inf), np.full(n, -np.inf)
    forward[0] = backward[-1] = 0.0
    for (i, j, _), s in zip(segments, scores, strict=True):
        forward[j] = np.logaddexp(forward[j], forward[i] + s)
    for (i, j, _), s in zip(reversed(segments), reversed(scores), strict=True):
        backward[i] = np.logaddexp(backward[i], backward[j] + s)
    inside = [borders.index(x) for span in gold for x in (span[0], span[2])]
    covered = {k for p in range(0, len(inside), 2) for k in range(inside[p], inside[p + 1])}
    out: Counter = Counter()
    for (i, j, kind), s in zip(segments, scores, strict=True):
        seen = (borders[i], kind, borders[j]) in gold if kind >= 0 else i not in covered
        weight = float(seen) - math.exp(min(0.0, forward[i] + s + backward[j] - forward[-1]))
        if abs(weight) > 1e-6:
            for k, v in segment_features(text, borders[i], borders[j], kind).items():
                out[k] += weight * v
    return out


def _made_up(rng: random.Random) -> tuple[str, list[Span]]:
    """A stretch with its entities: (text, gold)."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))

    def phone() -> str:
        a, c, e = (rng.choice("23456789") + d(2) for _ in range(3))
        cc, last = rng.choice(["1", "33", "44", "49", "34", "82"]), d(4)
        return rng.choice([
            f"({a}) {c}-{last}", f"{a}-{c}-{last}", f"{a}.{c}.{last}", f"00{cc} {a[:2]} {c}{last}", f"00{cc} {a} {c} {last}",
            f"0{a[:2]} {c}{last}{d(1)}", f"{a}-{d(2)}-{last}", f"+{cc} {a} {c} {last}", f"+{cc} ({a}) {c}-{last}", f"+{cc}-{a}-{c}-{last}",
            f"+{cc} {a[:2]} {e} {d(2)} {d(2)}", f"+{cc}{a}{c}{last}", f"1-{a}-{c}-{last}", f"({a}) {c} {last}",
        ])

    def card() -> str:
        head = d(15)
        number = next(head + x for x in "0123456789" if _luhn(head + x))
        return rng.choice([number, " ".join(number[k : k + 4] for k in range(0, 16, 4)), "-".join(number[k : k + 4] for k in range(0, 16, 4))])

    def other() -> str:
        sizes = [rng.randrange(1, 6) for _ in range(rng.randrange(3, 8))]
        if sizes[:3] in ([3, 3, 4], [3, 2, 4]):
            sizes[0] = 1
        year = lambda: str(rng.randrange(1900, 2030))
        return rng.choice([
            f"{year()}-{d(2)}-{d(2)} {d(2)}.{d(2)}.{d(2)}", f"{year()}-{year()} {year()}-{year()}", " ".join(map(d, sizes)), ".".join(map(d, sizes)),
            d(rng.randrange(9, 22)), f"{d(1)}.{d(6)} {d(1)}.{d(7)}", f"{d(2)}.{d(2)}.{year()} {d(2)}.{d(2)}.{year()}", f"({year()}) {d(3)} {d(5)}",
            f"{d(3)} {d(3)} {d(3)}", f"{rng.randrange(1, 999)} {d(3)} {d(3)} {d(3)}", f"{rng.randrange(1, 999)}.{d(3)}.{d(3)}.{d(3)}", f"{year()} {year()} {year()}", f"{d(4)}-{d(6)} {d(2)}",
        ])

    makers = rng.choice([[phone], [phone], [card], [other], [other], [other], [phone, card], [phone, phone]])
    text, gold = rng.choice(["", "call ", "no. ", "x: "]), []
    for k, make in enumerate(makers):
        own = make()
        start = len(text) + (k > 0)
        text += " " * (k > 0) + own
        if make is not other:
            gold.append((start, PHONE if make is phone else CARD, start + len(own)))
    return text + rng.choice(["", ".", " and", ", or"]), gold


def _regions_of(text: str, raw: list[Span], base: list[Span]) -> list[tuple[int, int]]:
    """What the field looks at: stretches of digits and raw matches, without base spans."""
    found = [(m.start(), m.end()) for m in _STRETCH.finditer(text) if m.end() - m.start() >= LEAST_DIGITS]
    found = [x for x in found if sum(map(len, _DIGITS.findall(text, *x))) >= LEAST_DIGITS]
    whole: list[list[int]] = []
    for a, b in sorted(found + regions(raw)):
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    out, k = [], 0
    taken = regions(base)
    for a, b in whole:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(taken) and taken[j][0] < b:
            out.append((at, taken[j][0]))
            at, j = taken[j][1], j + 1
        out.append((at, b))
    return [(a, b) for a, b in out if b - a >= LEAST_DIGITS and sum(map(len, _DIGITS.findall(text, a, b))) >= LEAST_DIGITS]


def fit_field(texts: list[str]) -> dict[str, float]:
    """Weights from made-up stretches, and from regions whose raw matches all pass or are
    short numbers."""
    rng, examples = random.Random(5), []
    for text in texts:
        raw = raw_matches(text)
        for a, b in regions(raw):
            own = [m for m in raw if a <= m[0] and m[2] <= b]
            good = [m for m in own if _passes(m[1], text[m[0] : m[2]])]
            doubtful = any(m not in good and len(_digits(text[m[0] : m[2]])) >= 9 for m in own)
            gold, end = set(), -1
            for m in sorted(good, key=lambda m: (m[0], -m[2])):
                if m[0] >= end:
                    gold.add(m)
                    end = m[2]
            borders, candidates = _segments(text, a, b)
            known = {(borders[i], kind, borders[j]) for i, j, kind in candidates}
            if not doubtful and gold <= known:
                examples.append((text, a, b, gold))
        if len(examples) >= SAMPLE_REGIONS:
            break
    del examples[SAMPLE_REGIONS:]
    for _ in range(MADE_UP):
        text, gold = _made_up(rng)
        examples.append((text, 0, len(text), set(gold)))
    rng.shuffle(examples)
    start = starting_weights()
    weights = dict(start)
    for _ in range(EPOCHS):
        for text, a, b, gold in examples:
            for k, g in _gradient(text, a, b, gold, weights).items():
                now = weights.get(k, 0.0)
                weights[k] = now + STEP * (g - SHRINK * (now - start.get(k, 0.0)))
    return weights


def find_spans(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans, each by start and kind."""
    raw = raw_matches(text)
    base = [m for m in raw if _passes(m[1], text[m[0] : m[2]])]
    added = []
    for a, b in _regions_of(text, raw, base) if _SOME.search(text) else ():
        for x, kind, y in decode(text, a, b, weights):
            features = segment_features(text, x, y, kind)
            if f"{KINDS[kind]} valid" in features and f"{KINDS[kind]} clean" in features:
                added.append((x, kind, y))
    return base, added


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """Replace each maximal stretch of spans by its first kind in angle brackets."""
    out, done = [], 0
    for a, kind, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind]}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sample_texts(docs: DataFrame) -> list[str]:
    order = F.xxhash64("doc_id")
    chosen = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(SAMPLE_DOCS)
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    picked = rows.join(F.broadcast(chosen), "doc_id").orderBy(order, "doc_id", "text").limit(SAMPLE_DOCS)
    return picked.select("text").toArrow().column("text").to_pylist()


def _finder(weights: dict[str, float], describe, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(describe(batch, texts, [find_spans(t, weights) for t in texts]), schema=schema)

    return run


def _digest_columns(batch: pa.RecordBatch, texts: list[str], found: list) -> list[pa.Array]:
    counts = [Counter(k for _, k, _ in base) for base, _ in found]
    return [
        batch.column("doc_id").cast(pa.int64()),
        *[pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))],
        pa.array([hashlib.sha256(span_text(base).encode()).hexdigest() for base, _ in found]),
        pa.array([span_text(base + added) for base, added in found]),
    ]


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data_digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    names = [c.split()[0] for c in DIGEST.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names])
    return docs.mapInArrow(_finder(fit_field(sample_texts(docs)), _digest_columns, schema), DIGEST)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows with all spans of `text` replaced; other columns are kept."""
    weights = fit_field(sample_texts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            clean = [t if t is None else redact(t, sum(find_spans(t, weights), [])) for t in texts]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)

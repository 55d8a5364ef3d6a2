"""Operator 11 against a plain program per conversation and all edit strings."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest

from kwspread.llm import turn_repair as R
from kwspread.llm.ordered import joined_sha256

MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {"u": "user", "a": "assistant"}


def apply(tags: str, edits: str):
    """Cost and roles that an edit string gives, or None where it doesn't fit."""
    state, n, cost, out = 0, 0, 0, []
    for e in edits:
        if e != "I":
            if n >= len(tags):
                return None
            tag, n = tags[n], n + 1
        if e == "D":
            cost += 4
            continue
        if e != "I" and tag == "d":
            return None
        who = tag.lower() if e == "K" else "a" if state == 2 else "u"
        if (state, who) not in MOVES:
            return None
        state = MOVES[state, who]
        cost += 3 * (e in "IR") + 3 * (e != "I" and tag.isupper())
        out.append((e, who, n - 1))
    return (cost, edits, out) if n == len(tags) and state in (0, 3) else None


def plain(tags: str):
    """Least (cost, edits): one dictionary of states per row, strings compared whole."""

    def insert(best):
        out = dict(best)
        for _ in range(3):
            for s, (c, e) in list(out.items()):
                for who in "ua":
                    t = MOVES.get((s, who))
                    if t is not None and (t not in out or (c + 3, e + "I") < out[t]):
                        out[t] = (c + 3, e + "I")
        return out

    best = {0: (0, "")}
    for tag in tags:
        now = {}

        def put(s, c, e):
            if s not in now or (c, e) < now[s]:
                now[s] = (c, e)

        for s, (c, e) in insert(best).items():
            put(s, c + 4, e + "D")
            if tag != "d":
                extra = 3 * tag.isupper()
                if (s, tag.lower()) in MOVES:
                    put(MOVES[s, tag.lower()], c + extra, e + "K")
                for who in "ua":
                    if (s, who) in MOVES:
                        put(MOVES[s, who], c + 3 + extra, e + "R")
        best = now
    ends = insert(best)
    return min(ends[s] for s in (0, 3) if s in ends)


def by_matrices(tags: list[str]):
    out = {}
    import pandas as pd

    for r in R._shard(pd.DataFrame({"tags": tags})).itertuples():
        fold = R._Fold(0)
        fold.add(dict(costs=r.costs, audits=r.audits, tags=r.tags, rows=list(range(len(r.tags))), illegal=0, head=0, tail=0, blank=0, duplicate=0, truncated=0, turns=0, first_turn=None, last_turn=None))
        row = fold.rows()[0]
        out[r.tags] = (row[-2], row[-1])
    return out


def test_all_edit_strings_of_short_sequences():
    for n in (1, 2, 3):
        for tags in map("".join, product("suxUd", repeat=n)):
            every = [
                apply(tags, "".join(e))
                for size in range(n, n + 4)
                for e in product("DIKR", repeat=size)
            ]
            assert min(x[:2] for x in every if x) == plain(tags), tags


def test_matrices_of_random_sequences():
    rng = random.Random(1)
    tags = {"".join(rng.choices("suaxSUAXd", [2, 8, 8, 1, 1, 2, 2, 1, 3], k=rng.randrange(1, 60))) for _ in range(150)}
    tags |= {"ua" * 40, "u" * 33, "d" * 17, "sua" + "x" * 30, "a" * 64}
    found = by_matrices(sorted(tags))
    for t in tags:
        assert found[t] == plain(t), t


def test_grammar_gives_its_sequences_back():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 9, rng.integers(1, 50)) for _ in range(40)] + [np.zeros(77, np.int64), np.array([], np.int64), np.tile([1, 2], 30)]
    rules, short = R.re_pair(sequences)

    def grown(s):
        return [s] if s < 9 else grown(rules[s - 9][0]) + grown(rules[s - 9][1])

    for was, now in zip(sequences, short, strict=True):
        assert [x for s in now for x in grown(s)] == was.tolist()
    assert rules and sum(map(len, short)) < sum(map(len, sequences)) / 2
    pairs = [p for s in short for p in zip(s.tolist(), s.tolist()[1:], strict=False)]
    assert max(pairs.count(p) for p in set(pairs)) <= 2  # runs of one symbol may keep an odd pair


def test_ropes_compare_as_strings():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("DIKR", [1, 1, 30, 1], k=rng.randrange(0, 90))) for _ in range(2))

        def rope(t):
            if len(t) < 2 or rng.random() < 0.1:
                return R.leaf(t)
            k = rng.randrange(len(t))
            return R.concat(rope(t[:k]), rope(t[k:]))

        assert R.flat(rope(a)) == a
        assert R.before(rope(a), rope(b)) == (a < b)


def brute(rows):
    """The contract, conversation by conversation."""
    out = {}
    ids = list(dict.fromkeys(r[0] for r in rows))
    for conv in ids:
        now = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if fate == 0:
                continue
            text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
            now += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        now.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, tags, counts = set(), "", [0, 0, 0]
        for _, role, text in now:
            bare = text.strip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            who = role[:1] if role[:1] in ("s", "u", "a") else "x"
            tags += "d" if fault in (0, 1) else who.upper() if fault == 2 else who
            if fault is not None:
                counts[fault] += 1
        turns = [t for t, _, _ in now if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in now]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = plain(tags)
        lines = []
        for e, who, n in apply(tags, audit)[2]:
            role = now[n][1] if e == "K" else ROLE[who]
            lines.append(role + ":" + ("" if e == "I" else now[n][2]))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(spark, rows):
    found = {r[0]: tuple(r)[1:] for r in R.repair_digest(table(spark, rows)).collect()}
    assert found == brute(rows)


def some_rows(seed, convs, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "  ", "Why?\n", "Ä long one! ", "", "a.b", None]
    return [
        (c, rng.choice([t, t, t, t + 1000]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}.")
        for c in range(convs)
        for t in range(rng.randrange(0, turns))
    ]


def test_digest_against_brute_force(spark):
    rows = [r for k, r in enumerate(some_rows(4, 60, 12)) if (r[0], r[1]) not in {(x[0], x[1]) for x in some_rows(4, 60, 12)[:k]}]
    check(spark, rows + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ok."), (7, None, "user", "Late?"), (900, None, None, None)])


def test_small_pieces_and_shards(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_SYMBOLS", 100)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"T {t % 150}" + rng.choice([".", ""])) for t in range(400)]
    rows += [(2, t, ["user", "assistant"][t % 2], f"T {t}.") for t in range(90)]
    # A worker reads PIECE from its own copy of the module, so pieces are cut by ranges here.
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Same."), (1, 0, "user", "Same."), (1, 1, "assistant", "Same."), (3, 5, "user", "x" * 300_000 + ".")]
    check(spark, rows)
    assert R.repair_digest(table(spark, [])).collect() == []


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_joined_hash_over_ranges(spark, size, monkeypatch):
    rows = [(k % 7 if k % 3 else 2, k, "é" * (k % 50)) for k in range(2_000)]
    df = spark.createDataFrame(rows, "a long, b long, c string").repartition(5)
    found = {r[0]: r[1] for r in joined_sha256(df, "a", ["b"], "c", "\n").collect()}
    want = {a: hashlib.sha256("\n".join(c for x, _, c in rows if x == a).encode()).hexdigest() for a in {r[0] for r in rows}}
    assert found == want

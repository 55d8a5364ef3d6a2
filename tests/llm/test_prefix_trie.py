"""Operator 12 against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from kwspread.llm import prefix_trie as P


def code(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, code(*r[1:])))
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(r[1:] for r in own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    out = []
    total = {}
    for path in sorted(nodes, key=len, reverse=True):
        cost = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [total[k] for k in kids[path]]
        total[path] = (sum(b[0] for b in below) or 1, cost + sum(b[1] for b in below))
    for path, members in nodes.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), len(kids[path]), *total[path], sha))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(spark, rows, **kw):
    return sorted((tuple(r) for r in P.prefix_trie(table(spark, rows), **kw).collect()), key=repr)


def some_rows(seed, convs, turns, texts):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        alike = random.Random(rng.randrange(4))  # families of alike conversations
        for t in range(rng.randrange(0, turns)):
            text = alike.choice(texts) if rng.random() < 0.9 else rng.choice(texts)
            out.append((c, t, ["user", "assistant", None][t % 3], text))
    return out


TEXTS = ["Yes.", "no", None, "", "Warum denn? ä", "a longer text " * 3]


@pytest.mark.parametrize("level,most", [(64, 4096), (2, 3), (3, 1), (5, 7)])
def test_nodes_against_brute_force(spark, level, most):
    rows = some_rows(1, 70, 16, TEXTS[:3] if level == 3 else TEXTS)
    rows += [(500, t, "user", f"t{t % 3}") for t in range(60)] + [(505, t, "user", f"t{t % 3}") for t in range(45)] + [(506, t, "user", f"t{t % 3}") for t in range(60)]
    assert found(spark, rows, level=level, most=most) == brute(rows)


def test_odd_input(spark):
    rows = [(0, None, "user", "a"), (0, 1, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "system", "b"), (None, 0, "user", "x"), (-3, 0, "user", "a"), (10**12, 5, "user", "b" * 100_000)]
    rows += rows[:3]
    want = [r for r in brute([r for r in rows if r[0] != -3])]
    assert found(spark, [r for r in rows if r[0] != -3]) == want
    assert len(found(spark, rows)) >= len(want)
    assert found(spark, []) == []
    assert found(spark, [(2, 0, "user", "only")]) == brute([(2, 0, "user", "only")])


def test_ranges_of_one_conversation(spark):
    rows = [(k, t, "user", f"t{t}") for k in (5, 7) for t in range(400)] + [(9, t, "user", f"t{t}") for t in range(9)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, level=16, most=5) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_tree_children_are_balanced():
    tree = P.Tree()
    tree.fill([[k] for k in range(1023)])

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.equal[0]) == 10

"""Operator 12: the trie of conversation prefixes, by ternary search trees per range shard.

A turn's dictionary code is the MD5 of its role and text; texts travel no further than
the table of codes. Conversations are rebuilt from pieces of codes (`rebuilt`) and cut
into bands of LEVEL turns, so a conversation of any length is many rows. A node is named
by the exclusive or of hashes of (place, code) along its path (128 bits); the band's first
node is the band's prefix. Equal bands with equal prefix are one class with their number.

1. Classes are dealt by ranges of (band, prefix, codes). Runs of at most SHARD_CLASSES
   consecutive classes are shards: local codes, a ternary search tree filled from the
   median outwards, and one walk from the last node to the first that adds up members,
   leaves and savings.
2. Nodes on a shard's first and last path may lie in other shards as well. They are merged
   by name: sums add up, a node met in several shards was paid for once too often in all
   but the first, and the end of a last path is no leaf where another shard goes on.
3. Deeper bands give their savings and leaves to the ones above per conversation: every
   node's single cost, and every leaf, is charged to its smallest member, and what a
   conversation gains below a band is a running sum over its bands. No round per level.
4. Conversations that end at a node are hashed in numeric order (`ordered.joined_sha256`).

Defined results: rows without conv_id belong to no conversation and count nowhere; null
roles and texts are empty; turns of one number go by their code; `c - c%5` takes the sign
of c as SQL does; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kwspread.llm.common import materialise
from kwspread.llm.ordered import in_ranges, joined_sha256, part, running, with_carried

LEVEL = 64
SHARD_CLASSES = 4_096
#: Families of conversations, and heads of 0 to HEADS - 1 turns.
FAMILY, HEADS = 5, 9
CODE = 16  # bytes
#: Merged nodes are broadcast up to this number (48 bytes each).
BROADCAST_ROWS = 500_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def place_hashes(codes: bytes, first: np.ndarray) -> np.ndarray:
    """Two hashes of each code at its place (n x 2, int64)."""
    halves = np.array([], "<u8").reshape(0, 2) if not codes else np.frombuffer(codes, "<u8").reshape(-1, 2)
    at = first.astype(np.uint64)[:, None] + np.uint64(1)
    salted = _mix(halves ^ _mix(at * np.array([_P, _Q])))
    return _mix(salted + at).view(np.int64)


def _batches(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


LONG, CODES, SIZES = pa.int64(), pa.binary(), pa.list_(pa.int64())

PIECES = "conv long, part long, at long, n long, codes binary, sizes array<long>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a conversation's codes in order; `at` counts its turns in this partition."""
    here = part()
    conv, codes, sizes, at = None, [], [], 0

    def piece() -> tuple:
        nonlocal codes, sizes, at
        at += len(codes)
        out = (conv, here, at, len(codes), b"".join(codes), sizes)
        codes, sizes = [], []
        return out

    for batch in batches:
        done = []
        for c, code, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                if codes:
                    done.append(piece())
                conv, at = c, 0
            codes.append(code)
            sizes.append(size)
            if len(codes) == LEVEL:
                done.append(piece())
        yield _batches(done, [LONG] * 4 + [CODES, SIZES], _names(PIECES))
    if codes:
        yield _batches([piece()], [LONG] * 4 + [CODES, SIZES], _names(PIECES))


def ordered_pieces(conversations: DataFrame) -> DataFrame:
    """conv, start (turns before), n, codes, sizes (UTF-8 bytes) of pieces in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("code"),
        F.octet_length(text).cast("long").alias("size"),
    )
    sorted_turns = in_ranges(turns, ["conv", "turn", "code"]).select("conv", "code", "size")
    pieces = materialise(sorted_turns.mapInArrow(_pieces, PIECES), "trie-pieces")
    return with_carried(pieces, "conv", ["at"]).withColumn("start", F.col("at") - F.col("n")).drop("at", "part")


FRAGMENTS = "conv long, band long, start long, total long, codes binary, sizes array<long>"


def _fragments(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                head = sorted(r["head"] or [], key=lambda x: x["start"])
                given = b"".join(x["codes"] for x in head)[: CODE * r["h"]]
                given_sizes = [s for x in head for s in x["sizes"]][: r["h"]]
                ahead = len(given_sizes)
                total = ahead + max(0, r["turns"] - r["h"])
                skip = min(max(0, r["h"] - r["start"]), r["n"])
                runs = [(ahead + max(r["start"], r["h"]) - r["h"], r["codes"][CODE * skip :], r["sizes"][skip:])]
                if r["start"] == 0:
                    runs.append((0, given, given_sizes))
                    if not total:
                        out.append((r["conv"], 0, 0, 0, b"", []))
                for start, codes, sizes in runs:
                    at = 0
                    while at < len(sizes):
                        band, inside = divmod(start + at, level)
                        to = min(len(sizes), at + level - inside)
                        out.append((r["conv"], band, start + at, total, codes[CODE * at : CODE * to], sizes[at:to]))
                        at = to
            yield _batches(out, [LONG] * 4 + [CODES, SIZES], _names(FRAGMENTS))

    return run


BANDS = "conv long, band long, total long, codes binary, sizes array<long>, x1 long, x2 long"


def _bands(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda x: x["start"])
                codes = b"".join(x["codes"] for x in parts)
                sizes = [s for x in parts for s in x["sizes"]]
                x1, x2 = np.bitwise_xor.reduce(place_hashes(codes, r["band"] * level + np.arange(len(sizes))), axis=0).tolist()
                out.append((r["conv"], r["band"], r["total"], codes, sizes, x1, x2))
            yield _batches(out, [LONG] * 3 + [CODES, SIZES, LONG, LONG], _names(BANDS))

    return run


def rebuilt(conversations: DataFrame, level: int) -> DataFrame:
    """The rebuilt conversations in bands (`BANDS`)."""
    pieces = materialise(ordered_pieces(conversations), "placed-pieces")
    start = F.struct("start", F.substring("codes", 1, CODE * (HEADS - 1)).alias("codes"), F.slice("sizes", 1, HEADS - 1).alias("sizes"))
    convs = pieces.groupBy("conv").agg(
        F.sum("n").alias("turns"), F.collect_list(F.when(F.col("start") < HEADS - 1, start)).alias("head")
    )
    convs = materialise(convs, "conversation-heads")
    base = convs.select(F.col("conv").alias("base"), "head")
    own = convs.select(
        "conv", "turns",
        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"),
        (F.col("conv") - F.col("conv") % FAMILY).alias("base"),
    )
    info = own.join(base, "base", "left").drop("base")
    fragments = pieces.join(info, "conv").mapInArrow(_fragments(level), FRAGMENTS)
    whole = fragments.groupBy("conv", "band").agg(
        F.first("total").alias("total"), F.collect_list(F.struct("start", "codes", "sizes")).alias("parts")
    )
    return materialise(whole.mapInArrow(_bands(level), BANDS), "bands")


DEEP = "k1 long, k2 long, conv long, band long, size long, more boolean"


def _deep_turns(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["sizes"])
                at = r["band"] * level + np.arange(n)
                keys = np.bitwise_xor.accumulate(place_hashes(r["codes"], at), axis=0) ^ np.array([r["p1"], r["p2"]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.full(n, r["conv"])), pa.array(np.full(n, r["band"])),
                        pa.array(r["sizes"], LONG), pa.array(at + 1 < r["total"]),
                    ],
                    _names(DEEP),
                )

    return run


def with_prefixes(bands: DataFrame, level: int) -> DataFrame:
    """Bands with their prefix (p1, p2) and what their conversation saves and which leaves
    it has below (saved, leaves)."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "saved", "leaves")]
    short = bands.where(F.col("total") <= level).select("*", *zero)
    if (bands.agg(F.max("total")).first()[0] or 0) <= level:
        return short  # there is no deeper band
    deep = running(bands.where(F.col("total") > level), "conv", ["band"], ["x1", "x2"], np.bitwise_xor)
    prefixes = [F.col(f"all_x{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)]
    deep = materialise(deep.select(*bands.columns, *prefixes), "deep-bands")
    below = deep.where("band > 0")
    nodes = below.mapInArrow(_deep_turns(level), DEEP).groupBy("k1", "k2").agg(
        F.min("conv").alias("conv"), F.first("band").alias("band"), F.first("size").alias("size"), F.max("more").alias("more")
    )
    charges = nodes.groupBy("conv", "band").agg(F.sum("size").alias("paid"), F.sum((~F.col("more")).cast("long")).alias("leaf"))
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    own = below.join(charges, ["conv", "band"], "left").select(
        "conv", "band", (-F.col("band")).alias("back"),
        (size - F.coalesce("paid", F.lit(0))).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaves"),
    )
    gains = running(own, "conv", ["back"], ["saved", "leaves"])
    above = gains.select("conv", (F.col("band") - 1).alias("band"), F.col("all_saved").alias("saved"), F.col("all_leaves").alias("leaves"))
    last = [F.coalesce(c, F.lit(0)).alias(c) for c in ("saved", "leaves")]
    return short.union(deep.join(above, ["conv", "band"], "left").select(*bands.columns, "p1", "p2", *last))


def band_classes(bands: DataFrame, level: int) -> DataFrame:
    on = F.col("total") > (F.col("band") + 1) * level
    return bands.groupBy("band", "p1", "p2", "codes").agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv").alias("least"),
        F.sum(on.cast("long")).alias("n_on"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"),
    )


# Ternary search trees.


class Tree:
    """Trie nodes with their children in a search tree by code. Node 0 is the root."""

    def __init__(self) -> None:
        self.code, self.low, self.equal, self.high = [-1], [-1], [-1], [-1]
        self.up, self.depth, self.seen = [-1], [0], [-1]  # seen: a sequence through the node

    def _new(self, code: int, up: int, sequence: int) -> int:
        for column, x in ((self.code, code), (self.low, -1), (self.equal, -1), (self.high, -1), (self.up, up), (self.depth, self.depth[up] + 1), (self.seen, sequence)):
            column.append(x)
        return len(self.code) - 1

    def insert(self, codes: list[int], sequence: int) -> int:
        """The node at the end of the sequence."""
        node, low, high, equal, code = 0, self.low, self.high, self.equal, self.code
        for c in codes:
            at = equal[node]
            if at < 0:
                at = equal[node] = self._new(c, node, sequence)
            while code[at] != c:
                side = low if c < code[at] else high
                if side[at] < 0:
                    side[at] = self._new(c, node, sequence)
                at = side[at]
            node = at
        return node

    def fill(self, sequences: list[list[int]]) -> list[int]:
        """Insert sorted sequences, each range's median first; the end node of each."""
        ends, todo = [0] * len(sequences), [(0, len(sequences))]
        while todo:
            a, b = todo.pop()
            if a < b:
                mid = (a + b) // 2
                ends[mid] = self.insert(sequences[mid], mid)
                todo += [(mid + 1, b), (a, mid)]
        return ends

    def path(self, node: int) -> list[int]:
        """From the root to the node."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.up[node]
        return out[::-1]


NODES = (
    "part long, k1 long, k2 long, u1 long, u2 long, depth long, n long, least long, up_least long, size long, children long, "
    "leaves long, saved long, more boolean, open boolean, up_open boolean, on_first boolean, on_last boolean, false_leaf boolean"
)


def shard_nodes(group: tuple, rows: list[dict], shard: int, first_open: bool, last_open: bool, level: int) -> list[tuple]:
    """Node rows (`NODES`) of consecutive classes of one band and prefix."""
    band, p1, p2 = group
    words = sorted({r["codes"][k : k + CODE] for r in rows for k in range(0, len(r["codes"]), CODE)})
    number = {w: k for k, w in enumerate(words)}
    sequences = [[number[r["codes"][k : k + CODE]] for k in range(0, len(r["codes"]), CODE)] for r in rows]
    tree = Tree()
    ends = tree.fill(sequences)
    n = len(tree.code)
    keys = []  # of the nodes along each sequence
    for r, s in zip(rows, sequences, strict=True):
        steps = np.bitwise_xor.accumulate(place_hashes(r["codes"], band * level + np.arange(len(s))), axis=0)
        keys.append((steps ^ np.array([p1, p2])).tolist() if len(s) else [])
    members, leaves, saved, children = [0] * n, [0] * n, [0] * n, [0] * n
    least: list = [None] * n
    more = [False] * n
    for r, end in zip(rows, ends, strict=True):
        members[end] = r["n"]
        least[end] = r["least"]
        more[end] = r["n_on"] > 0
        saved[end], leaves[end] = r["saved"], r["leaves"]
    goes_on = list(more)  # into the next band
    firsts, lasts = set(tree.path(ends[0])) if first_open else set(), set(tree.path(ends[-1])) if last_open else set()
    is_open = [v in firsts or v in lasts or goes_on[v] for v in range(n)]
    is_open[0] = True
    sizes = [0] * n
    for v in range(n - 1, -1, -1):  # a node's children have larger numbers
        if v:
            sizes[v] = rows[tree.seen[v]]["sizes"][tree.depth[v] - 1]
        if not more[v]:
            leaves[v] += 1
        saved[v] += (members[v] - 1) * sizes[v]
        up = tree.up[v]
        if v:
            members[up] += members[v]
            least[up] = least[v] if least[up] is None else min(least[up], least[v])
            leaves[up] += leaves[v]
            saved[up] += saved[v]
            more[up] = True
            children[up] += v not in firsts and v not in lasts  # those are counted when merged
    out = []
    for v in range(n):
        up, depth = tree.up[v], band * level + tree.depth[v]
        k1, k2 = keys[tree.seen[v]][tree.depth[v] - 1] if v else (p1, p2)
        if v == 0 and band:  # the node is one of the band above: only its children are here
            out.append((shard, k1, k2, None, None, depth, 0, None, None, None, children[0], 0, 0, True, True, False, False, False, False))
            continue
        u1, u2 = (None, None) if v == 0 else (p1, p2) if up == 0 else keys[tree.seen[v]][tree.depth[v] - 2]
        up_open = v > 0 and is_open[up]
        out.append((
            shard, k1, k2, u1, u2, depth, members[v], least[v], None if v == 0 or up_open else least[up], sizes[v], children[v],
            leaves[v], saved[v], more[v], is_open[v], up_open, v in firsts, v in lasts, v in lasts and v == ends[-1] and not more[v],
        ))
    return out


def _shards(level: int, most: int):
    kinds = [LONG] * 13 + [pa.bool_()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        shard = part() << 32

        def close() -> pa.RecordBatch:
            nonlocal held, shard
            shard += 1
            groups: list[tuple[tuple, list[dict]]] = []
            for r in held:
                name = (r["band"], r["p1"], r["p2"])
                if not groups or groups[-1][0] != name:
                    groups.append((name, []))
                groups[-1][1].append(r)
            out: list[tuple] = []
            for k, (name, rows) in enumerate(groups):
                out += shard_nodes(name, rows, shard, k == 0, k == len(groups) - 1, level)
            held = []
            return _batches(out, kinds, _names(NODES))

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for r in batch.slice(at, 512).to_pylist():
                    held.append(r)
                    if len(held) == most:
                        yield close()
        if held:
            yield close()

    return run


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row per open node: sums over its shards, put right where shards share paths."""
    mine = nodes.where("open")
    once = mine.groupBy("k1", "k2").agg(
        F.max("depth").alias("depth"), F.max("u1").alias("u1"), F.max("u2").alias("u2"), F.sum("n").alias("n"),
        F.min("least").alias("least"), F.min("up_least").alias("up_least"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("more").alias("more"),
        F.min(F.when(F.col("n") > 0, F.col("part"))).alias("home"), F.max(F.col("on_first") | F.col("on_last")).alias("shared"),
    )
    once = materialise(once, "open-nodes")
    # A node that an earlier shard has, too, was paid for again: give it back to the path.
    told = once.select("k1", "k2", "home", F.col("more").alias("goes_on"))
    path = mine.where("n > 0 AND (on_first OR on_last)").join(told, ["k1", "k2"])
    path = path.select("part", "depth", "k1", "k2", "on_first", "on_last",
                       F.when(F.col("on_first") & (F.col("part") > F.col("home")), F.col("size")).otherwise(0).alias("again"),
                       (F.col("false_leaf") & F.col("goes_on")).alias("no_leaf"))
    rest = Window.partitionBy("part").orderBy(F.desc("depth"))  # a shard's two paths
    own_first = F.sum("again").over(rest.rangeBetween(Window.unboundedPreceding, 0))
    fixed = path.select("k1", "k2",
                        F.when(F.col("on_first"), own_first).otherwise(0).alias("back"),
                        F.when(F.col("on_last") & F.max("no_leaf").over(Window.partitionBy("part")), 1).otherwise(0).alias("no_leaf"))
    fixed = fixed.groupBy("k1", "k2").agg(F.sum("back").alias("back"), F.sum("no_leaf").alias("no_leaf"))
    also = once.where("shared AND u1 IS NOT NULL").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("also"))
    none = F.lit(0)
    return once.join(fixed, ["k1", "k2"], "left").join(also, ["k1", "k2"], "left").select(
        "k1", "k2", "u1", "u2", "depth", "n", "least", "up_least",
        (F.col("children") + F.coalesce("also", none)).alias("children"),
        (F.col("leaves") - F.coalesce("no_leaf", none)).alias("leaves"),
        (F.col("saved") + F.coalesce("back", none)).alias("saved"),
    )


def prefix_nodes(bands: DataFrame, level: int = LEVEL, most: int = SHARD_CLASSES) -> DataFrame:
    """k1, k2 (name), depth, least (member), up_least (of the parent), n, children, leaves,
    saved of every node of the trie of `bands` (with prefixes)."""
    classes = in_ranges(band_classes(bands, level), ["band", "p1", "p2", "codes"])
    nodes = materialise(classes.mapInArrow(_shards(level, most), NODES), "trie-nodes")
    merged = materialise(merged_nodes(nodes), "merged-nodes")
    result = ["k1", "k2", "depth", "least", "up_least", "n", "children", "leaves", "saved"]
    inner = nodes.where("NOT open")
    near = [*result[:4], "u1", "u2", *result[4:]]
    waiting = inner.where("up_open").select(*near).union(merged.where("up_least IS NULL").select(*near))
    ups = merged.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("least").alias("found"))
    if merged.count() <= BROADCAST_ROWS:
        ups = F.broadcast(ups)
    found = waiting.join(ups, ["u1", "u2"], "left").withColumn("up_least", F.col("found"))
    return inner.where("NOT up_open").select(*result).union(merged.where("up_least IS NOT NULL").select(*result)).union(found.select(*result))


def prefix_trie(conversations: DataFrame, level: int = LEVEL, most: int = SHARD_CLASSES) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    bands = materialise(with_prefixes(rebuilt(conversations, level), level), "placed-bands")
    nodes = prefix_nodes(bands, level, most)
    ends = bands.where(F.col("total") <= (F.col("band") + 1) * level).select(
        F.concat_ws(":", *[F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).cast("string") for k in (1, 2)]).alias("node"),
        "conv", F.col("conv").cast("string").alias("id"),
    )
    hashes = joined_sha256(ends, "node", ["conv"], "id", ",")
    named = nodes.withColumn("key", F.concat_ws(":", "k1", "k2"))
    return named.join(hashes, "key", "left").select(
        F.col("least").alias("conv_id"), "depth", F.col("up_least").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

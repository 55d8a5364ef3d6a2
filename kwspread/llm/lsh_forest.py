"""Operator 3: near duplicates by an LSH forest, confirmed on full shingle sets.

1. Every text becomes the set of its distinct shingles (64-bit hashes; 4 words unless
   the caller gives another width) and a
   signature of TREES * MIN_DEPTH minimum hashes. Texts with equal sets are one class
   (partial aggregation: a group of copies of any size is one row per task).
2. The forest: each tree orders the classes by its own sequence of signature values
   (MAX_DEPTH of them, starting at its own MIN_DEPTH). The orders of all trees are sorted
   together by a range exchange whose key ends in the class id, so equal prefixes of any
   number are spread over tasks. A task walks its stretch once: neighbours whose common
   prefix is deep enough are candidates. How deep adapts to the region: where at most
   CROWD rows share MIN_DEPTH values all of them are neighbours; a crowded region is
   split at the next depth, and its rows keep two nearest neighbours and the centres of
   the regions around them, so the number of pairs stays in proportion to the rows. Two
   bits of 64 signature values travel along: they drop pairs that are far from similar,
   and a region's centre is the row closest to the majority of its rows.
3. Confirmation on full sets: components of the candidate graph are dealt into bins.
   A component of more than MAX_PART classes is cut into parts that each get the class
   with the most candidates as a common hub; pairs inside a part and with the hub are
   confirmed there, each set being moved once. Pairs across parts that are still in
   different confirmed components are confirmed by joining both sets to the pair.
4. The rest, exactly: a region of any tree (equal first MIN_DEPTH values) whose rows are
   not yet one confirmed component is open. Similar sets of open regions share one of
   their rarest shingles: of n shingles, ordered by how often they occur there, the first
   n - ceil(0.8 n) + 1 (prefix filter). So per shingle of these beginnings, what different
   components hold it is compared, by one byte of every signature value. What these links
   hold together is a family; in it all pairs of different components are confirmed on
   full sets. Shingles and families are dealt over tasks in blocks, and a task sends only
   links that join what was apart. Pages with a common frame and text of their own meet
   nobody here: their rarest shingles are their own.
5. Components of the confirmed links, joined back to all documents.

With similarity s a pair shares a prefix in one of the trees with probability
1 - (1 - s^MIN_DEPTH)^TREES; at 0.8 it is missed with probability 1e-8, and by the bytes
of step 4 with 5e-9 (fewer than SAME_LEAST of 78 or BITS_LEAST of 64 equal). Steps 2 and 3 lose nothing: what
they leave apart goes through step 4.

Defined results: a null text and a text without words have the empty set, are linked
with nothing and stay; fewer words than the width are one shingle; rows that repeat a doc_id
count as one document; a null doc_id is never linked (component null) and stays; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwspread.llm.common import Slots, give_back, materialise, split_words, text_slices, worker_cache
from kwspread.llm.components import components

WORDS = 4
NUMERATOR, DENOMINATOR = 80, 100
TREES, MIN_DEPTH, MAX_DEPTH = 26, 3, 8
SIGNATURE = TREES * MIN_DEPTH
SKETCH_VALUES = 64
#: Least share of equal 2-bit values: 0.85 expected at similarity 0.8, minus 4.5 deviations.
SKETCH_LEAST = 0.65
CROWD = 8
#: A crowded row's nearest neighbour is a candidate from this depth on.
NEAREST_DEPTH = 5
#: Crowded regions down to this depth link their rows to their centre.
CENTRES_TO = 6
#: Rows of one region that a task holds at once.
MAX_HELD = 50_000
MAX_PART = 200
#: Least equal bytes of the SIGNATURE values; fewer have probability 3e-9 at similarity 0.8.
SAME_LEAST = 40
#: Least equal 2-bit values of SKETCH_VALUES in step 4; fewer have probability 2e-9 there.
BITS_LEAST = 35
#: Rows and bytes of sets on each side of a block of step 4, and rows of a group of blocks.
BLOCK_ROWS, BLOCK_BYTES, GROUP_ROWS = 1_000, 16 << 20, 10_000
NODES_PER_BIN = 400
#: Blocks of step 4 of up to so many rows are compared together.
SMALL_BLOCK = 48
#: Buckets by which the shingles of open regions are counted.
BUCKETS = 1 << 20
SEED = 97
MAX_KNOWN = 400_000

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of texts; a worker keeps the words it has met."""

    def __init__(self) -> None:
        self.slots, self.hashes = Slots(), np.empty(0, np.uint64)

    def of(self, texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
        if len(self.slots) > MAX_KNOWN:
            self.__init__()
        words, counts = split_words(pc.ascii_lower(texts.cast(pa.string())))
        at, new = self.slots.numbered(words)
        if new:
            told = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))
            self.hashes = np.concatenate((self.hashes, told))
        h = self.hashes[at]
        wide = np.zeros(len(h), np.uint64)
        for k in range(width):
            wide[: len(h) - k] = _mix(wide[: len(h) - k] * _P + h[k:])
        out, lo = [], 0
        for n in counts.tolist():
            if n >= width:
                out.append(np.unique(wide[lo : lo + n - width + 1]))
            elif n:
                one = np.full(1, n, np.uint64)
                for x in h[lo : lo + n]:
                    one = _mix(one * _P + x)
                out.append(one)
            else:
                out.append(np.empty(0, np.uint64))
            lo += n
        return out


def shingles() -> Shingles:
    return worker_cache("shingles", Shingles)


def _factors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of each multiplicative hash over a set, upper 32 bits."""
    least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(values), 512):
        block = _mix(values[lo : lo + 512])[None, :] * factors[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


DESCRIBED = "doc_id long, n_shingles long, set_key binary, signature binary"


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    factors = _factors()
    for batch in chain.from_iterable(map(text_slices, batches)):
        sets = shingles().of(batch.column("text"), width)
        keys = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
        signs = [signature(s, factors).astype("<u4").tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(signs, pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_key", "signature"],
        )


def _tree_orders() -> np.ndarray:
    """Signature positions of each tree, the first MIN_DEPTH its own."""
    first = np.arange(TREES)[:, None] * MIN_DEPTH
    return (first + np.arange(MAX_DEPTH)[None, :]) % SIGNATURE


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = _tree_orders()
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(-1, SIGNATURE)
            low = signs[:, :SKETCH_VALUES]
            bits = np.packbits(np.concatenate((low & 1, low >> 1 & 1), axis=1).astype(np.uint8), axis=1)
            tree = np.repeat(np.arange(TREES, dtype=np.uint8)[None, :, None], len(signs), axis=0)
            keys = np.ascontiguousarray(signs[:, orders].astype(">u4")).view(np.uint8).reshape(len(signs), TREES, 4 * MAX_DEPTH)
            keys = np.ascontiguousarray(np.concatenate((tree, keys), axis=2)).reshape(len(signs) * TREES, -1)
            width, n = keys.shape[1], len(keys)
            sketch = np.ascontiguousarray(np.repeat(bits, TREES, axis=0))
            binary = lambda a, w: pa.Array.from_buffers(
                pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.py_buffer(a)]
            )
            node = np.repeat(part.column("node").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays(
                [binary(keys, width), pa.array(node, pa.int64()), binary(sketch, sketch.shape[1])],
                ["key", "node", "sketch"],
            )


def _run_starts(same: np.ndarray) -> np.ndarray:
    """For rows with `same[i]` (row i + 1 continues row i's run): start of each row's run."""
    n = len(same) + 1
    start = np.zeros(n, np.int64)
    start[1:] = np.where(same, 0, np.arange(1, n))
    return np.maximum.accumulate(start)


def _centres(region: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """For each row the position of its region's centre: the row whose sketch differs
    least from the majority of the region's sketches, bit by bit."""
    heads = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
    size = np.diff(np.append(heads, len(region)))
    bits = np.unpackbits(sketch, axis=1)
    majority = 2 * np.add.reduceat(bits, heads, axis=0, dtype=np.int32) > size[:, None]
    owner = np.repeat(np.arange(len(heads)), size)
    far = (bits != majority[owner]).sum(axis=1)
    order = np.lexsort((far, owner))
    return order[heads][owner]


def neighbour_pairs(keys: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (row indices) of rows sorted by (tree, values)."""
    n = len(keys)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    equal = keys[1:] == keys[:-1]
    common = np.where(equal.all(axis=1), MAX_DEPTH + 1, equal.argmin(axis=1)) - 1  # depth, -1: other tree
    starts, need = {}, np.full(n, MAX_DEPTH)
    for depth in range(MAX_DEPTH, MIN_DEPTH - 1, -1):
        starts[depth] = _run_starts(common >= depth)
        size = np.bincount(starts[depth], minlength=n)[starts[depth]]
        need[size <= CROWD] = depth
    left, right = [], []
    least = np.full(n, MAX_DEPTH)
    for offset in range(1, CROWD):
        if offset >= n:
            break
        least = np.minimum(least[: n - offset], common[offset - 1 :][: n - offset])
        floor = need[: n - offset]
        if offset == 1:  # the nearest neighbour, also in a crowd that deeper prefixes don't part
            floor = np.minimum(floor, NEAREST_DEPTH)
        elif offset > 2:  # a crowd is linked through its centres; two neighbours are enough
            floor = np.where(floor > MIN_DEPTH, MAX_DEPTH + 1, floor)
        hit = np.flatnonzero(least >= floor)
        left.append(hit)
        right.append(hit + offset)
    for depth in range(MIN_DEPTH, CENTRES_TO + 1):
        crowded = np.flatnonzero(need > depth)
        if len(crowded):
            centre = _centres(starts[depth][crowded], sketch[crowded])
            left.append(crowded[centre])
            right.append(crowded)
    return np.concatenate(left), np.concatenate(right)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted rows; regions (equal first MIN_DEPTH values) are kept whole up to
    MAX_HELD rows, beyond that a region goes on with its first and its last row."""
    width = 1 + 4 * MAX_DEPTH

    def told(table: tuple) -> pa.RecordBatch | None:
        raw, node, sketch = table
        values = raw[:, 1:].reshape(len(raw), MAX_DEPTH, 4).copy().view(">u4").reshape(len(raw), MAX_DEPTH)
        a, b = neighbour_pairs(np.column_stack((raw[:, 0].astype(np.uint32), values)), sketch)
        unequal = np.bitwise_xor(sketch[a], sketch[b])
        half = unequal.shape[1] // 2
        agree = SKETCH_VALUES - np.bitwise_count(unequal[:, :half] | unequal[:, half:]).sum(axis=1, dtype=np.int64)
        a, b = (x[(agree >= SKETCH_LEAST * SKETCH_VALUES) & (node[a] != node[b])] for x in (a, b))
        u, v = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        pairs = np.unique(np.column_stack((u, v)), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, width)
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(raw), -1)
        now = (raw, batch.column("node").to_numpy(), sketch)
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        region = now[0][:, : 1 + 4 * MIN_DEPTH]
        last = len(region) - int((region[::-1] == region[-1]).all(axis=1).argmin())
        cut = 0 if (region == region[-1]).all() else last
        if len(region) - cut > MAX_HELD:
            yield told(now)
            keep = [cut, len(region) - 1]
            held = tuple(x[keep] for x in now)
        else:
            if cut:
                yield told(tuple(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
    if held is not None and len(held[0]) > 1:
        yield told(held)


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Distinct candidate pairs u < v of classes (node, signature)."""
    rows = classes.select("node", "signature").mapInArrow(_tree_rows, "key binary, node long, sketch binary")
    ordered = rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(_candidates, "u long, v long").distinct()


def _set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Replace texts by their sets; rows whose set is not the class's own are left out."""
    for batch in chain.from_iterable(map(text_slices, batches)):
        sets = shingles().of(batch.column("text"), width)
        keys = batch.column("set_key").to_pylist()
        own = [k for k, s in enumerate(sets) if xxhash.xxh3_128_digest(s) == keys[k]]
        node = batch.column("node").take(pa.array(own, pa.int64()))
        yield pa.RecordBatch.from_arrays([node, pa.array([sets[k].tobytes() for k in own], pa.binary())], ["node", "set"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, of sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if DENOMINATOR * len(small) < NUMERATOR * len(large):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
    return DENOMINATOR * shared >= NUMERATOR * (len(a) + len(b) - shared)


def _confirm_bin(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    by_node = {n: np.frombuffer(s, np.uint64) for n, s in zip(sets["node"], sets["set"], strict=True)}
    ok = [
        u in by_node and v in by_node and similar(by_node[u], by_node[v])
        for u, v in zip(pairs["u"], pairs["v"], strict=True)
    ]
    return pairs.loc[np.array(ok, bool), ["u", "v"]]


def _confirm_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_pylist() for c in ("set_u", "set_v"))
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _set_table(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, set of the classes in `nodes` (distinct node)."""
    wanted = nodes.select("node").join(classes.select("node", "set_key"), "node")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node")
    return texts.mapInArrow(partial(_set_rows, width=width), "node long, set binary").dropDuplicates(["node"])


def confirmed_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int = WORDS) -> DataFrame:
    """Links u < v that hold on full sets and connect what all candidates connect."""
    parts = materialise(components(pairs.select("u", "v"), "candidates"), "candidate-parts")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    sizes = parts.join(degree, "node").groupBy("component").agg(
        F.count("*").alias("size"), F.max(F.struct("degree", -F.col("node"))).alias("top")
    )
    sizes = sizes.select("component", "size", (-F.col("top.col2")).alias("hub"))
    cut = F.when(F.col("size") > MAX_PART, F.ceil(F.col("size") * 2 / MAX_PART)).otherwise(1).cast("long")
    nodes = parts.join(sizes, "component").withColumn("parts", cut)
    nodes = nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    nodes = materialise(nodes, "candidate-nodes")
    bins = max(1, nodes.count() // NODES_PER_BIN)
    bin_of = lambda part: F.pmod(F.xxhash64("component", part), F.lit(bins)).cast("int")

    sets = materialise(_set_table(docs, classes, nodes, width), "sets")

    hubs = nodes.where("parts > 1 AND node = hub")
    places = nodes.select("node", bin_of(F.col("part")).alias("bin")).union(
        hubs.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
            "node", bin_of(F.col("p")).alias("bin")
        )
    )
    placed = sets.join(places.distinct(), "node")
    end = lambda c: nodes.select(F.col("node").alias(c), "component", F.col("part").alias(f"{c}_part"))
    dealt = pairs.join(end("u"), "u").join(end("v").drop("component"), "v")
    inside = dealt.where("u_part = v_part").select("u", "v", bin_of(F.col("u_part")).alias("bin"))
    starred = nodes.where("parts > 1 AND node <> hub").select(
        F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v"), bin_of(F.col("part")).alias("bin")
    )
    tasks = inside.union(starred).distinct()
    near = materialise(
        placed.groupBy("bin").cogroup(tasks.groupBy("bin")).applyInPandas(_confirm_bin, "u long, v long"), "links"
    )
    across = dealt.where("u_part <> v_part").select("u", "v")
    if across.isEmpty():
        return near
    known = materialise(components(near, "near"), "near-components")
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    still = across.join(side("u"), "u", "left").join(side("v"), "v", "left")
    still = still.where(F.coalesce("u_c", "u") != F.coalesce("v_c", "v")).select("u", "v")
    full = still.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v"
    )
    far = full.select("u", "v", "set_u", "set_v").mapInArrow(_confirm_rows, "u long, v long")
    return materialise(near.union(far), "all-links")


def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of every tree that a class lies in."""
    tree = np.arange(TREES, dtype=np.uint64)[None, :]
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(-1, TREES, MIN_DEPTH)
            region = np.repeat(_mix(tree + np.uint64(1)), len(signs), axis=0)
            for k in range(MIN_DEPTH):
                region = _mix(region * _P + signs[:, :, k])
            ends = [np.repeat(part.column(c).to_numpy(), TREES) for c in ("node", "component")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(region.ravel().view(np.int64)), *map(pa.array, ends)], ["owner", "node", "component"]
            )


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each signature value."""
    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, 4 * SIGNATURE)[:, ::4]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in raw], pa.binary())], ["node", "value"])


def _alike(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """left x right: at least SAME_LEAST signature values have equal low bytes. Pairs with
    fewer than BITS_LEAST of SKETCH_VALUES equal 2-bit values are not looked at further."""
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, SIGNATURE) for x in (left, right))
    plane = lambda x, k: np.packbits(x[:, :SKETCH_VALUES] >> k & 1, axis=1).view(np.uint64).ravel()
    unequal = plane(a, 0)[:, None] ^ plane(b, 0)
    unequal |= plane(a, 1)[:, None] ^ plane(b, 1)
    same = np.bitwise_count(unequal) <= SKETCH_VALUES - BITS_LEAST
    i, j = np.nonzero(same)
    for lo in range(0, len(i), 50_000):
        x, y = i[lo : lo + 50_000], j[lo : lo + 50_000]
        same[x, y] = (a[x] == b[y]).sum(axis=1) >= SAME_LEAST
    return same


def _confirmed(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """left x right: `similar` of full sets, by products of incidence matrices."""
    a, b = ([np.frombuffer(s, np.uint64) for s in x] for x in (left, right))
    if len(a) * len(b) <= 64:
        return np.array([[similar(x, y) for y in b] for x in a], bool).reshape(len(a), len(b))
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    size_a, size_b = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    shared = np.zeros((len(a), len(b)), np.int64)
    held = []
    for sets, sizes in ((a, size_a), (b, size_b)):
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.searchsorted(common, values)
        known = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == values) if len(common) else at[:0]
        known = known[np.argsort(at[known], kind="stable")]
        held.append((at[known], owner[known]))
    for lo in range(0, len(common), 4096):
        sides = []
        for (at, owner), rows in zip(held, shared.shape, strict=True):
            cut = slice(*np.searchsorted(at, (lo, lo + 4096)))
            side = np.zeros((rows, 4096), np.float32)
            side[owner[cut], at[cut] - lo] = 1
            sides.append(side)
        shared += (sides[0] @ sides[1].T).astype(np.int64)
    return DENOMINATOR * shared >= NUMERATOR * (size_a[:, None] + size_b[None, :] - shared)


def _spanning(node, component, label, left, right, hits) -> list[tuple[int, int]]:
    """Links that join, of all hits between different components, what has different labels."""
    out = []
    for k, i in enumerate(left):
        near = right[hits[k]]
        near = near[(component[near] != component[i]) & (label[near] != label[i])]
        if len(near):
            found, first = np.unique(label[near], return_index=True)
            out += [(min(node[i], node[j]), max(node[i], node[j])) for j in near[first]]
            label[np.isin(label, found)] = label[i]
    return out


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """The links that join something among all of (u, v)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(a, b), max(a, b)))
    return out


def _small_pairs(heads: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows i < j inside blocks of at most `most` rows."""
    size = np.repeat(sizes, sizes)
    row = np.arange(len(size))
    later = np.where(size <= most, np.repeat(heads + sizes, sizes) - row - 1, 0)
    i = np.repeat(row, later)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)


def _blocks(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows block by block, and where each begins and how many it has."""
    rows = rows.sort_values(["owner", "a", "b"], ignore_index=True)
    key = rows[["owner", "a", "b"]].to_numpy()
    heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.empty(0, np.int64)
    return rows, heads, np.diff(np.append(heads, len(key)))


def _alike_links(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Links of the blocks of a group by signatures. Small blocks are compared together."""
    rows, heads, sizes = _blocks(rows)
    node, component = rows["node"].to_numpy(), rows["component"].to_numpy()
    is_left, is_right = rows["is_left"].to_numpy(), rows["is_right"].to_numpy()
    value = rows["value"].tolist()
    sign = np.frombuffer(b"".join(value), np.uint8).reshape(-1, SIGNATURE)
    planes = [np.packbits(sign[:, :SKETCH_VALUES] >> k & 1, axis=1).view(np.uint64).ravel() for k in (0, 1)]
    found = []
    i, j = _small_pairs(heads, sizes, SMALL_BLOCK)
    for lo in range(0, len(i), 200_000):
        x, y = i[lo : lo + 200_000], j[lo : lo + 200_000]
        ok = (component[x] != component[y]) & (is_left[x] & is_right[y] | is_left[y] & is_right[x])
        x, y = x[ok], y[ok]
        unequal = np.bitwise_count(planes[0][x] ^ planes[0][y] | planes[1][x] ^ planes[1][y])
        ok = unequal <= SKETCH_VALUES - BITS_LEAST
        x, y = x[ok], y[ok]
        ok = (sign[x] == sign[y]).sum(axis=1) >= SAME_LEAST
        found.append((node[x[ok]], node[y[ok]]))
    for head, size in zip(heads.tolist(), sizes.tolist(), strict=True):
        if size > SMALL_BLOCK:
            here = slice(head, head + size)
            left, right = (head + np.flatnonzero(c[here]) for c in (is_left, is_right))
            if len(left) and len(right):
                hits = _alike([value[k] for k in left], [value[k] for k in right])
                x, y = (side[k] for side, k in zip((left, right), np.nonzero(hits), strict=True))
                ok = component[x] != component[y]
                found.append((node[x[ok]], node[y[ok]]))
    return _forest(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else []


def _confirmed_links(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Links of the blocks of a group by full sets, of which components are joined."""
    rows, heads, sizes = _blocks(rows)
    nodes, components_, value = rows["node"].to_numpy(), rows["component"].to_numpy(), rows["value"].tolist()
    is_left, is_right = rows["is_left"].to_numpy(), rows["is_right"].to_numpy()
    out = []
    for head, size in zip(heads.tolist(), sizes.tolist(), strict=True):
        here = slice(head, head + size)
        left, right = (np.flatnonzero(c[here]) for c in (is_left, is_right))
        if len(left) and len(right):
            node, component = nodes[here], components_[here]
            hits = _confirmed([value[head + k] for k in left], [value[head + k] for k in right])
            out += _spanning(node, component, component.copy(), left, right, hits)
    return out


def _join_apart(exact: bool):
    """Links of the blocks of a group; `exact` compares full sets, else signatures."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = (_confirmed_links if exact else _alike_links)(rows)
        give_back()
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _bucket(values: np.ndarray) -> np.ndarray:
    return (_mix(values) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the shingles of each bucket occur in a task's sets."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            raw = b"".join(batch.column("set").slice(at, 2_000).to_pylist())
            counts += np.bincount(_bucket(np.frombuffer(raw, np.uint64)), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["bucket", "n"])


def beginning(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, of which a similar set has one in its own beginning."""
    n = len(values)
    keep = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    return values[np.lexsort((values, counts[_bucket(values)]))[:keep]]


def _beginning_rows(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            firsts = [beginning(np.frombuffer(raw, np.uint64), counts) for raw in part.column("set").to_pylist()]
            owner = np.concatenate(firsts).view(np.int64) if firsts else np.empty(0, np.int64)
            sizes = np.fromiter(map(len, firsts), np.int64, len(firsts))
            ends = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "component")]
            yield pa.RecordBatch.from_arrays([pa.array(owner), *map(pa.array, ends)], ["owner", "node", "component"])


def open_beginnings(sets: DataFrame) -> DataFrame:
    """owner (shingle), node, component of the beginnings of sets (node, component, set).
    The counts that order shingles are sums over BUCKETS buckets: one number each reaches
    the driver, whatever the input; any order is exact, a good one parts more."""
    told = sets.select("set").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = told.toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    rows = sets.mapInArrow(partial(_beginning_rows, counts=counts), "owner long, node long, component long")
    # Only shingles that different components hold, and of those with the same holders one.
    name = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    held = rows.groupBy("owner").agg(F.count("*").alias("n"), (F.min("component") != F.max("component")).alias("open"), *name)
    owners = held.where("open").groupBy("n", "h0", "h1").agg(F.min("owner").alias("owner")).select("owner")
    return materialise(rows.join(materialise(owners, "open-shingles"), "owner"), "beginnings")


def _across(rows: DataFrame, values: DataFrame, exact: bool) -> DataFrame:
    """Links between the components of each owner: rows (owner, node, component), values
    (node, value). Rows outside the owner's largest component meet all of its rows, in
    blocks of bounded size."""
    weight = F.length("value") if exact else F.lit(0)
    if exact:
        rows = rows.join(values, "node")
    counted = rows.groupBy("owner", "component").agg(F.count("*").alias("n"), F.sum(weight).alias("bytes"))
    top = counted.groupBy("owner").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "component")).alias("top")
    )
    top = top.where("n > top.n")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    open_ = top.select(
        "owner",
        F.col("top.component").alias("largest"),
        blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("lefts"),
        blocks(F.col("n"), F.col("bytes")).alias("rights"),
    )
    open_ = materialise(open_, "open-owners")  # so the joins' shuffles can be split
    rows = rows.join(open_, "owner")
    if not exact:
        rows = rows.join(values, "node")
    rows = rows.withColumn("minor", F.col("component") != F.col("largest"))
    rows = rows.withColumn("own_a", F.pmod(F.xxhash64("node", F.lit(1)), "lefts").cast("int"))
    rows = rows.withColumn("own_b", F.pmod(F.xxhash64("node", F.lit(2)), "rights").cast("int"))
    as_right = F.transform(
        F.expr("sequence(0, lefts - 1)"),
        lambda a: F.struct(
            a.alias("a"), F.col("own_b").alias("b"), (F.col("minor") & (a == F.col("own_a"))).alias("is_left"), F.lit(True).alias("is_right")
        ),
    )
    as_left = F.transform(
        F.filter(F.expr("sequence(0, rights - 1)"), lambda b: F.col("minor") & (b != F.col("own_b"))),
        lambda b: F.struct(F.col("own_a").alias("a"), b.alias("b"), F.lit(True).alias("is_left"), F.lit(False).alias("is_right")),
    )
    dealt = rows.select("owner", "node", "component", "value", F.inline(F.concat(as_right, as_left)))
    count = open_.agg(F.sum(F.expr("lefts * rights")), F.count("*")).first()
    if not count[1]:
        return rows.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false")
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4 + int(count[0]) * 2 * BLOCK_ROWS // GROUP_ROWS
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("owner", "a", "b"), F.lit(groups)))
    # A fixed number of partitions: the work is in the pairs, not in the bytes.
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")
    return dealt.groupBy("group").applyInPandas(_join_apart(exact), "u long, v long").distinct()


def remaining_links(docs: DataFrame, classes: DataFrame, links: DataFrame, width: int = WORDS) -> DataFrame:
    """Confirmed links between components of `links` that share a region."""
    known = materialise(components(links, "confirmed"), "confirmed-components")
    classes = classes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = materialise(classes.select("node", "set_key", "signature", "component"), "known-classes")
    regions = classes.select("node", "signature", "component").mapInArrow(_region_rows, "owner long, node long, component long")
    several = regions.groupBy("owner").agg((F.min("component") != F.max("component")).alias("open")).where("open")
    open_nodes = regions.join(materialise(several.select("owner"), "open-regions"), "owner").select("node", "component").distinct()
    open_nodes = materialise(open_nodes, "open-nodes")
    sets = _set_table(docs, classes, open_nodes, width).join(open_nodes, "node")
    sets = materialise(sets.select("node", "component", "set"), "open-sets")
    low = classes.join(open_nodes.select("node"), "node").select("node", "signature").mapInArrow(_low_bytes, "node long, value binary")
    alike = _across(open_beginnings(sets), low, False)
    alike = materialise(alike, "alike")
    families = components(alike, "families")
    owned = families.select(F.col("component").alias("owner"), "node").join(classes.select("node", "component"), "node")
    owned = materialise(owned, "family-rows")
    return materialise(_across(owned, sets.select("node", F.col("set").alias("value")), True), "remaining-links")


def near_duplicates(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document (doc_id, text), by
    shingles of `width` words."""
    docs = docs.select("doc_id", "text")
    described = materialise(docs.mapInArrow(partial(_describe, width=width), DESCRIBED), "described")
    usable = described.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"))
    classes = materialise(classes, "classes")
    pairs = materialise(candidate_pairs(classes), "pairs")
    links = confirmed_links(docs, classes, pairs, width)
    links = links.union(remaining_links(docs, classes, links, width))
    # A doc_id with several texts is one document: its classes are linked through it.
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    homes = usable.select("doc_id", "set_key").join(repeated, "doc_id").join(classes.select("set_key", "node"), "set_key")
    shared = homes.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    joined = components(links.union(shared), "linked")
    labels = classes.select("set_key", "node").join(joined, "node", "left")
    labels = labels.select("set_key", F.coalesce("component", "node").alias("component_id"))
    result = described.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )

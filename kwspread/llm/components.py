"""Connected components of an edge table: local forests, then alternating stars.

First the edges are dealt evenly over tasks of at most EDGES_PER_TASK, and each task sends
the components of its own edges as stars (a node and the least node it reaches there). One
task is enough for a small graph. What several tasks leave is joined by alternating large
and small stars until every node points at a root.

Every round writes its edges to the shared folder, so lineage stays short and a lost
executor costs one round. Rounds grow with the logarithm of the longest path. Minima are
joined back to the edges instead of gathering neighbour lists, so a node of any degree is
only many narrow rows, never a list in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwspread.llm.common import materialise

MAX_ROUNDS = 60
EDGES_PER_TASK = 500_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a task's edges, every node with the least of its own."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), 100_000):
        pairs = [(x, find(x)) for x in nodes[at : at + 100_000]]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger end u to the smaller v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether every node with an edge down has one, to a node without any."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    loose = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return loose.where("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node reachable) of every node of `edges` (u, v: long)."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialise(down.distinct(), name)
    tasks = max(1, -(-now.count() // EDGES_PER_TASK))
    now = materialise(now.repartition(tasks).mapInArrow(_local_stars, "u long, v long"), name)
    for _ in range(MAX_ROUNDS):
        if tasks == 1 or _settled(now):
            break
        now = materialise(_small_star(_large_star(now)).distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    # Settled: every node points at its root.
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )

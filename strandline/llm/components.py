"""Connected components of an edge table: contraction inside tasks, and alternating large-star and small-star steps between them.

A task takes about ``TASK_EDGES`` edges and returns a forest of stars: each of its nodes points to
the least one it is connected with there. Edges that fit one task are done then. Otherwise a star
step joins every edge with the least neighbour of its node, which is aggregated before the shuffle,
and the next contraction starts from shorter paths. The number of rounds grows with the logarithm
of the longest chain. Nodes that hold more than a ``HUB``-th of all edges, of which there are less
than 2 * ``HUB``, are joined by broadcast, so that no task gathers a hub's edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._text import released

HUB = 500
#: Edges of a task: 16 MB of ids, and a few times as much while they are contracted.
TASK_EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are connected with a smaller one, and the least one each."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: a.size], place[a.size :]
    root = np.arange(nodes.size)
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(nodes.size))
    return nodes[moved], nodes[root[moved]]


@released
def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a task's edges (a, b); what waits is contracted whenever it has doubled."""
    a = b = np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        waiting.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size > max(TASK_EDGES, a.size):
            a, b = forest(*(np.concatenate(x) for x in zip((a, b), *waiting)))
            waiting, size = [], 0
    if waiting:
        a, b = forest(*(np.concatenate(x) for x in zip((a, b), *waiting)))
    for at in range(0, a.size, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """Point neighbours at the least node of the closed neighbourhood: larger ones, or the node and smaller ones.

    hub: from how many edges on a node is joined by broadcast.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
    hubs = least.where(F.col("degree") > hub).select("u", F.col("m").alias("of_hub"))
    # Edges of hubs know their least already; they are dealt by their other end.
    marked = both.join(F.broadcast(hubs), "u", "left").withColumn("k", F.when(F.col("of_hub").isNull(), F.col("u")).otherwise(F.xxhash64("v")))
    joined = marked.join(least.select(F.col("u").alias("k"), "m"), "k", "left").select("u", "v", F.coalesce("of_hub", "m").alias("m"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, task_edges: int = TASK_EDGES) -> DataFrame:
    """Columns ``id`` and ``component`` (the least id reachable) of every node that has an edge.

    ``edges`` has two long columns ``a`` and ``b`` and is read twice, so it should be a kept table
    or a projection of one; nulls, loops and repeats are ignored. Nodes without an edge to another
    node are absent. An empty table gives an empty table.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    n = edges.count()
    now = scratch.keep(_within_tasks(edges, n, task_edges), "forests")
    while n > task_edges:
        n = now.count()
        hub = max(1000, n // HUB)
        following = scratch.keep(_star(_star(now, True, hub), False, hub), "star")
        scratch.drop(now)
        if _are_stars(following):
            now = following
            break
        n = following.count()
        now = scratch.keep(_within_tasks(following, n, task_edges), "forests")
        scratch.drop(following)
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.union(now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component")))


def _within_tasks(edges: DataFrame, n: int, task_edges: int) -> DataFrame:
    """The ``n`` edges in as few tasks as hold them, contracted in each."""
    return edges.coalesce(max(1, -(-n // task_edges))).mapInArrow(_contracted, "a long, b long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one node, and none points to a node that points elsewhere."""
    tails = edges.groupBy("a").agg(F.count("*").alias("n"))
    heads = edges.select(F.col("b").alias("a")).distinct().withColumn("head", F.lit(True))
    return tails.join(heads, "a", "left").where("n > 1 or head").isEmpty()

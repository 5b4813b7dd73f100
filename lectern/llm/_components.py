"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import frugal
from ._store import Scratch

#: Edges for which a task is worth its start (4 MB), and up to which their least neighbours are broadcast.
FEW = 1 << 18
#: Edges that a task joins at a time.
JOINED = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges, but the smallest of its component, with that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def _joined_by_tasks(edges: DataFrame, tasks: int) -> DataFrame:
    """The same components by fewer and shorter edges: each of so many tasks joins those that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def joined() -> pa.RecordBatch:
            found = forest(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])

        for rows in batches:
            held.append((rows.column(0).to_numpy(), rows.column(1).to_numpy()))
            n += rows.num_rows
            if n >= JOINED:
                yield joined()
                held, n = [], 0
        if n:
            yield joined()

    return edges.select("u", "v").coalesce(tasks).mapInArrow(frugal(run), "u long, v long")


def _large_star(edges: DataFrame, store: Scratch, name: str, few: bool) -> DataFrame:
    """Many least neighbours are written, so that the join has plain tables on both sides and a hub's edges can be split."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = F.broadcast(least) if few else store.write(least, name)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(F.broadcast(least) if few else least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, store: Scratch, name: str) -> DataFrame:
    """u, v (longs) -> node, component (its smallest node) for every node with an edge.

    ``edges`` is read twice, so it should be a written table. Tasks join the
    edges that they read, rounds join what tasks found; edges of one task, at most
    ``FEW``, need no round. Every round is written to the shared folder; it ends
    when a round changes no edge. Rounds grow with the logarithm of the longest
    path over what tasks found.
    """
    tasks = -(-edges.count() // FEW)
    now = _joined_by_tasks(edges.filter("u != v"), max(1, tasks))
    now, seen, i = store.write(now, f"{name}-0"), None, 0
    while tasks > 1:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen or state["n"] == 0:
            break
        seen, i = (state["n"], state["s"]), i + 1
        few = state["n"] <= FEW
        now = store.write(_small_star(_large_star(now, store, f"{name}-least-{i}", few), few), f"{name}-{i}")
        store.drop(f"{name}-{i - 1}"), store.drop(f"{name}-least-{i}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

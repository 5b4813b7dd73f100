"""Approximate nearest neighbours: a forest of random-projection trees.

All nodes of a level of a tree share one random direction and are cut at their
own medians, so a tree is its directions and one number per node. The upper
levels are cut on a bounded sample; where the table is large enough for deeper
trees, the lower ones are cut on the executors, each below its node on as many
rows as its leaves need. Trees deepen with the table, so that leaves keep about
``leaf_rows`` rows, down to ``deepest`` levels. Every row is put in one leaf of
each tree. A query searches all trees through one priority queue: nodes wait by
the estimated chance that a near neighbour lies below them, which follows from
the margins at the splits and the cosine that its neighbours are expected to
have. That is read off the sample and carried on to the size of the table by
the local dimension. Leaves are taken until the trees together hold a neighbour
with probability ``target`` and one of them holds more than ``k`` rows. All rows
of the leaves taken are ranked again by exact cosine in double precision.

Rows and queries meet by leaf; leaves with many rows or many queries are dealt
to several blocks, so no block passes its bounds, whatever the skew. Only the
sample, one number per node and one count per leaf reach the driver, at most
trees << deepest of them. Queries that still lack rows (where an id stands on
many rows) are compared with all rows, in the same blocks.

Defined results: vectors that are null, zero, of another than the most common
length, or that hold null or non-finite components take no part, as query or
candidate; so do rows without id. Rows that repeat an id count once, with the
best score. Ties go to the smaller id. With fewer than ``k`` other ids in the
table, there are fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ._bpe import frugal, sparing
from ._store import Scratch, hash_sample


@dataclass
class Forest:
    """Complete binary trees in heap order: node i has children 2i and 2i + 1.

    ``directions``: trees x depth x dims; ``cuts``: trees x nodes; ``rows``: trees
    x leaves, how many rows each leaf holds; ``size``: rows of the table.
    """

    depth: int
    directions: np.ndarray
    cuts: np.ndarray
    sample: np.ndarray
    rows: np.ndarray
    size: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row in each tree."""
        out = np.empty((len(x), len(self.directions)), np.int32)
        for t, (w, b) in enumerate(zip(self.directions, self.cuts)):
            out[:, t] = descend((x @ w.T).astype(np.float32), b) - (1 << self.depth)
        return out

    def expected(self, q: np.ndarray, k: int) -> np.ndarray:
        """Cosine that each query's k-th neighbour in the table should have, from those in the sample."""
        n = len(self.sample)
        m = min(n, 4 * k + 4)
        near = np.sort(q @ self.sample.T, axis=1)[:, ::-1][:, :m]
        far = np.maximum(1 - near, 1e-9)  # half the squared distance
        at = min(k, m - 1)  # the query itself may be in the sample
        ratio = np.log(far[:, -1:] / far[:, 1:]) if m > 2 else np.zeros((len(q), 1))
        dimension = np.clip(2 / np.maximum(ratio.mean(1), 1e-6), 2, 64)  # Hill's estimate on squared distances
        shrink = np.minimum(1.0, (n / max(self.size, 1)) ** (2 / dimension))
        return np.clip(1 - far[:, at] * shrink, 0.0, 1 - 1e-9)

    def search(self, margins: list[np.ndarray], c: float, k: int, target: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs that one query takes, likeliest first. ``margins``: its projections in each tree."""
        # a neighbour at cosine c projects to about c * (w.q), with this deviation
        spread = math.sqrt(2 * (1 - c * c) / self.sample.shape[1])
        queue = [(-1.0, t, 1) for t in range(len(margins))]
        held, rows, out, first = [0.0] * len(margins), [0] * len(margins), [], 1 << self.depth
        at = [[c * x for x in m.tolist()] for m in margins]
        cuts, counts = self.cuts, self.rows
        while queue:
            p, t, node = heapq.heappop(queue)
            if node >= first:
                out.append((t, node - first))
                held[t] = min(1.0, held[t] - p)
                rows[t] += int(counts[t, node - first])
                if max(rows) > k and 1 - math.prod(1 - h for h in held) >= target:
                    break
                continue
            r = 0.5 * math.erfc((float(cuts[t, node]) - at[t][node.bit_length() - 1]) / spread)
            heapq.heappush(queue, (p * r, t, 2 * node + 1))
            heapq.heappush(queue, (p * (1 - r), t, 2 * node))
        return out


def descend(projections: np.ndarray, cuts: np.ndarray, node: np.ndarray | int = 1) -> np.ndarray:
    """The node that each row reaches, a level for each column of ``projections``."""
    at = np.full(len(projections), node, np.int64)
    for level in range(projections.shape[1]):
        at = 2 * at + (projections[:, level] > cuts[at])
    return at


def medians(projections: np.ndarray) -> np.ndarray:
    """Cuts in heap order of one tree over the rows given; a node without rows is cut at 0."""
    depth = projections.shape[1]
    cuts = np.zeros(1 << depth, np.float32)
    at = np.ones(len(projections), np.int64)
    for level in range(depth):
        p = projections[:, level]
        order = np.lexsort((p, at))
        nodes, first, n = np.unique(at[order], return_index=True, return_counts=True)
        cuts[nodes] = (p[order[first + (n - 1) // 2]] + p[order[first + n // 2]]) / 2
        at = 2 * at + (p > cuts[at])
    return cuts


def directions(trees: int, depth: int, dims: int, seed: int = 7) -> np.ndarray:
    w = np.random.default_rng(seed).standard_normal((trees, depth, dims))
    return w / np.linalg.norm(w, axis=2, keepdims=True)


def grow(sample: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cuts of all trees, on the sample alone."""
    return np.stack([medians((sample @ d.T).astype(np.float32)) for d in w]) if w.shape[1] else np.zeros((len(w), 1), np.float32)


def deepen(data: DataFrame, dims: int, w: np.ndarray, top: np.ndarray, upper: int, total: int, per_leaf: int = 24) -> np.ndarray:
    """Cuts down to all levels of ``w``: those below the ``upper`` ones are found on the executors.

    Below each node of that level, about ``per_leaf`` rows for each leaf are
    chosen by hash, by a share that follows from the node's own rows: a node with
    very many rows does not send more of them.
    """
    spark, trees, depth = data.sparkSession, len(w), w.shape[1]
    lower = depth - upper
    shared = spark.sparkContext.broadcast((w, top))

    def below(b: pa.RecordBatch, t: int) -> tuple[np.ndarray, np.ndarray]:
        p = (_unit(_matrix(b.column(1), dims)) @ shared.value[0][t].T).astype(np.float32)
        return descend(p[:, :upper], shared.value[1][t]), p[:, upper:]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((trees, 2 << upper), np.int64)
        for b in batches:
            for t in range(trees):
                n[t] += np.bincount(below(b, t)[0], minlength=2 << upper)
        t, node = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(node, pa.int64()), pa.array(n[t, node])], ["tree", "node", "n"])

    held = np.zeros((trees, 2 << upper), np.int64)
    for r in data.mapInArrow(frugal(count), "tree int, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect():
        held[r["tree"], r["node"]] = r["n"]  # at most trees << upper rows
    share = np.minimum(1.0, per_leaf * (1 << lower) / np.maximum(held, 1))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(2).to_numpy() / float(1 << 30)
            for t in range(trees):
                node, p = below(b, t)
                i = np.flatnonzero(u < share[t, node])
                cols = [pa.array(np.full(len(i), t, np.int32)), pa.array(node[i]), pa.array([x.tobytes() for x in p[i]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["tree", "node", "p"])

    def cut(rows: pa.Table) -> pa.Table:
        p = np.stack([np.frombuffer(x.as_py(), np.float32) for x in rows["p"]])
        return pa.table({"tree": rows["tree"][:1], "node": rows["node"][:1], "cuts": pa.array([medians(p).tobytes()], pa.binary())})

    lot = F.pmod(F.xxhash64(F.lit("cuts"), "vec_id", "embedding"), F.lit(1 << 30))
    chosen = data.select("vec_id", "embedding", lot.alias("lot")).mapInArrow(frugal(choose), "tree int, node long, p binary")
    cuts = np.zeros((trees, 1 << depth), np.float32)
    cuts[:, : 1 << upper] = top
    for r in chosen.groupBy("tree", "node").applyInArrow(sparing(cut), "tree int, node long, cuts binary").toLocalIterator():
        sub = np.frombuffer(r["cuts"], np.float32)
        for level in range(lower):
            n = 1 << level
            cuts[r["tree"], r["node"] * n : (r["node"] + 1) * n] = sub[n : 2 * n]
    return cuts


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding of the rows that take part, and their length."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    e = F.col("embedding") if kind in ("float", "double") else F.transform("embedding", lambda x: x.cast("double"))
    ok = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    ok = ok.filter(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    top = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()  # one row per length
    dims = top["d"] if top else 0
    return ok.filter(F.size("embedding") == dims), dims


def id_sample(data: DataFrame, n: int) -> list[Row]:
    """vec_id, embedding of at most ``n`` ids, one row each, whatever the number of their rows; empty only if ``data`` is."""
    ids = data.select("vec_id").distinct()
    some = hash_sample(ids, F.col("vec_id"), n)
    if some.isEmpty():
        some = ids.orderBy(F.xxhash64("vec_id")).limit(n)
    return data.join(F.broadcast(some), "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()


def best(ids: np.ndarray, v: np.ndarray, norms: np.ndarray, asks: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    """query_id, vec_id, score: the ``k`` ids nearest to each query among the rows of a block, which are sorted by id."""
    qn = np.linalg.norm(q, axis=1)
    close = (q @ v.T) / (qn[:, None] * norms[None, :])
    close[asks[:, None] == ids[None, :]] = -np.inf
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    of_id = np.maximum.reduceat(close, first, axis=1)  # a repeated id takes one place
    nth = np.cumsum(np.append(0, ids[1:] != ids[:-1]))  # each row's place in of_id
    out: list[tuple[int, int, float]] = []
    for i, row in enumerate(of_id):
        n = min(k, len(row))
        edge = np.partition(row, len(row) - n)[len(row) - n] - 1e-12  # rounding must not part equal vectors
        if len(first) == len(ids):
            near = np.flatnonzero(row >= edge)
        else:  # of each id, the rows that rounding could put first
            near = np.flatnonzero((close[i] >= edge) & (close[i] >= row[nth] - 1e-12))
        near = near[np.isfinite(close[i, near])]
        exact = np.array([np.dot(q[i], v[j]) / (qn[i] * norms[j]) for j in near])
        kept: dict[int, float] = {}
        for o in np.lexsort((ids[near], -exact)).tolist():
            if len(kept) == k:
                break
            kept.setdefault(int(ids[near[o]]), float(exact[o]))
        out += [(int(asks[i]), d, s) for d, s in kept.items()]
    cols = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())]
    return pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])


def nearest(
    rows: DataFrame, queries: Column, k: int = 5, trees: int = 4, target: float = 0.97, sample: int = 4096, leaf_rows: int = 512, deepest: int = 20, block_rows: int = 4096, block_queries: int = 8192
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found among all other rows.

    ``queries``: which rows of vec_id, embedding are queries. The upper levels of
    the trees are cut on at most ``sample`` rows of different ids, chosen by a
    hash of vec_id; so is the cosine that a query's neighbours should have.
    """
    spark = rows.sparkSession
    store = Scratch(spark, "forest")
    data, dims = usable(rows)
    schema = "query_id long, vec_id long, score double"
    got = id_sample(data, sample)
    if not got:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = data.count()
    known = _unit(np.array([r["embedding"] for r in got], np.float64))
    depth = max(0, min(deepest, round(math.log2(max(1, total / leaf_rows)))))
    upper = min(depth, max(0, int(math.log2(max(1, len(got) / 16)))))
    w = directions(trees, depth, dims)
    cuts = grow(known, w[:, :upper])
    if depth > upper:
        cuts = deepen(data, dims, w, cuts, upper, total)
    forest = Forest(depth, w, cuts, known, np.zeros((trees, 1 << depth), np.int64), total)
    placing = spark.sparkContext.broadcast(forest)  # bounded by sample, trees and deepest

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = placing.value.leaves(_unit(_matrix(b.column(1), dims)))
            leaf = pa.ListArray.from_arrays(pa.array(np.arange(0, leaf.size + 1, trees, dtype=np.int32)), pa.array(leaf.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, leaf], ["id", "v", "asks", "row", "leaf"])

    real = data.schema["embedding"].dataType.simpleString()
    placed = data.select("vec_id", "embedding", F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))  # deals rows to blocks
    placed = store.write(placed.mapInArrow(frugal(place), f"id long, v {real}, asks boolean, row long, leaf array<int>"), "placed")
    index = placed.select(F.posexplode("leaf").alias("tree", "leaf"), "id", "row", "v")
    counts = store.write(index.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")), "counts")  # one row per leaf of each tree
    held = counts.toArrow()
    forest.rows[held["tree"].to_numpy(), held["leaf"].to_numpy()] = held["n"].to_numpy()
    shared = spark.sparkContext.broadcast(forest)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = _unit(_matrix(b.column(1), dims))
            for a in range(0, len(x), 128):
                q = x[a : a + 128]
                sides = np.stack([(q @ d.T).astype(np.float32) for d in f.directions], 1)
                taken = [f.search(list(m), float(c), k, target) for m, c in zip(sides, f.expected(q, k))]
                at = pa.array(np.repeat(np.arange(a, a + len(taken)), list(map(len, taken))))
                flat = [p for ps in taken for p in ps]
                cols = [pa.array([p[0] for p in flat], pa.int32()), pa.array([p[1] for p in flat], pa.int32()), b.column(0).take(at), b.column(2).take(at), b.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(cols, ["tree", "leaf", "id", "row", "v"])

    probes = store.write(placed.filter("asks").select("id", "v", "row").mapInArrow(frugal(probe), f"tree int, leaf int, id long, row long, v {real}"), "probes")
    found = store.write(_meet(index, probes, counts, dims, k, block_rows, block_queries, schema), "found")
    # queries that lack rows though there are more ids: they are compared with all rows
    ids = data.select("vec_id").distinct().count()
    have = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= min(k, ids - 1))
    short = placed.filter("asks").join(have, F.col("id") == F.col("query_id"), "left_anti").select(F.lit(0).alias("tree"), F.lit(0).alias("leaf"), "id", "row", "v")
    short = store.write(short, "short")
    if ids > 1 and not short.isEmpty():
        every = placed.select(F.lit(0).alias("tree"), F.lit(0).alias("leaf"), "id", "row", "v")
        whole = spark.createDataFrame([(0, 0, total)], "tree int, leaf int, n long")
        found = found.unionByName(_meet(every, short, whole, dims, k, block_rows, block_queries, schema))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(index: DataFrame, probes: DataFrame, counts: DataFrame, dims: int, k: int, block_rows: int, block_queries: int, schema: str) -> DataFrame:
    """The ``k`` nearest rows of each query in every block of every leaf it takes."""
    n_rows = counts.select("tree", "leaf", F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("nr"))
    n_asks = probes.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_queries)).cast("int").alias("nq"))
    blocks = n_rows.join(n_asks, ["tree", "leaf"])
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = F.broadcast(blocks) if counts.count() <= 1 << 20 else blocks
    left = index.join(blocks, ["tree", "leaf"]).select("*", part("nr").alias("r")).select("tree", "leaf", "r", every("nq").alias("q"), F.lit(0).alias("ask"), "id", "v")
    right = probes.join(blocks, ["tree", "leaf"]).select("*", part("nq").alias("q")).select("tree", "leaf", every("nr").alias("r"), "q", F.lit(1).alias("ask"), "id", "v")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vs, ready = None, [], [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(5)], 1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            for a, z in zip(cuts, np.append(cuts[1:], len(keys))):
                here, ask = tuple(keys[a, :4].tolist()), keys[a, 4]
                if here != key:
                    key, ids, vs, ready = here, [], [], None
                x, names = _matrix(b.column(6).slice(a, z - a), dims), b.column(5).slice(a, z - a).to_numpy()
                if not ask:
                    ids.append(names), vs.append(x)
                elif ids:
                    if ready is None:
                        v, near = np.concatenate(vs), np.concatenate(ids)
                        order = np.argsort(near, kind="stable")
                        ready = near[order], v[order], np.linalg.norm(v[order], axis=1)
                    for s in range(0, len(x), 64):
                        yield best(*ready, names[s : s + 64], x[s : s + 64], k)

    meet = left.unionByName(right).repartition("tree", "leaf", "r", "q").sortWithinPartitions("tree", "leaf", "r", "q", "ask")
    return meet.mapInArrow(frugal(rank), schema)

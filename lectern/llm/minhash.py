"""Near-duplicate classes by an inverted join of MinHash signatures.

A document is the set of its distinct n-word shingles (64-bit hashes); equal
sets are one class, and copies of a class are never compared. A signature holds
the least hash of the set under each of ``coordinates`` permutations; two sets
of Jaccard similarity s agree in a coordinate with probability s. A pair is kept
for verification if at least ``need`` coordinates agree: the largest number that
a pair at the threshold reaches but with probability ``miss`` (one in a thousand
million). What is kept is confirmed on the full sets, so no false link is left.

1. Scan: the class of each row, and each class's signature.
2. Postings: every (coordinate, value) of a class. How many classes hold it is
   counted exactly; a value of one class alone links nothing and goes. A class
   with fewer than ``need`` values left links with nothing.
3. Prefix: of its m values left, rarest first, a class posts m - need + 1. Two
   signatures that agree ``need`` times meet in one of these (the need - 1
   longest lists of a class are skipped in the merge and only probed).
4. Lists of at most ``long_list`` classes give pairs, which are kept if their
   signatures agree often enough. A longer list joins its classes with the first
   of their size range, and neighbouring ranges with each other: rows in
   proportion to the list, from which candidate clusters follow.
5. Large clusters are first compared with stars: each class with the list head
   that agrees most. Classes that these links join need no more comparisons
   with each other. Clusters that still fall apart meet by blocks of bounded
   size, where signatures are merged by prefix and skip again, and every pair
   that is not joined yet is counted and verified.
6. Connected components of the links.

Step 5 is linear where near copies resemble their list's head (seen in groups of
copies with small changes); else the sets of a cluster of N shingles are read
N / block_shingles times.

Defined results: null texts and texts without words have the empty set, which
links with nothing; fewer than n words are one shingle. ``component_id`` is the
smallest doc_id that links reach, rows with equal sets included; a null doc_id
names a component only if it has no other, and such a row is ``kept`` then.
Rows that repeat the doc_id of their component are all kept. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bpe import frugal, slices
from ._components import components
from ._store import Scratch, small_enough
from ._words import finish
from .ngram_join import set_hash, shingle_sets

#: Shingles that are hashed at a time, so that they stay near the processor.
CHUNK = 1 << 16


def needed(coordinates: int, num: int, den: int, miss: float = 1e-9) -> int:
    """The most coordinates that a pair of similarity num / den agrees in but with probability ``miss``."""
    s, below = num / den, 0.0
    for c in range(coordinates + 1):
        below += math.comb(coordinates, c) * s**c * (1 - s) ** (coordinates - c)
        if below > miss:
            return max(c, 1)
    return coordinates


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of ``coordinates`` 32-bit values for each set; sets are not empty.

    Shingle hashes are mixed already, so a product with an odd number is a
    permutation that orders them anew.
    """
    odd = finish(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(sets), coordinates), np.uint32)
    sizes = np.array([len(s) for s in sets])
    a = 0
    while a < len(sets):
        z = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), CHUNK, side="right")))
        flat, starts = np.concatenate(sets[a:z]), np.cumsum(sizes[a:z]) - sizes[a:z]
        for k in range(coordinates):
            out[a:z, k] = np.minimum.reduceat(flat * odd[k], starts) >> np.uint64(32)
        a = z
    return out


def _scan(docs: DataFrame, n: int, coordinates: int) -> DataFrame:
    """Rows with doc_id, n, cls; and, where a task meets a class first, n, cls and its signature."""
    names = ["doc_id", "n", "cls", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in batches:
            for a, z in slices(rows.column(1)):
                sets = shingle_sets(rows.column(1).slice(a, z - a), n)
                cls = list(map(set_hash, sets))
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(a, z - a), pa.array(map(len, sets), pa.int64()), pa.array(cls, pa.int64()), pa.nulls(z - a, pa.binary())], names)
                new = []
                for i, c in enumerate(cls):
                    if len(sets[i]) and c not in seen:
                        if len(seen) > 500_000:
                            seen.clear()  # repeats are dropped where classes meet
                        seen.add(c)
                        new.append(i)
                sig = signatures([sets[i] for i in new], coordinates)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(new), pa.int64()), pa.array([len(sets[i]) for i in new], pa.int64()), pa.array([cls[i] for i in new], pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary())], names
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(frugal(run), "doc_id long, n long, cls long, sig binary")


def _posted(classes: DataFrame, coordinates: int) -> DataFrame:
    """token, cls, n: the coordinate and its value in one number."""
    at = (np.arange(coordinates, dtype=np.int64) << 32)[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, 1024):
                part = rows.slice(a, 1024)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, coordinates)
                token = (sig.astype(np.int64) | at).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(part.column(0).to_numpy(), coordinates)), pa.array(np.repeat(part.column(1).to_numpy(), coordinates))], ["token", "cls", "n"])

    return classes.select("cls", "n", "sig").mapInArrow(frugal(run), "token long, cls long, n long")


def _prefixes(posted: DataFrame, need: int) -> DataFrame:
    """token, df, cls, n of the prefix of each class that may link at all."""
    held = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = posted.join(held, "token").groupBy("cls").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    ts = F.slice("ts", F.lit(1), F.size("ts") - (need - 1))
    return shared.filter(F.size("ts") >= need).select("cls", "n", F.explode(ts).alias("t")).select("t.token", "t.df", "cls", "n")


def _agree(a: str, b: str) -> Column:
    """In how many coordinates two binary signatures agree."""
    at = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(a), F.lit(4)), lambda i: F.substring(c, i, F.lit(4)))
    return F.size(F.filter(F.zip_with(at(F.col(a)), at(F.col(b)), lambda x, y: x == y), lambda same: same))


def _with_agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    one, two = sigs.select(F.col("cls").alias("u"), F.col("sig").alias("su")), sigs.select(F.col("cls").alias("v"), F.col("sig").alias("sv"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", _agree("su", "sv").alias("agree"))


def _in_reach(n: Column, m: Column, num: int, den: int) -> Column:
    return F.least(n, m) * den >= F.greatest(n, m) * num


def _short_pairs(prefixes: DataFrame, long_list: int, num: int, den: int) -> DataFrame:
    short = prefixes.filter(F.col("df") <= long_list)
    one, two = short.select("token", F.col("cls").alias("u"), F.col("n").alias("nu")), short.select("token", F.col("cls").alias("v"), F.col("n").alias("nv"))
    return one.join(two, "token").filter((F.col("u") < F.col("v")) & _in_reach(F.col("nu"), F.col("nv"), num, den)).select("u", "v").distinct()


def _long_links(prefixes: DataFrame, long_list: int, num: int, den: int, store: Scratch) -> DataFrame:
    """u, v: each class with the head of its size range in a list, and heads of neighbouring ranges. A pair in reach is in one range or two neighbours."""
    size = F.floor(F.log("n") / F.lit(math.log(den / num) * (1 + 1e-9))) if num < den else F.col("n")
    long = prefixes.filter(F.col("df") > long_list).withColumn("range", size.cast("long"))
    heads = store.write(long.groupBy("token", "range").agg(F.min("cls").alias("head")), "heads")
    member = long.join(heads, ["token", "range"]).select(F.col("cls").alias("u"), F.col("head").alias("v"))
    after = heads.select("token", (F.col("range") - 1).alias("range"), F.col("head").alias("u"))
    return member.unionByName(heads.join(after, ["token", "range"]).select("u", F.col("head").alias("v"))).filter("u != v").distinct()


def _sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """cls, tokens of the ``wanted`` classes, from a second scan of the texts; the sets of other classes are not shuffled while the wanted ones are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in batches:
            for a, z in slices(rows.column(0)):
                new = {}
                for s in shingle_sets(rows.column(0).slice(a, z - a), n):
                    c = set_hash(s)
                    if len(s) and c not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(c)
                        new[c] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(new.keys(), pa.int64()), pa.array(new.values(), pa.binary())], ["cls", "tokens"])

    wanted = F.broadcast(wanted) if small_enough(wanted, 32 << 20, 16) else wanted
    return docs.select("text").mapInArrow(frugal(run), "cls long, tokens binary").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))


@dataclass
class Member:
    """A class in a group; ``label`` names the classes that are joined with it already."""

    cls: int
    block: int
    label: int
    sig: np.ndarray
    tokens: np.ndarray


def similar_to(one: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of ``others`` link with ``one``: sorted sets, compared exactly."""
    out = np.zeros(len(others), bool)
    for j, s in enumerate(others):
        common = np.searchsorted(one, s)
        common = int((one[np.minimum(common, len(one) - 1)] == s).sum())
        out[j] = den * common >= num * (len(one) + len(s) - common)
    return out


def joining_links(group: list[Member], cross: bool, need: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of linked members that join all members which links join. ``cross``: only pairs of different blocks are looked at.

    Lists are merged over prefixes; the lists behind a prefix are skipped, and
    probed for the members that the merge found. Members that are joined
    already are passed over.
    """
    g = len(group)
    sig = np.stack([m.sig for m in group])
    blocks, sizes = np.array([m.block for m in group]), np.array([len(m.tokens) for m in group])
    label = np.unique([m.label for m in group], return_inverse=True)[1]
    left = int(label.max()) + 1
    k = sig.shape[1]
    _, token, df = np.unique((sig.astype(np.int64) | (np.arange(k, dtype=np.int64) << 32)[None, :]).ravel(), return_inverse=True, return_counts=True)
    token = token.reshape(g, k)
    order = np.argsort(df[token], axis=1, kind="stable")
    token = np.take_along_axis(token, order, 1)
    alone = (df[token] == 1).sum(1)
    stop = np.maximum(k - need + 1, alone)
    posted = (np.arange(k)[None, :] >= alone[:, None]) & (np.arange(k)[None, :] < stop[:, None])
    who, at = np.nonzero(posted)
    tokens = token[who, at]
    by = np.argsort(tokens, kind="stable")
    owners, tokens = who[by], tokens[by]
    for i in range(g - 1):
        if left == 1:
            return
        mine = token[i, alone[i] : stop[i]]
        lists = [owners[a:z] for a, z in zip(np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, side="right"))]
        if not lists:
            continue
        j = np.unique(np.concatenate(lists))
        j = j[(j > i) & (label[j] != label[i])]
        j = j[np.minimum(sizes[j], sizes[i]) * den >= np.maximum(sizes[j], sizes[i]) * num]
        if cross:
            j = j[blocks[j] != blocks[i]]
        j = j[(sig[j] == sig[i]).sum(1) >= need]
        while len(j):
            now, j = j[:256], j[256:]
            for linked in now[similar_to(group[i].tokens, [group[x].tokens for x in now], num, den)].tolist():
                if label[linked] != label[i]:
                    yield i, linked
                    label[label == label[linked]] = label[i]
                    left -= 1
            j = j[label[j] != label[i]]


def _joined(members: DataFrame, need: int, num: int, den: int) -> DataFrame:
    """cluster, x, y, cls, block, label, sig, tokens -> u, v: links that join the members of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            found = [(held[i].cls, held[j].cls) for i, j in joining_links(held, key[1] != key[2], need, num, den)]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

        key, held = None, []
        for rows in batches:
            for cluster, x, y, cls, block, label, sig, tokens in zip(*[c.to_pylist() for c in rows.columns]):
                if (cluster, x, y) != key:
                    if len(held) > 1:
                        yield solve()
                    key, held = (cluster, x, y), []
                held.append(Member(cls, block, label, np.frombuffer(sig, np.uint32), np.frombuffer(tokens, np.uint64)))
        if len(held) > 1:
            yield solve()

    ordered = members.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "cls")
    return ordered.select("cluster", "x", "y", "cls", "block", "label", "sig", "tokens").mapInArrow(frugal(run), "u long, v long")


def _stars(pairs: DataFrame, sets: DataFrame, num: int, den: int, rays: int = 1024) -> DataFrame:
    """u, v -> the pairs that link. A v stands once for each ``rays`` of its u."""
    salt = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
    count = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / F.lit(rays)).cast("int").alias("parts"))
    ray = pairs.join(count, "v").select("v", salt.alias("salt"), "u").join(sets.withColumnRenamed("cls", "u"), "u").select("v", "salt", "u", "tokens")
    hub = count.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).join(sets.withColumnRenamed("cls", "v"), "v").select("v", "salt", F.lit(None).cast("long").alias("u"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.zeros(0, np.uint64)
        for rows in batches:
            out = []
            for v, u, tokens in zip(*[rows.column(c).to_pylist() for c in ("v", "u", "tokens")]):
                s = np.frombuffer(tokens, np.uint64)
                if u is None:
                    center = s
                elif similar_to(center, [s], num, den)[0]:
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

    return hub.unionByName(ray).repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first()).mapInArrow(frugal(run), "u long, v long")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 85, den: int = 100, coordinates: int = 64, long_list: int = 16, block_shingles: int = 3_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of every row of ``docs``.

    Two documents link when den * |intersection| >= num * |union|. ``class_id``
    names the set itself.
    """
    store = Scratch(docs.sparkSession, "minhash")
    need = needed(coordinates, num, den)
    scan = store.write(_scan(docs, n, coordinates), "scan")
    every = scan.filter("sig IS NULL").select("doc_id", "n", "cls")
    sigs = store.write(scan.filter("sig IS NOT NULL").groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "signatures")
    prefixes = store.write(_prefixes(_posted(sigs, coordinates), need), "prefixes")
    short = store.write(_with_agreement(_short_pairs(prefixes, long_list, num, den), sigs).filter(F.col("agree") >= need).select("u", "v"), "short")
    long = store.write(_long_links(prefixes, long_list, num, den, store), "long")
    clusters = components(short.unionByName(long), store, "clusters").select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    clusters = store.write(clusters.join(sigs, "cls"), "clusters")
    sets = store.write(_sets(docs, n, clusters.select("cls")), "sets")
    sizes = store.write(clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int").alias("nb")), "sizes")

    # large clusters: each class with the head that agrees most
    large = clusters.join(sizes.filter("nb > 1"), "cluster").select("cls", "cluster", "nb")
    stars = _with_agreement(long.join(large.select(F.col("cls").alias("u")), "u", "left_semi"), sigs).filter(F.col("agree") >= need)
    stars = stars.groupBy("u").agg(F.max_by("v", F.struct("agree", F.col("v"))).alias("v"))
    first = store.write(_stars(store.write(stars, "stars"), sets, num, den), "first")
    label = components(first, store, "labels").select(F.col("node").alias("cls"), F.col("component").alias("label"))
    labelled = store.write(clusters.join(label, "cls", "left").join(sizes, "cluster").select("cls", "cluster", "nb", "sig", F.coalesce("label", "cls").alias("label")), "labelled")
    open_ = labelled.groupBy("cluster").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("cluster")
    rows = labelled.join(open_, "cluster").join(sets, "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    second = store.write(_joined(rows, need, num, den), "second")

    linked = components(first.unionByName(second), store, "components").select(F.col("node").alias("cls"), "component")
    reps = store.write(every.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep")), "reps")
    named = store.write(linked.join(reps, "cls"), "named")
    names = named.join(named.groupBy("component").agg(F.min("rep").alias("name")), "component").select("cls", "name")
    whole = store.write(reps.join(names, "cls", "left").select("cls", F.coalesce("name", "rep").alias("component_id")), "whole")
    # both sides are plain tables here, so that a class with very many documents can be split
    out = every.filter("n > 0").join(whole, "cls").unionByName(every.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("cls").alias("class_id"))

"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct n-word shingles (64-bit hashes); equal
sets are one class. With all sets sorted by one global order, rare shingles
first, two sets of Jaccard similarity >= t share at least one token in their
1-prefixes (|s| - ceil(t|s|) + 1 tokens), and at least l tokens in their
l-prefixes, which are l - 1 tokens longer. Each class picks its own l by
estimated candidate cost; a pair must share min(l) tokens of the layers that
both have before it is verified.

1. Scan: the set of each text. Sets are dealt to packs by a hash of the class,
   where a class stands once.
2. Frequencies: each pack asks for the document frequency of its distinct
   shingles, by ranges (buckets) of the hash, and is told a level, a byte for
   each: how many classes hold it, on a logarithmic scale. Nothing is broadcast:
   the exchange follows the input, four bytes and one for each shingle of a pack,
   in at most 1 << ``fan_bits`` rows for each pack (beyond that many packs it goes
   by hops, each of which adds as many bytes again).
3. Prefixes: shingles that no other class holds come first in the order and need
   no posting. A class whose 1-prefix holds only such is done: it links with
   nothing. Of the others the prefix goes out as postings (token, class).
4. Lists are read as a stream, sorted by set size. Short lists (at most
   ``long_list`` classes) give pairs, counted over all tokens under min(l). A
   long list joins its classes through the first of each size range, so that
   work stays linear: its pairs are counted under the same rule in step 5.
5. Connected components of what remains are candidate clusters: no link of two
   different sets leaves a cluster. Sets of a cluster meet by blocks of bounded
   size. There prefix tokens are counted pair by pair, pairs with min(l) are
   verified exactly, and a spanning forest of the links and each class's number
   of links come out. Copies of a class are numbers of members, never rows.
6. Connected components of the links.

Defined results: null texts and texts without words have the empty set, which
links with nothing; fewer than n words are one shingle; repeated rows and equal
texts fall in one class; a null doc_id is never a component's name unless
nothing else is there; an empty table gives no rows. Other columns are not read.
Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe import frugal, slices, sparing
from ._components import components
from ._store import Scratch, small_enough
from ._words import ASCII_SPACE, finish, lowered, word_hashes

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Values of l that a document may choose from.
LAYERS = np.array([m << e for e in range(10) for m in (2, 3)][:-1] + [1])
LAYERS.sort()
#: Cost, in postings, of verifying a candidate, for each shingle.
VERIFY = 0.4
#: Steps of a level for each doubling of the number of classes that hold a shingle.
STEPS = 8


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = lowered(column)
    words, counts = word_hashes(data, offsets, ~ASCII_SPACE[data])
    words = finish(words)
    ends = np.cumsum(counts)
    m = len(words) - n + 1
    grams = np.zeros(max(m, 0), np.uint64)
    for k in range(n if m > 0 else 0):
        grams += words[k : k + m] * (ODD[k % len(ODD)] + np.uint64(2 * (k // len(ODD))))
    grams = finish(grams)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            part = (words[a:b] * ODD[np.arange(b - a) % len(ODD)]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(finish(np.array([part], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit name of a set, never that of another set but by collision."""
    if not len(s):
        return 0
    x = finish(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(finish(np.array([x], np.uint64)).view(np.int64)[0])


def _packed(docs: DataFrame, n: int, packs: int) -> DataFrame:
    """Rows of two kinds, dealt to packs: ``doc`` with doc_id, n, cls and m (how many such rows
    there are), by both; and the sets with n, cls and tokens, once for each class, by class."""
    names = ["pack", "doc", "doc_id", "n", "cls", "m", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in batches:
            for a, b in slices(rows.column(1)):
                sets = shingle_sets(rows.column(1).slice(a, b - a), n)
                found: dict[tuple[int | None, int], int] = {}
                new = []
                names_of = list(map(set_hash, sets))
                for i, key in enumerate(zip(rows.column(0).slice(a, b - a).to_pylist(), names_of)):
                    found[key] = found.get(key, 0) + 1
                    if len(sets[i]) and key[1] not in seen:
                        if len(seen) > 500_000:
                            seen.clear()  # repeats are dropped again where a pack's rows meet
                        seen.add(key[1])
                        new.append(i)
                size = dict(zip(names_of, map(len, sets)))
                at = [(d or 0) * 31 + c for d, c in found]
                k = len(found)
                cols = [
                    pa.array([x % packs for x in at], pa.int32()), pa.array(np.ones(k, bool)), pa.array([d for d, _ in found], pa.int64()), pa.array([size[c] for _, c in found], pa.int64()),
                    pa.array([c for _, c in found], pa.int64()), pa.array(list(found.values()), pa.int64()), pa.nulls(k, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)
                k = len(new)
                cols = [
                    pa.array([names_of[i] % packs for i in new], pa.int32()), pa.array(np.zeros(k, bool)), pa.nulls(k, pa.int64()), pa.array([len(sets[i]) for i in new], pa.int64()),
                    pa.array([names_of[i] for i in new], pa.int64()), pa.nulls(k, pa.int64()), pa.array([sets[i].tobytes() for i in new], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "pack int, doc boolean, doc_id long, n long, cls long, m long, tokens binary")
    return rows.repartition("pack").groupBy("pack", "doc", "doc_id", "n", "cls").agg(F.sum("m").alias("m"), F.first("tokens").alias("tokens"))


def _flat(tokens: pa.ChunkedArray) -> np.ndarray:
    """All tokens of a binary column, in order."""
    return np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in tokens] or [np.zeros(0, np.uint64)])


def levels_of(df: np.ndarray) -> np.ndarray:
    """A byte for each document frequency: 0 for 1 alone."""
    return np.minimum(np.round(STEPS * np.log2(np.maximum(df, 1))), 255).astype(np.uint8)


def _low_high(v: np.ndarray) -> tuple[bytes, bytes | None]:
    """Sorted 64-bit values as 32-bit halves; the high one compressed, or None where it is 0."""
    high = (v >> np.uint64(32)).astype(np.uint32)
    return v.astype(np.uint32).tobytes(), zstandard.ZstdCompressor(level=1).compress(high.tobytes()) if high.any() else None


def _values(low: bytes, high: bytes | None) -> np.ndarray:
    v = np.frombuffer(low, np.uint32).astype(np.uint64)
    if high is not None:
        v |= np.frombuffer(zstandard.ZstdDecompressor().decompress(high, max_output_size=len(low)), np.uint32).astype(np.uint64) << np.uint64(32)
    return v


def _all_values(rows: pa.Table) -> list[np.ndarray]:
    return [_values(x, y) for x, y in zip(rows["low"].to_pylist(), rows["high"].to_pylist())]


def _all_counts(rows: pa.Table, sizes: list[int]) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    return np.concatenate([np.frombuffer(expand.decompress(x, max_output_size=4 * n), np.uint32) for x, n in zip(rows["counts"].to_pylist(), sizes)])


def _split(node: int, prefix: int, v: np.ndarray, counts: np.ndarray, left: int, bits: int) -> pa.Table:
    """Rows of the ranges that the next ``bits`` of the sorted ``left``-bit values name; what stays of a value is shorter by them."""
    part = (v >> np.uint64(left - bits)).astype(np.int64) if bits else np.zeros(len(v), np.int64)
    v = v & np.uint64((1 << (left - bits)) - 1)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(v)])
    ends = np.append(starts[1:], len(v))[: len(starts)]
    press = zstandard.ZstdCompressor(level=1)
    pairs = [_low_high(v[a:z]) for a, z in zip(starts, ends)]
    return pa.table(
        {
            "node": pa.array([node] * len(starts), pa.int64()),
            "bucket": pa.array((prefix << bits) + part[starts], pa.int64()),
            "low": pa.array([x for x, _ in pairs], pa.binary()),
            "high": pa.array([y for _, y in pairs], pa.binary()),
            "counts": pa.array([press.compress(np.minimum(counts[a:z], 2**32 - 1).astype(np.uint32).tobytes()) for a, z in zip(starts, ends)], pa.binary()),
        }
    )


def _asked(packed: DataFrame, bits: int, fan_bits: int) -> list[DataFrame]:
    """Each hop's rows (node, bucket, low, high, counts): distinct shingles of a node in a bucket, and in how many sets they are.

    Nodes of the first hop are packs. A hop merges 1 << ``fan_bits`` nodes of a
    bucket to one and splits the bucket in as many, so every hop has at most
    that many rows for each pack.
    """
    hops = max(1, -(-bits // fan_bits))
    widths = [min(fan_bits, bits - h * fan_bits) for h in range(hops)]
    schema, whole = "node long, bucket long, low binary, high binary, counts binary", min(64, 32 + bits)

    def ask(rows: pa.Table) -> pa.Table:
        tokens, counts = np.unique(_flat(rows.filter(pc.invert(rows["doc"]))["tokens"]), return_counts=True)
        # shingles that agree in all bits that are sent stay apart here: each has its own place in the answer
        return _split(rows["pack"][0].as_py(), 0, tokens >> np.uint64(64 - whole), counts, whole, widths[0])

    out = [packed.groupBy("pack").applyInArrow(sparing(ask), schema)]
    for h in range(1, hops):
        left, width = whole - h * fan_bits, widths[h]

        def merge(rows: pa.Table, left: int = left, width: int = width) -> pa.Table:
            values = _all_values(rows)
            merged, at = np.unique(np.concatenate(values), return_inverse=True)
            counts = np.bincount(at, _all_counts(rows, list(map(len, values)))).astype(np.int64)
            return _split(rows["node"][0].as_py() >> fan_bits, rows["bucket"][0].as_py(), merged, counts, left, width)

        out.append(out[-1].groupBy("bucket", F.shiftright("node", fan_bits)).applyInArrow(sparing(_of_one(merge)), schema))
    return out


def _of_one(f: Callable) -> Callable:
    """``f`` as a function of one argument, whatever defaults it has."""

    def run(rows: pa.Table) -> pa.Table:
        return f(rows)

    return run


def _levels(packed: DataFrame, bits: int, fan_bits: int = 8, store: Scratch | None = None) -> DataFrame:
    """node (a pack), bucket, levels: of the pack's distinct shingles, range by range in ascending order.

    Ranges are as many as packs, 1 << ``bits``. Up to 1 << ``fan_bits`` packs the
    exchange is direct; beyond, it goes and comes back by hops, so that rows stay in
    proportion to packs. Inside a range the next 32 bits stand for a shingle. Two
    that share them add up, for all packs alike, so the order stays one order.
    """
    asked = _asked(packed, bits, fan_bits)
    if len(asked) > 1:
        asked = [store.write(df, f"asked-{h}") for h, df in enumerate(asked)]
    schema = "node long, bucket long, levels binary"

    def tell(rows: pa.Table, values: list[np.ndarray], level: np.ndarray) -> pa.Table:
        press, ends = zstandard.ZstdCompressor(level=1), np.cumsum(list(map(len, values)))
        told = [press.compress(level[z - len(v) : z].tobytes()) for v, z in zip(values, ends)]
        return pa.table({"node": rows["node"], "bucket": rows["bucket"], "levels": pa.array(told, pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        values = _all_values(rows)
        _, at = np.unique(np.concatenate(values), return_inverse=True)
        return tell(rows, values, levels_of(np.bincount(at, _all_counts(rows, list(map(len, values)))))[at])

    def pass_on(rows: pa.Table, told: pa.Table) -> pa.Table:
        """``told``: the levels of the merged node's ranges; its values are those of ``rows``, merged again."""
        expand, values = zstandard.ZstdDecompressor(), _all_values(rows)
        level = np.concatenate([np.frombuffer(expand.decompress(x, max_output_size=1 << 31), np.uint8) for x in told.sort_by("bucket")["levels"].to_pylist()])
        return tell(rows, values, level[np.unique(np.concatenate(values), return_inverse=True)[1]])

    told = asked[-1].groupBy("bucket").applyInArrow(sparing(answer), schema)
    for h in range(len(asked) - 2, -1, -1):
        width = min(fan_bits, bits - (h + 1) * fan_bits)
        back = told.withColumn("up", F.shiftright("bucket", width))
        down = asked[h].groupBy("bucket", F.shiftright("node", fan_bits)).cogroup(back.groupBy("up", "node"))
        told = down.applyInArrow(sparing(pass_on), schema)
        if h:
            told = store.write(told, f"told-{h}")
    return told


def adaptive_prefix(s: np.ndarray, level: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Prefix tokens that other classes hold, in the global order (level, hash), their layers, and the chosen l.

    Cost of l: the postings themselves, the list entries that they meet, and the
    verification of the candidates left, a share 1 / l of those.
    """
    n = len(s)
    overlap = -(-num * n // den)
    first = n - overlap + 1
    choices = LAYERS[LAYERS <= overlap]
    lengths = first + choices - 1
    order = np.argsort(level, kind="stable")  # s is sorted, so ties stay by hash
    s, level = s[order], level[order]
    alone = int(np.searchsorted(level, 1))
    met = np.cumsum(2.0 ** (level[: lengths[-1]] / STEPS) - 1)[lengths - 1]
    ell = int(choices[np.argmin(np.maximum(lengths - alone, 0) + met + VERIFY * n * met / choices)])
    layer = np.maximum(np.arange(first + ell - 1) - first + 2, 1)
    return s[alone : first + ell - 1], layer[alone:].astype(np.int16), ell


def _prefixes(packed: DataFrame, levels: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of documents as they are, and the sets whose prefix holds a token of another set, with ell, prefix, layers."""
    schema = "doc boolean, doc_id long, n long, cls long, m long, tokens binary, ell short, prefix binary, layers binary"

    def choose(rows: pa.Table, told: pa.Table) -> pa.Table:
        docs, sets = rows.filter(rows["doc"]), rows.filter(pc.invert(rows["doc"]))
        plain = ["doc", "doc_id", "n", "cls", "m"]
        kept, prefixes = [], []
        if len(sets):
            expand = zstandard.ZstdDecompressor()
            told = told.sort_by("bucket")
            level = np.concatenate([np.frombuffer(expand.decompress(x.as_py(), max_output_size=1 << 31), np.uint8) for x in told["levels"]])
            flat = _flat(sets["tokens"])
            size = sets["n"].to_numpy()
            ends = np.cumsum(size)
            level = level[np.unique(flat, return_inverse=True)[1]]
            alone = np.add.reduceat(level == 0, ends - size, dtype=np.int64)
            for i in np.flatnonzero(alone < size - -(-num * size // den) + 1).tolist():
                part = slice(ends[i] - size[i], ends[i])
                prefixes.append(adaptive_prefix(flat[part], level[part], num, den))
                kept.append(i)
        sets = sets.take(pa.array(kept, pa.int64())).select([*plain, "tokens"])
        sets = sets.append_column("ell", pa.array([p[2] for p in prefixes], pa.int16()))
        sets = sets.append_column("prefix", pa.array([p[0].tobytes() for p in prefixes], pa.binary()))
        sets = sets.append_column("layers", pa.array([p[1].tobytes() for p in prefixes], pa.binary()))
        docs = docs.select(plain)
        for name, kind in (("tokens", pa.binary()), ("ell", pa.int16()), ("prefix", pa.binary()), ("layers", pa.binary())):
            docs = docs.append_column(name, pa.nulls(len(docs), kind))
        return pa.concat_tables([docs, sets.cast(docs.schema)])

    return packed.groupBy("pack").cogroup(levels.groupBy(F.col("node").cast("int"))).applyInArrow(sparing(choose), schema)


def _postings(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, 512):
                part = rows.slice(a, 512)
                tokens = [np.frombuffer(x.as_py(), np.int64) for x in part.column(3)]
                layers = np.concatenate([np.frombuffer(x.as_py(), np.int16) for x in part.column(4)])
                k = list(map(len, tokens))
                cols = [np.concatenate(tokens), np.repeat(part.column(0).to_numpy(), k), np.repeat(part.column(1).to_numpy(), k).astype(np.int32), np.repeat(part.column(2).to_numpy(), k), layers]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["token", "cls", "n", "ell", "layer"])

    return sets.select("cls", "n", "ell", "prefix", "layers").mapInArrow(frugal(run), "token long, cls long, n int, ell short, layer short")


def _candidates(postings: DataFrame, num: int, den: int, long_list: int) -> DataFrame:
    """a, b, need, c: shared tokens of pairs in short lists; need 0: a link of a long list."""

    def pairs(t: np.ndarray, cls: np.ndarray, n: np.ndarray, ell: np.ndarray, layer: np.ndarray, held: bool, more: bool) -> pa.RecordBatch:
        """Rows sorted by token, size, class. ``held``: the first list is the rest of a long one; ``more``: the last one goes on."""
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (cls[1:] != cls[:-1])
        t, cls, n, ell, layer = t[fresh], cls[fresh], n[fresh], ell[fresh], layer[fresh]
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        sizes = np.diff(np.append(starts, len(t)))
        run = np.repeat(np.arange(len(starts)), sizes)
        many = sizes > long_list
        many[0] |= held
        many[-1] |= more
        wide = many[run]
        out = []
        keep = np.flatnonzero(~wide & (sizes[run] > 1))
        for d in range(1, long_list):
            i = keep[keep + d < len(t)]
            i = i[run[i] == run[i + d]]
            if not len(i):
                break
            j = i + d
            need = np.minimum(ell[i], ell[j])
            ok = (np.maximum(layer[i], layer[j]) <= need) & (n[i].astype(np.int64) * den >= n[j].astype(np.int64) * num)
            out.append((cls[i[ok]], cls[j[ok]], need[ok]))
        at = np.flatnonzero(wide)
        if len(at):
            # a new hub where the list starts or the next size is out of reach
            near = np.append(False, (run[at[1:]] == run[at[:-1]]) & (n[at[:-1]].astype(np.int64) * den >= n[at[1:]].astype(np.int64) * num))
            hub = at[np.maximum.accumulate(np.where(near, 0, np.arange(len(at))))]
            out.append((cls[hub[near]], cls[at[near]], np.zeros(int(near.sum()), np.int16)))
        x = np.concatenate([o[0] for o in out] or [np.zeros(0, np.int64)])
        y = np.concatenate([o[1] for o in out] or [np.zeros(0, np.int64)])
        need = np.concatenate([o[2] for o in out] or [np.zeros(0, np.int16)]).astype(np.int16)
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((need, y, x))
        x, y, need = x[order], y[order], need[order]
        new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (need[1:] != need[:-1]))[: len(x)])
        c = np.diff(np.append(new, len(x)))
        return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new]), pa.array(need[new]), pa.array(c.astype(np.int64))], ["a", "b", "need", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int16, np.int16)]
        held = False
        for rows in batches:
            cols = [np.concatenate([c, rows.column(i).to_numpy(zero_copy_only=False)]) for i, c in enumerate(carry)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # tokens are sorted: where the last list starts
            if len(cols[0]) - last > 4 * long_list or (held and last == 0):
                # a long list goes on: what came is linked, its last row stays
                yield pairs(*cols, held, True)
                carry, held = [c[-1:] for c in cols], True
                continue
            if last:
                yield pairs(*[c[:last] for c in cols], held, False)
                held = False
            carry = [c[last:] for c in cols]
        if len(carry[0]):
            yield pairs(*carry, held, False)

    ordered = postings.repartition("token").sortWithinPartitions("token", "n", "cls")
    met = ordered.mapInArrow(frugal(run), "a long, b long, need short, c long")
    met = met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need"), F.min("need").alias("low"))
    return met.filter("low = 0 OR c >= need").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges starts[i]..ends[i], one range after the other."""
    size = np.maximum(ends - starts, 0)
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@dataclass
class Member:
    """A class in a group: its set, and its prefix with layers and l."""

    cls: int
    block: int
    copies: int
    ell: int
    tokens: np.ndarray
    prefix: np.ndarray
    layers: np.ndarray


def links_of_group(group: list[Member], cross: bool, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the later j linked with it). ``cross``: only pairs of different blocks.

    Pairs that share min(l) prefix tokens are verified by exact intersection sizes.
    """
    g = len(group)
    blocks, ell = np.array([m.block for m in group]), np.array([m.ell for m in group])
    sizes = np.array([len(m.tokens) for m in group])
    _, token = np.unique(np.concatenate([m.prefix for m in group]), return_inverse=True)
    held = np.array([len(m.prefix) for m in group])
    order = np.argsort(token, kind="stable")  # lists of the tokens, each in the order of the group
    owner, layer = np.repeat(np.arange(g), held)[order], np.concatenate([m.layers for m in group])[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    stop = np.searchsorted(token[order], token, side="right")
    mine = np.append(0, np.cumsum(held))
    _, ids, df = np.unique(np.concatenate([m.tokens for m in group]), return_inverse=True, return_counts=True)
    mark = np.zeros(len(df), bool)
    bounds = np.append(0, np.cumsum(sizes))
    for i in range(g - 1):
        own = slice(mine[i], mine[i + 1])
        at = _ranges(place[own] + 1, stop[own])
        j = owner[at]
        need = np.minimum(ell[i], ell[j])
        ok = np.maximum(np.repeat(layer[place[own]], stop[own] - place[own] - 1), layer[at]) <= need
        shared = np.bincount(j[ok], minlength=g)
        j = np.flatnonzero((shared > 0) & (shared >= np.minimum(ell[i], ell)))
        if cross:
            j = j[blocks[j] != blocks[i]]
        if not len(j):
            continue
        all_i = ids[bounds[i] : bounds[i + 1]]
        mark[all_i] = True
        common = np.add.reduceat(mark[ids[_ranges(bounds[j], bounds[j + 1])]], np.cumsum(sizes[j]) - sizes[j], dtype=np.int64)
        mark[all_i] = False
        j = j[den * common >= num * (sizes[i] + sizes[j] - common)]
        if len(j):
            yield i, j


def _verify(members: DataFrame, num: int, den: int) -> DataFrame:
    """Sets by cluster and pair of blocks x, y -> a, b (a forest of the links) and a, links (b null)."""

    def solve(group: list[Member], cross: bool) -> pa.RecordBatch:
        cls, copies = np.array([m.cls for m in group], np.int64), np.array([m.copies for m in group], np.int64)
        label = np.arange(len(group))
        degree = np.zeros(len(group), np.int64)
        a, b = [], []
        for i, js in links_of_group(group, cross, num, den):
            degree[i] += copies[js].sum()
            degree[js] += copies[i]
            for other in np.unique(label[js]).tolist():
                if other != label[i]:
                    j = js[label[js] == other][0]
                    a.append(int(cls[i])), b.append(int(cls[j]))
                    label[label == other] = label[i]
        own = np.flatnonzero(degree)
        n = len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array([*a, *cls[own].tolist()], pa.int64()), pa.array([*b, *[None] * n], pa.int64()), pa.array([*[None] * len(a), *degree[own].tolist()], pa.int64())], ["a", "b", "links"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for rows in batches:
            for cluster, x, y, cls, block, copies, ell, tokens, prefix, layers in zip(*[c.to_pylist() for c in rows.columns]):
                if (cluster, x, y) != key:
                    if len(held) > 1:
                        yield solve(held, key[1] != key[2])
                    key, held = (cluster, x, y), []
                held.append(Member(cls, block, copies, ell, np.frombuffer(tokens, np.uint64), np.frombuffer(prefix, np.uint64), np.frombuffer(layers, np.int16)))
        if len(held) > 1:
            yield solve(held, key[1] != key[2])

    ordered = members.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    return ordered.mapInArrow(frugal(run), "a long, b long, links long")


def _members(sets: DataFrame, clustered: DataFrame) -> DataFrame:
    """The sets of clustered classes, for all their block pairs."""
    clustered = F.broadcast(clustered) if small_enough(clustered, 32 << 20, 64) else clustered  # beyond that the sets are shuffled
    rows = sets.select("cls", "ell", "tokens", "prefix", "layers").join(clustered, "cls")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "cls", "block", "copies", "ell", "tokens", "prefix", "layers")


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, long_list: int = 16, pack_bytes: int = 8 << 20, block_shingles: int = 3_000_000, fan_bits: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, class_id, group_id of every row of ``docs``.

    Two documents link when den * |intersection| >= num * |union|.
    ``component_id`` is the smallest doc_id reachable by links; ``n_links``
    counts the linked documents, copies with the same set included. ``class_id``
    names the set itself and ``group_id`` the component by its sets, also where
    doc_ids repeat or are missing (null for the empty set). A pack
    holds about ``pack_bytes`` of text, less where that would leave cores idle.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "ngram-join")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    packs = 1 + max(total // pack_bytes, min(total >> 20, 4 * spark.sparkContext.defaultParallelism))
    packed = _packed(docs, n, packs)
    levels = _levels(packed, max(0, (packs - 1).bit_length()), fan_bits, store)
    table = store.write(_prefixes(packed, levels, num, den), "sets")
    every, sets = table.filter("doc").select("doc_id", "n", "cls", "m"), table.filter("NOT doc")
    classes = every.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.sum("m").alias("copies"), F.first("n").alias("n"))
    classes = store.write(classes, "classes")
    found = store.write(_candidates(_postings(sets), num, den, long_list), "candidates")
    clusters = components(found, store, "clusters").join(classes.withColumnRenamed("cls", "node"), "node")
    clusters = store.write(clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster"), "rep", "copies", "n"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int").alias("nb"))
    clustered = store.write(clusters.join(sizes, "cluster").select("cls", "cluster", "nb", "copies"), "clustered")
    verified = store.write(_verify(_members(sets, clustered), num, den), "links")
    linked = components(verified.filter("b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v")), store, "components")
    degree = verified.filter("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    named = store.write(linked.join(classes.select(F.col("cls").alias("node"), "rep"), "node"), "named")
    names = named.groupBy("component").agg(F.min("rep").alias("name"))
    named = named.join(names, "component").select(F.col("node").alias("cls"), "name", F.col("component").alias("group"))
    whole = classes.join(named, "cls", "left").join(degree, "cls", "left")
    whole = store.write(whole.select("cls", F.coalesce("group", "cls").alias("group"), F.coalesce("name", "rep").alias("name"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "whole")
    # both sides are plain tables here, so that a class with very many documents can be split
    out = every.filter("n > 0").join(whole, "cls").select("doc_id", "n", "name", "links", "m", "cls", "group")
    none = every.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("name"), F.lit(0).cast("long").alias("links"), "m", "cls", F.lit(None).cast("long").alias("group"))
    out = out.unionByName(none).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("name").alias("component_id"), F.col("links").cast("long").alias("n_links"), F.col("cls").alias("class_id"), F.col("group").alias("group_id"))


def class_of(docs: DataFrame, n: int = 5) -> DataFrame:
    """row (all columns of ``docs``), class_id: the set of each row's text, 0 for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names = [set_hash(s) for a, b in slices(rows.column(1)) for s in shingle_sets(rows.column(1).slice(a, b - a), n)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.int64())], ["row", "class_id"])

    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return packed.mapInArrow(frugal(run), T.StructType([packed.schema["row"], T.StructField("class_id", T.LongType())]))

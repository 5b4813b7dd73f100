"""How sources of a language diverge in their terms, with counts pre-filtered by a sketch.

Terms are runs of letters (A-Z lower-cased, all characters beyond ASCII). A
language keeps the terms that at least ``least`` of its documents hold. Every
(language, source) group that occurs, and every language, gives each kept term a
smoothed share p in thousand-millionths; two shares diverge by
floor((p - q)**2 / (p + q)).

1. Sketch: tasks count documents per (language, term) in a count-min sketch of
   one-byte counters that stop at 255. Its pieces are merged by adding, which
   never underestimates. A term whose least counter is under ``least`` cannot be
   kept.
2. Counts: in a second scan such terms go before anything is shuffled; for the
   others occurrences and documents are counted exactly by language, source and
   term, summed in each task's slices first. ``least`` is then applied exactly.
3. Pairs: most terms are missing from most sources, and all missing terms of a
   source have one share. So a pair's sum over all kept terms is put together
   from the terms that both hold (a sparse join by language and term), for each
   source the terms that it holds against the other's share of a missing term
   (from a histogram of its counts), and a multiple of one value for the rest.
   The divergence has no direction, so each pair is computed once.

The sketch has two rows of ``2**bits`` counters. ``bits`` follows the size of
the texts between 2**16 and 2**25 counters, so what is broadcast is at most
64 MB; beyond, more terms pass the sketch and are dropped by their exact count.
Terms are told apart by 64-bit hashes within a slice, by themselves everywhere
else. The number of rows of part ``pair`` is the square of a language's sources,
as asked for.

Defined results: null text, lang and source are ''. Groups without terms take
part; with no kept term all pair values are 0. Ranks go by value, descending,
then by the item's UTF-8 bytes. Repeated rows count as documents of their own.
An empty table, or languages of one source without kept terms, give no rows.
Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import MIX, MIX2, frugal, hash_pieces, slices
from ._store import Scratch
from ._words import WORD_BYTE, finish, lowered, runs

#: Counters of a piece of the sketch.
PIECE = 1 << 14
#: Ends of the number of counters in a row of the sketch, as powers of two.
BITS = (16, 25)


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def _terms(rows: pa.RecordBatch, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends, hashes and the text's number of every term of rows a..z."""
    data, offsets = lowered(rows.column(0).slice(a, z - a))
    starts, ends = runs(WORD_BYTE[data], offsets)
    h = hash_pieces(data, starts, ends - starts) if len(starts) else np.zeros(0, np.uint64)
    return data, starts, ends, h, np.searchsorted(offsets, starts, side="right") - 1


@functools.lru_cache(maxsize=4096)
def _seed(lang: str) -> int:
    raw = np.frombuffer(lang.encode() + bytes(64), np.uint8)
    return int(hash_pieces(raw, np.array([0]), np.array([len(raw) - 64]))[0])


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([_seed(x) for x in langs], np.uint64)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter of each key in both rows of the sketch."""
    x = finish(h)
    return (x & np.uint64((1 << bits) - 1)).astype(np.int64), ((x * MIX2) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(total_bytes: int) -> int:
    """About a counter for every 16 bytes of text, within ``BITS``."""
    return min(max((total_bytes >> 4).bit_length(), BITS[0]), BITS[1])


def sketch(docs: DataFrame, bits: int) -> np.ndarray:
    """2 x 2**bits counters of documents per (language, term), never too small up to 255."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << bits), np.uint8)
        for rows in batches:
            for a, z in slices(rows.column(0)):
                _, _, _, h, doc = _terms(rows, a, z)
                h = (h ^ _seeds(rows.column(1).slice(a, z - a).to_pylist())[doc]) * MIX
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                h = h[np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]]  # once for each document
                for row, at in zip(table, _places(h, bits)):
                    at, n = np.unique(at, return_counts=True)
                    row[at] = np.minimum(row[at].astype(np.int64) + n, 255)
        press = zstandard.ZstdCompressor(level=1)
        pieces = table.reshape(-1, PIECE)
        used = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([press.compress(pieces[i].tobytes()) for i in used], pa.binary())], ["piece", "counters"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by piece: the sums of each piece."""
        expand, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        key, total = None, np.zeros(PIECE, np.int64)
        give = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([press.compress(np.minimum(total, 255).astype(np.uint8).tobytes())], pa.binary())], ["piece", "counters"])
        for rows in batches:
            for piece, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if piece != key:
                    if key is not None:
                        yield give()
                    key, total = piece, np.zeros(PIECE, np.int64)
                total = np.minimum(total + np.frombuffer(expand.decompress(raw, max_output_size=PIECE), np.uint8), 255)
        if key is not None:
            yield give()

    some = docs.select("text", "lang").mapInArrow(frugal(count), "piece int, counters binary")
    # two levels, so that the pieces of very many tasks do not meet in one
    merged = some.withColumn("salt", F.pmod(F.xxhash64("counters"), F.lit(64))).repartition("piece", "salt").sortWithinPartitions("piece").select("piece", "counters").mapInArrow(frugal(add), "piece int, counters binary")
    merged = merged.repartition("piece").sortWithinPartitions("piece").mapInArrow(frugal(add), "piece int, counters binary")
    out = np.zeros((2 << bits) // PIECE * PIECE, np.uint8).reshape(-1, PIECE)
    expand = zstandard.ZstdDecompressor()
    for r in merged.toLocalIterator():  # 2**(bits + 1) / PIECE rows
        out[r["piece"]] = np.frombuffer(expand.decompress(r["counters"], max_output_size=PIECE), np.uint8)
    return out.reshape(2, -1)


def _counted(docs: DataFrame, table: np.ndarray, least: int) -> DataFrame:
    """lang, source, term, n (occurrences), docs, by task: of the terms that the sketch lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    bits = table.shape[1].bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = sent.value
        for rows in batches:
            for a, z in slices(rows.column(0)):
                data, starts, ends, h, doc = _terms(rows, a, z)
                langs, sources = rows.column(1).slice(a, z - a).to_pylist(), rows.column(2).slice(a, z - a).to_pylist()
                one, two = _places((h ^ _seeds(langs)[doc]) * MIX, bits)
                ok = np.flatnonzero(np.minimum(rows_of[0][one], rows_of[1][two]) >= least)
                if not len(ok):
                    continue
                h, doc, starts, ends = h[ok], doc[ok], starts[ok], ends[ok]
                names: dict[tuple[str, str], int] = {}
                group = np.array([names.setdefault(x, len(names)) for x in zip(langs, sources)])[doc]
                order = np.lexsort((doc, h, group))
                h, doc, group, starts, ends = h[order], doc[order], group[order], starts[order], ends[order]
                new = np.append(True, (h[1:] != h[:-1]) | (group[1:] != group[:-1]))
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(h)))
                held = np.add.reduceat((new | np.append(True, doc[1:] != doc[:-1])).astype(np.int64), first)
                raw = data.tobytes()
                terms = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())]
                named = list(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([named[g][k] for g in group[first].tolist()], pa.string()) for k in (0, 1)] + [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(held)], ["lang", "source", "term", "n", "docs"]
                )

    return docs.mapInArrow(frugal(run), "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, store: Scratch, least: int) -> DataFrame:
    """lang, source, term, n of the kept terms, where n > 0; a written table."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    some = _counted(docs, sketch(docs, sketch_bits(total)), least)
    exact = store.write(some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "exact")
    kept = exact.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term")
    return store.write(exact.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "counts")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (n + 2) / (total + 2 * terms)), exact for all longs."""
    top = (n.cast("decimal(19,0)") + 2) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", top, total.cast("decimal(19,0)") + terms.cast("decimal(19,0)") * 2).cast("long") + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def audit(docs: DataFrame, least: int = 10, ranks: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language by its divergence over all
    kept terms; part ``term``: the ``ranks`` terms that set a source most apart
    from its language, of those that it uses more.
    """
    store = Scratch(docs.sparkSession, "source-audit")
    docs = _prepared(docs)
    counts = kept_counts(docs, store, least)
    groups = docs.select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    sizes = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", *map(zero, ("total", "own", "v", "all")))
    groups = groups.withColumn("none", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1))
    groups = store.write(groups, "groups")  # a row for each group

    shares = counts.join(groups.filter("v > 0"), ["lang", "source"])
    shares = store.write(shares.select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("v")).alias("p")), "shares")
    one = groups.select("lang", F.col("source").alias("g"), F.col("none").alias("gn"), F.col("own").alias("go"), "v")
    two = groups.select("lang", F.col("source").alias("h"), F.col("none").alias("hn"), F.col("own").alias("ho"))
    pairs = one.join(two, "lang").filter("g < h")
    p, q, gn, hn = (F.col(c) for c in ("p", "q", "gn", "hn"))
    # terms that both hold, beyond what the two sums over own terms and the rest say of them
    left = shares.select("lang", "term", F.col("source").alias("g"), "p").join(groups.select("lang", F.col("source").alias("g"), F.col("none").alias("gn")), ["lang", "g"])
    right = shares.select("lang", "term", F.col("source").alias("h"), F.col("p").alias("q")).join(groups.select("lang", F.col("source").alias("h"), F.col("none").alias("hn")), ["lang", "h"])
    both = left.join(right, ["lang", "term"]).filter("g < h").groupBy("lang", "g", "h").agg(F.sum(_apart(p, q) - _apart(p, hn) - _apart(gn, q) + _apart(gn, hn)).alias("both"))
    # own terms against the other's share of a missing term: equal counts have equal shares
    kinds = store.write(shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")), "kinds")
    others = groups.select("lang", F.col("source").alias("item"), "none")
    against = kinds.join(others, "lang").filter("source != item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _apart(p, F.col("none"))).alias("own_sum"))
    g_own = against.select("lang", F.col("source").alias("g"), F.col("item").alias("h"), F.col("own_sum").alias("a"))
    h_own = against.select("lang", F.col("source").alias("h"), F.col("item").alias("g"), F.col("own_sum").alias("b"))
    value = F.coalesce("both", F.lit(0)) + F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) + (F.col("v") - F.col("go") - F.col("ho")) * _apart(gn, hn)
    pairs = pairs.join(both, ["lang", "g", "h"], "left").join(g_own, ["lang", "g", "h"], "left").join(h_own, ["lang", "g", "h"], "left")
    pairs = store.write(pairs.select("lang", "g", "h", F.when(F.col("v") > 0, value).otherwise(0).cast("long").alias("value")), "pairs")
    pairs = pairs.select("lang", F.col("g").alias("source"), F.col("h").alias("item"), "value").unionByName(pairs.select("lang", F.col("h").alias("source"), F.col("g").alias("item"), "value"))

    whole = of_lang.join(groups.select("lang", "v", "all").distinct(), "lang").select("lang", "term", _share(F.col("n"), F.col("all"), F.col("v")).alias("q"))
    terms = shares.join(whole, ["lang", "term"]).filter(p > q).select("lang", "source", F.col("term").alias("item"), _apart(p, q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).filter(F.col("rank") <= ranks)
    return pairs.unionByName(terms)

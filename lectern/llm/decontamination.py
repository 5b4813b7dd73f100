"""Benchmark decontamination with a distributed positional inverted index.

1. Test terms: the words of all benchmark windows, with their corpus counts.
2. Anchors: every window marks its ``rarest`` rarest terms; the index stores
   the postings (term, document, positions) of marked terms alone.
3. Intersection: a posting at position p of a term at item offset o lies on
   the diagonal p - o. Windows occur on diagonals where enough marked offsets
   of one window meet; lists are intersected by grouping on the diagonal.
4. Phrases: the item is laid on the document along each surviving diagonal,
   and runs of equal words are compared with the window: exact matches.

All steps are DataFrame functions. The benchmark side is broadcast only while
its measured size is under ``broadcast_bytes``; beyond that the same joins
shuffle, and words pass a sieve of hashed terms before. Candidates are one row per (document, item) with its
diagonals, whatever the number of windows on them.

Defined results
- null text: no words, on either side; such an item has no window;
- repeated documents and items are treated one by one (items by item_id: a
  repeated item_id counts once in ``n_items``);
- null doc_id: its row is kept, with its own matches;
- an empty benchmark or document table: no hits, or no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands as a term for a document's length; no word can hold it.
LENGTH = "\x00"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes runs of a-z, 0-9 and non-ASCII characters."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.filter(cut, lambda w: w != "")


def windows(items: DataFrame, n: int) -> DataFrame:
    """item_id, text -> item_key, item_id, w (words), n_win (window length)."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.select(F.xxhash64("item_id", "w").alias("item_key"), "item_id", "w").dropDuplicates(["item_key"])
    return w.withColumn("n_win", F.least(F.size("w"), F.lit(n)))


def _small(df: DataFrame, limit: int) -> bool:
    """Whether the measured size of ``df`` (its strings and arrays as text) is under ``limit``."""
    width = sum((F.length(F.to_json(F.struct(c))) for c in df.columns), F.lit(0))
    return (df.agg(F.sum(width).alias("b")).first()["b"] or 0) <= limit


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, term of every word, and a row (LENGTH, number of words) per document.

    The text is split as it is and A-Z lowered word by word, which costs a
    third of lowering whole texts that hold non-ASCII characters.
    """
    text = F.coalesce("text", F.lit(""))
    edge = lambda at: F.substring(text, at, 1).rlike(SEPARATOR).cast("int")
    d = docs.select("doc_id", F.split(text, SEPARATOR).alias("w"), edge(1).alias("lead"), F.when(text == "", 1).otherwise(edge(-1)).alias("trail"))
    d = d.select("doc_id", "lead", "trail", F.posexplode(F.array_append("w", F.lit(LENGTH))).alias("pos", "word")).filter("word != ''")
    pos = F.col("pos") - F.col("lead") - F.when(F.col("word") == LENGTH, F.col("trail")).otherwise(0)
    ascii_only = F.length("word") == F.octet_length("word")
    return d.select("doc_id", pos.alias("pos"), F.when(ascii_only, F.lower("word")).otherwise(F.translate("word", UPPER, LOWER)).alias("term"))


def term_counts(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """term -> corpus count n, over all words of all documents; 0 if it never occurs.

    Beyond the broadcast limit words are counted before they meet the terms, so
    that a frequent word is one row for each task.
    """
    found = tokens(docs).select("term")
    if small:
        found = found.join(F.broadcast(terms), "term")
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def sieve(terms: DataFrame, cells: int = 1 << 17) -> DataFrame:
    """One row, ``bits``: ``cells`` longs with a bit for the hash of each term."""
    h = F.pmod(F.xxhash64("term"), F.lit(64 * cells))
    cell = terms.select(h.alias("h")).groupBy((F.col("h") / 64).cast("long").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 64 AS INT))")).alias("b"))
    every = terms.sparkSession.range(cells).withColumnRenamed("id", "cell").join(cell, "cell", "left").select("cell", F.coalesce("b", F.lit(0)).alias("b"))
    return every.agg(F.array_sort(F.collect_list(F.struct("cell", "b")))["b"].alias("bits"))  # cells rows, whatever the terms


def known_terms(words_: DataFrame, terms: DataFrame, small: bool, cells: int = 1 << 17) -> DataFrame:
    """The rows of ``words_`` whose term is in ``terms``. Where those are shuffled, a sieve goes first: most words are in
    none, and frequent ones would meet in one task only to be dropped there."""
    if small:
        return words_.join(F.broadcast(terms), "term")
    bits = sieve(terms, cells).scalar()
    h = F.pmod(F.xxhash64("term"), F.lit(64 * cells))
    marked = words_.withColumns({"_h": h, "_bits": bits})
    marked = marked.filter(F.expr("(shiftrightunsigned(get(_bits, CAST(_h DIV 64 AS INT)), CAST(_h % 64 AS INT)) & 1) = 1")).drop("_h", "_bits")
    return marked.join(terms, "term")


def anchors(items: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """item_key, offset, term: the offsets of each window's ``rarest`` rarest terms."""
    placed = items.select("item_key", "n_win", F.size("w").alias("len"), F.posexplode("w").alias("offset", "term")).join(counts, "term")
    # a term stands in the windows that start at offset - n_win + 1 .. offset
    starts = F.sequence(F.greatest(F.col("offset") - F.col("n_win") + 1, F.lit(0)), F.least(F.col("offset"), F.col("len") - F.col("n_win")))
    per_window = placed.select("item_key", F.explode(starts).alias("start"), F.struct("n", "offset", "term").alias("t"))
    per_window = per_window.groupBy("item_key", "start").agg(F.slice(F.array_sort(F.collect_list("t")), 1, rarest).alias("t"))
    return per_window.select("item_key", F.explode("t").alias("t")).select("item_key", "t.offset", "t.term").distinct()


def postings(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """term, doc_id, pos: the index over the marked terms, and each document's length. ``terms`` is a written table."""
    length = terms.sparkSession.range(1).select(F.lit(LENGTH).alias("term"))
    if small:
        return known_terms(tokens(docs), terms.union(length), True)
    every = tokens(docs)
    return known_terms(every.filter(F.col("term") != LENGTH), terms, False).unionByName(every.filter(F.col("term") == LENGTH).select("term", "doc_id", "pos"))


def candidates(index: DataFrame, marks: DataFrame, items: DataFrame, rarest: int, small: bool) -> DataFrame:
    """doc_id, item_key, diags: where the offset-adjusted lists of some window meet."""
    met = index.join(_hint(marks, small), "term").select("doc_id", "item_key", (F.col("pos") - F.col("offset")).alias("diag"), "offset")
    met = met.groupBy("doc_id", "item_key", "diag").agg(F.array_sort(F.collect_set("offset")).alias("o"))
    need = items.select("item_key", F.least(F.lit(rarest), F.col("n_win")).alias("need"), "n_win")
    met = met.join(_hint(need, small), "item_key").filter(F.size("o") >= F.col("need"))
    # enough offsets inside the span of one window
    within = F.exists(F.sequence(F.lit(0), F.size("o") - F.col("need")), lambda i: F.get("o", i + F.col("need") - 1) - F.get("o", i) < F.col("n_win"))
    return met.filter(within).groupBy("doc_id", "item_key").agg(F.collect_list("diag").alias("diags"))


def phrase_hits(doc_words: Column, item_words: Column, diag: Column, n_win: Column) -> Column:
    """Document positions inside a window of the item that lies on ``diag``: runs without a mismatch, of that length at least."""
    size = F.size(item_words)
    other = F.filter(F.sequence(F.lit(0), size - 1), lambda j: ~F.get(doc_words, diag + j).eqNullSafe(F.get(item_words, j)))
    ends = F.concat(F.array(F.lit(-1)), other, F.array(size))

    def between(e: Column) -> Column:
        runs = F.zip_with(F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        long_ = F.filter(runs, lambda r: r["b"] - r["a"] - 1 >= n_win)
        return F.flatten(F.transform(long_, lambda r: F.sequence(diag + r["a"] + 1, diag + r["b"] - 1)))

    return F.flatten(F.transform(F.array(ends), between))  # a transform of one element binds it: it is computed once


@dataclass
class Matches:
    """``lengths``: doc_id, n_words of each document. ``found``: found_in (a doc_id), found (its candidates).
    ``small``: whether ``found`` is under the broadcast limit."""

    lengths: DataFrame
    found: DataFrame
    small: bool


def match(docs: DataFrame, items: DataFrame, n: int = 13, rarest: int = 2, broadcast_bytes: int = 8 << 20) -> Matches:
    """Builds the index over ``docs`` and intersects the lists of every window of ``n`` words."""
    store = Scratch(docs.sparkSession, "decontamination")
    items = store.write(windows(items, n), "items")
    small = _small(items, broadcast_bytes)
    terms = items.select(F.explode("w").alias("term")).distinct()
    text = docs.select("doc_id", "text")
    marks = store.write(anchors(items, term_counts(text, terms, small), rarest), "marks")
    marked = store.write(marks.select("term").distinct(), "terms")
    index = store.write(postings(text, marked, small), "postings")
    found = candidates(index.filter(F.col("term") != LENGTH), marks, items, rarest, small)
    found = found.join(_hint(items.select("item_key", "item_id", "w", "n_win"), small), "item_key")
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "w", "n_win", "diags")).alias("found"))
    found = store.write(found.withColumnRenamed("doc_id", "found_in"), "candidates")
    lengths = index.filter(F.col("term") == LENGTH).select("doc_id", F.col("pos").cast("long").alias("n_words"))
    return Matches(lengths, found, _small(found, broadcast_bytes))


def verify(docs: DataFrame, m: Matches, num: int = 1, den: int = 20) -> DataFrame:
    """The rows of ``docs`` that have candidates, with n_words, hits, item_ids, n_hit, contaminated.

    ``hits``: positions of words inside any occurrence of a window; ``item_ids``:
    items with occurring windows, sorted as strings. A document is
    contaminated if it has a hit and den * n_hit >= num * n_words.
    """
    body = docs.join(_hint(m.found, m.small), F.col("doc_id").eqNullSafe(F.col("found_in"))).drop("found_in")
    body = body.withColumn("_words", F.explode(F.array(words(F.col("text")))))  # a row of its own, so that no lambda splits the text again
    on_diagonals = lambda f: F.flatten(F.transform(f["diags"], lambda d: phrase_hits(F.col("_words"), f["w"], d, f["n_win"])))
    matched = F.transform("found", lambda f: F.struct(f["item_id"].alias("item_id"), on_diagonals(f).alias("hits")))
    body = body.withColumn("_m", F.filter(matched, lambda f: F.size(f["hits"]) > 0))
    body = body.withColumn("n_words", F.size("_words").cast("long"))
    body = body.withColumn("hits", F.array_sort(F.array_distinct(F.flatten(F.transform("_m", lambda f: f["hits"])))))
    body = body.withColumn("item_ids", F.array_sort(F.array_distinct(F.transform("_m", lambda f: f["item_id"].cast("string")))))
    body = body.withColumn("n_hit", F.size("hits").cast("long"))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * den >= F.col("n_words") * num)
    return body.withColumn("contaminated", bad).drop("_words", "_m", "found")


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, num: int = 1, den: int = 20, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, hits, item_ids, n_hit, contaminated of every document."""
    m = match(docs, items, n, broadcast_bytes=broadcast_bytes)
    seen = verify(docs.select("doc_id", "text"), m, num, den)
    rest = m.lengths.join(_hint(m.found.select("found_in"), m.small), F.col("doc_id").eqNullSafe(F.col("found_in")), "left_anti")
    none = rest.select(
        "doc_id", "n_words", F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("item_ids"), F.lit(0).cast("long").alias("n_hit"), F.lit(False).alias("contaminated")
    )
    return seen.select(*none.columns).unionByName(none)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 13, num: int = 1, den: int = 20) -> DataFrame:
    """``docs`` without contaminated rows: rows without candidates pass as they are."""
    m = match(docs, items, n)
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")  # names of other columns cannot clash
    clean = verify(packed, m, num, den).filter(~F.col("contaminated")).select("row.*")
    rest = docs.join(_hint(m.found.select(F.col("found_in").alias("_found_in")), m.small), docs["doc_id"].eqNullSafe(F.col("_found_in")), "left_anti").select(*docs.columns)
    return rest.unionByName(clean)


def proximity(docs: DataFrame, phrases: DataFrame, slop: int, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """item_id, doc_id, first, last: places where all terms of a phrase occur in order
    with at most ``slop`` other words between neighbours, one row for each pair
    of first and last word.

    The lists of the terms are intersected from the rarest on: the rarest term
    restricts the documents, then all positions of each term that can be reached
    from those of the one before it are carried along the phrase, for each start.
    """
    store = Scratch(docs.sparkSession, "proximity")
    items = store.write(windows(phrases, 1 << 30), "items")
    small = _small(items, broadcast_bytes)
    terms = store.write(items.select(F.explode("w").alias("term")).distinct(), "terms")
    counts = term_counts(docs.select("doc_id", "text"), terms, small)
    marks = anchors(items, counts, 1).select("item_key", "term")
    index = store.write(postings(docs.select("doc_id", "text"), terms, small), "postings")
    inside = index.join(_hint(marks, small), "term").select("doc_id", "item_key").distinct()
    lists = index.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    needed = items.select("item_key", F.posexplode("w").alias("offset", "term"))
    rows = inside.join(_hint(needed, small), "item_key").join(lists, ["doc_id", "term"], "left")
    rows = rows.groupBy("doc_id", "item_key").agg(F.array_sort(F.collect_list(F.struct("offset", F.coalesce("at", F.array().cast("array<int>")).alias("at")))).alias("l"))
    first = F.transform(F.col("l")[0]["at"], lambda p: F.struct(p.alias("first"), F.array(p).alias("ends")))

    def follow(acc: Column, term: Column) -> Column:
        near = lambda c, q: F.exists(c["ends"], lambda e: (q > e) & (q <= e + 1 + slop))
        reach = F.transform(acc, lambda c: F.struct(c["first"].alias("first"), F.filter(term["at"], lambda q: near(c, q)).alias("ends")))
        return F.filter(reach, lambda c: F.size(c["ends"]) > 0)

    spans = F.aggregate(F.slice("l", F.lit(2), F.size("l")), first, follow)
    out = rows.select("doc_id", "item_key", F.explode(spans).alias("s")).select("doc_id", "item_key", "s.first", F.explode("s.ends").alias("last"))
    return out.join(_hint(items.select("item_key", "item_id"), small), "item_key").select("item_id", "doc_id", "first", "last")

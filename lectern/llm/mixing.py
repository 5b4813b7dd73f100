"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: weights share a token budget; no target may pass ``max_epochs``
   times its source's size, and the excess is shared again by weight.
2. Blocks: each source's documents are laid in shuffled order on a line of
   tokens, which is cut in equal blocks.
3. Schedule: slot i gets the golden-ratio point frac(i * phi), which falls in
   one source's part of the cumulative targets. Slots are ranked per source,
   and rank r takes the source's block r (then round again from the start).
   A source's slots end where its target is met: surplus slots go, and the few
   that the points leave short are put at the end.

All steps are DataFrame functions. Prefix sums go over hash buckets first, then
inside a bucket, so neither a hot source nor a long schedule meets in one task.
Tables that are broadcast have one row per source.

Defined results
- null or empty text: size 0, takes nothing;
- null source: a source of its own, the last in order;
- repeated rows: each is a document; ties in the shuffle go by doc_id, then size;
- slots are whole numbers, each given once; surplus ones are left out;
- an empty table: no rows; a source without words: target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, small_enough

GOLDEN = (math.sqrt(5) - 1) / 2
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null: 0. Splitting is several times faster than a regex count."""
    edge = lambda at: F.substring(text, at, 1).rlike(SPACE).cast("int")
    parts = F.size(F.split(text, SPACE)) - edge(1) - edge(-1)
    return F.when(text.isNull() | (text == ""), 0).otherwise(parts).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size -> ord, source, source_size, target.

    Water-filling in closed form: target = min(cap, weight * level). Sources
    sorted by cap / weight are capped up to the first whose level fits (from there
    on levels only fall, so it is the largest that fits). The
    window has one row per source (all sizes are already summed).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("ord", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    s = s.select("ord", "source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "ord")
    everything = Window.partitionBy()
    s = s.withColumn("before_cap", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest_w", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    s = s.withColumn("level", (F.col("total") - F.col("before_cap")) / F.col("rest_w"))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    s = s.withColumn("final", F.max(F.when(fits, F.col("level"))).over(everything))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("final")))
    return s.select("ord", "source", "source_size", target.alias("target"))


def shuffled(doc_id: Column, size: Column) -> Column:
    """Where a document stands on its source's line, before ties."""
    return F.xxhash64(F.lit("mix"), doc_id, size)


def _lines(docs: DataFrame, per_bucket: int) -> DataFrame:
    """Adds ``start``: where a document begins on its source's shuffled line. Rows that repeat id, source and size
    go as one with their number, so a repeated row does not meet itself in one window."""
    n = docs.count()
    docs = docs.groupBy("doc_id", "source", "ord", "size").agg(F.count(F.lit(1)).alias("m"))
    docs = docs.withColumn("h", shuffled(F.col("doc_id"), F.col("size"))).withColumn("bucket", F.pmod("h", F.lit(n // per_bucket + 1)))
    length = F.col("size") * F.col("m")
    sums = docs.groupBy("ord", "bucket").agg(F.sum(length).alias("s"))
    before = Window.partitionBy("ord").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("ord", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("ord", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    docs = docs.join(sums, ["ord", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return docs.withColumn("start", F.col("base") + F.col("inside") + F.col("copy") * F.col("size")).drop("base", "inside", "bucket", "h", "m")


def schedule(targets: DataFrame, block: int, slots: int, chunk: int = 4096) -> DataFrame:
    """ord, rank, slot for ``slots`` golden-ratio points, then each source's own limit.

    A rank is a count of earlier slots of the same source: by chunks of slots,
    then inside the chunk.
    """
    spark = targets.sparkSession
    acc = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    parts = targets.withColumn("hi", F.sum("target").over(acc) / F.greatest(F.sum("target").over(whole), F.lit(1e-300)))
    cuts = parts.filter("target > 0").agg(F.array_sort(F.collect_list(F.struct("hi", "ord"))).alias("cuts"))
    points = spark.range(0, slots).select(F.col("id").alias("slot"), F.expr(f"id * {GOLDEN!r}D - floor(id * {GOLDEN!r}D)").alias("u"))
    owner = F.coalesce(F.get(F.filter("cuts", lambda c: c["hi"] > F.col("u")), 0)["ord"], F.try_element_at("cuts", F.lit(-1))["ord"])
    points = points.withColumn("cuts", cuts.scalar())  # an entry per source
    got = points.select("slot", owner.alias("ord"), F.expr(f"slot div {chunk}").alias("c"))
    counts = got.groupBy("ord", "c").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("ord").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("ord", "c", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.col("n")).alias("upto"))
    inside = F.row_number().over(Window.partitionBy("ord", "c").orderBy("slot"))
    ranked = got.withColumn("inside", inside).join(counts, ["ord", "c"]).select("ord", (F.col("base") + F.col("inside") - 1).alias("rank"), "slot")
    need = targets.select("ord", _ranks_needed(F.floor("target"), F.col("source_size"), block).alias("need"))
    have = counts.groupBy("ord").agg(F.max("upto").alias("have"))
    # one row per source: its missing slots follow those of the sources before it
    short = need.join(have, "ord", "left").withColumn("have", F.coalesce("have", F.lit(0))).withColumn("missing", F.greatest(F.col("need") - F.col("have"), F.lit(0)))
    behind = F.coalesce(F.sum("missing").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = (
        short.withColumn("behind", behind)
        .filter("missing > 0")
        .select("ord", "have", "behind", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
        .select("ord", "rank", (F.lit(slots) + F.col("behind") + F.col("rank") - F.col("have")).alias("slot"))
    )
    return ranked.join(need, "ord").filter("rank < need").select("ord", "rank", "slot").unionByName(short)


def _ranks_needed(target: Column, size: Column, block: int) -> Column:
    """Blocks until ``target`` tokens are taken, the last of an epoch being shorter."""
    per_epoch = F.ceil(size / F.lit(block))
    epochs = F.floor(target / F.greatest(size, F.lit(1)))
    rest = target - epochs * size
    return F.when((size <= 0) | (target <= 0), F.lit(0)).otherwise(epochs * per_epoch + F.ceil(rest / F.lit(block))).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, slots: int = 1 << 16, largest_block: int = 1 << 20, per_bucket: int = 4096) -> dict[str, DataFrame]:
    """doc_id, source, text -> the parts of a mix.

    ``documents``: doc_id, source, size, source_size, target, taken, copies of
    every document. ``schedule``: slot, source, block, epoch, tokens, in slot order the mix
    itself. About ``slots`` slots, more once a block would pass ``largest_block`` tokens.
    """
    store = Scratch(docs.sparkSession, "mixing")
    sized = store.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")  # texts are split once
    targets = store.write(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs), "targets")
    few = small_enough(targets, width=256)  # sources may be hosts or addresses: then they are shuffled
    beside = F.broadcast if few else (lambda df: df)
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    wanted = int(total * budget)
    block = max(1, min(largest_block, -(-wanted // slots)))
    plan = schedule(targets, block, -(-wanted // block))
    per_epoch = F.ceil(F.col("source_size") / F.lit(block))
    plan = (
        plan.join(beside(targets), "ord")  # one row per source
        .withColumn("epoch", F.floor(F.col("rank") / per_epoch))
        .withColumn("block", F.col("rank") - F.col("epoch") * per_epoch)
        .withColumn("before", F.col("epoch") * F.col("source_size") + F.col("block") * block)
        .withColumn("tokens", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.floor("target") - F.col("before")))
    )
    plan = store.write(plan, "schedule")
    taken = plan.groupBy("ord", "block").agg(F.collect_list("tokens").alias("lengths"))  # an entry per epoch
    owners = targets.select(F.col("ord"), F.col("source").alias("of"))
    placed = _lines(sized.join(beside(owners), F.col("source").eqNullSafe(F.col("of"))).drop("of"), per_bucket)
    pieces = placed.filter("size > 0").select(
        "doc_id", "ord", "size", "start", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block")
    )
    lo, hi = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    overlap = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + F.greatest(F.least(hi, n) - lo, F.lit(0)).cast("long"))
    got = pieces.join(taken, ["ord", "block"], "left").select("doc_id", "ord", "size", "start", F.coalesce(overlap, F.lit(0)).alias("taken"))
    got = got.groupBy("doc_id", "ord", "size", "start").agg(F.sum("taken").alias("taken"))
    empty = placed.filter("size = 0").select("doc_id", "ord", "size", "start", F.lit(0).cast("long").alias("taken"))
    out = got.unionByName(empty).join(beside(targets), "ord")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    return {
        "documents": out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", copies.alias("copies")),
        "schedule": plan.select("slot", "source", "block", "epoch", "tokens"),
        "targets": targets,
    }

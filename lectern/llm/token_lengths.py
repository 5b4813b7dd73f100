"""Token counts: an exact histogram of encoded lengths, and its suffix sums.

Documents are encoded by the tokenizers library in Arrow batches; only
(length, number of documents) leaves a batch. Suffix sums over the distinct
lengths then answer, for every context limit at once, how many documents and
tokens are at least that long, what is left if documents are cut there, and
quantiles. Sums go over blocks of lengths first, then inside a block.

Defined results: null and empty texts have length 0; repeated rows count one by
one; an empty table gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import frugal, slices, Encoder
from ._store import Scratch

BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """length, n_docs: one row per distinct encoded length. It is written, so that texts are encoded once however often it is read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                _, n = encoder.encode(batch.column(0).slice(a, b - a), count_only=True)
                length, docs = np.unique(n, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(docs, pa.int64())], ["length", "n_docs"])

    parts = docs.select(text).mapInArrow(frugal(count), "length long, n_docs long")
    return Scratch(docs.sparkSession, "lengths").write(parts.groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds n_tokens, docs_ge, tokens_ge (documents of this length or more) and
    truncated_tokens (all tokens if every document is cut at this length)."""
    h = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.expr(f"length div {BLOCK}"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per BLOCK lengths
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("t").over(whole).alias("t_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("t_in", F.sum("n_tokens").over(inside)).join(blocks, "block")
    docs_ge, tokens_ge = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return h.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("t_all") - tokens_ge + F.col("length") * docs_ge).alias("truncated_tokens"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, tokens_over (documents longer than the limit), truncated_tokens, for any limits."""
    total = sums.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"))
    per = [
        F.struct(
            F.lit(int(x)).cast("long").alias("limit"),
            F.coalesce(F.max(F.when(F.col("length") > x, F.col("docs_ge"))), F.lit(0)).alias("docs_over"),
            F.coalesce(F.max(F.when(F.col("length") > x, F.col("tokens_ge"))), F.lit(0)).alias("tokens_over"),
        )
        for x in limits
    ]
    rows = sums.agg(F.array(*per).alias("r")).select(F.explode("r").alias("r")).select("r.*").withColumn("all", total.scalar())
    return rows.select("limit", "docs_over", "tokens_over", (F.col("all") - F.col("tokens_over") + F.col("limit") * F.col("docs_over")).alias("truncated_tokens"))


def quantile(sums: DataFrame, q: float) -> Column | int | None:
    """The smallest length that at least q of the documents do not pass; None without documents."""
    total = sums.agg(F.max("docs_ge").alias("n")).first()["n"]
    if not total:
        return None
    covered = (F.lit(total) - F.col("docs_ge") + F.col("n_docs")) >= F.lit(q * total)
    return sums.filter(covered).agg(F.min("length").alias("x")).first()["x"]

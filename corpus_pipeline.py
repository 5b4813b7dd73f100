"""The corpus pipeline: five operators of lectern.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, language_id, mixing, ngram_join, token_shards
from lectern.llm._store import Scratch, small_enough

#: A text is rejected if its best language is hardly ahead of the others.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a determined language; a missing lang is filled in."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")  # names of other columns cannot clash
    out = language_id.predict(packed, language_id.train(docs.filter(fold != 2)))
    out = out.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return out.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar documents: the one with the smallest doc_id.

    A doc_id that stands on one row decides by itself. Rows whose doc_id repeats
    or is missing are told apart by their text: of such rows one stays in a group
    that has no smaller doc_id. Rows without words stay.
    """
    store = Scratch(spark, "near-duplicates")
    joined = store.write(ngram_join.join(docs).select("doc_id", "n_shingles", "component_id", "class_id", "group_id"), "joined")
    once = joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("c"))
    ids = store.write(once.filter("doc_id IS NULL OR n > 1 OR c != doc_id").select("doc_id", (F.col("doc_id").isNull() | (F.col("n") > 1)).alias("odd")), "ids")
    beside = F.broadcast(ids) if small_enough(ids) else ids
    kept = docs.join(beside, docs["doc_id"].eqNullSafe(beside["doc_id"]), "left_anti").select(*docs.columns)
    odd = ids.filter("odd").select(F.col("doc_id").alias("_odd"))
    if odd.isEmpty():
        return kept
    told = joined.join(odd, joined["doc_id"].eqNullSafe(odd["_odd"])).select("doc_id", "class_id", "component_id", "group_id").distinct()
    told = store.write(told.select(F.col("doc_id").alias("_id"), F.col("class_id").alias("_class"), "component_id", "group_id"), "told")
    rows = ngram_join.class_of(docs.join(F.broadcast(odd) if small_enough(odd) else odd, docs["doc_id"].eqNullSafe(F.col("_odd")), "left_semi").select(*docs.columns))
    rows = rows.join(told, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("class_id") == F.col("_class")))
    first = rows.filter(F.col("group_id").isNotNull() & F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("group_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.unionByName(first.select("row.*").select(*docs.columns)).unionByName(rows.filter("group_id IS NULL").select("row.*").select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents: as many copies as the mix takes of their words, rounded.

    Rows that repeat a doc_id in a source each get the largest number that one of them has, 2 at most.
    """
    mixed = mixing.mix(docs)["documents"].groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"))
    taken = mixed.agg(F.max("copies").alias("_mix_copies")).filter("_mix_copies > 0")
    out = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("_mix_id")) & docs["source"].eqNullSafe(F.col("_mix_source")))
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_shards.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_shards.read_tokens(files)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_shards", token_stage),
]

#: Languages, similarity classes and token ids cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = store.write(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs

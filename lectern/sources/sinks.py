"""Where rows go: the translation cache and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cache_log import CacheLog


def upsert(cache: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """The cache after the rows of ``new`` replaced those with equal keys; of equal new keys the last by ``order`` wins."""
    columns = cache.columns
    old = cache.withColumn("_age", F.lit(-1).cast("long")).select(*columns, "_age")
    all_rows = old.unionByName(new.withColumn("_age", F.col(order).cast("long")).select(*columns, "_age"))
    last = all_rows.groupBy("cache_key").agg(F.max_by(F.struct(*columns), F.struct("_age", *[F.col(c) for c in columns])).alias("r"))
    return last.select("r.*")


def write_cache(spark: SparkSession, cache: DataFrame, root: str) -> str:
    """Puts ``cache`` in place of all that the log under ``root`` holds, and returns where its rows are; earlier generations stay readable."""
    log = CacheLog(spark, root)
    entry = log.append(cache, base=True, replaces=tuple(e.number for e in log.live()))
    if entry is None:
        raise RuntimeError(f"the cache under {root} was compacted by another writer meanwhile")
    return f"{log.root}/data/{entry.name}/rows"


def latest_cache(spark: SparkSession, root: str) -> DataFrame | None:
    """The cache under ``root`` as its log has it, or None if there is none."""
    log = CacheLog(spark, root)
    return log.read() if log.live() else None


def newest_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_reports(reports: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON text per report row, in UTF-8; on one line unless ``pretty``."""
    options = {"pretty": "true"} if pretty else {}
    reports.select(F.to_json(F.struct("*"), options).alias("value")).write.mode("overwrite").text(path)

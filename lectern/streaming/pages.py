"""Pages that arrive as a stream: quality and routing as they come, and a cache that is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import quality
from ..schemas import CACHE
from ..sources import sinks
from ..sources.cache_log import CacheLog
from ..sources.tables import synthetic_lines


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def route_stream(documents: DataFrame, path: str, checkpoint: str, mode: str = "auto") -> StreamingQuery:
    """Routes the pages of each micro-batch and adds them to a table; a document's pages arrive in one batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        routed = quality.route(quality.page_quality(synthetic_lines(batch)), mode)
        routed.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # a repeated epoch overwrites itself

    return documents.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def events_per_window(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """ts, event_type, value -> counts and sums by event-time window, with a bound on late rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def upsert_stream(rows: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch adds its rows to the cache's log under ``root`` as a generation; a repeated epoch of the same checkpoint is taken in once."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(*CACHE.names, F.lit(epoch).cast("long").alias("ord"))
        CacheLog(batch.sparkSession, root).append(sinks.upsert(rows.drop("ord").limit(0), rows), stream=checkpoint, epoch=epoch)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def compact(spark: SparkSession, root: str, cache: DataFrame | None = None) -> DataFrame:
    """Takes all generations under ``root`` together, and returns the cache that is there then.

    ``cache`` stands in for what was compacted before, where the caller has changed
    it: generations that came since count over it, those taken in before do not.
    """
    log = CacheLog(spark, root)
    log.compact(cache)
    return log.read()

"""What a vision model has said of images, kept by the content they have: a folder of numbered additions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READING = "digest string, reply string, mode string, calls int, error string, sent_w int, sent_h int, scale double, image_w int, image_h int"


class ReadingLog:
    """Additions are written whole or not at all (Spark's commit of a folder). Of equal digests one that was read goes before an error, then the later one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _written(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [str(p) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def read(self) -> DataFrame:
        parts = self._written()
        if not parts:
            return self.spark.createDataFrame([], READING)
        rows = self.spark.read.schema(READING).parquet(*parts).withColumn("_at", F.regexp_extract(F.col("_metadata.file_path"), r"/r(\d+)-", 1).cast("long"))
        best = rows.groupBy("digest").agg(F.max_by(F.struct("*"), F.struct(F.col("error").isNull(), "_at")).alias("r"))
        return best.select("r.*").drop("_at")

    def append(self, rows: DataFrame) -> None:
        now = self.spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("t")).first()["t"]
        rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/r{now}-{uuid.uuid4().hex[:8]}")

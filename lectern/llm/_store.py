"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session that is one process, as in tests, may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}"
    return f"{found.rstrip('/')}/lectern-llm-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. For the caller, once its results are written: results are read from these tables."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes too, unless the session already does: texts differ in length by orders."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(8 << 20))


class Scratch:
    """Parquet tables of one run under the shared folder.

    Writing a table cuts lineage: a lost executor costs a re-read, not a
    recomputation. ``drop`` frees a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, large_values: bool = False) -> DataFrame:
        """``large_values``: compressed already, and of a megabyte or so. Codecs and ranged reads would hold whole pages of them in buffers beside the heap."""
        writer, reader = df.write.mode("overwrite"), self.spark.read
        if large_values:
            writer, reader = writer.option("compression", "none"), reader.option("parquet.hadoop.vectored.io.enabled", "false")
        writer.parquet(self.path(table))
        return reader.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Values of a hash that a share is taken of: so many that no language is too large for one.
HASHES = 1 << 62


def hash_share(n: int, wanted: int) -> int:
    """How many of ``HASHES`` values let about ``wanted`` of ``n`` rows through, and never none."""
    return HASHES if n <= wanted else max(1, HASHES * wanted // n)


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``key``.

    A share by hash goes first, so that tasks do not each send ``n`` rows to
    be merged; ties go by the hash of all columns.
    """
    total, whole = df.count(), 1 << 30
    share = min(whole, int(1.5 * n / max(total, 1) * whole) + 1)
    h = F.xxhash64(F.lit("sample"), key)
    return df.filter(F.pmod(h, F.lit(whole)) < share).orderBy(F.pmod(h, F.lit(whole)), F.xxhash64(*df.columns)).limit(n)


def small_enough(ids: DataFrame, limit: int = 8 << 20, width: int = 16) -> bool:
    """Whether a written table of ids may be broadcast: its rows are counted against ``limit`` bytes."""
    return ids.count() * width <= limit

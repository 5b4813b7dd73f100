"""Payloads of model services, kept for a while: what a service says of its models is asked for once in ``life`` seconds by all jobs together."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: seconds for which a catalog counts as fresh.
LIFE = 600


def catalog_payloads(spark: SparkSession, root: str, services: list[str], fetch: Callable[[str], str], life: float = LIFE, now: Callable[[], float] = time.time) -> DataFrame:
    """service, value (JSON) of each service, for ``read_catalog``: from ``root`` where it is younger than ``life``, else fetched and kept there.

    Fetching happens here, on the driver: services are few. A service that fails
    keeps its last payload; without one it gives no row.
    """
    path, at = root.rstrip("/"), now()
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "service string, value string, at double"
    held = spark.read.schema(schema).json(f"{path}/*") if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else spark.createDataFrame([], schema)
    latest = held.groupBy("service").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value")).filter(F.col("service").isin(services))
    fresh = {r["service"] for r in latest.filter(F.col("at") > at - life).select("service").collect()}
    got = []
    for s in services:
        if s not in fresh:
            try:
                got.append((s, fetch(s), at))
            except OSError:
                continue
    if got:
        spark.createDataFrame(got, schema).coalesce(1).write.json(f"{path}/{uuid.uuid4().hex}")
        latest = latest.unionByName(spark.createDataFrame(got, schema)).groupBy("service").agg(F.max_by("value", "at").alias("value"))
    return latest.select("service", "value")

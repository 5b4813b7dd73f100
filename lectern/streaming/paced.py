"""Translating units that arrive as a stream, at a pace that the service sets.

All partitions share one budget of requests for a round. A service that answers
"too many" halves it for the next round and makes it wait; calm rounds raise it
step by step. Pace, backlog and answers are kept under one folder by round, so a
stream that starts again goes on where it was, and a round that is repeated asks
nobody twice: its answers are written before anything else depends on them.

    units/round=n      what arrived, once for each text
    answers/round=n    key, translation, error, status of what was asked
    pace/n.json        the budget after round n
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import translate
from ..operators.translate import BATCH, FAILURES, LONGEST_WAIT, RETRY_STATES, Backend, ServiceError
from ..sources import sinks
from ..sources.cache_log import CacheLog

UNIT = "cache_key string, kind string, text string"
ANSWER = "cache_key string, translation string, error string, status int"
#: Status of a unit that was not asked for, because the service had said "too many" to its partition; and of an answer.
NOT_ASKED, ANSWERED = 0, 200


@dataclass(frozen=True)
class Pace:
    """``budget``: requests of a round; ``wait``: seconds before the next one; ``busy``: rounds in a row that were refused."""

    budget: int
    wait: float = 0.0
    busy: int = 0

    def after(self, refused: int, step: int, most: int) -> Pace:
        if refused:
            return Pace(max(1, self.budget // 2), float(min(LONGEST_WAIT, 2**self.busy)), self.busy + 1)
        return Pace(min(most, self.budget + step))


class PacedTranslation:
    """A backend behind a budget of ``start`` to ``most`` requests a round, made by ``lanes`` partitions at once."""

    def __init__(self, spark: SparkSession, root: str, backend: Backend, cache: CacheLog, languages: tuple[str, str, str], start: int = 16, most: int = 1024, step: int = 4, lanes: int = 4, attempts: int = 6, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.root, self.backend, self.cache, self.languages = spark, root.rstrip("/"), backend, cache, languages
        self.start, self.most, self.step, self.lanes, self.attempts, self.sleep = start, most, step, lanes, attempts, sleep
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _rounds(self, kind: str) -> list[int]:
        """The rounds of which a table is there as a whole."""
        if not self._fs.exists(self._path(kind)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(kind))]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n and self._fs.exists(self._path(f"{kind}/{n}/_SUCCESS")))

    def _read(self, kind: str, schema: str, before: int) -> DataFrame:
        there = [n for n in self._rounds(kind) if n < before]
        if not there:
            return self.spark.createDataFrame([], schema).withColumn("round", F.lit(0).cast("long"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/round={n}" for n in there])
        return rows.withColumn("round", F.regexp_extract(F.col("_metadata.file_path"), r"/round=(\d+)/", 1).cast("long"))

    def pace(self, before: int) -> Pace:
        """The budget that the last round before ``before`` left."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("pace"))] if self._fs.exists(self._path("pace")) else []
        found = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit() and int(n[:-5]) < before)
        if not found:
            return Pace(self.start)
        stream = self._fs.open(self._path(f"pace/{found[-1]}.json"))
        try:
            return Pace(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _keep_pace(self, n: int, pace: Pace) -> None:
        out = self._fs.create(self._path(f"pace/{n}.json"), True)  # the same round has the same pace
        out.write(json.dumps(asdict(pace)).encode())
        out.close()

    def backlog(self, before: int) -> DataFrame:
        """Units that arrived and have no answer yet, each once: cache_key, kind, text, first (the round it came in), tries."""
        units = self._read("units", UNIT, before + 1).groupBy("cache_key").agg(F.min_by(F.struct("kind", "text"), "round").alias("u"), F.min("round").alias("first")).select("cache_key", "u.*", "first")
        answers = self._read("answers", ANSWER, before)
        over = (F.col("status") == ANSWERED) | (~F.col("status").isin(NOT_ASKED, *RETRY_STATES))
        told = answers.groupBy("cache_key").agg(F.bool_or(over).alias("over"), F.count_if(F.col("status").isin(*RETRY_STATES) & (F.col("status") != 429)).alias("tries"))
        left = units.join(told, "cache_key", "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
        return left.filter(~F.coalesce("over", F.lit(False)) & (F.col("tries") < self.attempts)).drop("over")

    def _ask(self, due: DataFrame) -> DataFrame:
        """The answers to ``due`` (lane, request, cache_key, kind, text). A lane that is refused asks for nothing more in this round."""
        backend = self.backend

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, at, refused = [], None, set()

            def answer() -> pd.DataFrame:
                lane = at[0]
                keys = [k for k, _, _ in asked]
                if lane in refused:
                    return pd.DataFrame({"cache_key": keys, "translation": None, "error": None, "status": NOT_ASKED})
                got, error, status = {}, None, ANSWERED
                try:
                    got = translate.read_reply(backend.translate([{"id": k, "kind": kind, "text": t} for k, kind, t in asked]))
                except ServiceError as e:
                    error, status = f"{type(e).__name__}: {e}", e.status
                    if status == 429:
                        refused.add(lane)
                except FAILURES as e:
                    error, status = f"{type(e).__name__}: {e}", 1
                # what a reply leaves out is asked for again, as after a fault of the service
                states = [(ANSWERED if got.get(k) else 500) if status == ANSWERED else status for k in keys]
                return pd.DataFrame({"cache_key": keys, "translation": [got.get(k) for k in keys], "error": error, "status": states})

            for f in frames:
                for lane, request, *row in f.itertuples(index=False):
                    if asked and (lane, request) != at:
                        yield answer()
                        asked = []
                    at = (lane, request)
                    asked.append(tuple(row))
            if asked:
                yield answer()

        dealt = due.repartitionByRange(self.lanes, "lane").sortWithinPartitions("lane", "request")
        return dealt.select("lane", "request", "cache_key", "kind", "text").mapInPandas(run, ANSWER)

    def round(self, n: int, arrived: DataFrame | None = None) -> Pace:
        """One round: what arrived joins the backlog, and as much of it is asked for as the budget allows, the oldest first."""
        if arrived is not None and n not in self._rounds("units"):
            keyed = translate.with_keys(arrived, *self.languages)
            new = translate.lookup(keyed, self.cache.lookup(keyed)).filter("cached IS NULL")
            new = new.groupBy("cache_key").agg(F.min_by(F.struct("kind", "text"), F.struct("doc_id", "page", "unit_ord")).alias("u"))
            new.select("cache_key", "u.*").write.mode("overwrite").parquet(f"{self.root}/units/round={n}")
        pace = self.pace(n)
        if n not in self._rounds("answers"):
            self.sleep(pace.wait)
            # budget * BATCH rows at most
            due = self.backlog(n).orderBy("tries", "first", "cache_key").limit(pace.budget * BATCH)
            due = due.withColumn("k", F.monotonically_increasing_id())  # of one partition after the limit
            due = due.withColumn("request", F.expr(f"k DIV {BATCH}")).withColumn("lane", F.pmod("request", F.lit(self.lanes)))
            self._ask(due).write.mode("overwrite").parquet(f"{self.root}/answers/round={n}")
        answers = self.spark.read.schema(ANSWER).parquet(f"{self.root}/answers/round={n}")
        good = answers.filter(F.col("status") == ANSWERED).join(self._read("units", UNIT, n + 1).dropDuplicates(["cache_key"]), "cache_key")
        source, target, model = self.languages
        rows = good.select("cache_key", F.col("text").alias("source_text"), F.lit(source).alias("source_language"), F.lit(target).alias("target_language"), F.lit(model).alias("model"), "translation", F.lit(0).alias("ord"))
        if not rows.isEmpty():
            self.cache.append(sinks.upsert(rows.drop("ord").limit(0), rows), stream=self.root, epoch=n)
        after = pace.after(answers.filter("status = 429").count(), self.step, self.most)
        self._keep_pace(n, after)
        return after

    def stream(self, units: DataFrame, checkpoint: str) -> StreamingQuery:
        """A round for each micro-batch of units (doc_id, page, unit_ord, kind, text). Call ``drain`` for what is left at its end."""
        query = units.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return query.foreachBatch(lambda batch, epoch: self.round(epoch, batch) and None).start()

    def drain(self, rounds: int = 1000) -> int:
        """Rounds without arrivals until the backlog is empty; how many were needed. They are numbered far behind those of a stream."""
        begin = max([10**9, *[n + 1 for n in self._rounds("answers")]])
        for k in range(rounds):
            if self.backlog(begin + k).isEmpty():
                return k
            self.round(begin + k)
        raise RuntimeError(f"units are left after {rounds} rounds")

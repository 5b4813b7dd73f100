"""The translation cache as a log of generations.

A generation is a set of rows written once: ``data/<name>/rows`` (files by key
prefix, sorted by key) and ``data/<name>/index`` (the key range of each file, and
a Bloom filter of its keys in pieces of 32,768 bits). It counts once its entry
``log/<number>.json`` is there. An entry is created only if no other has its
number, so of two writers one takes the next number; what was written without an
entry is never read.

Of equal keys the row of the latest generation holds. A compaction writes the
merged rows as one generation that replaces those it was made of, and stands
where the latest of them stood: what others add meanwhile stays later. A
micro-batch of a stream writes its number in its entry and is taken in once,
however often it is repeated.

A lookup joins the keys' prefixes with the index, tests the filters, and reads
only files that may hold a key. Rows, index and lookups are Spark tables; the
driver holds the entries, one for each generation since the last compaction and
the number it replaced.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CACHE

#: Bits of a piece of a filter, bits for each key, and hashes of a key.
PIECE, PER_KEY, HASHES = 32_768, 10, 3
#: Rows that a file of a generation holds, about.
FILE_ROWS = 1_000_000
ENTRY = re.compile(r"(\d{20})\.json$")


@dataclass(frozen=True)
class Entry:
    """``order``: the place among generations where equal keys are decided; ``digits``: hex digits of a key that name its file."""

    number: int
    name: str
    order: int
    digits: int
    base: bool = False
    replaces: tuple[int, ...] = ()
    stream: str | None = None
    epoch: int | None = None


def _bits(pieces: Column) -> Column:
    """The places of a key in its file's filter, counted from 1."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), "cache_key"), pieces * PIECE) + 1 for i in range(HASHES)])


def _is_set(bitmap: Column, place: Column) -> Column:
    at = F.call_function("bitmap_bit_position", place)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1


class CacheLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def entries(self) -> list[Entry]:
        """All entries, by number. One that was cut off while it was written does not count, but keeps its number."""
        if not self._fs.exists(self._path("log")):
            return []
        names = sorted(m[1] for s in self._fs.listStatus(self._path("log")) if (m := ENTRY.search(s.getPath().getName())))
        return [e for e in (self._entry(int(n)) for n in names) if e is not None]

    def _entry(self, number: int) -> Entry | None:
        stream = self._fs.open(self._path(f"log/{number:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except json.JSONDecodeError:
            return None
        return Entry(**found | {"replaces": tuple(found["replaces"])})

    def live(self, until: int | None = None) -> list[Entry]:
        """The generations that count, also as of an earlier number."""
        found = [e for e in self.entries() if until is None or e.number <= until]
        gone = {n for e in found for n in e.replaces}
        return sorted((e for e in found if e.number not in gone), key=lambda e: (e.order, e.number))

    def _create(self, number: int, text: str) -> bool:
        """Whether the entry could be made: False if its number is taken."""
        try:
            out = self._fs.create(self._path(f"log/{number:020d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or self._fs.exists(self._path(f"log/{number:020d}.json")):
                return False
            raise
        try:
            out.write(text.encode())
        finally:
            out.close()
        return True

    def _commit(self, name: str, digits: int, order: int | None, base: bool, replaces: tuple[int, ...], stream: str | None, epoch: int | None) -> Entry | None:
        """The new entry; None if the micro-batch or a generation to be replaced was taken in by someone else."""
        while True:
            found = self.entries()
            if stream is not None and any(e.stream == stream and e.epoch == epoch for e in found):
                return None
            if set(replaces) & {n for e in found for n in e.replaces}:
                return None
            taken = [int(m[1]) for s in self._fs.listStatus(self._path("log")) if (m := ENTRY.search(s.getPath().getName()))] if self._fs.exists(self._path("log")) else []
            number = max(taken, default=0) + 1
            entry = Entry(number, name, number if order is None else order, digits, base, replaces, stream, epoch)
            if self._create(number, json.dumps(entry.__dict__)):
                return entry

    def append(self, rows: DataFrame, stream: str | None = None, epoch: int | None = None, base: bool = False, replaces: tuple[int, ...] = (), order: int | None = None) -> Entry | None:
        """Adds ``rows`` (one for each key) as a generation. With ``stream`` and ``epoch``, only if that micro-batch is not there yet."""
        if stream is not None and any(e.stream == stream and e.epoch == epoch for e in self.entries()):
            return None
        name, n = uuid.uuid4().hex, rows.count()
        digits = 0
        while n > FILE_ROWS * 16**digits and digits < 4:
            digits += 1
        place = F.concat(F.lit("x"), F.substring("cache_key", 1, digits)) if digits else F.lit("x")
        path = f"{self.root}/data/{name}/rows"
        placed = rows.select(*CACHE.names, place.alias("p"))
        placed.repartition(max(1, min(16**digits, 4096)), "p").sortWithinPartitions("p", "cache_key").write.partitionBy("p").parquet(path)
        self._write_index(path, f"{self.root}/data/{name}/index")
        entry = self._commit(name, digits, order, base, replaces, stream, epoch)
        if entry is None:
            self._fs.delete(self._path(f"data/{name}"), True)
        return entry

    def _write_index(self, rows: str, index: str) -> None:
        read = self.spark.read.schema(CACHE).parquet(rows) if self._holds_files(rows) else None
        if read is None:
            return
        keys = read.select("cache_key", F.col("_metadata.file_path").alias("file"))
        files = keys.groupBy("file").agg(F.min("cache_key").alias("low"), F.max("cache_key").alias("high"), F.ceil(F.count(F.lit(1)) * PER_KEY / PIECE).alias("pieces"))
        marks = keys.join(files.select("file", "pieces"), "file").select("file", F.explode(_bits(F.col("pieces"))).alias("b"))
        marks = marks.groupBy("file", F.call_function("bitmap_bucket_number", F.col("b")).alias("piece")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("b"))).alias("bits"))
        marks.join(files, "file").withColumn("p", F.regexp_extract("file", "/p=(x[0-9a-f]*)/", 1)).write.parquet(index)

    def _holds_files(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return self._fs.exists(at) and any(s.isDirectory() for s in self._fs.listStatus(at))

    def _rows(self, entry: Entry, files: list[str] | None = None) -> DataFrame | None:
        path = f"{self.root}/data/{entry.name}/rows"
        if not self._holds_files(path) or files == []:
            return None
        read = self.spark.read.schema(CACHE).parquet(*([path] if files is None else files))
        return read.select(*CACHE.names, F.lit(entry.order).cast("long").alias("_order"))

    def _latest(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], CACHE)
        rows = reduce(DataFrame.unionAll, parts)
        if len(parts) == 1:
            return rows.select(*CACHE.names)
        return rows.groupBy("cache_key").agg(F.max_by(F.struct(*CACHE.names), F.struct("_order", *CACHE.names)).alias("r")).select("r.*")

    def read(self, until: int | None = None) -> DataFrame:
        """The cache, as it is or as it was after generation ``until``."""
        return self._latest([r for e in self.live(until) if (r := self._rows(e)) is not None])

    def candidate_files(self, keys: DataFrame) -> dict[str, list[str]]:
        """name of each live generation -> its files that may hold one of the ``keys``. Files are counted by generation, so their list is as long as the index says."""
        out = {}
        keys = keys.select("cache_key").distinct()
        for e in self.live():
            if not self._holds_files(f"{self.root}/data/{e.name}/rows"):
                continue
            index = self.spark.read.parquet(f"{self.root}/data/{e.name}/index")
            place = F.concat(F.lit("x"), F.substring("cache_key", 1, e.digits)) if e.digits else F.lit("x")
            ranges = index.select("p", "file", "low", "high", "pieces").distinct()
            near = keys.withColumn("p", place).join(ranges, "p").filter("cache_key BETWEEN low AND high")
            probes = near.select("file", "cache_key", F.explode(_bits(F.col("pieces"))).alias("b")).withColumn("piece", F.call_function("bitmap_bucket_number", F.col("b")))
            hits = probes.join(index.select("file", "piece", "bits"), ["file", "piece"]).filter(_is_set(F.col("bits"), F.col("b")))
            found = hits.groupBy("file", "cache_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == HASHES).select("file").distinct()
            out[e.name] = [r["file"] for r in found.toLocalIterator()]
        return out

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The cache's rows of the ``keys`` (a column cache_key), from the files that may hold them."""
        files = self.candidate_files(keys)
        parts = [r for e in self.live() if e.name in files and (r := self._rows(e, files[e.name])) is not None]
        wanted = keys.select("cache_key").distinct()
        return self._latest([p.join(wanted, "cache_key", "left_semi").select(*CACHE.names, "_order") for p in parts])

    def compact(self, base: DataFrame | None = None) -> Entry | None:
        """One generation in place of all that are there. ``base``: rows that stand in for the compacted part, where the caller has changed it."""
        live = self.live()
        if not live and base is None:
            return None
        parts = [r for e in live if not (e.base and base is not None) and (r := self._rows(e)) is not None]
        if base is not None:
            parts = [base.select(*CACHE.names).withColumn("_order", F.lit(-1).cast("long")), *parts]
        return self.append(self._latest(parts), base=True, replaces=tuple(e.number for e in live), order=max((e.order for e in live), default=None) if live else None)

    def vacuum(self, keep: int = 8) -> int:
        """Deletes the rows of generations that were replaced before the last ``keep`` entries, and of those never committed; how many. Not beside a running writer."""
        found = self.entries()
        gone = {n for e in found[: max(0, len(found) - keep)] for n in e.replaces}
        kept = {e.name for e in found if e.number not in gone}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("data"))] if self._fs.exists(self._path("data")) else []
        dropped = [n for n in names if n not in kept]
        for n in dropped:
            self._fs.delete(self._path(f"data/{n}"), True)
        return len(dropped)

"""Token-ID output: documents compressed one by one with a shared dictionary.

A shard is one binary value: magic, dictionary hash, number of documents, then
a presence byte, doc_id and token count of each, offsets, and the frames. A
document's ids are unsigned 16- or 32-bit little-endian numbers, compressed by
zstandard with a dictionary trained on such arrays, so one short document is
read without its neighbours. Shards are rows of a Parquet table, which any
store that Spark writes to can hold, and which the commit protocol protects
when executors are lost.

Documents stand in ascending doc_id order: a range shuffle of the texts, a sort
inside partitions, and shards of bounded size, built while rows stream by. A
hash of the text and the partition a row comes from stand behind doc_id in the
range, so that a repeated or missing doc_id is spread over tasks too.

Defined results: null and empty texts have the end id alone; repeated doc_ids
stand side by side, ordered by a hash of the text, then by text; null doc_ids
come first; an empty table gives no shards. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import frugal, slices, Encoder
from ._store import Scratch, hash_sample, small_enough

MAGIC = b"LTOK"
HEAD = struct.Struct("<4sB8sQ")  # magic, bytes per id, dictionary hash, documents


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary of about ``size`` bytes; the raw samples where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


def _load(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    trained = dictionary[:4] == struct.pack("<I", 0xEC30A437)  # the format's magic number
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def pack(doc_ids: list[int | None], counts: list[int], frames: list[bytes], width: int, dict_hash: bytes) -> bytes:
    n = len(doc_ids)
    present = bytes(x is not None for x in doc_ids)
    ids = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes()
    return b"".join([HEAD.pack(MAGIC, width, dict_hash, n), present, ids, np.array(counts, "<u8").tobytes(), offsets, *frames])


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, found, n = HEAD.unpack_from(data)
        if magic != MAGIC or found != dictionary_hash(dictionary):
            raise ValueError("not a shard of this dictionary")
        at = HEAD.size
        present, at = data[at : at + n], at + n
        ids = np.frombuffer(data, "<i8", n, at)
        self.doc_ids = [int(x) if p else None for x, p in zip(ids, present)]
        self.counts = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 16 * n).astype(np.int64)
        self.frames, self.data = at + 16 * n + 8 * (n + 1), data
        self.reader = zstandard.ZstdDecompressor(dict_data=_load(dictionary))

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, as unsigned 32-bit numbers."""
        a, b = self.frames + self.offsets[i], self.frames + self.offsets[i + 1]
        raw = self.reader.decompress(self.data[a:b], max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


@dataclass
class TokenFiles:
    """``shards``: part, seq, base (tokens before it in its part), n_docs, n_tokens, shard. ``parts`` has one row per part."""

    shards: DataFrame
    parts: DataFrame
    dictionary: bytes


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, partitions: int | None = None, sample: int = 400, sample_bytes: int = 1 << 18, dict_bytes: int = 1 << 16, shard_ids: int = 1 << 20, part_bytes: int = 128 << 20) -> TokenFiles:
    """Encodes doc_id, text and writes shards of about ``shard_ids`` ids.

    The dictionary is trained on ``sample`` documents of at most ``sample_bytes``
    each, chosen by hash. ``partitions`` defaults to one for each ``part_bytes``
    of text, and to the session's shuffle partitions at least.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if partitions is None:
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
        partitions = max(total // part_bytes + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    encoder = Encoder(tokenizer, bits=14)
    width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
    short = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    chosen = hash_sample(short, F.col("doc_id"), sample).collect()
    samples = [np.append(encoder.encode(pa.array([r["text"]], pa.string()))[0], end_id).astype(f"<u{width}").tobytes() for r in chosen]
    dictionary = train(samples, dict_bytes).as_bytes()
    dict_hash = dictionary_hash(dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        enc, press = Encoder(tokenizer), zstandard.ZstdCompressor(level=3, dict_data=_load(dictionary))
        ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, base
            total = sum(counts)
            row = [[part], [seq], [base], [len(ids)], [total], [pack(ids, counts, frames, width, dict_hash)]]
            seq, base = seq + 1, base + total
            ids.clear(), counts.clear(), frames.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])], ["part", "seq", "base", "n_docs", "n_tokens", "shard"])

        pending = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b in slices(batch.column(1)):
                flat, n = enc.encode(batch.column(1).slice(a, b - a))
                ends = np.cumsum(n)
                flat = flat.astype(f"<u{width}")
                for i, (lo, hi) in enumerate(zip((ends - n).tolist(), ends.tolist())):
                    frames.append(press.compress(np.append(flat[lo:hi], np.array(end_id, flat.dtype)).tobytes()))
                    ids.append(keys[a + i])
                    counts.append(hi - lo + 1)
                    pending += hi - lo + 1
                    if pending >= shard_ids:
                        yield flush()
                        pending = 0
        if ids:
            yield flush()

    keys = [F.col("doc_id").asc_nulls_first(), "_hash"]
    dealt = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.spark_partition_id().alias("_from"))
    ordered = dealt.repartitionByRange(partitions, *keys, "_from").sortWithinPartitions(*keys, "text").select("doc_id", "text")
    shards = store.write(ordered.mapInArrow(frugal(encode), "part int, seq int, base long, n_docs long, n_tokens long, shard binary"), "shards", large_values=True)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    return TokenFiles(shards, parts, dictionary)


def read_tokens(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the shards."""
    dictionary = files.dictionary

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py(), dictionary)
                crc = [zlib.crc32(shard.ids(i).tobytes()) for i in range(len(shard.doc_ids))]
                starts = base + np.cumsum(shard.counts) - shard.counts
                cols = [pa.array(shard.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = F.broadcast(files.parts) if small_enough(files.parts) else files.parts  # a row for each part
    placed = files.shards.join(parts, "part").select((F.col("base") + F.col("part_base")).alias("base"), "shard")
    return placed.mapInArrow(frugal(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: TokenFiles, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of a few documents: only their frames are decompressed."""
    wanted, dictionary = set(doc_ids), files.dictionary

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_py(), dictionary)
                at = [i for i, d in enumerate(shard.doc_ids) if d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[i] for i in at], pa.int64()), pa.array([shard.ids(i).tolist() for i in at], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.shards.select("shard").mapInArrow(frugal(pick), "doc_id long, ids array<long>")

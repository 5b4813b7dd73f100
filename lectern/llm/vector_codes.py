"""Codes of vectors by parts: codebooks from Lloyd rounds with Elkan's bounds.

Components become integers, floor(256 * x). A vector is cut into equal
consecutive parts, and every part position has a codebook, which starts as that
part of the first vectors by id. Between rounds a vector keeps, for each part,
its entry, an upper bound of the distance to it and a lower bound for every
entry of the codebook. After a round the bounds are shifted by how far the
entries moved. An entry is passed over where its lower bound, or half its
distance from the own entry, is strictly over the upper bound; else the squared
distance is computed in integers, and ties go to the lower index. Bounds are
rounded away from the distance, so that no entry is passed over that integers
would choose; a lower bound is kept as a byte, in steps of the part's largest.

State is a written table for each round; entries are the only thing that is
sent to all tasks (``entries`` vectors), sums of parts are aggregated by entry in
each task first, and only as many rows as there are entries reach the driver.

Defined results: vectors that are null or hold null or non-finite components go.
Vectors of fewer components than the longest, or of a number that parts do not
divide, are filled up with zeros, which change no distance between equal lengths.
The first vectors are taken by vec_id (null last), of equal ids by hash and
content; with fewer vectors than ``entries`` the codebooks are smaller. Rows that
repeat a vec_id are rows of their own. An empty table gives no rows. Components
so large that a row's error may not fit a long stop the job with an
ArithmeticError. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import frugal
from ._store import Scratch

#: Values handled at a time: rows of a batch times components times entries.
STEP = 4096


def _up(x: np.ndarray) -> np.ndarray:
    """32-bit values not under x."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.maximum(np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y), np.float32(0))


def root_up(d: np.ndarray) -> np.ndarray:
    """At least the square roots of integers; a root in doubles is off by less than a few parts in 2**53."""
    return _up(np.sqrt(d.astype(np.float64)) * (1 + 2.0**-50))


def root_down(d: np.ndarray) -> np.ndarray:
    return _down(np.sqrt(d.astype(np.float64)) * (1 - 2.0**-50))


def packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each lower bound, and the step of each part that they count, both rounded down."""
    step = _down(lower.max(-1).astype(np.float64) / 255)
    q = np.floor(lower / np.maximum(step, np.finfo(np.float32).tiny)[..., None].astype(np.float64))
    q = np.minimum(q, 255)
    return (q - (q * step[..., None] > lower)).clip(0).astype(np.uint8), step


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, int]:
    """The squared distance of each row of ``x`` to its nearest entry, and how many distances were computed.

    ``code``, ``upper`` and ``lower`` are this part's state, brought up to date in place;
    ``half``: half the distances between entries, rounded down.
    """
    rows = np.arange(len(x))
    own = ((x - book[code]) ** 2).sum(1)  # the error is asked for in the end, and the bound gets tight by it
    upper[:] = np.minimum(upper, root_up(own))
    open_ = (lower <= upper[:, None]) & (half[code] <= upper[:, None])
    open_[rows, code] = False
    i, c = np.nonzero(open_)
    d = ((x[i] - book[c]) ** 2).sum(1)
    lower[i, c] = root_down(d)
    lower[rows, code] = root_down(own)
    table = np.full((len(x), len(book)), np.iinfo(np.int64).max)
    table[i, c] = d
    table[rows, code] = own
    code[:] = table.argmin(1)  # the first of equals
    best = table[rows, code]
    upper[:] = root_up(best)
    return best, len(x) + len(i)


def moved_by(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far entries moved, rounded up."""
    return root_up(((new - old) ** 2).sum(-1))


def halves(book: np.ndarray) -> np.ndarray:
    """Half the distance between the entries of a codebook, rounded down; an entry is never in the way of itself."""
    return root_down(((book[:, None, :] - book[None, :, :]) ** 2).sum(-1)) * np.float32(0.5)


def _integers(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """row columns and ``x`` (32-bit integers as bytes, filled up to a multiple of ``parts``), and its length."""
    kept = vectors.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))))
    most = kept.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("n"), F.coalesce(F.max(F.array_max(F.transform("vector", F.abs))), F.lit(0.0)).alias("x")).first()
    length = -(-most["n"] // parts) * parts
    limit = 2.0 ** min(30, math.floor((62 - math.log2(max(length, 1))) / 2 - 1))  # (2 * limit)**2 * length fits
    if 256 * most["x"] + 1 > limit:
        raise ArithmeticError(f"a component of {most['x']} is too large: squared distances would not fit 64 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column(2)
            size = np.diff(np.asarray(column.offsets))
            flat = np.asarray(column.flatten())
            x = np.zeros((rows.num_rows, length), np.int32)
            x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(256 * flat)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "x"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "vector").mapInArrow(frugal(run), f"vec_id long, label {label}, x binary"), length


def _assigned(state: DataFrame, books: np.ndarray, shift: np.ndarray | None, bounds: bool) -> DataFrame:
    """A round of assignments. ``books``: parts x entries x part length; ``shift``: how far entries moved since the last one, None for the first.

    ``bounds``: whether another round follows that needs them.
    """
    parts, entries, width = books.shape
    label = state.schema["label"].dataType.simpleString()
    half = np.stack([halves(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                rows = whole.slice(a, STEP)
                n = rows.num_rows
                x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.int32).astype(np.int64).reshape(n, parts, width)
                if shift is None:
                    code = np.zeros((n, parts), np.uint8)
                    upper, lower = np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, entries), np.float32)
                else:
                    read = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)  # noqa: B023, E731
                    code = read("code", np.uint8).reshape(n, parts).copy()
                    upper = _up(read("upper", np.float32).reshape(n, parts).astype(np.float64) + np.take_along_axis(shift, code.T.astype(np.int64), 1).T)
                    lower = read("lower", np.uint8).reshape(n, parts, entries) * read("step", np.float32).reshape(n, parts, 1).astype(np.float64)
                    lower = _down(lower - shift)
                error, met = np.zeros(n, np.int64), 0
                for p in range(parts):
                    best, count = reassign(x[:, p], books[p], code[:, p], upper[:, p], lower[:, p], half[p])
                    error += best
                    met += count
                blob = lambda v: pa.array([r.tobytes() for r in v], pa.binary()) if bounds else pa.nulls(n, pa.binary())  # noqa: B023, E731
                cols = [rows.column("vec_id"), rows.column("label"), rows.column("x") if bounds else pa.nulls(n, pa.binary())]
                low, step = packed(lower) if bounds else (None, None)
                cols += [pa.array([r.tobytes() for r in code], pa.binary()), blob(upper), blob(low), blob(step), pa.array(error), pa.array([met] + [0] * (n - 1), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "x", "code", "upper", "lower", "step", "error", "computed"])

    return state.mapInArrow(frugal(run), f"vec_id long, label {label}, x binary, code binary, upper binary, lower binary, step binary, error long, computed long")


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every entry at the floor of the mean of its parts. Tasks send one row for each entry; so many rows reach the driver."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for rows in batches:
            n = rows.num_rows
            x = np.frombuffer(b"".join(rows.column(0).to_pylist()), np.int32).astype(np.int64).reshape(n, parts, width)
            code = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64) + np.arange(parts) * entries
            np.add.at(total, code.ravel(), x.reshape(-1, width))
            count += np.bincount(code.ravel(), minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["at", "n", "sums"])

    some = state.select("x", "code").mapInArrow(frugal(run), "at int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = books.reshape(-1, width).copy()
    for r in some.groupBy("at").agg(F.sum("n").alias("n"), *exact).collect():  # parts * entries rows at most
        out[r["at"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out.reshape(books.shape)


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, label, vector -> vec_id, code, error, label_error, codebooks_sha256, label.

    ``code``: entry numbers in the order of parts, two hex digits each; ``error``:
    squared distances summed over parts; ``label_error``: its sum over equal labels.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    store = Scratch(vectors.sparkSession, "vector-codes")
    ints, length = _integers(vectors, parts)
    state = store.write(ints, "integers")
    seeds = [np.frombuffer(r["x"], np.int32).astype(np.int64) for r in state.orderBy(F.col("vec_id").asc_nulls_last(), F.xxhash64("x"), "x").limit(entries).collect()]  # ``entries`` rows
    books = np.stack([s.reshape(parts, -1) for s in seeds], 1) if seeds and length else np.zeros((parts, max(len(seeds), 1), max(length // parts, 1)), np.int64)
    if not length:
        state = state.withColumn("x", F.lit(bytes(4 * parts)))  # only empty vectors: a zero for each part
    shift = None
    for k in range(rounds):
        state = store.write(_assigned(state, books, shift, True), f"round-{k}")
        new = _updated(state, books)
        shift, books = moved_by(books, new), new
        if k:
            store.drop(f"round-{k - 1}")
    done = store.write(_assigned(state, books, shift, False).select("vec_id", "label", "code", "error", "computed"), "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist() if length else [])).encode()).hexdigest()
    by_label = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    by_label = store.write(by_label, "labels")
    out = done.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")

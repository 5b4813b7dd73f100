"""Row merge: fragments that stand side by side become one line.

A fragment joins the latest of the last eight merged rows whose middle and
height are near; a merged row's box grows, and with it what it attracts. That
order-dependent fold runs over whole pages, a page a row, in Arrow batches, so
that texts and spans are dealt out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

LOOK_BACK, NEAR_MIDDLE, NEAR_HEIGHT = 8, 1.2, 1.5
KEYS = ["doc_id", "page"]


def assign_rows(boxes: list[tuple[float, float, float, float]]) -> list[tuple[int, int]]:
    """(row, turn) of each box. Boxes take their turn by top (to a tenth), then left, then as given."""
    x0, y0, _, y1 = np.array(boxes, float).reshape(-1, 4).T
    row, turn = assign_pages(np.array([0, len(boxes)]), x0, y0, y1)
    return list(zip(row.tolist(), turn.tolist()))


def assign_pages(starts: np.ndarray, x0: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``assign_rows`` of many pages: rows and turns. ``starts``: where each page begins, and the end.

    Only heights decide. Boxes of one height that take their turn one after the other
    go to one row once that row has room for them, so the fold steps over them together.
    """
    page = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    values, at = np.unique(y0, return_inverse=True)
    top = np.array([round(v, 1) for v in values.tolist()], float)[at]
    order = np.lexsort((x0, top, page))
    turn, row = np.empty(len(x0), np.int32), np.empty(len(x0), np.int32)
    turn[order] = np.arange(len(x0)) - starts[page]
    p, a, z = page[order], y0[order], y1[order]
    begins = np.flatnonzero(np.append(np.ones(min(1, len(p)), bool), (p[1:] != p[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])))
    rows: list[tuple[float, float]] = []
    lengths, found, last = [], [], -1
    for now, t, b, n in zip(p[begins].tolist(), a[begins].tolist(), z[begins].tolist(), np.diff(np.append(begins, len(p))).tolist()):
        if now != last:
            rows, last = [], now
        while n:
            for r in range(len(rows) - 1, max(-1, len(rows) - 1 - LOOK_BACK), -1):
                u, v = rows[r]
                if abs((t + b) / 2 - (u + v) / 2) <= NEAR_MIDDLE and abs((b - t) - (v - u)) <= NEAR_HEIGHT:
                    taken = n if u <= t and b <= v else 1
                    rows[r] = (min(u, t), max(v, b))
                    break
            else:
                r, taken = len(rows), 1
                rows.append((t, b))
            lengths.append(taken)
            found.append(r)
            n -= taken
    row[order] = np.repeat(np.array(found, np.int32), lengths)
    return row, turn


def members_of_pages(starts: np.ndarray, x0: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> pa.Array:
    """For each page its rows, and for each row the places of its boxes on the page, in the order of their turns: a list of lists."""
    row, turn = assign_pages(starts, x0, y0, y1)
    page = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((turn, row, page))
    p, r = page[order], row[order]
    begins = np.flatnonzero(np.append(np.ones(min(1, len(p)), bool), (p[1:] != p[:-1]) | (r[1:] != r[:-1])))
    inner = pa.ListArray.from_arrays(pa.array(np.append(begins, len(p)), pa.int32()), pa.array(order - starts[p], pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(p[begins], np.arange(len(starts))), pa.int32()), inner)


def with_rows(lines: DataFrame) -> DataFrame:
    """Adds row and turn (``assign_rows``) to lines. Sorted pages stream by in Arrow batches; only boxes are looked at, other columns pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last page of a batch may go on in the next."""
        rest: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                rest = part if rest is None else pa.concat_tables([rest, part])
            if rest is None or not len(rest):
                continue
            keys = np.stack([np.asarray(rest[k].combine_chunks()) for k in KEYS], 1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            ready = len(rest) if batch is None else int(starts[-1])
            if not ready:
                continue
            box = rest["bbox"].combine_chunks()
            corners = [np.asarray(box.field(c))[:ready] for c in ("x0", "y0", "y1")]
            row, turn = assign_pages(np.append(starts[starts < ready], ready), *corners)
            done = rest.slice(0, ready).combine_chunks()
            yield from done.append_column("row", pa.array(row)).append_column("turn", pa.array(turn)).to_batches()
            rest = rest.slice(ready)

    there = lines.select(*KEYS, "ord", "text", "bbox", "spans").repartition(*KEYS).sortWithinPartitions(*KEYS, "ord")
    return there.mapInArrow(run, T.StructType([*there.schema.fields, T.StructField("row", T.IntegerType()), T.StructField("turn", T.IntegerType())]))


def merge_rows(lines: DataFrame) -> DataFrame:
    """doc_id, page, ord, text, bbox, spans -> the same, merged; ``ord`` is then the order by top and left."""
    fragments = F.array_sort(F.collect_list(F.struct("ord", "text", "bbox", "spans")))
    return merge_pages(lines.groupBy(*KEYS).agg(fragments.alias("fragments")))


def merge_pages(pages: DataFrame) -> DataFrame:
    """``merge_rows`` of pages: doc_id, page, fragments array<struct<text, bbox, spans, ..>> in their order. Pages stream by in Arrow batches; nothing is dealt out."""
    fragment = pages.schema["fragments"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("fragments"))
            flat = lists.flatten()
            if len(flat):
                lengths = np.asarray(lists.value_lengths().fill_null(0))
                page, rows = _merged(np.append(0, np.cumsum(lengths)), flat)
                keys = [batch.column(batch.schema.get_field_index(k)).take(pa.array(page)) for k in KEYS]
                yield pa.RecordBatch.from_arrays([*keys, *rows], [*KEYS, "ord", "text", "bbox", "spans"])

    out = [*[pages.schema[k] for k in KEYS], T.StructField("ord", T.IntegerType()), *[fragment[c] for c in ("text", "bbox", "spans")]]
    return pages.select(*KEYS, "fragments").mapInArrow(run, T.StructType(out))


def _merged(starts: np.ndarray, flat: pa.StructArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages of fragments -> the page of each merged row, and ord, text, bbox, spans of the rows, by page, top and left."""
    edges = {c: flat.field("bbox").field(c) for c in ("x0", "y0", "x1", "y1")}
    values = {c: np.asarray(v.to_numpy(zero_copy_only=False), float) for c, v in edges.items()}  # nan for null
    row, turn = assign_pages(starts, values["x0"], values["y0"], values["y1"])
    page = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((turn, row, page))
    p, r = page[order], row[order]
    new = np.append(True, (p[1:] != p[:-1]) | (r[1:] != r[:-1]))
    begins, group = np.flatnonzero(new), np.cumsum(new) - 1
    sizes = np.diff(np.append(begins, len(p)))

    def side(c: str) -> tuple[np.ndarray, np.ndarray]:
        """The outer edge of each row, and where it is not known."""
        missing, v = np.asarray(edges[c].is_null())[order], values[c][order]
        found = np.fmin.reduceat(v, begins) if c in ("x0", "y0") else np.maximum.reduceat(np.where(missing, -np.inf, v), begins)
        return found, np.logical_and.reduceat(missing, begins)

    box = {c: side(c) for c in edges}
    first = {c: np.where(missing, -np.inf, v) for c, (v, missing) in box.items()}  # what is not known comes first
    final = np.lexsort((r[begins], first["x0"], first["y0"], p[begins]))
    place = np.arange(len(final)) - np.searchsorted(p[begins], p[begins])  # pages stay in their order

    # spans keep the order in which fragments took their turn, then sort stably by their left edge
    taken = flat.take(pa.array(order))
    lists = taken.field("spans")
    counts = np.asarray(lists.value_lengths().fill_null(0))
    spans = lists.flatten()
    of = np.repeat(group, counts)
    left = spans.field("bbox").field("x0")
    left = np.where(np.asarray(left.is_null()), -np.inf, np.asarray(left.to_numpy(zero_copy_only=False), float))
    spans = spans.take(pa.array(np.lexsort((np.where(sizes[of] == 1, 0.0, left), of))))
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(begins)))).astype(np.int32)
    lost = np.logical_or.reduceat(np.asarray(lists.is_null()), begins)
    said, parts = taken.field("text").take(pa.array(begins)).to_pylist(), spans.field("text").to_pylist()
    text = [t if n == 1 else None if none else tx.joined(parts[a:z]) for t, n, none, a, z in zip(said, sizes.tolist(), lost.tolist(), ends[:-1].tolist(), ends[1:].tolist())]

    at = pa.array(final)
    boxes = pa.StructArray.from_arrays([pa.array(v, mask=missing) for v, missing in box.values()], list(box))
    whole = pa.ListArray.from_arrays(pa.array(ends), spans, type=lists.type, mask=pa.array(lost))
    return p[begins][final], [pa.array(place.astype(np.int32)), pa.array(text, taken.field("text").type).take(at), boxes.take(at), whole.take(at)]


class RowTurns:
    """A table function: the fold over the boxes of one page, for SQL. ``register`` gives it its name.

    SELECT * FROM row_turns(TABLE(boxes) PARTITION BY (doc_id, page) ORDER BY ord), where boxes has doc_id, page, ord, x0, y0, x1, y1.
    """

    def __init__(self) -> None:
        self.keys: list[tuple] = []
        self.boxes: list[tuple[float, float, float, float]] = []

    def eval(self, row: Row) -> None:
        self.keys.append((row["doc_id"], row["page"], row["ord"]))
        self.boxes.append((row["x0"], row["y0"], row["x1"], row["y1"]))

    def terminate(self) -> Iterator[tuple]:
        for key, found in zip(self.keys, assign_rows(self.boxes)):
            yield (*key, *found)


class RowMembers:
    """A table function: the same fold over the edges of one page's boxes, as arrays: the places of each row's boxes, in the order of their turns.

    SELECT * FROM pages, LATERAL row_members(x0, y0, y1)
    """

    def eval(self, x0: list[float], y0: list[float], y1: list[float]) -> Iterator[tuple[list[list[int]]]]:
        yield (members_of_pages(np.array([0, len(x0)]), *[np.array(c, float) for c in (x0, y0, y1)]).to_pylist()[0],)


class TextLines:
    """A table function: the lines of a text with their page and place, 50 to a page: SELECT * FROM documents, LATERAL text_lines(text)."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        for n, line in enumerate(text.split("\n") if text is not None else []):
            yield n // 50, n % 50, line


def register(spark: SparkSession) -> None:
    """Makes row_turns, row_members and text_lines callable in SQL."""
    spark.udtf.register("row_turns", F.udtf(RowTurns, returnType="doc_id long, page int, ord int, row int, turn int"))
    spark.udtf.register("row_members", F.udtf(RowMembers, returnType="members array<array<int>>"))
    spark.udtf.register("text_lines", F.udtf(TextLines, returnType="page int, ord int, line string"))

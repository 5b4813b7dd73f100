"""Fitting a translation into the place of its source: wrapping, and the search for a size.

Sizes are searched downward in fixed steps, each with its own wrapping; the
loop runs in Arrow batches, a unit at a time.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fonts import ADVANCES, ASCENDER, DESCENDER, advance

BLANK, WIDEST = ADVANCES[0], max(ADVANCES)
STEP, SMALLEST, TINY = 0.15, 5.2, 4.8
BLOCK_LEADING, CELL_LEADING, PAD_X, PAD_Y = 1.02, 1.05, 6.0, 2.5


def wrap(text: str, width: float, size: float) -> list[str]:
    """Words filled greedily into lines; a word wider than a line is cut by characters."""
    return fill([(w, advance(w)) for w in text.split()], width * 1000 / size)


_of_short = functools.lru_cache(1 << 16)(advance)


def whole(x: float) -> int:
    """``x`` rounded down, between 0 and a large number; 0 for what is no number."""
    return int(min(max(0.0, x), 1e9))


def head(text: str, lines: int, room: float) -> tuple[list[tuple[str, int]], bool]:
    """The measured words of a text, up to the first that so many lines can't hold; and whether there is such a word. No line is wider than ``room`` and one letter."""
    out, left = [], lines * max(room, WIDEST)
    n, rest = 32, text
    while rest:
        words = rest.split(None, n)
        rest = words.pop() if len(words) > n else ""
        for word in words:
            w = _of_short(word) if len(word) < 40 else advance(word)
            out.append((word, w))
            left -= w
            if left < 0:
                return out, True
        n *= 2
    return out, False


def fill(words: list[tuple[str, int]], room: float, blank: int = BLANK, most: float = math.inf) -> list[str]:
    """``wrap`` over words with known widths: both in thousandths of the size, so that a search measures once. Stops when there are more lines than ``most``."""
    glue = " " if blank else ""
    lines: list[str] = []
    line, used = "", 0
    for word, w in words:
        if len(lines) > most:
            return lines
        if line and used + blank + w <= room:
            line, used = f"{line}{glue}{word}", used + blank + w
            continue
        if line:
            lines.append(line)
        line, used = word, w
        if w > room:
            line, used = "", 0
            for c in word:
                n = advance(c)
                if line and used + n > room:
                    lines.append(line)
                    if len(lines) > most:
                        return lines
                    line, used = c, n
                else:
                    line, used = line + c, used + n
    return [*lines, line] if line else lines


def filler(words: list[tuple[str, int]]) -> Callable[[float, float], list[str]]:
    """``fill`` for several rooms: where no word has to be cut, the end of a line is found by halving. Widths are whole numbers, so a room counts as one."""
    texts = [w for w, _ in words]
    ends = list(accumulate((w + BLANK for _, w in words), initial=0))
    widest = max((w for _, w in words), default=0)

    def lines(room: float, most: float) -> list[str]:
        if not widest <= room < 1e15:
            return fill(words, room, most=most)
        out, at, held = [], 0, math.floor(room) + BLANK
        while at < len(texts) and len(out) <= most:
            to = bisect_right(ends, ends[at] + held) - 1
            out.append(" ".join(texts[at:to]))
            at = to
        return out

    return lines


@functools.lru_cache(1 << 12)
def sizes(start: float, min_scale: float) -> tuple[float, ...]:
    size, least, out = start, max(SMALLEST, start * min_scale), []
    while size >= least - 1e-6:
        out.append(size)
        size -= STEP
    return tuple(out)


def largest(tried: tuple[float, ...], lay: Callable[[float], list[str] | None]) -> tuple[float, list[str]] | None:
    """The largest of falling sizes at which ``lay`` finds lines that fit, with them. Smaller letters never need more lines, so what
    fits at a size fits at all smaller ones: the least is tried first, then the largest, then halves of those between."""
    if not tried or not (lines := lay(tried[-1])):
        return None
    found, low, high, at = (tried[-1], lines), 0, len(tried) - 1, 0
    while low < high:
        if lines := lay(tried[at]):
            found, high = (tried[at], lines), at
        else:
            low = at + 1
        at = (low + high) // 2
    return found


def fit_block(text: str, width: float, height: float, n_lines: int, size: float, min_scale: float) -> tuple[float, list[str], str | None]:
    """(size, lines, warning): the largest size at which the text keeps to its lines and box; else the least, cut."""
    most, least, across = max(1, n_lines), max(SMALLEST, size * min_scale), max(8.0, width)
    words, more = head(text, most, across * 1000 / least)
    filled = filler(words)

    def lay(s: float) -> list[str] | None:
        lines = filled(across * 1000 / s, most)
        return lines if len(lines) <= most and len(lines) * max(1.0, (ASCENDER - DESCENDER) * s) * BLOCK_LEADING <= height + 0.5 else None

    if not more and (found := largest(sizes(size, min_scale), lay)):
        return *found, None
    return least, filled(across * 1000 / least, most)[:most], "the text did not fit at the least size and was cut"


def fit_cell(text: str, width: float, height: float, size: float, min_scale: float) -> tuple[float, list[str], str | None]:
    """The same for a table cell, with padding; at last one line, smaller if it must be."""
    inner_w, inner_h = width - 2 * PAD_X, height - 2 * PAD_Y
    least = max(SMALLEST, size * min_scale)
    most = whole(inner_h / ((ASCENDER - DESCENDER) * least * CELL_LEADING)) + 1
    words, more = head(text, most, inner_w * 1000 / least)
    filled = filler(words)

    def lay(s: float) -> list[str] | None:
        lines = filled(inner_w * 1000 / s, most)
        return lines if len(lines) * (ASCENDER - DESCENDER) * s * CELL_LEADING <= inner_h else None

    if not more and (found := largest(sizes(size, min_scale), lay)):
        return *found, None
    s, n = least, advance(text)
    while s > TINY and s * n / 1000 > inner_w:
        s -= 0.1
    return s, [text], "the cell needed the least size"


#: Margin in pixels, share of the height that a size starts from, gap between lines as a share of their height.
IMAGE_MARGIN, IMAGE_START, IMAGE_GAP = 4, 0.78, 0.08


def fit_pixels(text: str, width: int, height: int, min_scale: float = 0.9) -> tuple[int, list[str], bool]:
    """(size, lines, cut) of a text in a box of an image, in whole pixels: the largest size at which all lines stand in the box."""
    room, tall = max(8, width - IMAGE_MARGIN), max(8, height - IMAGE_MARGIN)
    start = max(8, int(tall * IMAGE_START))
    least = max(7, int(start * min_scale))
    clean = text.replace("\n", " ").strip()
    words = [(w, advance(w)) for w in (clean.split() if " " in clean else clean)]
    blank = BLANK if " " in clean else 0  # scripts without blanks run on
    for size in range(start, least - 1, -1):
        lines = fill(words, room * 1000 / size, blank)
        line = max(1, round((ASCENDER - DESCENDER) * size))
        if lines and len(lines) * line + (len(lines) - 1) * max(1, int(line * IMAGE_GAP)) <= tall:
            return size, lines, False
    return least, fill(words, room * 1000 / least, blank)[: max(1, tall // least)], True


def with_sizes(units: DataFrame, min_scale: float = 0.9) -> DataFrame:
    """Adds final_size and warning (as ``plan_fit``) to units, null without a translation. Units stay where they are; only what is measured goes through Arrow batches."""

    @F.arrow_udf(returnType=T.StructType([T.StructField("final_size", T.DoubleType()), T.StructField("warning", T.StringType())]))
    def sized(kind: pa.Array, text: pa.Array, w: pa.Array, h: pa.Array, n_lines: pa.Array, size: pa.Array) -> pa.Array:
        numbers = [c.to_numpy(zero_copy_only=False).tolist() for c in (w, h, n_lines, size)]
        found = [
            (None, None, None) if t is None else fit_cell(t.strip(), w, h, s, min_scale) if k == "table_cell" else fit_block(t.strip(), w, h, n, s, min_scale)
            for k, t, w, h, n, s in zip(kind.to_pylist(), text.to_pylist(), *numbers)
        ]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.string())], ["final_size", "warning"])

    side = lambda a, z: F.col(f"bbox.{z}") - F.col(f"bbox.{a}")
    out = units.withColumn("_fit", sized("kind", "translation", side("x0", "x1"), side("y0", "y1"), "n_lines", "size"))
    return out.withColumns({"final_size": F.col("_fit.final_size"), "warning": F.col("_fit.warning")}).drop("_fit")


def plan_fit(units: DataFrame, min_scale: float = 0.9) -> DataFrame:
    """doc_id, page, unit_id, kind, translation, bbox, n_lines, size -> doc_id, page, unit_id, final_size, fitted, warning."""
    schema = "doc_id long, page int, unit_id string, final_size double, fitted array<string>, warning string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [
                fit_cell(t.strip(), w, h, s, min_scale) if k == "table_cell" else fit_block(t.strip(), w, h, n, s, min_scale)
                for k, t, w, h, n, s in zip(f.kind, f.translation.fillna(""), f.w, f.h, f.n_lines, f["size"])
            ]
            out = f[["doc_id", "page", "unit_id"]].copy()
            out["final_size"], out["fitted"], out["warning"] = [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]
            yield out

    flat = units.selectExpr("doc_id", "page", "unit_id", "kind", "translation", "n_lines", "size", "bbox.x1 - bbox.x0 AS w", "bbox.y1 - bbox.y0 AS h")
    return flat.mapInPandas(run, schema)

"""Text widths from advance widths of a standard sans-serif font, in Arrow batches where loops are needed.

Widths are the public metrics of Helvetica, in thousandths of the size; other
characters take ``DEFAULT``. A renderer that finds another font will measure
otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advance widths of the characters from blank to tilde, in code order.
ADVANCES = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
DEFAULT = 556
ASCENDER, DESCENDER = 1.075, -0.299


_WIDTHS = {chr(32 + i): w for i, w in enumerate(ADVANCES)}
_BY_CODE = np.array([DEFAULT] * 32 + ADVANCES + [DEFAULT])


def advance(text: str) -> int:
    """Width in thousandths of the size."""
    if len(text) < 40:
        return sum(_WIDTHS.get(c, DEFAULT) for c in text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(_BY_CODE[np.minimum(codes, 127)].sum())


def measure(text: str, size: float) -> float:
    return size * advance(text) / 1000


def text_width(text: Column, size: Column) -> Column:
    """``measure`` as an expression."""
    table = F.array(*[F.lit(x) for x in ADVANCES])
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return size * F.aggregate(codes, F.lit(0), lambda a, c: a + F.coalesce(F.when((c >= 32) & (c < 127), F.get(table, c - 32)), F.lit(DEFAULT))) / 1000


def is_bold(flags: Column) -> Column:
    return flags.bitwiseAND(16) != 0


def first_present(paths: list[str], fallback: str = "helv") -> str:
    """The first font file that is there. Looked up where it is called, never inside a plan."""
    from pathlib import Path

    return next((p for p in paths if Path(p).exists()), fallback)

"""Reading documents through Spark's own files, for stores that only Spark reaches. ``pages`` is the data source for all others.

PDFs need the PDF library on all executors; without it an attempt to read says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pages import SCHEMA, page_rows


def available() -> bool:
    import importlib.util

    return importlib.util.find_spec("pymupdf") is not None


def read_pages(spark: SparkSession, path: str, pattern: str = "*.pdf", dpi: int = 0) -> DataFrame:
    """A row per page and per failure, as ``pages.SCHEMA`` has them. A document is one value of the scan; bytes are not shuffled."""
    if pattern.endswith(".pdf") and not available():
        raise RuntimeError("reading PDF files needs the pymupdf package on all executors")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(page_rows(name, content or b"", dpi=dpi))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS.get(n, pa.string())) for i, n in enumerate(names)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, SCHEMA)


KINDS = {"page": pa.int32(), "width": pa.float64(), "height": pa.float64(), "image_count": pa.int32(), "drawing_count": pa.int32(), "raster": pa.binary()}

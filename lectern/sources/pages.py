"""Documents as a data source: ``spark.read.format("lectern_pages")`` gives a row per page.

The planner lists files and their sizes and opens none. Small files share a
partition; a large one is read by several, each of which takes its share of the
pages, whatever their number turns out to be. A file that cannot be opened is one
row with its error, a page that cannot be read another; neither stops the rest.

Files are found and read through pyarrow's file systems (local, S3, GCS, HDFS).
A store that only Spark reaches is read by ``pdf.read_pages``, with the same
openers. An opener knows one kind of document: PDFs (where the PDF library is
installed), or extracted pages as JSON lines, one page a line.
"""

from __future__ import annotations

import base64
import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "file string, page int, width double, height double, text string, image_count int, drawing_count int, raw string, visuals string, raster binary, error string"  # page counts from 1; visuals: see visuals.VISUALS
)
NOTHING = (None,) * 9


class Opener(Protocol):
    """An opened document. ``page`` gives the columns width to visuals of page i (from 0), ``raster`` its picture as PNG or None."""

    def __init__(self, content: bytes): ...
    def __len__(self) -> int: ...
    def page(self, i: int) -> tuple: ...
    def raster(self, i: int, dpi: int) -> bytes | None: ...


class PdfPages:
    def __init__(self, content: bytes):
        import pymupdf

        self.doc = pymupdf.open(stream=content, filetype="pdf")

    def __len__(self) -> int:
        return len(self.doc)

    def page(self, i: int) -> tuple:
        p = self.doc[i]
        images, drawings = p.get_images(full=True), p.get_drawings()
        found = []
        for info in images:
            got = self.doc.extract_image(info[0]) or {}
            data = base64.b64encode(got.get("image") or b"").decode()
            found.append({"xref": info[0], "ext": got.get("ext"), "width": got.get("width"), "height": got.get("height"), "data": data, "rects": [list(r) for r in p.get_image_rects(info[0])]})
        seen = json.dumps({"images": found, "drawings": [{"rect": list(d["rect"]) if d.get("rect") else None} for d in drawings]})
        return p.rect.width, p.rect.height, p.get_text("text"), len(images), len(drawings), json.dumps(p.get_text("dict"), default=str), seen

    def raster(self, i: int, dpi: int) -> bytes | None:
        return self.doc[i].get_pixmap(dpi=dpi).tobytes("png")


class DumpedPages:
    """Pages as an extractor has written them: {"width", "height", "text", "raw": {"blocks"}, "images", "drawings", "raster"}, a line each; all but the sizes may be missing."""

    def __init__(self, content: bytes):
        self.lines = [x for x in content.decode().splitlines() if x.strip()]
        if self.lines:
            self._read(0)  # what is no such file shows at once

    def _read(self, i: int) -> dict:
        found = json.loads(self.lines[i])
        if not isinstance(found, dict) or "width" not in found or "height" not in found:
            raise ValueError("not an extracted page")
        return found

    def __len__(self) -> int:
        return len(self.lines)

    def page(self, i: int) -> tuple:
        p = self._read(i)
        images, drawings = p.get("images") or [], p.get("drawings") or []
        seen = json.dumps({"images": images, "drawings": drawings})
        return float(p["width"]), float(p["height"]), p.get("text") or "", len(images), len(drawings), json.dumps(p.get("raw") or {}, ensure_ascii=False), seen

    def raster(self, i: int, dpi: int) -> bytes | None:
        got = self._read(i).get("raster")
        return base64.b64decode(got) if got else None


#: Openers by the end of a file's name; a job may add its own before it reads.
OPENERS: dict[str, type[Opener]] = {".pdf": PdfPages, ".jsonl": DumpedPages}


def page_rows(name: str, content: bytes, part: int = 0, parts: int = 1, dpi: int = 0) -> Iterator[tuple]:
    """Rows of SCHEMA of one share of a document's pages."""
    opener = OPENERS.get(os.path.splitext(name)[1].lower())
    try:
        if opener is None:
            raise ValueError("no opener for files of this name")
        doc = opener(content)
        n = len(doc)
    except Exception as e:  # noqa: BLE001  whatever a broken file makes a library raise
        if part == 0:
            yield (name, *NOTHING, f"{type(e).__name__}: {e}")
        return
    for i in range(n * part // parts, n * (part + 1) // parts):
        try:
            yield (name, i + 1, *doc.page(i), doc.raster(i, dpi) if dpi else None, None)
        except Exception as e:  # noqa: BLE001
            yield (name, i + 1, *NOTHING[1:], f"{type(e).__name__}: {e}")


def resolved(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def files_of(path: str) -> Iterator[tuple[str, int]]:
    """Name and size of every document at ``path``: a file, or a folder with all that it holds."""
    store, at = resolved(path)
    info = store.get_file_info(at)
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == files.FileType.File else store.get_file_info(files.FileSelector(at, recursive=True))
    for f in found:
        if f.type == files.FileType.File and os.path.splitext(f.path)[1].lower() in OPENERS:
            yield f.path, f.size


@dataclass
class Share(InputPartition):
    """(file, part, parts) of each file that a task reads."""

    shares: list[tuple[str, int, int]]


def shares_of(sizes: Iterator[tuple[str, int]], split: int) -> list[Share]:
    """Files dealt to partitions of about ``split`` bytes; what is larger is read by several."""
    out, held, total = [], [], 0
    for name, size in sizes:
        parts = -(-size // split)
        if parts > 1:
            out += [Share([(name, k, parts)]) for k in range(parts)]
            continue
        if held and total + size > split:
            out.append(Share(held))
            held, total = [], 0
        held.append((name, 0, 1))
        total += size
    return [*out, Share(held)] if held else out


class PageReader(DataSourceReader):
    def __init__(self, path: str, split: int, dpi: int):
        self.path, self.split, self.dpi = path, split, dpi

    def partitions(self) -> list[Share]:
        return shares_of(files_of(self.path), self.split) or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        store, _ = resolved(self.path)
        for name, part, parts in partition.shares:
            try:
                with store.open_input_stream(name) as f:
                    content = f.read()
            except OSError as e:
                if part == 0:
                    yield (name, *NOTHING, f"{type(e).__name__}: {e}")
                continue
            yield from page_rows(name, content, part, parts, self.dpi)


class Pages(DataSource):
    """Options: path; splitBytes, how much of files a task reads (64 MB); dpi, to have pages drawn (0: not)."""

    @classmethod
    def name(cls) -> str:
        return "lectern_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("lectern_pages needs a path")
        return PageReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)), int(self.options.get("dpi", 0)))


def read_pages(spark: SparkSession, path: str, split_bytes: int = 64 << 20, dpi: int = 0) -> DataFrame:
    """The pages of all documents at ``path``, with error rows; see SCHEMA."""
    spark.dataSource.register(Pages)
    return spark.read.format(Pages.name()).option("splitBytes", split_bytes).option("dpi", dpi).load(path)


def dump(rows: list[dict]) -> bytes:
    """Pages as ``DumpedPages`` reads them."""
    out = io.StringIO()
    for r in rows:
        out.write(json.dumps(r, ensure_ascii=False) + "\n")
    return out.getvalue().encode()

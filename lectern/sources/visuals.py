"""Images and drawings of pages, as rows, from what an extractor says of a page; and what a recognition engine says of its image."""

from __future__ import annotations

import importlib.util
import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box

#: JSON of a page: images with their number, bytes in base64, size and the rectangles where they stand; rectangles of drawings.
VISUALS = "images array<struct<xref:int,ext:string,width:int,height:int,data:string,rects:array<array<double>>>>, drawings array<struct<rect:array<double>>>"


def _box(r: Column) -> Column:
    return box(F.get(r, 0), F.get(r, 1), F.get(r, 2), F.get(r, 3))


def _read(pages: DataFrame, column: str) -> DataFrame:
    return pages.select("doc_id", "page", F.from_json(column, VISUALS).alias("v"))


def placements(pages: DataFrame, column: str = "visuals") -> DataFrame:
    """doc_id, page, xref, occ, rect: every place where an image stands. Of equal numbers on a page the first counts."""
    images = _read(pages, column).select("doc_id", "page", F.posexplode("v.images").alias("i", "m"))
    first = images.groupBy("doc_id", "page", F.col("m.xref").alias("xref")).agg(F.min_by("m.rects", "i").alias("rects"))
    return first.select("doc_id", "page", "xref", F.posexplode("rects").alias("occ", "r")).select("doc_id", "page", "xref", "occ", _box(F.col("r")).alias("rect"))


def images(pages: DataFrame, column: str = "visuals") -> DataFrame:
    """doc_id, page, xref, ext, image_w, image_h, bytes, digest of each image once a page; images without bytes go."""
    m = _read(pages, column).select("doc_id", "page", F.posexplode("v.images").alias("i", "m"))
    first = m.groupBy("doc_id", "page", F.col("m.xref").alias("xref")).agg(F.min_by("m", "i").alias("m"))
    data = F.unbase64("m.data")
    out = first.select("doc_id", "page", "xref", F.coalesce("m.ext", F.lit("png")).alias("ext"), F.col("m.width").alias("image_w"), F.col("m.height").alias("image_h"), data.alias("bytes"), F.sha2(data, 256).alias("digest"))
    return out.filter("octet_length(bytes) > 0")


def drawings(pages: DataFrame, column: str = "visuals") -> DataFrame:
    """doc_id, page, ord, bbox of every drawing that has a rectangle: the rules from which tables are found."""
    d = _read(pages, column).select("doc_id", "page", F.posexplode("v.drawings").alias("ord", "d"))
    return d.filter("d.rect IS NOT NULL").select("doc_id", "page", "ord", _box(F.col("d.rect")).alias("bbox"))


def page_areas(pages: DataFrame, column: str = "visuals") -> DataFrame:
    """doc_id, page, width, height, image_area: the sum over all placements of a page."""
    at = placements(pages, column)
    r = F.col("rect")
    area = at.groupBy("doc_id", "page").agg(F.sum(F.greatest(F.lit(0.0), (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))).alias("image_area"))
    return pages.select("doc_id", "page", "width", "height").join(area, ["doc_id", "page"], "left").withColumn("image_area", F.coalesce("image_area", F.lit(0.0)))


def data_url(data: Column, ext: Column) -> Column:
    """An image as text that can stand in a request."""
    return F.concat(F.lit("data:image/"), F.lower(F.coalesce(ext, F.lit("png"))), F.lit(";base64,"), F.base64(data))


def find_results(found: object) -> dict | None:
    """The first object at any depth that has recognised texts and their places."""
    todo = [found]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if "rec_texts" in x and ("rec_boxes" in x or "rec_polys" in x):
                return x
            todo += list(x.values())[::-1]
        elif isinstance(x, list):
            todo += x[::-1]
    return None


def _points(place: object) -> list[list[float]] | None:
    """Four points, or two corners given as four numbers; None if it is neither."""
    try:
        if len(place) == 4 and isinstance(place[0], list):
            return [[float(p[0]), float(p[1])] for p in place]
        x0, y0, x1, y1 = map(float, place[:4])
        return [[x0, y0], [x1, y1]]
    except (TypeError, ValueError, IndexError):
        return None


def recognition_payloads(pages: DataFrame, column: str = "reply") -> DataFrame:
    """doc_id, page, JSON of an engine's result, wrapped as it may be -> doc_id, page, texts, boxes for ``recognized_lines``.

    Unreadable results give no row, unreadable places go with their texts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, page, reply in zip(f.doc_id, f.page, f[column]):
                try:
                    found = find_results(json.loads(reply))
                except (TypeError, ValueError):
                    found = None
                if found is not None:
                    places = found.get("rec_boxes")
                    places = found.get("rec_polys") if places is None else places
                    pairs = [(str(t), p) for t, p in zip(found["rec_texts"] or [], map(_points, places or [])) if p is not None]
                    rows.append((doc_id, page, [t for t, _ in pairs], [p for _, p in pairs]))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "texts", "boxes"])

    return pages.select("doc_id", "page", column).mapInPandas(run, "doc_id long, page int, texts array<string>, boxes array<array<array<double>>>")


def engines() -> dict[str, bool]:
    """Which recognition engines this machine has."""
    command = os.environ.get("TESSERACT_CMD", "").strip()
    return {"paddlex": importlib.util.find_spec("paddlex") is not None, "tesseract": bool(command and os.path.exists(command)) or shutil.which("tesseract") is not None}

"""How good the native text of a page is, and which way of extraction it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import area

#: US Letter and A4 pages come with their own size; this one stands in where none is known.
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0


def page_quality(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, page, chars, lines, area_ratio, duplicate_ratio, image_ratio, score.

    ``pages``: doc_id, page, width, height, image_area of every page, also of
    those without lines; else pages of the standard size without images.
    """
    t = lines.select("doc_id", "page", tx.strip(F.col("text")).alias("t"), area(F.col("bbox")).alias("a"))
    t = t.groupBy("doc_id", "page").agg(
        F.sum(F.length("t")).alias("chars"), F.count_if(F.col("t") != "").alias("lines"), F.sum("a").alias("occupied"), F.count_distinct(F.when(F.col("t") != "", F.col("t"))).alias("distinct")
    )
    if pages is not None:
        t = pages.select("doc_id", "page", (F.col("width") * F.col("height")).alias("page_area"), "image_area").join(t, ["doc_id", "page"], "left")
    else:
        t = t.withColumns({"page_area": F.lit(PAGE_WIDTH * PAGE_HEIGHT), "image_area": F.lit(0.0)})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = F.greatest(F.lit(1.0), F.col("page_area"))
    t = t.select(
        "doc_id",
        "page",
        zero("chars").cast("long").alias("chars"),
        zero("lines").cast("long").alias("lines"),
        F.least(F.lit(1.0), F.coalesce("occupied", F.lit(0.0)) / whole).alias("area_ratio"),
        (F.lit(1.0) - zero("distinct") / F.greatest(F.lit(1), zero("lines"))).alias("duplicate_ratio"),
        image_ratio(F.col("image_area"), F.col("page_area")).alias("image_ratio"),
    )
    gain = lambda ok, x: F.when(ok, x).otherwise(0.0)
    score = gain(F.col("chars") >= 30, 0.55) + gain(F.col("lines") >= 3, 0.20) + gain(F.col("area_ratio") >= 0.0003, 0.15) + gain(F.col("duplicate_ratio") < 0.25, 0.10)
    return t.withColumn("score", score)


def image_ratio(image_area: Column, page_area: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(image_area, F.lit(0.0)) / F.greatest(F.lit(1.0), page_area))


def image_dominant(ratio: Column, chars: Column, can_edit: bool) -> Column:
    return F.lit(can_edit) & (ratio >= 0.72) & (chars < 80)


def suspicious(q: DataFrame) -> Column:
    return (q["chars"] < 20) | ((q["chars"] < 80) & (q["image_ratio"] > 0.45) & (q["score"] < 0.75))


def route(q: DataFrame, mode: str = "auto", ocr: bool = False, can_edit: bool = False) -> DataFrame:
    """Adds mode, confidence and error: whether a page is native, goes to recognition or to an image editor.

    ``ocr``: whether a recognition engine is there. A page that cannot be read
    has an error in its row and does not stop the others.
    """
    native, healthy = q["lines"] > 0, (~suspicious(q)) if mode != "ocr" else F.lit(False)
    if mode == "native":
        kind = F.when(native, "native").otherwise("error")
    else:
        kind = F.when(healthy, "native").when(F.lit(ocr), "ocr").when(native, "native-fallback").otherwise("error")
    kind = F.when(image_dominant(q["image_ratio"], q["chars"], can_edit), "full-page").otherwise(kind)
    out = q.withColumn("mode", kind)
    return out.withColumns({"confidence": F.when(F.col("mode").startswith("native"), F.col("score")), "error": F.when(F.col("mode") == "error", F.lit("no text and no recognition engine"))})


def document_profile(pages: DataFrame) -> DataFrame:
    """file, page, width, height, text, image_count, drawing_count -> one nested row per file."""
    t = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    p = F.struct("page", "width", "height", (t != "").alias("has_extractable_text"), F.length(t).alias("text_chars"), "image_count", "drawing_count")
    out = pages.groupBy("file").agg(F.count(F.lit(1)).alias("page_count"), F.array_sort(F.collect_list(p)).alias("pages"), F.bool_or(t != "").alias("any"))
    return out.select("file", "page_count", "pages", F.when(F.col("any"), "native-text").otherwise("ocr-required").alias("recommended_pipeline"))

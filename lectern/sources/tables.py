"""Where rows come from: the driver tables, extractor output, recognition payloads, catalogs, and synthetic layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import box
from ..schemas import CACHE, RAW_PAGE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _box_of(values: Column) -> Column:
    at = lambda i: F.coalesce(F.get(values, i), F.lit(0.0))
    return box(at(0), at(1), at(2), at(3))


def raw_lines(pages: DataFrame, column: str = "raw") -> DataFrame:
    """doc_id, page, JSON of an extractor's blocks -> doc_id, page, ord, text, bbox, spans.

    Only text blocks count; missing fields of a span get their defaults; lines
    without spans or without text go. ``ord`` is the order in the payload.
    """
    p = pages.select("doc_id", "page", F.from_json(column, RAW_PAGE).alias("r"))
    lines = F.flatten(F.transform(F.filter(F.coalesce("r.blocks", F.array()), lambda b: b["type"] == 0), lambda b: F.coalesce(b["lines"], F.array())))
    span = lambda s: F.struct(
        F.coalesce(s["text"], F.lit("")).alias("text"),
        _box_of(s["bbox"]).alias("bbox"),
        F.coalesce(s["font"], F.lit("")).alias("font"),
        F.coalesce(s["size"], F.lit(10.0)).alias("size"),
        F.coalesce(s["color"], F.lit(0)).alias("color"),
        F.coalesce(s["flags"], F.lit(0)).alias("flags"),
    )
    p = p.select("doc_id", "page", F.posexplode(lines).alias("ord", "l"))
    p = p.select("doc_id", "page", "ord", _box_of(F.col("l.bbox")).alias("bbox"), F.transform(F.coalesce("l.spans", F.array()), span).alias("spans"))
    return p.withColumn("text", tx.join_fragments(F.transform("spans", lambda s: s["text"]))).filter("size(spans) > 0 AND text != ''").select("doc_id", "page", "ord", "text", "bbox", "spans")


def recognized_lines(pages: DataFrame, scale: float) -> DataFrame:
    """doc_id, page, texts array<string>, boxes array<array<array<double>>> (points of each text) -> lines in reading order.

    A box is four points or two corners, in pixels; ``scale`` pixels are one point.
    """
    p = pages.select("doc_id", "page", F.posexplode(F.arrays_zip("texts", "boxes")).alias("i", "r"))
    xs, ys = F.transform("r.boxes", lambda q: q[0] / scale), F.transform("r.boxes", lambda q: q[1] / scale)
    p = p.select("doc_id", "page", "i", tx.strip(F.col("r.texts")).alias("text"), box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).alias("bbox"))
    return _recognized(p.filter("text != '' AND bbox.x0 IS NOT NULL"))


def recognized_words(words: DataFrame, scale: float, least: float = 20.0) -> DataFrame:
    """doc_id, page, i, text, conf (as text), left, top, width, height -> lines of words at confidence ``least`` or more."""
    conf = F.coalesce(F.when(F.trim("conf").isin("", "-1"), F.lit(0.0)).otherwise(F.col("conf").try_cast("double")), F.lit(0.0))
    x, y = F.col("left") / scale, F.col("top") / scale
    p = words.select("doc_id", "page", "i", tx.strip(F.col("text")).alias("text"), conf.alias("c"), box(x, y, x + F.col("width") / scale, y + F.col("height") / scale).alias("bbox"))
    return _recognized(p.filter((F.col("text") != "") & (F.col("c") >= least)))


def _recognized(p: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    h = F.col("bbox.y1") - F.col("bbox.y0")
    order = Window.partitionBy("doc_id", "page").orderBy(F.bround(F.col("bbox.y0") / F.greatest(F.lit(3.0), h)), "bbox.x0", "i")
    span = F.struct("text", "bbox", F.lit("ocr").alias("font"), F.greatest(F.lit(5.0), h * 0.78).alias("size"), F.lit(0).alias("color"), F.lit(0).alias("flags"))
    return p.select("doc_id", "page", (F.row_number().over(order) - 1).alias("ord"), "text", "bbox", F.array(span).alias("spans"))


def mean_confidence(words: DataFrame) -> DataFrame:
    """doc_id, page, confidence: mean of all readable values, also of words left out, as 0 to 1."""
    ok = ~F.trim("conf").isin("", "-1")
    mean = F.avg(F.when(ok, F.col("conf").try_cast("double"))) / 100
    return words.groupBy("doc_id", "page").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(mean, F.lit(0.0)))).alias("confidence"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path)


def synthetic_lines(documents: DataFrame) -> DataFrame:
    """A layout for plain texts, to have something to measure: a line of text per line, 50 to a page, 18 points apart.

    doc_id, page, ord (in the page), text, bbox, spans. A fixture, not a behaviour.
    """
    d = documents.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    d = d.select("doc_id", F.expr("CAST(n DIV 50 AS INT)").alias("page"), F.expr("CAST(n % 50 AS INT)").alias("ord"), "text")
    y = F.lit(40.0) + F.lit(18.0) * F.col("ord")
    b = box(F.lit(50.0), y, F.lit(50.0) + F.least(F.lit(450.0), F.length("text") * 6.0), y + 10)
    span = F.struct("text", b.alias("bbox"), F.lit("F").alias("font"), F.lit(10.0).alias("size"), F.lit(0).alias("color"), F.lit(0).alias("flags"))
    return d.select("doc_id", "page", "ord", "text", b.alias("bbox"), F.array(span).alias("spans"))


def synthetic_rules(lines: DataFrame) -> DataFrame:
    """Rules beside synthetic lines: every third crosses its line, every fifth lies under it, every seventh is upright.

    doc_id, page, ord, bbox.
    """
    b = F.col("bbox")
    n = F.col("ord")
    rule = (
        F.when(n % 3 == 0, box(b["x0"], b["y0"] + 5, b["x1"], b["y0"] + 6))
        .when(n % 5 == 0, box(b["x0"], b["y1"] + 1, b["x1"], b["y1"] + 1.5))
        .when(n % 7 == 0, box((b["x0"] + b["x1"]) / 2, b["y0"] - 5, (b["x0"] + b["x1"]) / 2 + 1, b["y1"] + 5))
    )
    return lines.select("doc_id", "page", "ord", rule.alias("bbox")).filter("bbox IS NOT NULL")

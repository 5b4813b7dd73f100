"""Text regions inside images: reading a model's reply, and placing what it found on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import page_box, valid_box

REPLY = "regions array<struct<bbox:array<string>,source_text:string,translation:string,confidence:string>>"


def distinct_images(placements: DataFrame) -> DataFrame:
    """The first placement of each image on a page."""
    return placements.groupBy("doc_id", "page", "xref").agg(F.min("occ").alias("occ"))


def content_key(data: str = "bytes"):
    """Equal image bytes have equal keys: analyse one of each, then join back."""
    return F.sha2(F.col(data), 256)


def analysed_once(images: DataFrame, data: str = "bytes") -> DataFrame:
    return images.withColumn("digest", content_key(data)).dropDuplicates(["digest"])


def read_regions(replies: DataFrame) -> DataFrame:
    """digest, reply, sent_w, sent_h, scale, image_w, image_h -> digest, i, bbox_px, source_text, translation, confidence.

    Boxes are checked against the image that was sent, scaled back, and checked
    again; regions without a box or a text go.
    """
    r = replies.select("*", F.posexplode(tx.parse_reply(F.col("reply"), REPLY)["regions"]).alias("i", "r"))
    sent = valid_box(F.col("r.bbox"), F.col("sent_w"), F.col("sent_h"))
    back = lambda k: F.col("b")[k] / F.greatest(F.col("scale"), F.lit(1e-9))
    r = r.withColumn("b", sent).filter("b IS NOT NULL")
    full = F.array(*[back(k).cast("string") for k in ("x0", "y0", "x1", "y1")])
    r = r.withColumn("bbox_px", valid_box(full, F.col("image_w"), F.col("image_h")))
    text = lambda c: tx.strip(F.coalesce(F.col(c), F.lit("")))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.0))))
    r = r.select("digest", "i", "bbox_px", text("r.source_text").alias("source_text"), text("r.translation").alias("translation"), confidence.alias("confidence"))
    return r.filter("bbox_px IS NOT NULL AND source_text != '' AND translation != ''")


def place_regions(placements: DataFrame, images: DataFrame, regions: DataFrame) -> DataFrame:
    """Every placement of an image gets all its regions.

    placements: doc_id, page, xref, occ, rect; images: doc_id, page, xref,
    digest, image_w, image_h. Regions are numbered from 1 among those accepted.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("digest").orderBy("i"))
    numbered = regions.withColumn("n", n)
    at = placements.join(images, ["doc_id", "page", "xref"]).join(numbered, "digest")
    return at.select(
        "doc_id",
        "page",
        F.format_string("p%d_img%d_%d_r%d", F.col("page") + 1, "xref", "occ", "n").alias("region_id"),
        "xref",
        "occ",
        "bbox_px",
        page_box(F.col("rect"), F.col("image_w"), F.col("image_h"), F.col("bbox_px")).alias("bbox"),
        "source_text",
        "translation",
        "confidence",
    )


def by_placement(regions: DataFrame, placements: DataFrame) -> DataFrame:
    """doc_id, page, xref, occ, rect, regions: what is redrawn in each place of an image. Places that are not there have none."""
    keys = ["doc_id", "page", "xref", "occ"]
    group = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("region_id", "bbox_px", "translation"))).alias("regions"))
    return group.join(placements.select(*keys, "rect"), keys).select(*keys, "rect", "regions")


def border_color(pixels: DataFrame) -> DataFrame:
    """region_id, r, g, b of border pixels -> their upper median by channel."""
    middle = lambda c: F.element_at(F.array_sort(F.collect_list(c)), F.expr("CAST(count(1) DIV 2 + 1 AS INT)"))
    return pixels.groupBy("region_id").agg(*[middle(c).alias(c) for c in ("r", "g", "b")])


def in_reading_order(regions: DataFrame) -> DataFrame:
    return regions.orderBy("doc_id", "page", "bbox.y0", "bbox.x0", "region_id")

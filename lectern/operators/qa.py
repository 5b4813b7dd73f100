"""Checks of a rendered page: texts that collide, rules through texts, texts outside their place, and the verdict.

Every join keeps (doc_id, page) as its equal key; the geometry is a residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import area, contains, height, intersection_area, overlap_x, overlap_y, safe_box, width

PAGE = ["doc_id", "page"]


def rendered(spans: DataFrame) -> DataFrame:
    """doc_id, page, ord, text, bbox with stripped, non-empty texts."""
    return spans.select(*PAGE, "ord", tx.strip(F.col("text")).alias("text"), "bbox").filter("text != ''")


#: Cells of a page in which boxes meet, in points: a few lines high, about half a line wide.
CELL_WIDTH, CELL_HEIGHT = 256.0, 36.0


def in_cells(items: DataFrame, cell_width: float = CELL_WIDTH, cell_height: float = CELL_HEIGHT) -> DataFrame:
    """Adds cx, cy: a row for each cell of the page that a box reaches into. Boxes without an area meet nothing and go."""
    b, at = F.col("bbox"), lambda v, size: F.floor(v / size)
    cells = lambda lo, hi, size: F.explode(F.sequence(at(b[lo], size), at(b[hi], size)))
    there = items.filter((width(b) > 0) & (height(b) > 0))
    return there.withColumn("cx", cells("x0", "x1", cell_width)).withColumn("cy", cells("y0", "y1", cell_height))


def text_collisions(items: DataFrame, cell_width: float = CELL_WIDTH, cell_height: float = CELL_HEIGHT) -> DataFrame:
    """doc_id, page, a, b, area: pairs that share more than 0.4 square points and 12 % of the smaller box.

    Boxes meet by cells of the page, so work follows what is near and not the
    square of a page. A pair counts in the one cell that holds the upper left
    corner of what it shares.
    """
    dealt = in_cells(items, cell_width, cell_height)
    a = dealt.select(*PAGE, "cx", "cy", F.col("ord").alias("a"), F.col("bbox").alias("ab"))
    b = dealt.select(*PAGE, "cx", "cy", F.col("ord").alias("b"), F.col("bbox").alias("bb"))
    ab, bb = F.col("ab"), F.col("bb")
    shared = intersection_area(ab, bb)
    least = F.least(F.greatest(F.lit(1.0), area(ab)), F.greatest(F.lit(1.0), area(bb)))
    here = (F.floor(F.greatest(ab["x0"], bb["x0"]) / cell_width) == F.col("cx")) & (F.floor(F.greatest(ab["y0"], bb["y0"]) / cell_height) == F.col("cy"))
    met = a.join(b, [*PAGE, "cx", "cy"]).filter((F.col("a") < F.col("b")) & here)
    return met.filter((shared > 0.4) & (shared / least > 0.12)).select(*PAGE, "a", "b", shared.alias("area"))


def rule_crossings(items: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, page, ord, rule, type: rules that run through the body of a text."""
    r = rules.select(*PAGE, F.col("ord").alias("rule"), F.col("bbox").alias("r"))
    b, r_ = F.col("bbox"), F.col("r")
    y, x = (r_["y0"] + r_["y1"]) / 2, (r_["x0"] + r_["x1"]) / 2
    flat = (height(r_) <= 2.0) & (width(r_) >= 20)
    upright = ~flat & (width(r_) <= 2.0) & (height(r_) >= 10)
    through = lambda v, lo, hi, inset, size: (v > lo + inset * size) & (v < hi - inset * size)
    across = flat & through(y, b["y0"], b["y1"], 0.18, height(b)) & (overlap_x(r_, b) > F.least(width(r_), width(b)) * 0.35)
    down = upright & through(x, b["x0"], b["x1"], 0.12, width(b)) & (overlap_y(r_, b) > F.least(height(r_), height(b)) * 0.35)
    kind = F.when(across, "horizontal-line-crossing-text").when(down, "vertical-line-crossing-text")
    large = (width(r_) >= 20) | (height(r_) >= 20)
    return items.join(r.filter(large), PAGE).select(*PAGE, "ord", "rule", kind.alias("type")).filter("type IS NOT NULL")


def outside_safe(items: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, page, id, ord: texts that belong to an expected region (id, text, safe) and leave its safe box."""
    e = expected.filter("safe IS NOT NULL").select(*PAGE, "id", F.coalesce("text", F.lit("")).alias("needle"), "safe")
    belongs = (F.col("needle") == "") | F.col("text").contains(F.substring("needle", 1, 20)) | F.col("needle").contains(F.col("text"))
    return items.join(e, PAGE).filter(belongs & ~contains(F.col("safe"), F.col("bbox"))).select(*PAGE, "id", "ord")


def expected_regions(units: DataFrame) -> DataFrame:
    """doc_id, page, id, text, safe of the units that were placed without a warning."""
    return units.filter("warning IS NULL").select(*PAGE, F.col("unit_id").alias("id"), F.col("translation").alias("text"), safe_box(F.col("bbox")).alias("safe"))


def uncovered(lines: DataFrame, translated: DataFrame, share: float = 0.55) -> DataFrame:
    """The lines that no translated line covers by more than ``share`` of their area; they are put back as they were."""
    t = translated.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("bbox").alias("t"))
    whole = F.greatest(F.lit(1.0), width(F.col("bbox")) * height(F.col("bbox")))
    covered = intersection_area(F.col("bbox"), F.col("t")) / whole > share
    return lines.join(t, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & covered, "left_anti")


def reinserted_size(spans: Column) -> Column:
    """Size of a line that is put back: its largest span, 5.2 at least, 9.5 without spans."""
    return F.greatest(F.lit(5.2), F.coalesce(F.array_max(F.transform(spans, lambda s: s["size"])), F.lit(9.5)))


def page_verdicts(items: DataFrame, collisions: DataFrame, crossings: DataFrame, outside: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """doc_id, page, text_count, the counts of each defect, and pass. Pages in ``skipped`` (doc_id, page) pass unchecked."""
    kinds = {"text_text": collisions, "text_drawing": crossings, "outside": outside}
    rows = items.select(*PAGE, F.lit("text_count").alias("k"))
    for k, df in kinds.items():
        rows = rows.union(df.select(*PAGE, F.lit(k)))
    if skipped is not None:
        rows = rows.union(skipped.select(*PAGE, F.lit("skipped")))
    g = rows.groupBy(*PAGE).agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("text_count", *kinds, "skipped")])
    g = g.withColumn("skipped", F.col("skipped") > 0)
    return g.withColumn("pass", F.col("skipped") | ((F.col("text_text") == 0) & (F.col("text_drawing") == 0) & (F.col("outside") == 0)))


def document_verdicts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.bool_and(F.coalesce("pass", F.lit(False))).alias("validation_pass"), F.count_if(~F.coalesce("pass", F.lit(False))).alias("warnings"))

"""The nested report of a run: documents hold pages, pages hold units, counts and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def bbox_list(b: Column) -> Column:
    return F.array(b["x0"], b["y0"], b["x1"], b["y1"])


def page_keys(*frames: DataFrame) -> DataFrame:
    """Every page that any of the frames mentions."""
    keys = frames[0].select(*PAGE)
    for f in frames[1:]:
        keys = keys.union(f.select(*PAGE))
    return keys.distinct()


def component_counts(pages: DataFrame, **parts: DataFrame) -> DataFrame:
    """Rows of each part per page, 0 where it has none: one shuffle for all parts."""
    rows = pages.select(*PAGE, F.lit("").alias("k"))
    for k, df in parts.items():
        rows = rows.union(df.select(*PAGE, F.lit(k)))
    out = rows.groupBy(*PAGE).agg(F.count_if(F.col("k") == "").alias("own"), *[F.count_if(F.col("k") == k).alias(k) for k in parts])
    return out.filter("own > 0").drop("own")


def inspection(units: DataFrame, routes: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """doc_id, extraction, units: what is on the pages and how they would be read."""
    u = F.struct(F.col("page") + 1, "unit_ord", F.col("unit_id").alias("id"), "kind", "text", bbox_list(F.col("bbox")).alias("bbox"))
    per_doc = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(u)).alias("units"))
    counts = component_counts(routes, units=units, **({"image_text_regions": regions} if regions is not None else {}))
    r = routes.join(counts, PAGE)
    page = F.struct((F.col("page") + 1).alias("page"), "mode", (F.col("mode") == "ocr").alias("ocr_used"), "confidence", "error", F.round("image_ratio", 4).alias("image_ratio"), "units")
    out = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("extraction"))
    return out.join(per_doc, "doc_id", "left")


def render_report(units: DataFrame, verdicts: DataFrame, kept: DataFrame | None = None, every: DataFrame | None = None) -> DataFrame:
    """doc_id, pages, warnings, validation_pass. ``units``: with translation, final_size, warning, error.

    A unit without a translation stands in the report with its error, and its document does not pass.
    ``kept``: lines that are put back, by page; ``every``: all pages, also those that nothing stands on,
    which pass.
    """
    u = F.struct("unit_ord", F.col("unit_id").alias("id"), "kind", F.col("text").alias("source"), "translation", bbox_list(F.col("bbox")).alias("bbox"), F.col("n_lines").alias("original_line_count"), F.col("final_size").alias("final_font_size"), "warning", "error")
    check = F.struct("text_count", F.col("text_text").alias("text_text_collisions"), F.col("text_drawing").alias("text_drawing_collisions"), F.col("outside").alias("outside_safe_regions"), "pass", "skipped")
    line = F.struct("ord", "text", bbox_list(F.col("bbox")).alias("bbox"), F.col("final_size").alias("final_font_size"))
    # all parts as rows of one table: they are dealt out once, by document, for its pages and for itself
    rows = units.select(*PAGE, u.alias("unit"), (F.col("warning").isNotNull() | F.col("error").isNotNull()).alias("warned"), F.col("error").isNotNull().alias("gone"))
    back = kept if kept is not None else units.filter("false").selectExpr(*PAGE, "unit_ord AS ord", "text", "bbox", "size AS final_size")
    parts = [verdicts.select(*PAGE, check.alias("check"), F.lit(True).alias("named")), back.select(*PAGE, line.alias("line"))]
    for part in [*parts, *([every.select(*PAGE, F.lit(True).alias("named"))] if every is not None else [])]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    filled = lambda c: F.nullif(F.array_sort(F.collect_list(c)), F.array())
    all_pages = rows.repartition("doc_id").groupBy(*PAGE).agg(
        filled("unit").alias("units"), F.first("check", True).alias("validation"), filled("line").alias("kept_lines"), F.count_if("warned").alias("warned"), F.count_if("gone").alias("lost"), F.bool_or(F.col("unit").isNotNull() | F.coalesce("named", F.lit(False))).alias("named")
    ).filter("named")
    failed = ~F.coalesce("validation.pass", F.col("units").isNull())
    lost = F.coalesce("lost", F.lit(0))
    page = F.struct((F.col("page") + 1).alias("page"), "units", "validation", "kept_lines")
    return all_pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(page)).alias("pages"), (F.coalesce(F.sum("warned"), F.lit(0)) + F.sum(failed.cast("long"))).alias("warnings"), F.bool_and(~failed & (lost == 0)).alias("validation_pass")
    )


def summary(reports: DataFrame) -> DataFrame:
    """line: what a console shows of each document, in order of doc_id."""
    units = F.aggregate("pages", F.lit(0), lambda n, p: n + F.coalesce(F.size(p["units"]), F.lit(0)))
    state = F.when(F.col("validation_pass"), "passed").otherwise("failed")
    return reports.orderBy("doc_id").select(F.format_string("document %s: %d pages, %d units, %d warnings, checks %s", F.col("doc_id").cast("string"), F.size("pages"), units, "warnings", state).alias("line"))

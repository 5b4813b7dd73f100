"""Translation units: cells of tables, and runs of lines that read as one block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import box, center_x, width
from .grids import cell_lines, match_grid

PAGE = ["doc_id", "page"]


def dominant(spans: Column) -> Column:
    """The span with the longest text; the first of equals; null without spans."""
    ranked = F.transform(spans, lambda s, i: F.struct((-F.length(s["text"])).alias("n"), i.alias("i"), s.alias("s")))
    return F.array_min(F.transform(ranked, lambda r: F.struct(r["n"].alias("n"), r["i"].alias("i"), r["s"]["font"].alias("font"), r["s"]["size"].alias("size"), r["s"]["color"].alias("color"), r["s"]["flags"].alias("flags"))))


def dominant_of(lines: Column) -> Column:
    """The longest of the lines' own ``dominant`` styles; of equals that of the first line. Texts need not be gathered for it."""
    known = F.filter(lines, lambda x: x["style"].isNotNull())
    ranked = lambda x: F.struct(x["style"]["n"].alias("n"), x["ord"].alias("ord"), x["style"].alias("s"))
    return F.array_min(F.transform(known, ranked))["s"]


def continues(b: Column, size: Column, pb: Column, psize: Column) -> Column:
    """Whether a line goes on with the block of the line before it."""
    gap = b["y0"] - pb["y1"]
    title = lambda x: (width(x) > 150) & (center_x(x) > 160) & (center_x(x) < 435)
    titles = (pb["y0"] < 285) & (b["y0"] < 285) & title(pb) & title(b) & (gap <= 30)
    body = (gap >= 3) & (gap <= 12) & ~((pb["y0"] < 215) & (b["y0"] < 215)) & (width(pb) >= 300) & (width(b) >= 300) & (F.abs(pb["x0"] - b["x0"]) <= 25)
    return (F.abs(psize - size) <= 0.8) & (titles | body)


def group_lines(lines: DataFrame) -> DataFrame:
    """Adds style (of its longest span), n (place in reading order) and block (number of its block on the page)."""
    order = Window.partitionBy(*PAGE).orderBy("bbox.y0", "bbox.x0", "ord")
    t = lines.withColumn("style", dominant(F.col("spans"))).withColumn("_size", F.coalesce("style.size", F.lit(10.0)))
    t = t.withColumns({"_pb": F.lag("bbox").over(order), "_ps": F.lag("_size").over(order), "n": F.row_number().over(order) - 1})
    starts = F.col("_pb").isNull() | ~continues(F.col("bbox"), F.col("_size"), F.col("_pb"), F.col("_ps"))
    return t.withColumn("block", (F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("int")).drop("_size", "_pb", "_ps")


def kind(n: Column, widest: Column, mean_center: Column, first_x0: Column, chars: Column, page_width: Column) -> Column:
    return (
        F.when((n <= 2) & (widest > page_width * 0.25) & (F.abs(mean_center - page_width / 2) < page_width * 0.22), "title")
        .when((n == 1) & (widest < page_width * 0.45) & (first_x0 < page_width * 0.25), "heading")
        .when((n >= 3) & (widest >= page_width * 0.45), "paragraph")
        .when(chars < 90, "label")
        .otherwise("paragraph")
    )


def text_units(lines: DataFrame, page_width: float = 595.0, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, page, block, text, bbox, n_lines, kind, font, size, color, flags, lines: a unit per block.

    Equal window and grouping keys: (doc_id, page) is shuffled once. ``pages``
    (doc_id, page, width) knows the width of its pages; the others have ``page_width``.
    """
    g = group_lines(lines)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("n").alias("ord"), "text", "bbox", "style")))
    u = g.groupBy(*PAGE, "block").agg(ordered.alias("lines"))
    boxes = F.transform("lines", lambda x: x["bbox"])
    side = lambda f, k: f(F.transform(boxes, lambda b: b[k]))
    n = F.size("lines")
    mean = F.aggregate(boxes, F.lit(0.0), lambda a, b: a + center_x(b)) / n
    widest = F.array_max(F.transform(boxes, width))
    texts = F.transform("lines", lambda x: x["text"])
    u = u.withColumn("style", dominant_of(F.col("lines")))
    style, across = F.col("style"), F.lit(page_width)
    if pages is not None:
        u = u.join(pages.select(*PAGE, F.col("width").alias("_across")), PAGE, "left")
        across = F.coalesce("_across", across)
    return u.select(
        *PAGE,
        "block",
        tx.strip(F.array_join(texts, "\n")).alias("text"),
        box(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")).alias("bbox"),
        n.alias("n_lines"),
        kind(n, widest, mean, F.get(boxes, 0)["x0"], F.length(F.array_join(texts, " ")), across).alias("kind"),
        F.coalesce(style["font"], F.lit("")).alias("font"),
        F.coalesce(style["size"], F.lit(10.0)).alias("size"),
        F.coalesce(style["color"], F.lit(0)).alias("color"),
        F.coalesce(style["flags"], F.lit(0)).alias("flags"),
        F.transform("lines", lambda x: x["bbox"]).alias("line_boxes"),
    )


def cell_units(cells: DataFrame) -> DataFrame:
    """A unit per occupied cell and row: its box is the whole band by the column."""
    key = [*PAGE, "top", "bottom", "x0", "x1", "col", "row_key"]
    styled = cells.withColumn("style", dominant(F.col("spans"))).drop("spans").repartition(*PAGE)  # for the groups and the window
    g = styled.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("bbox.x0", "ord", "text", "bbox", "style"))).alias("lines"))
    g = g.withColumn("style", dominant_of(F.col("lines")))
    style = F.col("style")
    order = Window.partitionBy(*PAGE).orderBy("row_key", "x0", "top", "col")
    return g.select(
        *PAGE,
        (F.row_number().over(order)).alias("cell"),
        tx.strip(F.array_join(F.transform("lines", lambda x: x["text"]), " ")).alias("text"),
        box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")).alias("bbox"),
        F.size("lines").alias("n_lines"),
        F.lit("table_cell").alias("kind"),
        F.coalesce(style["font"], F.lit("")).alias("font"),
        F.coalesce(style["size"], F.lit(10.0)).alias("size"),
        F.coalesce(style["color"], F.lit(0)).alias("color"),
        F.coalesce(style["flags"], F.lit(0)).alias("flags"),
        F.transform("lines", lambda x: x["bbox"]).alias("line_boxes"),
    )


def segment(lines: DataFrame, language: str, grids: DataFrame | None = None, page_width: float = 595.0, pages: DataFrame | None = None) -> DataFrame:
    """All units of all pages: doc_id, page, unit_id, unit_ord, text, bbox, n_lines, kind, style.

    ``unit_id`` is unique in its document: p{page}_t001.. for cells, then
    p{page}_u{n} with n going on after the cells.
    """
    source = lines.filter(tx.is_source_text(F.col("text"), language))
    if grids is None:
        u = text_units(source, page_width, pages)
        ordinal = F.col("block") + 1
        return _named(u, ordinal, "u").drop("block")
    placed = match_grid(source, grids)
    cells = cell_units(cell_lines(placed))
    blocks = text_units(placed.filter("grid IS NULL").drop("grid"), page_width, pages)
    counts = cells.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("cells"))
    blocks = blocks.join(counts, PAGE, "left")
    text = _named(blocks, F.col("block") + 1 + F.coalesce("cells", F.lit(0)), "u").drop("block", "cells")
    return _named(cells, F.col("cell"), "t").drop("cell").unionByName(text)


def _named(units: DataFrame, ordinal: Column, letter: str) -> DataFrame:
    return units.withColumns({"unit_ord": ordinal.cast("int"), "unit_id": F.format_string(f"p%d_{letter}%03d", F.col("page") + 1, ordinal.cast("int"))})

"""Table grids from thin rules, the cells they make, and spans cut at cell borders."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import box, center_x, center_y, cluster, height, overlap_x, width

PAGE = ["doc_id", "page"]


def is_horizontal(b: Column) -> Column:
    return (width(b) >= 30) & (height(b) <= 1.5)


def is_vertical(b: Column) -> Column:
    return ~is_horizontal(b) & (height(b) >= 10) & (width(b) <= 1.5)


def detect_grids(rules: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """doc_id, page, bbox of rules -> doc_id, page, grid_ord, top, bottom, xs: row bands with two columns or more. Rules are read and dealt out by page once."""
    b = F.col("bbox")
    flat = F.collect_list(F.when(is_horizontal(b), b["y0"]))
    upright = F.collect_list(F.when(is_vertical(b), F.struct(b["x0"].alias("x"), b["y0"].alias("y0"), b["y1"].alias("y1"))))
    pages = rules.filter("doc_id IS NOT NULL AND page IS NOT NULL").groupBy(*PAGE).agg(cluster(flat, tolerance).alias("ys"), upright.alias("upright")).filter("size(ys) > 1")
    bands = F.transform(F.sequence(F.lit(0), F.size("ys") - 2), lambda i: F.struct(F.get("ys", i).alias("top"), F.get("ys", i + 1).alias("bottom")))
    spanning = lambda g: F.filter("upright", lambda u: (u["y0"] <= g["top"] + 2) & (u["y1"] >= g["bottom"] - 2))
    found = F.transform(F.filter(bands, lambda g: g["bottom"] - g["top"] >= 12), lambda g: F.struct(g["top"].alias("top"), g["bottom"].alias("bottom"), cluster(F.transform(spanning(g), lambda u: u["x"]), tolerance).alias("xs")))
    grids = pages.select(*PAGE, F.posexplode(F.filter(found, lambda g: F.size(g["xs"]) >= 3)).alias("grid_ord", "g"))
    return grids.select(*PAGE, "grid_ord", "g.top", "g.bottom", "g.xs")


def match_grid(lines: DataFrame, grids: DataFrame) -> DataFrame:
    """Adds grid (null beside all grids): the first band, in grid order, that holds a line's middle. Its x is not looked at."""
    y = center_y(F.col("bbox"))
    on_page = grids.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("grid_ord", "top", "bottom", "xs"))).alias("_grids"))
    holding = F.filter("_grids", lambda g: (y >= g["top"] - 2) & (y <= g["bottom"] + 2))
    return lines.join(on_page, PAGE, "left").withColumn("grid", F.get(holding, 0)).drop("_grids")


def nearest_blank(t: str, at: int) -> int:
    """Where the blank inside a text is that is nearest to ``at``, the first of equals; ``at`` where there is none. Looks outwards from there."""
    n = len(t)
    for d in range(max(at, n - at)):
        for i in (at - d, at + d):
            if 0 < i < n - 1 and t[i].isspace():
                return i
    return at


def cut_text(text: str, x0: float, x1: float, borders: list[float]) -> list[tuple[str, float, float]]:
    """A text from x0 to x1 cut at the borders it crosses, in proportion to its characters, at the nearest blank inside if it has one."""
    pieces = [(text, x0, x1)]
    for border in borders:
        out = []
        for t, a, z in pieces:
            n = len(t)
            if n < 2 or not a < border < z:
                out.append((t, a, z))
                continue
            at = max(1, min(n - 1, round(n * ((border - a) / max(0.001, z - a)))))
            at = nearest_blank(t, at)
            middle = a + (z - a) * (at / n)
            out += [(t[:at], a, middle), (t[at:], middle, z)]
        pieces = out
    return pieces


def cut_spans(lines: DataFrame) -> DataFrame:
    """Lines with a grid -> the same with ``pieces``: their spans, cut at the inner borders of the grid. Only spans and borders go through Arrow batches, and lines stay where their page is."""

    @F.arrow_udf(returnType=lines.schema["spans"].dataType)
    def pieces(spans: pa.Array, xs: pa.Array) -> pa.Array:
        out = []
        for line, borders in zip(spans.to_pylist(), xs.to_pylist()):
            cut = [(s, *p) for s in line or [] for p in cut_text(s["text"] or "", s["bbox"]["x0"], s["bbox"]["x1"], borders[1:-1])]
            out.append([s | {"text": t, "bbox": s["bbox"] | {"x0": a, "x1": z}} for s, t, a, z in cut])
        return pa.array(out, spans.type)

    inside = lines.filter("grid IS NOT NULL").select(*PAGE, "ord", "grid", "bbox", "spans")
    return inside.withColumn("pieces", pieces("spans", "grid.xs"))


def cell_lines(lines: DataFrame) -> DataFrame:
    """Lines with a grid -> one row per line and column that holds a span's middle (within 1 point, so a span near a
    border stands in both): doc_id, page, ord, grid, col, x0, x1, row_key, text, bbox, spans. Spans outside go."""
    xs = F.col("grid.xs")
    cut = cut_spans(lines)
    columns = F.transform(F.sequence(F.lit(0), F.size(xs) - 2), lambda i: F.struct(i.alias("col"), F.get(xs, i).alias("x0"), F.get(xs, i + 1).alias("x1")))
    c = cut.select(*PAGE, "ord", "grid", "pieces", (F.bround(F.col("bbox.y0") / 2) * 2).alias("row_key"), F.explode(columns).alias("c"))
    inside = F.filter("pieces", lambda s: (center_x(s["bbox"]) >= F.col("c.x0") - 1) & (center_x(s["bbox"]) <= F.col("c.x1") + 1))
    c = c.withColumn("spans", inside).filter("size(spans) > 0")
    by_left = F.array_sort(F.transform("spans", lambda s, i: F.struct(s["bbox"]["x0"].alias("x"), i.alias("i"), s["text"].alias("t"))))
    side = lambda f, k: f(F.transform("spans", lambda s: s["bbox"][k]))
    return c.select(
        *PAGE,
        "ord",
        F.col("grid.top").alias("top"),
        F.col("grid.bottom").alias("bottom"),
        "c.col",
        "c.x0",
        "c.x1",
        "row_key",
        tx.strip(F.array_join(F.transform(by_left, lambda t: t["t"]), "")).alias("text"),
        box(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")).alias("bbox"),
        "spans",
    )


def table_borders(rules: DataFrame, grids: DataFrame) -> DataFrame:
    """The rules that belong to a grid: near its top or bottom and along it, or upright near one of its columns."""
    b = F.col("bbox")
    g = grids.select(*PAGE, "top", "bottom", "xs")
    lies = (F.least(F.abs(b["y0"] - F.col("top")), F.abs(b["y0"] - F.col("bottom"))) < 1.5) & (F.greatest(F.lit(0.0), F.least(b["x1"], F.array_max("xs")) - F.greatest(b["x0"], F.array_min("xs"))) > 30)
    stands = F.exists("xs", lambda x: F.abs(b["x0"] - x) < 1.5) & (height(b) > 10)
    return rules.join(g, (rules["doc_id"] == g["doc_id"]) & (rules["page"] == g["page"]) & (lies | stands), "left_semi")


def decorations(rules: DataFrame, lines: DataFrame, grids: DataFrame) -> DataFrame:
    """Thin rules under or through the given lines that are no table borders."""
    thin = rules.filter((height(F.col("bbox")) <= 1.5) & (width(F.col("bbox")) >= 25))
    own = table_borders(thin, grids).select(*PAGE, "ord")
    free = thin.join(own, [*PAGE, "ord"], "left_anti").select(*PAGE, "ord", "bbox")
    t = lines.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("bbox").alias("t"))
    r = F.col("bbox")
    near = (overlap_x(r, F.col("t")) >= F.least(width(r), width(F.col("t"))) * 0.55) & (r["y0"] >= F.col("t.y0") - 1.5) & (r["y0"] <= F.col("t.y1") + 1.5)
    return free.join(t, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & near, "left_semi")

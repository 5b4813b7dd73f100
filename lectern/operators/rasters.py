"""Pictures as arrays: tiles, colours around a region, scaling by area, and filling of erased regions.

A raster is a row with id, width, height and pixels (RGB, a byte a channel, row by
row). Work on it is exact integer arithmetic on tiles, so that the order in which
tiles arrive does not matter. A picture is read as one value anyway; its tiles are
spread, so that one large picture is not one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import sent_size

TILE = 256
RASTER = "id string, width int, height int, pixels binary"
#: A region's colour comes from the pixels above and below the first eighth of its width, and left and right of the first eighth of its height.
SHARE = 8


def tiles(rasters: DataFrame, tile: int = TILE) -> DataFrame:
    """id, width, height, tx, ty, w, h, pixels of each tile. Rasters whose pixels are not width * height * 3 bytes stop the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, width, height, pixels in zip(*[c.to_pylist() for c in rows.columns]):
                a = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
                cut = [(x // tile, y // tile, a[y : y + tile, x : x + tile]) for y in range(0, height, tile) for x in range(0, width, tile)]
                n = len(cut)
                cols = [pa.array([name] * n, pa.string()), *[pa.array([v] * n, pa.int32()) for v in (width, height)]]
                cols += [pa.array(v, pa.int32()) for v in ([c[0] for c in cut], [c[1] for c in cut], [c[2].shape[1] for c in cut], [c[2].shape[0] for c in cut])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([c[2].tobytes() for c in cut], pa.binary())], NAMES)

    there = rasters.select("id", "width", "height", "pixels").filter("id IS NOT NULL AND width > 0 AND height > 0")
    return there.mapInArrow(run, "id string, width int, height int, tx int, ty int, w int, h int, pixels binary").repartition("id", "tx", "ty")


NAMES = ["id", "width", "height", "tx", "ty", "w", "h", "pixels"]


def joined(cut: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of (id, width, height, tx, ty, pixels) -> rasters."""

    def run(rows: pa.Table) -> pa.Table:
        width, height = rows["width"][0].as_py(), rows["height"][0].as_py()
        out = np.zeros((height, width, 3), np.uint8)
        for tx, ty, pixels in zip(rows["tx"].to_pylist(), rows["ty"].to_pylist(), rows["pixels"].to_pylist()):
            part = out[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
            part[:] = np.frombuffer(pixels, np.uint8).reshape(part.shape)
        return pa.table({"id": rows["id"].slice(0, 1), "width": rows["width"].slice(0, 1), "height": rows["height"].slice(0, 1), "pixels": pa.array([out.tobytes()], pa.binary())})

    return cut.select("id", "width", "height", "tx", "ty", "pixels").groupBy("id").applyInArrow(run, RASTER)


def in_pixels(bbox: Column, width: Column, height: Column) -> Column:
    """A box of an image in whole pixels, inside it: rounded to even halves, ends in order of a slice."""
    whole = lambda k, most: F.least(F.greatest(F.bround(bbox[k]).cast("int"), F.lit(0)), most)
    return F.struct(whole("x0", width).alias("x0"), whole("y0", height).alias("y0"), whole("x1", width).alias("x1"), whole("y1", height).alias("y1"))


def border_colors(rasters: DataFrame, regions: DataFrame, tile: int = TILE) -> DataFrame:
    """region_id, id, r, g, b, samples: the upper median of each channel of the pixels beside a region (region_id, id, box in pixels x0, y0, x1, y1).

    Regions that have no pixel beside them give no row. Regions go to the tiles that
    their border touches; a tile answers with a histogram, and these add up.
    """
    size = rasters.select("id", "width", "height")
    wide = F.greatest(F.lit(1), F.expr(f"(x1 - x0) DIV {SHARE}"))
    high = F.greatest(F.lit(1), F.expr(f"(y1 - y0) DIV {SHARE}"))
    part = lambda x0, y0, x1, y1: F.struct(x0.alias("a"), y0.alias("b"), x1.alias("c"), y1.alias("d"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    right, low = F.least(x1, x0 + wide), F.least(y1, y0 + high)
    strips = F.array(part(x0, y0 - 1, right, y0), part(x0, y1, right, y1 + 1), part(x0 - 1, y0, x0, low), part(x1, y0, x1 + 1, low))
    s = regions.select("region_id", "id", "x0", "y0", "x1", "y1").filter("x1 > x0 AND y1 > y0").join(size, "id").select("region_id", "id", "width", "height", F.explode(strips).alias("s"))
    s = s.filter("s.a >= 0 AND s.b >= 0 AND s.c <= width AND s.d <= height AND s.c > s.a AND s.d > s.b")
    over = lambda lo, hi: F.explode(F.sequence(F.expr(f"CAST(s.{lo} DIV {tile} AS INT)"), F.expr(f"CAST((s.{hi} - 1) DIV {tile} AS INT)")))
    s = s.withColumn("tx", over("a", "c")).withColumn("ty", over("b", "d"))
    asked = s.groupBy("id", "tx", "ty").agg(F.collect_list(F.struct("region_id", "s.a", "s.b", "s.c", "s.d")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for name, tx, ty, w, h, pixels, wanted in zip(*[c.to_pylist() for c in rows.columns]):
                a = np.frombuffer(pixels, np.uint8).reshape(h, w, 3)
                for q in wanted:
                    got = a[max(0, q["b"] - ty * tile) : max(0, q["d"] - ty * tile), max(0, q["a"] - tx * tile) : max(0, q["c"] - tx * tile)].reshape(-1, 3)
                    for c in range(3):
                        v, n = np.unique(got[:, c], return_counts=True)
                        out += [(q["region_id"], name, c, int(x), int(k)) for x, k in zip(v, n)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["region_id", "id", "c", "v", "n"])

    cut = tiles(rasters, tile).select("id", "tx", "ty", "w", "h", "pixels").join(asked, ["id", "tx", "ty"])
    seen = cut.mapInArrow(run, "region_id string, id string, c int, v int, n long").groupBy("region_id", "id", "c", "v").agg(F.sum("n").alias("n"))
    per = seen.groupBy("region_id", "id", "c").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"), F.sum("n").alias("total"))  # 256 values at most
    at = F.expr("total DIV 2")
    walk = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("v")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when((s["v"] < 0) & (s["seen"] + x["n"] > at), x["v"]).otherwise(s["v"]).alias("v")))["v"]
    per = per.select("region_id", "id", "c", "total", walk.alias("v"))
    channel = lambda i: F.max(F.when(F.col("c") == i, F.col("v")))
    return per.groupBy("region_id", "id").agg(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), F.max("total").alias("samples"))


def overlaps(a: int, z: int, before: int, after: int) -> tuple[int, np.ndarray]:
    """Of the source pixels a..z of a side with ``before`` pixels scaled to ``after``: the first target pixel they reach, and
    a matrix targets x sources of shared lengths, in parts of which a source pixel has ``after`` and a target pixel ``before``."""
    first, last = a * after // before, (z * after - 1) // before
    target, source = np.arange(first, last + 1)[:, None], np.arange(a, z)[None, :]
    return first, np.maximum(0, np.minimum((target + 1) * before, (source + 1) * after) - np.maximum(target * before, source * after)).astype(np.int64)


def scaled(rasters: DataFrame, longest: int, tile: int = TILE) -> DataFrame:
    """Rasters with no side over ``longest``: each target pixel is the mean of the area it covers, halves up. Smaller ones stay as they are."""
    size = sent_size(F.col("width"), F.col("height"), longest)
    sized = rasters.select("id", "width", "height", "pixels", size.alias("s"))
    same = sized.filter("s.scale = 1.0").select("id", "width", "height", "pixels")
    cut = tiles(sized.filter("s.scale < 1.0"), tile)
    cut = cut.withColumn("s", sent_size(F.col("width"), F.col("height"), longest)).select(*NAMES, F.col("s.w").alias("sw"), F.col("s.h").alias("sh"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, width, height, tx, ty, w, h, pixels, sw, sh in zip(*[c.to_pylist() for c in rows.columns]):
                a = np.frombuffer(pixels, np.uint8).reshape(h, w, 3).astype(np.int64)
                x, across = overlaps(tx * tile, tx * tile + w, width, sw)
                y, down = overlaps(ty * tile, ty * tile + h, height, sh)
                total = np.einsum("ij,jkc,lk->ilc", down, a, across, optimize=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip((name, width, height, sw, sh, x, y, total.shape[1], total.shape[0], total.tobytes()), (pa.string(), *[pa.int32()] * 8, pa.binary()))],
                    ["id", "width", "height", "sw", "sh", "x", "y", "w", "h", "total"],
                )

    def whole(rows: pa.Table) -> pa.Table:
        name, width, height, sw, sh = (rows[c][0].as_py() for c in ("id", "width", "height", "sw", "sh"))
        out = np.zeros((sh, sw, 3), np.int64)
        for x, y, w, h, total in zip(*[rows[c].to_pylist() for c in ("x", "y", "w", "h", "total")]):
            out[y : y + h, x : x + w] += np.frombuffer(total, np.int64).reshape(h, w, 3)
        area = width * height
        mean = ((2 * out + area) // (2 * area)).astype(np.uint8)
        return pa.table({"id": pa.array([name]), "width": pa.array([sw], pa.int32()), "height": pa.array([sh], pa.int32()), "pixels": pa.array([mean.tobytes()], pa.binary())})

    parts = cut.mapInArrow(part, "id string, width int, height int, sw int, sh int, x int, y int, w int, h int, total binary")
    return same.unionByName(parts.groupBy("id").applyInArrow(whole, RASTER))


def harmonic(a: np.ndarray, hole: np.ndarray, close: float = 1e-4) -> np.ndarray:
    """``a`` (rows x columns x channels) with the ``hole`` filled so that each pixel there is the mean of its neighbours in the picture: conjugate gradients on all channels at once."""
    out = a.astype(np.float64)
    if not hole.any() or hole.all():
        return out
    padded = lambda v: np.pad(v, ((1, 1), (1, 1), (0, 0)))
    around = lambda v: v[:-2, 1:-1] + v[2:, 1:-1] + v[1:-1, :-2] + v[1:-1, 2:]
    degree = around(padded(np.ones((*hole.shape, 1))))
    m = hole[:, :, None]
    apply = lambda v: np.where(m, degree * v - around(padded(np.where(m, v, 0.0))), 0.0)
    b = np.where(m, around(padded(np.where(m, 0.0, out))), 0.0)
    x = np.where(m, out[~hole].mean(0), 0.0)
    r = b - apply(x)
    p, rs = r.copy(), (r * r).sum((0, 1))
    for _ in range(20 * int(hole.sum() ** 0.5) + 200):
        if (np.sqrt(rs) < close).all():
            break
        ap = apply(p)
        step = rs / np.maximum((p * ap).sum((0, 1)), 1e-300)
        x += step * p
        r -= step * ap
        new = (r * r).sum((0, 1))
        p = r + new / np.maximum(rs, 1e-300) * p
        rs = new
    out[hole] = x[hole]
    return out


def erased(rasters: DataFrame, regions: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """Rasters with their regions (id, x0, y0, x1, y1 in pixels) filled.

    With ``colors`` (region_id, id, r, g, b of ``border_colors``; regions then have a
    region_id) by one colour, in the order of region_id; regions without a colour
    stay. Else smoothly, from what stands around: all regions of a picture are one
    hole, pixels outside keep their value. A picture that is all hole stays.
    """
    keys = ["x0", "y0", "x1", "y1"]
    if colors is not None:
        asked = regions.join(colors, ["region_id", "id"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("region_id", *keys, "r", "g", "b"))).alias("holes"))
    else:
        asked = regions.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("holes"))
    there = rasters.select("id", "width", "height", "pixels").join(asked, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for width, height, pixels, holes in zip(*[rows.column(c).to_pylist() for c in ("width", "height", "pixels", "holes")]):
                a = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
                if holes:
                    a = a.copy()
                    mask = np.zeros((height, width), bool)
                    for q in holes:
                        at = (slice(max(0, q["y0"]), max(0, q["y1"])), slice(max(0, q["x0"]), max(0, q["x1"])))
                        mask[at] = True
                        if "r" in q:
                            a[at] = (q["r"], q["g"], q["b"])
                    if "r" not in holes[0] and not mask.all():
                        a[mask] = np.clip(np.floor(harmonic(a, mask)[mask] + 0.5), 0, 255).astype(np.uint8)
                out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("width"), rows.column("height"), pa.array(out, pa.binary())], ["id", "width", "height", "pixels"])

    return there.mapInArrow(run, T.StructType([T.StructField("id", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())]))

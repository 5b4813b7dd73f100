"""Rasters on tiles against plain numpy on whole pictures."""

import numpy as np
import pytest

from lectern.operators import rasters

REGION = "region_id string, id string, x0 int, y0 int, x1 int, y1 int"


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(3)
    return {name: rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for name, w, h in (("a", 70, 33), ("b", 5, 90), ("c", 1, 1), ("d", 32, 32))}


def frame(spark, pictures):
    return spark.createDataFrame([(k, v.shape[1], v.shape[0], bytearray(v.tobytes())) for k, v in pictures.items()], rasters.RASTER)


def back(df):
    return {r["id"]: np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(r["height"], r["width"], 3) for r in df.collect()}


def test_tiles_are_put_together_again(spark, pictures):
    cut = rasters.tiles(frame(spark, pictures), 16)
    assert cut.count() == 5 * 3 + 6 + 1 + 4
    got = back(rasters.joined(cut, 16))
    assert set(got) == set(pictures) and all((got[k] == v).all() for k, v in pictures.items())


def median_beside(a, x0, y0, x1, y1):
    found = []
    for x in range(x0, min(x1, x0 + max(1, (x1 - x0) // 8))):
        found += [a[y0 - 1, x]] if y0 > 0 else []
        found += [a[y1, x]] if y1 < len(a) else []
    for y in range(y0, min(y1, y0 + max(1, (y1 - y0) // 8))):
        found += [a[y, x0 - 1]] if x0 > 0 else []
        found += [a[y, x1]] if x1 < a.shape[1] else []
    return tuple(int(sorted(p[c] for p in found)[len(found) // 2]) for c in range(3)) if found else None


def test_colours_beside_regions(spark, pictures):
    boxes = [("a", 0, 0, 70, 33), ("a", 3, 2, 60, 30), ("a", 15, 15, 17, 17), ("a", 16, 0, 70, 16), ("b", 1, 10, 4, 80), ("b", 0, 0, 5, 1), ("c", 0, 0, 1, 1), ("d", 4, 4, 4, 9), ("a", 40, 1, 66, 32)]
    regions = spark.createDataFrame([(f"r{i}", *b) for i, b in enumerate(boxes)], REGION)
    got = {r["region_id"]: (r["r"], r["g"], r["b"]) for r in rasters.border_colors(frame(spark, pictures), regions, 16).collect()}
    want = {f"r{i}": median_beside(pictures[k], *b) for i, (k, *b) in enumerate(boxes) if b[2] > b[0]}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_scaling_is_the_mean_of_areas(spark, pictures):
    got = back(rasters.scaled(frame(spark, pictures), 31, 16))
    assert (got["c"] == pictures["c"]).all()
    for k in ("a", "b", "d"):
        a = pictures[k]
        h, w = a.shape[:2]
        sh, sw = got[k].shape[:2]
        assert max(sh, sw) == 31
        share = lambda n, m: np.array([[max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) for j in range(n)] for i in range(m)]) * m / n
        mean = np.einsum("ij,jkc,lk->ilc", share(h, sh), a.astype(float), share(w, sw))
        assert np.abs(got[k] - mean).max() <= 0.5 + 1e-9


def solved(a, hole):
    """The harmonic fill by one system of equations."""
    at = {p: i for i, p in enumerate(zip(*np.nonzero(hole)))}
    m, b = np.zeros((len(at), len(at))), np.zeros((len(at), a.shape[2]))
    for (y, x), i in at.items():
        for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1]:
                m[i, i] += 1
                if q in at:
                    m[i, at[q]] -= 1
                else:
                    b[i] += a[q]
    out = a.astype(float)
    out[hole] = np.linalg.solve(m, b)
    return out


def test_holes_are_filled_smoothly(spark, pictures):
    regions = [("x", "a", 3, 2, 30, 20), ("y", "a", 25, 15, 70, 33), ("z", "b", 0, 0, 5, 40), ("w", "c", 0, 0, 1, 1), ("v", "d", 9, 9, 9, 20)]
    got = back(rasters.erased(frame(spark, pictures), spark.createDataFrame(regions, REGION)))
    for k, a in pictures.items():
        hole = np.zeros(a.shape[:2], bool)
        for _, i, x0, y0, x1, y1 in regions:
            if i == k:
                hole[y0:y1, x0:x1] = True
        assert (got[k][~hole] == a[~hole]).all()
        if hole.any() and not hole.all():
            want = solved(a, hole)
            assert np.abs(rasters.harmonic(a, hole) - want).max() < 1e-3
            assert np.abs(got[k].astype(float) - want)[hole].max() <= 0.5 + 1e-3
    assert (got["c"] == pictures["c"]).all() and (got["d"] == pictures["d"]).all()


def test_holes_are_filled_with_one_colour(spark, pictures):
    regions = spark.createDataFrame([("x", "a", 3, 2, 30, 20), ("y", "a", 25, 15, 60, 30), ("z", "c", 0, 0, 1, 1)], REGION)
    raster = frame(spark, pictures)
    got = back(rasters.erased(raster, regions, rasters.border_colors(raster, regions, 16)))
    want = pictures["a"].copy()
    want[2:20, 3:30] = median_beside(pictures["a"], 3, 2, 30, 20)
    want[15:30, 25:60] = median_beside(pictures["a"], 25, 15, 60, 30)
    assert (got["a"] == want).all() and (got["c"] == pictures["c"]).all()

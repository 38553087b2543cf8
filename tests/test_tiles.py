import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import metrics, quantiles, tiles

RNG = np.random.default_rng(3)


def frame(spark, images):
    """Rows of {image: {value: 2-D array}}; pixels that are no number are left out."""
    rows, names = [], list(next(iter(images.values())))
    for img, values in images.items():
        high, wide = next(iter(values.values())).shape
        rows += [(img, y, x, *(float(values[n][y, x]) for n in names)) for y in range(high) for x in range(wide) if not any(math.isnan(values[n][y, x]) for n in names)]
    return spark.createDataFrame(rows, "img long, y int, x int, " + ", ".join(f"{n} double" for n in names))


def box(grid):
    """Sums of 3 x 3 pixels by plain loops."""
    padded = np.pad(np.nan_to_num(grid), 1)
    return np.array([[padded[y : y + 3, x : x + 3].sum() for x in range(grid.shape[1])] for y in range(grid.shape[0])])


def test_a_filter_over_tiles_is_the_filter_over_the_picture(spark):
    a, b = RNG.normal(0, 1, (23, 17)), RNG.normal(0, 1, (5, 40))
    a[3, 4] = math.nan
    df = frame(spark, {1: {"v": a}, 7: {"v": b}})
    three = lambda g: {"s": tiles.separable(g["v"], [1.0, 1.0, 1.0])}
    got = {(r.img, r.y, r.x): r.s for r in tiles.pixels(df, ["img"], ["v"], 1, three, ["s"], side=8).collect()}
    want = {(i, y, x): v for i, g in ((1, a), (7, b)) for (y, x), v in np.ndenumerate(box(g)) if not math.isnan(g[y, x])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    total = {r.img: (r.n, r.s) for r in tiles.sums(df, ["img"], ["v"], 1, three, ["s"], side=3).collect()}
    for i in (1, 7):
        own = [v for k, v in want.items() if k[0] == i]
        assert total[i] == (len(own), pytest.approx(sum(own)))
    with pytest.raises(ValueError):
        tiles.sums(df, ["img"], ["v"], 5, three, ["s"], side=10)


def test_similarity_over_borders_of_tiles(spark):
    p, t = RNG.uniform(0, 1, (70, 67)), RNG.uniform(0, 1, (70, 67))
    w = np.array(metrics.gaussian())
    blur = lambda a: sum(w[i] * w[j] * np.pad(a, 5)[i : i + 70, j : j + 67] for i in range(11) for j in range(11))
    mp, mt = blur(p), blur(t)
    index = (2 * mp * mt + 1e-4) * (2 * (blur(p * t) - mp * mt) + 9e-4) / ((mp**2 + mt**2 + 1e-4) * (blur(p * p) - mp**2 + blur(t * t) - mt**2 + 9e-4))
    df = frame(spark, {0: {"pred": p, "gt": t}}).withColumn("c", F.lit(2))
    assert metrics.ssim(df, ["img"]).first().ssim == pytest.approx(index.mean())


def test_scores_of_equal_images_and_empty_masks(spark):
    ramp = np.add.outer(np.arange(9.0), np.arange(9.0)) / 20
    df = frame(spark, {0: {"pred": ramp, "gt": ramp, "mask": np.ones((9, 9))}, 1: {"pred": ramp, "gt": ramp + 0.5, "mask": np.zeros((9, 9))}})
    mse = df.groupBy("img").agg(metrics.masked_mean((F.col("pred") - F.col("gt")) ** 2, F.col("mask")).alias("m"))
    assert {r.img: r.p for r in mse.select("img", metrics.psnr(F.col("m")).alias("p")).collect()} == {0: math.inf, 1: None}
    depth = {r.img: (r.scale, r.error) for r in metrics.scale_invariant(df, ["img"]).collect()}
    assert depth[0] == (pytest.approx(1), pytest.approx(0)) and depth[1] == (None, None)
    steep = {r.img: r.l1 for r in metrics.gradient_l1(df.withColumn("e", F.col("pred") - F.col("gt")), ["img"], "e").collect()}
    assert steep == {0: 0.0, 1: None}


def test_normals_where_depth_is_zero_or_missing(spark):
    z = np.ones((6, 6))
    z[4:, :] = 0
    wx, wy = (np.arange(6.0) * z, np.arange(6.0)[:, None] * z)
    holed = wx.copy()
    holed[1, 1] = math.nan
    rows = {(r.img, r.y, r.x): (r.nx, r.ny, r.nz) for r in metrics.surface_normals(frame(spark, {0: {"wx": wx, "wy": wy, "wz": z}, 1: {"wx": holed, "wy": wy, "wz": z}}), ["img"]).collect()}
    assert len(rows) == 71
    assert rows[0, 2, 2] == (0, 0, -1) and rows[0, 5, 2] == rows[0, 0, 2] == (0, 0, 0)
    assert rows[0, 1, 2] == (0, 0, -1) and rows[1, 1, 2] == rows[1, 2, 1] == (0, 0, 0)
    assert all(math.isfinite(v) for n in rows.values() for v in n)


@pytest.mark.parametrize("values", [[1.0] * 1990 + list(range(2, 12)), [5.0] * 3000, [*range(1000), *[500.0] * 2000, *[501.0] * 3]])
def test_quantiles_of_heavy_values(spark, monkeypatch, values):
    monkeypatch.setattr(quantiles, "SORTED", 100)
    monkeypatch.setattr(quantiles, "RANGES", 8)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    shares = [0.0, 0.1, 0.5, 0.9, 0.995, 0.9999, 1.0]
    assert quantiles.exact(df, "v", shares) == pytest.approx(np.quantile(values, shares))

"""Rectified pictures against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import rectify, tiles

K = [0.12, -0.03, 0.004, -0.002]
CAMERA = "cam string, fx double, fy double, cx double, cy double, width int, height int, k array<double>"


def bent(u, v, k):
    r2 = u * u + v * v
    radial = 1 + k[0] * r2 + k[1] * r2 * r2
    return u * radial + 2 * k[2] * u * v + k[3] * (r2 + 2 * u * u), v * radial + k[2] * (r2 + 2 * v * v) + 2 * k[3] * u * v


def linear(image, u, v):
    """Zero beyond the border, one place at a time."""
    x, y = int(np.floor(u)), int(np.floor(v))
    get = lambda i, j: image[i, j] if 0 <= i < image.shape[0] and 0 <= j < image.shape[1] else 0.0
    a, b = u - x, v - y
    return (1 - b) * ((1 - a) * get(y, x) + a * get(y, x + 1)) + b * ((1 - a) * get(y + 1, x) + a * get(y + 1, x + 1))


def rows_of(spark, name, image):
    return spark.createDataFrame([(name, y, x, float(image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])], "cam string, y int, x int, v double")


def test_straightened_undoes_bent(spark):
    rng = np.random.default_rng(5)
    at = rng.uniform(-0.8, 0.8, (200, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in at], "u double, v double")
    k = [F.lit(x) for x in K]
    u, v = g.bent(F.col("u"), F.col("v"), k)
    back = df.select("u", "v", u.alias("bu"), v.alias("bv")).select("u", "v", "bu", "bv", g.straightened(F.col("bu"), F.col("bv"), k).alias("s")).collect()
    assert all(abs(r.s.u - r.u) < 1e-12 and abs(r.s.v - r.v) < 1e-12 for r in back)
    assert np.allclose([(r.bu, r.bv) for r in back], [bent(r.u, r.v, K) for r in back], atol=1e-14)
    flat = spark.range(1).select(g.straightened(F.lit(1.0), F.lit(0.0), [F.lit(-1 / 3), *[F.lit(0.0)] * 3]).alias("s")).first().s
    assert flat is None  # the place lies beyond the fold


def test_optimal_cameras(spark):
    rows = [("plain", 50.0, 60.0, 40.0, 30.0, 80, 64, [0.0] * 4), ("barrel", 50.0, 60.0, 40.0, 30.0, 80, 64, K), ("fold", 1.0, 1.0, 0.0, 0.0, 2, 2, [-1 / 3, 0.0, 0.0, 0.0]), ("none", 50.0, 60.0, 40.0, 30.0, 80, 64, None)]
    found = {r.cam: r for r in rectify.optimal_cameras(spark.createDataFrame(rows, CAMERA), ["cam"]).collect()}
    p = found["plain"]
    assert np.allclose([p.nfx, p.nfy, p.ncx, p.ncy], [50, 60, 40, 30])
    assert found["fold"].nfx is None and found["none"].nfx is None
    # every border place by plain repetition
    side = {}
    for name, at in (("left", [(0, i / 8 * 63) for i in range(9)]), ("right", [(79, i / 8 * 63) for i in range(9)]), ("top", [(i / 8 * 79, 0) for i in range(9)]), ("bottom", [(i / 8 * 79, 63) for i in range(9)])):
        x, y = np.array([((a - 40) / 50, (b - 30) / 60) for a, b in at]).T
        u, v = x, y
        for _ in range(300):
            bu, bv = bent(u, v, K)
            u, v = u + (x - bu) * 0.5, v + (y - bv) * 0.5
        side[name] = u if name in ("left", "right") else v
    x0, x1, y0, y1 = side["left"].max(), side["right"].min(), side["top"].max(), side["bottom"].min()
    b = found["barrel"]
    assert np.allclose([b.nfx, b.nfy, b.ncx, b.ncy], [79 / (x1 - x0), 63 / (y1 - y0), -79 / (x1 - x0) * x0, -63 / (y1 - y0) * y0], atol=1e-9)


def test_sampled_over_tiles(spark):
    rng = np.random.default_rng(6)
    image = rng.uniform(size=(11, 150))
    at = np.concatenate([rng.uniform(-3, 155, (150, 2)) * [1, 0.08], [(63.5, 3.5), (64.0, 0.0), (63.999, 10.0), (149.0, 10.0), (149.5, 10.5), (-0.5, -0.5), (-9.0, 400.0)]])
    asked = spark.createDataFrame([("a", i, float(u), float(v)) for i, (u, v) in enumerate(at)] + [("a", 900, None, 1.0), ("a", 901, 1.0, float("nan")), ("b", 902, 1.0, 1.0)], "cam string, id int, u double, v double")
    renamed = rows_of(spark, "a", image).withColumnRenamed("v", "value")
    found = {r.id: r.value for r in tiles.sampled(renamed, asked, ["cam"], ["value"]).collect()}
    assert len(found) == len(at) + 3 and found[900] == found[901] == found[902] == 0
    assert all(abs(found[i] - linear(image, u, v)) < 1e-12 for i, (u, v) in enumerate(at))
    assert tiles.sampled(renamed, asked.limit(0), ["cam"], ["value"]).count() == 0
    assert {r.value for r in tiles.sampled(renamed.limit(0), asked, ["cam"], ["value"]).collect()} == {0.0}


def test_pinhole_pictures(spark):
    image = np.random.default_rng(7).uniform(size=(64, 80))
    cameras = spark.createDataFrame([("a", 50.0, 60.0, 40.0, 30.0, 80, 64, K), ("b", 1.0, 1.0, 0.0, 0.0, 2, 2, [-1 / 3, 0.0, 0.0, 0.0])], CAMERA)
    o = rectify.optimal_cameras(cameras, ["cam"]).where("cam = 'a'").first()
    rows = rectify.pinhole(rows_of(spark, "a", image).withColumnRenamed("v", "value"), cameras, ["cam"], ["value"]).collect()
    assert len(rows) == 64 * 80 and {r.cam for r in rows} == {"a"}
    for r in rows[::7]:
        u, v = bent((r.x - o.ncx) / o.nfx, (r.y - o.ncy) / o.nfy, K)
        assert abs(r.value - linear(image, 50 * u + 40, 60 * v + 30)) < 1e-9
    # the rectangle touches border places, between which the curve may leave the picture by a little
    assert sum(r["mask"] == 255 for r in rows) > 0.97 * len(rows)


@pytest.mark.parametrize("model", ["linear", "spherical"])
def test_fisheye_pictures(spark, model):
    image = np.random.default_rng(8).uniform(size=(40, 60))
    k, p, s = [0.05, -0.01, 0.002, 0.0, 0.0, 0.0001], [0.001, -0.002], [0.0005, 0.0001, -0.0004, 0.0003]
    cameras = spark.createDataFrame([("a", 25.0, 29.0, 20.0, 60, 40, k, p, s)], "cam string, f double, cx double, cy double, width int, height int, k array<double>, p array<double>, s array<double>")
    rows = rectify.fisheye(rows_of(spark, "a", image).withColumnRenamed("v", "value"), cameras, ["cam"], ["value"], 12.0, 25, model).collect()
    assert len(rows) == 25 * 37  # 25 / 40 * 60 = 37.5
    outside = 0
    for r in rows:
        a, b = (r.x - 18) / 12, (r.y - 12) / 12
        n = np.hypot(a, b)
        angle = np.arctan(n) if model == "linear" else n
        scale = angle * (1 + sum(c * angle ** (2 * i + 2) for i, c in enumerate(k))) / n if n else 1.0
        u, v = a * scale, b * scale
        r2 = u * u + v * v
        along = 2 * (u * p[0] + v * p[1])
        u, v = 25 * (u + u * along + p[0] * r2 + s[0] * r2 + s[1] * r2**2) + 29, 25 * (v + v * along + p[1] * r2 + s[2] * r2 + s[3] * r2**2) + 20
        inside = 0 <= u <= 59 and 0 <= v <= 39 and angle < np.pi / 2
        outside += not inside
        want = (linear(image, u, v), 255, int(255 * v / 39)) if inside else (0.0, 0, 0)
        assert abs(r.value - want[0]) < 1e-9 and (r["mask"], r["row"]) == want[1:]
    assert 0 < outside < len(rows)
    with pytest.raises(ValueError, match="not a camera model"):
        rectify.fisheye(rows_of(spark, "a", image), cameras, ["cam"], ["v"], 12.0, 25, "flat")

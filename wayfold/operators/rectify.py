"""Rectified pictures: the optimal matrix of an undistorted camera, maps into fisheye pictures, and what goes with a picture.

A camera is a row of parameters; places are column expressions, pixels are sampled by tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import tiles


def optimal_cameras(cameras: DataFrame, keys: list[str], grid: int = 9) -> DataFrame:
    """(keys, nfx, nfy, ncx, ncy): the pinhole camera that shows the greatest upright rectangle without invalid pixels.

    ``cameras`` has keys, fx, fy, cx, cy, width, height and ``k``, two radial and two tangential terms. ``grid`` places on each
    border of the picture are straightened; the rectangle inside them fills a picture of the same size. It is null where the
    distortion can't be undone at the border, or where no such rectangle is left.
    """
    i = F.col("i") / (grid - 1)
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), x.alias("a"), y.alias("b")) for n, x, y in (("left", F.lit(0.0), i), ("right", F.lit(1.0), i), ("top", i, F.lit(0.0)), ("bottom", i, F.lit(1.0))))))
    rows = cameras.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("place", sides)
    x, y = ((F.col(f"place.{a}") * (F.col(size) - 1) - F.col(f"c{c}")) / F.col(f"f{c}") for a, size, c in (("a", "width", "x"), ("b", "height", "y")))
    at = rows.withColumn("at", g.straightened(x, y, [F.col("k")[n] for n in range(4)]))
    on = lambda side, f, c: f(F.when(F.col("place.side") == side, F.col(f"at.{c}")))
    inner = at.groupBy(*keys).agg(F.max("width").alias("w"), F.max("height").alias("h"), on("left", F.max, "u").alias("x0"), on("right", F.min, "u").alias("x1"), on("top", F.max, "v").alias("y0"), on("bottom", F.min, "v").alias("y1"), F.count_if(F.col("at").isNull()).alias("lost"))
    fits = (F.col("lost") == 0) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    fx, fy = (F.when(fits, F.try_divide(F.col(n) - 1.0, F.col(f"{c}1") - F.col(f"{c}0"))) for n, c in (("w", "x"), ("h", "y")))
    return inner.select(*keys, fx.alias("nfx"), fy.alias("nfy"), (-fx * F.col("x0")).alias("ncx"), (-fy * F.col("y0")).alias("ncy"))


def _pixels(cameras: DataFrame, height: Column, width: Column) -> DataFrame:
    rows = cameras.withColumn("y", F.explode(F.sequence(F.lit(0), height.cast("int") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), width.cast("int") - 1)))


def _byte(x: Column) -> Column:
    """Cut to a byte; rounded first, so that 255 doesn't become 254 by its last digit."""
    return F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)), 6)).cast("int")


def pinhole(pictures: DataFrame, cameras: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, y, x, values, mask): pictures of distorted pinhole cameras under their optimal matrix; ``mask`` is 255 where all is inside, less on the border.

    ``pictures`` has keys, y, x and values, ``cameras`` a row for each key as :func:`optimal_cameras` takes it. Pictures of
    cameras without such a matrix give no rows.
    """
    both = cameras.join(optimal_cameras(cameras, keys).where("nfx is not null"), keys)
    u, v = (F.col("x") - F.col("ncx")) / F.col("nfx"), (F.col("y") - F.col("ncy")) / F.col("nfy")
    rows = _pixels(both, F.col("height"), F.col("width")).withColumn("p", u).withColumn("q", v)
    a, b = g.bent(F.col("p"), F.col("q"), [F.col("k")[n] for n in range(4)])
    asked = rows.select(*keys, "y", "x", (F.col("fx") * a + F.col("cx")).alias("u"), (F.col("fy") * b + F.col("cy")).alias("v"))
    found = tiles.sampled(pictures.select(*keys, "y", "x", *values, F.lit(1.0).alias("_one")), asked, keys, [*values, "_one"])
    return found.select(*keys, "y", "x", *values, _byte(F.col("_one") * 255).alias("mask"))


def fisheye(pictures: DataFrame, cameras: DataFrame, keys: list[str], values: list[str], focal: float, height: int, model: str = "linear") -> DataFrame:
    """(keys, y, x, values, mask, row): fisheye pictures as a linear or spherical camera of ``focal`` and ``height`` sees them.

    ``cameras`` has keys, f, cx, cy, width, height and ``k`` (6), ``p`` (2), ``s`` (4) of ``geometry.fisheye_pixel``. The new width
    keeps the old shape, cut to a whole number; the new centre is the picture's. ``values`` may hold a vignette, or a mask of its
    own. ``row`` (0 to 255) tells which row of the old picture, from first to last, a pixel was read out with. Pixels that lie
    outside the old picture are zero in all columns.
    """
    if model not in ("linear", "spherical"):
        raise ValueError(f"{model} is not a camera model: linear or spherical")
    width = F.floor(height / F.col("height") * F.col("width"))
    rows = _pixels(cameras.withColumn("_w", width), F.lit(height), F.col("_w"))
    a, b = (F.col("x") - (F.col("_w") - 1) / 2) / focal, (F.col("y") - (height - 1) / 2) / focal
    rows = rows.withColumn("_a", a).withColumn("_b", b)
    a, b = F.col("_a"), F.col("_b")
    ray = [a, b, F.lit(1.0)]
    if model == "spherical":
        r = F.sqrt(a * a + b * b)
        ray = [*(F.when(r > 0, c * F.sin(r) / r).otherwise(0.0) for c in (a, b)), F.cos(r)]
    u, v = g.fisheye_pixel(ray, F.col("f"), [F.col("cx"), F.col("cy")], *([F.col(c)[n] for n in range(size)] for c, size in (("k", 6), ("p", 2), ("s", 4))))
    rows = rows.withColumn("_u", u).withColumn("_v", v)
    inside = F.coalesce((F.col("_u") >= 0) & (F.col("_u") <= F.col("width") - 1) & (F.col("_v") >= 0) & (F.col("_v") <= F.col("height") - 1), F.lit(False))
    read = F.when(inside, _byte(F.try_divide(F.col("_v"), F.col("height") - 1) * 255)).otherwise(0)
    asked = rows.select(*keys, "y", "x", F.when(inside, F.col("_u")).alias("u"), F.when(inside, F.col("_v")).alias("v"), F.coalesce(read, F.lit(0)).alias("row"))
    found = tiles.sampled(pictures.select(*keys, "y", "x", *values), asked, keys, values)
    return found.select(*keys, "y", "x", *values, F.when(F.col("u").isNotNull(), 255).otherwise(0).alias("mask"), "row")

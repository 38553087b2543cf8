"""Image and geometry scores as aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import tiles

C1, C2 = 1e-4, 9e-4  # fixed values: the stabilisers of structural similarity on [0, 1]


def psnr(mse: Column) -> Column:
    """Infinite for images without an error."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.try_divide(F.lit(1.0), F.sqrt(mse))))


def masked_mean(value: Column, mask: Column) -> Column:
    """The mean under the mask; null where nothing is under it, so that means over frames leave such a frame out."""
    return F.try_divide(F.sum(value * mask), F.sum(mask))


def huber(error: Column, delta: float) -> Column:
    e = F.abs(error)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def gaussian(size: int = 11, sigma: float = 1.5) -> list[float]:
    w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)]
    return [x / sum(w) for x in w]


def _index(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    w = gaussian()
    p, t = g["pred"], g["gt"]
    mp, mt = tiles.separable(p, w), tiles.separable(t, w)
    pp, tt, pt = tiles.separable(p * p, w) - mp * mp, tiles.separable(t * t, w) - mt * mt, tiles.separable(p * t, w) - mp * mt
    return {"total": (2 * mp * mt + C1) * (2 * pt + C2) / ((mp * mp + mt * mt + C1) * (pp + tt + C2))}


def ssim(df: DataFrame, image: list[str]) -> DataFrame:
    """Mean structural similarity of ``gt`` and ``pred`` for each image; pixels have c, y and x. Beyond the border is zero."""
    return tiles.sums(df, image, ["pred", "gt"], 5, _index, ["total"], "c").select(*image, (F.col("total") / F.col("n")).alias("ssim"))


def scores(distances: DataFrame, thresholds: list[float], sigma: float) -> DataFrame:
    """precision, recall and f of distances ``d`` labelled way = 'p' or 'r', at each threshold (strict)."""
    rows = distances.select("way", "d", F.explode(F.array(*map(F.lit, thresholds))).alias("tau"))
    share = lambda w: F.avg(F.when(F.col("way") == w, (F.col("d") < F.col("tau")).cast("double")))
    both = rows.groupBy("tau").agg(share("p").alias("precision"), share("r").alias("recall"))
    f = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.select("tau", "precision", "recall", f.alias("f"), (F.col("tau") >= 2 * sigma).alias("trustworthy"))


def distance_summary(d: Column, median: float, p95: float) -> list[Column]:
    """count, mean, the given median and 95th percentile in cm, shares below 5 and 10 cm."""
    return [F.count(d).alias("n"), F.round(100 * F.avg(d), 4).alias("mean_cm"), F.round(F.lit(100 * median), 4).alias("median_cm"), F.round(F.lit(100 * p95), 4).alias("p95_cm"), F.round(F.avg((d < 0.05).cast("double")), 6).alias("below_5cm"), F.round(F.avg((d < 0.10).cast("double")), 6).alias("below_10cm")]


def eroded(df: DataFrame, keys: list[str], mask: str = "mask", by: int = 2) -> DataFrame:
    """``df`` (keys, y, x, ...) with the least mask within ``by`` pixels on either axis; nothing counts beyond the border."""
    low = lambda group, axis: F.min(mask).over(Window.partitionBy(*group).orderBy(axis).rangeBetween(-by, by))
    return df.withColumn(mask, low([*keys, "y"], "x")).withColumn(mask, low([*keys, "x"], "y"))


def squared_mask(df: DataFrame, keys: list[str], width: int, side: int) -> DataFrame:
    """Masks (keys, y, x, mask) of ``width`` columns and ``side`` rows, resampled linearly to squares and cut at a half."""
    at = (F.col("x") + 0.5) * width / side - 0.5
    base = F.floor(at).cast("int")
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(width - 1))
    taps = F.array(F.struct(inside(base).alias("from"), (1 - (at - base)).alias("w")), F.struct(inside(base + 1).alias("from"), (at - base).alias("w")))
    # a row of pixels asks for the same columns in every mask, so only these 2 * side taps are sent
    asked = df.sparkSession.range(side).select(F.col("id").cast("int").alias("x")).select("x", F.inline(taps))
    have = df.select(*keys, "y", F.col("x").alias("from"), "mask").where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "y")))
    return have.join(F.broadcast(asked), "from").groupBy(*keys, "y", "x").agg((F.sum(F.col("w") * F.col("mask")) > 0.5).cast("int").alias("mask"))


def remapped(image: DataFrame, asked: DataFrame, keys: list[str], value: str, show: list[str] | None = None) -> DataFrame:
    """(keys, id, value, and the columns ``show`` of ``asked``): linear samples of ``image`` (keys, y, x, value) at ``asked`` (keys, id, u, v and more); zero beyond the border."""
    show = show or []
    return tiles.sampled(image, asked.select(*keys, "id", *dict.fromkeys(["u", "v", *show])), keys, [value]).select(*keys, "id", value, *show)


def scale_invariant(df: DataFrame, image: list[str]) -> DataFrame:
    """(image, scale, error) of depths gt and pred under the eroded mask: the scale and the squared error are of masked pixels alone; a prediction of zeros counts as ones. Null where nothing is masked."""
    rows = eroded(df, image)
    m = F.col("mask")
    zero = rows.groupBy(*image).agg((F.sum(F.col("pred") ** 2 * m) <= 1e-6).alias("_zero"))
    rows = rows.join(zero, image).withColumn("pred", F.when(F.col("_zero"), 1.0).otherwise(F.col("pred")))
    p, t = F.col("pred"), F.col("gt")
    # the error of the best scale follows from three sums
    sums = rows.groupBy(*image).agg(F.sum(m).alias("n"), F.sum(t * p * m).alias("tp"), F.sum(p * p * m).alias("pp"), F.sum(t * t * m).alias("tt"))
    s = F.try_divide(F.col("tp"), F.col("pp"))
    return sums.select(*image, s.alias("scale"), F.try_divide(s * s * F.col("pp") - 2 * s * F.col("tp") + F.col("tt"), F.col("n")).alias("error"))


def inverse_depth_losses(error: Column, std: Column, delta: float = 0.1) -> dict[str, Column]:
    """Mean L1, Huber and L2 losses of an inverse-depth error, plain and weighted by 1 / std (L2: 1 / std^2)."""
    return {
        "l1": F.avg(F.abs(error)), "huber": F.avg(huber(error, delta)), "l2": F.avg(error * error),
        "l1_weighted": F.avg(F.abs(error) / std), "huber_weighted": F.avg(huber(error, delta) / std), "l2_weighted": F.avg(error * error / (std * std)),
    }


def bernoulli_kl(rho: float, mean: Column) -> Column:
    """Divergence of a Bernoulli mean from ``rho``."""
    return rho * F.log(F.lit(rho) / (mean + 1e-5)) + (1 - rho) * F.log(F.lit(1 - rho) / (1 - mean + 1e-5))


#: The 5 x 5 gradient along x; along y it is transposed.
GRADIENT = [[-1, -2, 0, 2, 1], [-2, -4, 0, 4, 2], [-3, -6, 0, 6, 3], [-2, -4, 0, 4, 2], [-1, -2, 0, 2, 1]]


def _gradients(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    e = g["_value"]
    both = np.abs(tiles.weighted(e, GRADIENT)) + np.abs(tiles.weighted(e, [list(r) for r in zip(*GRADIENT, strict=True)]))
    m = g["mask"][2:-2, 2:-2]
    return {"total": both * m, "masked": m}


def gradient_l1(df: DataFrame, image: list[str], value: str) -> DataFrame:
    """(image, l1): absolute x and y gradients of the difference ``value`` (image, y, x, mask), summed under the mask over its pixels; zero beyond the border, null where nothing is masked."""
    found = tiles.sums(df.withColumn("_value", F.col(value)), image, ["_value", "mask"], 2, _gradients, ["total", "masked"])
    return found.select(*image, F.try_divide("total", "masked").alias("l1"))


def _normal(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    p = np.stack([g["wx"], g["wy"], g["wz"]], axis=-1)
    n = np.cross(p[2:, 1:-1] - p[:-2, 1:-1], p[1:-1, 2:] - p[1:-1, :-2])
    size = np.linalg.norm(n, axis=-1)
    beside = g["there"][2:, 1:-1] * g["there"][:-2, 1:-1] * g["there"][1:-1, 2:] * g["there"][1:-1, :-2]
    n = np.where((beside * size > 0)[..., None], n / np.where(size > 0, size, 1)[..., None], 0.0)
    return {"nx": n[..., 0], "ny": n[..., 1], "nz": n[..., 2]}


def surface_normals(df: DataFrame, image: list[str]) -> DataFrame:
    """(image, y, x, nx, ny, nz): unit normals of points (wx, wy, wz) by central differences, from row to row and from column to column.

    Zero at the border, beside missing pixels, and where the differences span nothing.
    """
    return tiles.pixels(df.withColumn("there", F.lit(1.0)), image, ["wx", "wy", "wz", "there"], 1, _normal, ["nx", "ny", "nz"])


def matched(predictions: DataFrame, truth: DataFrame, key: str, order: str) -> DataFrame:
    """Predictions with their truth by ``key``: the last of several truths by ``order``; a prediction without one is an error."""
    last = truth.groupBy(key).agg(F.max_by(F.struct(*truth.columns), order).alias("truth"))
    both = predictions.join(last, key, "left")
    return both.withColumn("truth", F.when(F.col("truth").isNull(), F.raise_error(F.concat(F.lit("no truth for "), F.coalesce(key, F.lit("null")))).cast(both.schema["truth"].dataType)).otherwise(F.col("truth")))


def histogram_mode(df: DataFrame, value: str, low: Column, high: Column, bins: int) -> DataFrame:
    """One row (bin, n, middle): the fullest of ``bins`` equal bins, the last one closed; ties to the lowest."""
    x = F.col(value)
    at = F.least(F.floor((x - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
    ends = df.agg(low.alias("_low"), high.alias("_high"))
    rows = df.join(F.broadcast(ends)).where((x >= F.col("_low")) & (x <= F.col("_high"))).groupBy("_low", "_high", at.alias("bin")).agg(F.count("*").alias("n"))
    best = rows.agg(F.max_by(F.struct("bin", "n", "_low", "_high"), F.struct("n", -F.col("bin"))).alias("b"))
    return best.select("b.bin", "b.n", (F.col("b._low") + (F.col("b.bin") + 0.5) * (F.col("b._high") - F.col("b._low")) / bins).alias("middle"))

"""Image filters by tiles with a halo: a pixel travels to its own tile and to those whose border it is within reach of.

A tile has ``side`` x ``side`` pixels of its own and ``halo`` more on each side, so a filter is one pass over arrays of a
fixed size, whatever the picture's size, and a pixel is sent about (1 + 2 halo / side)^2 times instead of once for
each tap. Pixels that don't exist count as zero and give no result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 64

#: From the arrays of values, halo included, the arrays of results without it.
Filter = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def _dealt(df: DataFrame, image: list[str], plane: list[str], values: list[str], halo: int, side: int):  # noqa: ANN202
    if side <= 2 * halo:
        raise ValueError("a tile must be wider than its halo on both sides")
    reach = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))))
    rows = df.select(*image, *plane, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *(F.col(v).cast("double").alias(v) for v in values))
    return rows.withColumn("_ty", reach("y")).withColumn("_tx", reach("x")).groupBy(*image, "_ty", "_tx")


def _filtered(table: pa.Table, plane: list[str], values: list[str], halo: int, side: int, apply: Filter):  # noqa: ANN202
    """For each plane of a tile: its value, places of its own pixels, and the results there."""
    column = {c: table.column(c).to_numpy() for c in ("y", "x", *values)}
    y, x = (column[c] - int(table.column(f"_t{c}")[0].as_py()) * side + halo for c in ("y", "x"))
    of, names = (None, None)
    if plane:
        coded = table.column(plane[0]).combine_chunks().dictionary_encode()
        of, names = coded.indices.to_numpy(), coded.dictionary
    wide = side + 2 * halo
    for p in range(len(names)) if plane else [None]:
        some = slice(None) if p is None else of == p
        grids = {v: np.zeros((wide, wide)) for v in values}
        there = np.zeros((wide, wide), bool)
        there[y[some], x[some]] = True
        for v, grid in grids.items():
            grid[y[some], x[some]] = column[v][some]
        own = there[halo : halo + side, halo : halo + side]
        if own.any():
            i, j = np.nonzero(own)
            with np.errstate(divide="ignore", invalid="ignore"):
                yield (names[p].as_py() if plane else None), i, j, {n: r[i, j] for n, r in apply(grids).items()}


def pixels(df: DataFrame, image: list[str], values: list[str], halo: int, apply: Filter, results: list[str], side: int = SIDE) -> DataFrame:
    """(image, y, x, results) for each pixel of ``df`` (image, y, x, values); results that are no number are null."""
    kinds = dict(df.select(*image).dtypes)

    def run(table: pa.Table) -> pa.Table:
        out = [[] for _ in (*image, "y", "x", *results)]
        top, left = (int(table.column(f"_t{c}")[0].as_py()) * side for c in ("y", "x"))
        for _, i, j, found in _filtered(table, [], values, halo, side, apply):
            keys = [pa.array([table.column(c)[0].as_py()] * len(i), table.schema.field(c).type) for c in image]
            out = [*keys, pa.array(i + top), pa.array(j + left), *(pa.array(found[n], pa.float64(), mask=~np.isfinite(found[n])) for n in results)]
        return pa.Table.from_arrays(out if len(out[0]) else [pa.array([], table.schema.field(c).type if c in image else pa.int64() if c in "yx" else pa.float64()) for c in (*image, "y", "x", *results)], [*image, "y", "x", *results])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in image), "y long, x long", *(f"{n} double" for n in results)])
    return _dealt(df, image, [], values, halo, side).applyInArrow(run, schema)


def sums(df: DataFrame, image: list[str], values: list[str], halo: int, apply: Filter, results: list[str], plane: str | None = None, side: int = SIDE) -> DataFrame:
    """(image, n, results): each result summed over an image's pixels, and their number; planes are filtered one by one."""
    kinds = dict(df.select(*image).dtypes)
    own = [plane] if plane else []

    def run(table: pa.Table) -> pa.Table:
        n, total = 0, dict.fromkeys(results, 0.0)
        for _, i, _, found in _filtered(table, own, values, halo, side, apply):
            n += len(i)
            for r in results:
                total[r] += float(found[r].sum())
        rows = int(n > 0)
        keys = [pa.array([table.column(c)[0].as_py()] * rows, table.schema.field(c).type) for c in image]
        return pa.Table.from_arrays([*keys, pa.array([n] * rows, pa.int64()), *(pa.array([total[r]] * rows, pa.float64()) for r in results)], [*image, "n", *results])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in image), "n long", *(f"{r} double" for r in results)])
    return _dealt(df, image, own, values, halo, side).applyInArrow(run, schema).groupBy(*image).agg(F.sum("n").alias("n"), *(F.sum(r).alias(r) for r in results))


def sampled(df: DataFrame, asked: DataFrame, image: list[str], values: list[str], side: int = SIDE) -> DataFrame:
    """``asked`` (image, u, v and more) with linear samples of ``values`` of ``df`` (image, y, x, values) at column u and row v.

    A place goes to the tile it lies in, which has a halo of one pixel, so neither pixels nor places are sent once for each of
    the four. Pixels that don't exist count as zero; a place without u or v gets zeros.
    """
    kinds = dict(asked.dtypes)
    own = [c for c in asked.columns if c not in image]
    tile = lambda c: F.coalesce(F.floor(F.col(c) / side).cast("long"), F.lit(-2).cast("long"))
    places = asked.withColumn("_ty", tile("v")).withColumn("_tx", tile("u")).groupBy(*image, "_ty", "_tx")

    def run(key: tuple, pixels_: pa.Table, found: pa.Table) -> pa.Table:
        top, left = (key[len(image) + i].as_py() * side - 1 for i in (0, 1))
        u, v = (found.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "uv")
        there = np.isfinite(u) & np.isfinite(v)
        u, v = np.where(there, u, left), np.where(there, v, top)
        j, i = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        a, b = u - j, v - i
        out = [found.column(c) for c in (*image, *own)]
        for name in values:
            grid = np.zeros((side + 3, side + 3))
            if len(pixels_):
                grid[pixels_.column("y").to_numpy() - top, pixels_.column("x").to_numpy() - left] = pixels_.column(name).to_numpy()
            i0, j0 = i - top, j - left
            value = (1 - b) * ((1 - a) * grid[i0, j0] + a * grid[i0, j0 + 1]) + b * ((1 - a) * grid[i0 + 1, j0] + a * grid[i0 + 1, j0 + 1])
            out.append(pa.array(np.where(there, value, 0.0)))
        return pa.Table.from_arrays(out, [*image, *own, *values])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*image, *own)), *(f"`{v}` double" for v in values)])
    return _dealt(df, image, [], values, 1, side).cogroup(places).applyInArrow(run, schema)


def separable(grid: np.ndarray, weights: list[float]) -> np.ndarray:
    """Sums with the same weights along both axes; the result lacks the halo."""
    n = len(weights)
    along = sum(w * grid[:, k : grid.shape[1] - n + 1 + k] for k, w in enumerate(weights))
    return sum(w * along[k : grid.shape[0] - n + 1 + k] for k, w in enumerate(weights))


def weighted(grid: np.ndarray, weights: list[list[float]]) -> np.ndarray:
    """Sums with a square table of weights; the result lacks the halo."""
    n = len(weights)
    high, wide = (s - n + 1 for s in grid.shape)
    return sum(float(weights[i][j]) * grid[i : i + high, j : j + wide] for i in range(n) for j in range(n) if weights[i][j])

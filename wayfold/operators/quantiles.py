"""Exact quantiles of tables of any size: ranges are counted first, and only the ones that hold a rank are sorted."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are sorted at once, and sent to the driver for it, at most; and ranges counted at a time.
SORTED, RANGES = 1_000_000, 256


def _at(df: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values of ranks from 0 among the n of ``v``.

    Each round counts the values between approximate quantiles, and those equal to one apart, so a
    value that fills many ranges is found at once and every other range is smaller than the table.
    """
    if n <= SORTED:
        values = np.sort(df.toArrow().column(0).to_numpy())
        return {k: float(values[k]) for k in ranks}
    cuts = sorted(set(df.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 20 * RANGES)).first()[0]))
    v, bounds = F.col("v"), F.array(*map(F.lit, cuts))
    below = F.size(F.filter(bounds, lambda c: c < v))
    place = (2 * below + F.array_contains(bounds, v).cast("int")).alias("p")
    counts = {r["p"]: r["n"] for r in df.groupBy(place).agg(F.count("*").alias("n")).collect()}  # 2 * RANGES rows at most
    order = sorted(counts)
    first = np.concatenate([[0], np.cumsum([counts[p] for p in order])]).tolist()
    by_place: dict[int, list[int]] = {}
    for k in ranks:
        by_place.setdefault(bisect_right(first, k) - 1, []).append(k)
    out = {}
    for i, some in by_place.items():
        p = order[i]
        if p % 2:
            out |= dict.fromkeys(some, cuts[p // 2])
            continue
        k = p // 2
        inner = df.where((v > cuts[k - 1] if k else F.lit(True)) & (v < cuts[k] if k < len(cuts) else F.lit(True)))
        found = _at(inner, [x - first[i] for x in some], counts[p])
        out |= {x + first[i]: y for x, y in found.items()}
    return out


def exact(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """The quantiles of the values that are not null, linear between neighbours; not a number where there are none."""
    df = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = df.count()
    if not n:
        return [math.nan] * len(shares)
    at = [q * (n - 1) for q in shares]
    known = _at(df, sorted({f(x) for x in at for f in (math.floor, math.ceil)}), n)
    between = lambda a, b, x: a if a == b else a + (b - a) * x
    return [between(known[math.floor(x)], known[math.ceil(x)], x - math.floor(x)) for x in at]

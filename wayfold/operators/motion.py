"""How far points move in the image between two poses, as quantiles for each sample.

Each sample meets all points of its key, so pairs grow with the product of both. They are made and sorted as arrays inside a task, block by
block, and never become rows; a task gets one key's points and at most about ``SAMPLES`` of its samples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.spatial import keep

#: Samples of one key in one task, about; numbers in one array, about.
SAMPLES, ROOM = 1 << 15, 1 << 15
_NOW, _BEFORE = [f"_c{i}" for i in range(12)], [f"_b{i}" for i in range(12)]


def _camera(m: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
    """Points in camera axes for each row of m: nine numbers of a rotation and three of a shift."""
    return [m[:, 3 * i, None] * x + m[:, 3 * i + 1, None] * y + m[:, 3 * i + 2, None] * z + m[:, 9 + i, None] for i in range(3)]


def _moves(now: np.ndarray, before: np.ndarray, places: np.ndarray, focal: float, depth: float) -> np.ndarray:
    """The greater of both axes' moves for each sample and point; no number where the point isn't in front of both cameras."""
    (a, b, c), (d, e, f) = _camera(now, *places), _camera(before, *places)
    hidden = (c <= depth) | (f <= depth)  # what is no number counts as far
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = np.maximum(np.abs(focal * a / c - focal * d / f), np.abs(focal * b / c - focal * e / f))
    out[hidden] = -1.0
    return out


def _quantile(values: np.ndarray, share: float) -> float:
    """Of sorted values, linear between neighbours."""
    at = (len(values) - 1) * share
    low, high = math.floor(at), math.ceil(at)
    a, b = float(values[low]), float(values[high])
    return a if low == high or a == b else (high - at) * a + (at - low) * b


def percentiles(samples: DataFrame, points: DataFrame, key: str, sample: str, now: tuple[list[Column], list[Column]], before: tuple[list[Column], list[Column]], focal: float, depth: float, shares: list[float]) -> DataFrame:
    """(sample, n, p): quantiles of the pixels that the points (key, x, y, z) of a sample's key move between its two cameras.

    ``now`` and ``before`` are rotations and shifts of ``samples`` into camera axes. Points nearer than ``depth`` in either camera don't count; a
    sample that sees none has no row. Rows with a null in a camera or place see nothing; rows of one sample count together.
    """
    kind = dict(samples.dtypes)[sample]
    flat = {n: c.cast("double") for names, (m, t) in ((_NOW, now), (_BEFORE, before)) for n, c in zip(names, [*m, *t], strict=True)}
    known = lambda names: " AND ".join(f"{n} IS NOT NULL" for n in names)
    rows = keep(samples.select(F.col(key).alias("_k"), F.col(sample).alias("_s"), *(c.alias(n) for n, c in flat.items())).where(known(["_k", *flat])), "motion")
    places = points.select(F.col(key).alias("_k"), *(F.col(c).cast("double").alias(c) for c in "xyz")).where(known(["_k", *"xyz"]))
    crowds = keep(rows.groupBy("_k").agg(F.ceil(F.count("*") / SAMPLES).cast("int").alias("_n")), "motion")
    dealt = rows.join(crowds, "_k").withColumn("_share", F.pmod(F.xxhash64("_s"), F.col("_n")).cast("int")).drop("_n")
    sent = places.join(crowds, "_k").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    names = ["_s", "n", "p"]

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        at = np.stack([held.column(c).to_numpy() for c in "xyz"])
        of, same = asking.column("_s").combine_chunks().dictionary_encode("encode"), at.shape[1]
        code = of.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        now, before = (np.column_stack([asking.column(n).to_numpy() for n in part])[order] for part in (_NOW, _BEFORE))
        found: list[tuple[int, int, list[float]]] = []
        open_: list[np.ndarray] = []  # what the current sample sees, when rows of it are left
        step = max(1, ROOM // max(1, same))
        for lo in range(0, len(code) if same else 0, step):
            some = slice(lo, lo + step)
            moves = np.empty((len(code[some]), same))
            for p in range(0, same, ROOM):
                moves[:, p : p + ROOM] = _moves(now[some], before[some], at[:, p : p + ROOM], focal, depth)
            moves.sort(1)  # hidden ones first, what is no number last
            hidden = (moves < 0).sum(1)
            for i, row in enumerate(moves):
                seen, here = row[hidden[i] :], lo + i
                last = here + 1 == len(code) or code[here + 1] != code[here]
                if open_ or not last:
                    open_.append(seen.copy())
                    if not last:
                        continue
                    seen, open_ = np.sort(np.concatenate(open_)), []
                if len(seen):
                    found.append((int(code[here]), len(seen), [_quantile(seen, q) for q in shares]))
        codes, n, p = zip(*found, strict=True) if found else ([], [], [])
        return pa.Table.from_arrays([of.dictionary.take(pa.array(codes, pa.int64())), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names)

    made = dealt.groupBy("_k", "_share").cogroup(sent.groupBy("_k", "_share")).applyInArrow(run, f"_s {kind}, n long, p array<double>")
    return made.select(F.col("_s").alias(sample), "n", "p")

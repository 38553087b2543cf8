import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import motion
from wayfold.plans import pose_queries

RNG = np.random.default_rng(23)
MATRIX, SHIFT = [f"m{i}" for i in range(9)], [f"t{i}" for i in range(3)]


def plainly(samples, points):
    seen = {}
    for k, s, *m in samples:
        for p, *at in points:
            if k is None or k != p or None in m or None in at:
                continue
            now, before = (np.array(m[i : i + 9]).reshape(3, 3) @ at + m[i + 9 : i + 12] for i in (0, 12))
            if now[2] > 0.5 and before[2] > 0.5:
                seen.setdefault(s, []).append(max(abs(300 * now[i] / now[2] - 300 * before[i] / before[2]) for i in (0, 1)))
    return {s: (len(v), *np.quantile(v, [0.25, 0.5, 0.75])) for s, v in seen.items()}


def test_percentiles_of_odd_rows(spark, monkeypatch):
    """Rows of one sample, keys without points, nulls, hidden points; keys cut over tasks and blocks."""
    monkeypatch.setattr(motion, "SAMPLES", 5)
    monkeypatch.setattr(motion, "ROOM", 16)
    camera = lambda: [*map(float, np.eye(3).ravel() + RNG.normal(0, 0.2, 9)), *map(float, RNG.normal(0, 1, 3))]
    samples = [(i % 3, i // 2 * 3 + i % 3, *camera(), *camera()) for i in range(60)]
    samples += [(None, 900, *camera(), *camera()), (1, 901, *camera()[:-1], None, *camera()), (7, 902, *camera(), *camera()), (2, None, *camera(), *camera())]
    points = [(i % 4, *map(float, RNG.normal([0, 0, 2], 2))) for i in range(160)] + [(None, 0.0, 0.0, 4.0), (1, None, 0.0, 4.0)]
    names = ["a" + c for c in MATRIX + SHIFT] + ["b" + c for c in MATRIX + SHIFT]
    df = spark.createDataFrame(samples, "k long, s long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    at = spark.createDataFrame(points, "k long, x double, y double, z double").repartition(3)
    side = lambda o: ([F.col(o + c) for c in MATRIX], [F.col(o + c) for c in SHIFT])
    got = {r.s: (r.n, *r.p) for r in motion.percentiles(df, at, "k", "s", side("a"), side("b"), 300.0, 0.5, [0.25, 0.5, 0.75]).collect()}
    want = plainly(samples, points)
    assert got.keys() == want.keys() and None in want
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_what_is_no_number_counts_last():
    values = np.array([1.0, 2.0, math.nan])
    assert motion._quantile(values, 0.5) == 2.0 and math.isnan(motion._quantile(values, 1.0))


def test_pairs_of_samples_and_points_are_no_rows(spark, tmp_path):
    """2,000 samples of one key and 1,500 points of it: no join makes a row for each of 3 M pairs."""
    k = F.col("id")
    spark.range(2_000).select((k * 500).alias("event_id"), F.timestamp_micros(k * 1_000_000).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (k * 37 % 400).cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1_500).select((k * 500).alias("o_orderkey"), (k * 7 % 90).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    df = pose_queries.A07_A32_A34_motion_percentiles(spark, str(tmp_path))
    assert 0 < df.count() < 2_000 and df.agg(F.max("n")).first()[0] <= 1_500
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    df._jdf.queryExecution().toRdd().count()
    while nodes:
        p = nodes.pop()
        rows = p.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        nodes += [p.children().apply(i) for i in range(p.children().size())]
        for inner in ("finalPhysicalPlan", "plan"):
            if p.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec") and hasattr(p, inner):
                try:
                    nodes.append(getattr(p, inner)())
                except Exception:
                    pass
    assert 0 < most <= 4_000

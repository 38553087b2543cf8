"""Capture operators over streams: filters, event-time windows and the keyed keyframe scan.

The batch operators are what the reference data needs; these are the same rules for data that arrives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def confident(points: DataFrame, inverse: float = 0.005, distance: float = 0.01) -> DataFrame:
    """Stateless, so it works alike on a stream and on a table."""
    return points.where((F.col("inv_dist_std") < inverse) & (F.col("dist_std") < distance))


def counts_by_window(events: DataFrame, time: str, late: str, window: str, *keys: str) -> DataFrame:
    """Events by window; timestamps without zone count as UTC, since watermarks need an instant."""
    at = events.withColumn(time, F.col(time).cast("timestamp"))
    return at.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def nearest_pairs(frames: DataFrame, observations: DataFrame, tolerance: str, late: str) -> DataFrame:
    """Frames with the observations of their recording within a tolerance, both as streams with watermarks.

    Columns: rec_id, frame_id, frame_time; rec_id, obs_time, uid. Both ends are included.
    """
    f = frames.withWatermark("frame_time", late).alias("f")
    o = observations.withWatermark("obs_time", late).alias("o")
    near = (F.col("o.obs_time") >= F.col("f.frame_time") - F.expr(f"interval {tolerance}")) & (F.col("o.obs_time") <= F.col("f.frame_time") + F.expr(f"interval {tolerance}"))
    return f.join(o, (F.col("f.rec_id") == F.col("o.rec_id")) & near).select("f.rec_id", "f.frame_id", "o.uid", "f.frame_time", "o.obs_time")


POSE = ["tx", "ty", "tz", "qw", "qx", "qy", "qz"]


def keyframes(poses: DataFrame, metres: float, degrees: float) -> DataFrame:
    """(rec_id, t_us, kept) for each pose as it arrives; the state of a recording is the last pose kept.

    Poses of one recording must arrive in order of time; within a batch they are sorted.
    """

    def scan(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("t_us", kind="stable")
        last, kept = (state.get if state.exists else None), []
        for x in rows[POSE].itertuples(index=False):
            keep = last is None
            if last is not None:
                away = math.sqrt(sum((a - b) ** 2 for a, b in zip(x[:3], last[:3], strict=True)))
                turn = math.degrees(2 * math.acos(min(1.0, abs(sum(a * b for a, b in zip(x[3:], last[3:], strict=True))))))
                keep = away >= metres or turn >= degrees
            kept.append(keep)
            last = tuple(map(float, x)) if keep else last
        state.update(last)
        yield pd.DataFrame({"rec_id": key[0], "t_us": rows["t_us"].to_numpy(), "kept": kept})

    state = ", ".join(f"{c} double" for c in POSE)
    return poses.groupBy("rec_id").applyInPandasWithState(scan, "rec_id long, t_us long, kept boolean", state, "append", GroupStateTimeout.NoTimeout)

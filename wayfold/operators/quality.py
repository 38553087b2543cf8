"""Checks, comparisons and small classifications."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def camera_kind(label: Column) -> Column:
    """tracking or rgb, by the label's beginning; any other label is an error."""
    tracking = label.startswith("camera-slam") | label.startswith("slam-")
    rgb = label.startswith("camera-rgb") | label.startswith("camera_rgb")
    return F.when(tracking, "tracking").when(rgb, "rgb").otherwise(F.raise_error(F.concat(F.lit("unknown camera label: "), F.coalesce(label, F.lit("null")))))


def valid(channels: list[Column], least: float) -> Column:
    """No channel is NaN or infinite, and some channel's size is below ``least``."""
    sound = [~F.isnan(c) & (F.abs(c) != float("inf")) for c in channels]
    return F.coalesce(reduce(lambda a, b: a & b, sound) & reduce(lambda a, b: a | b, [F.abs(c) < least for c in channels]), F.lit(False))


def flattened(df: DataFrame, keys: list[str], json: str, digest: bool = True) -> DataFrame:
    """(keys, path, digest): a row for each leaf and list of a JSON column, objects opened to any depth; lists are hashed whole. Without ``digest`` the JSON text is ``value``."""
    level = df.select(*keys, F.lit("").alias("path"), F.parse_json(json).alias("v"))
    out = None
    while True:
        kind = F.expr("schema_of_variant(v)")
        opened = level.where(kind.startswith("OBJECT"))
        leaves = level.where(~kind.startswith("OBJECT")).select(*keys, "path", F.sha2(F.to_json("v"), 256).alias("digest") if digest else F.to_json("v").alias("value"))
        out = leaves if out is None else out.unionAll(leaves)
        if not opened.limit(1).count():
            return out
        level = opened.select(*keys, "path", F.explode(F.expr("variant_get(v, '$', 'map<string,variant>')")).alias("_k", "v")).select(*keys, F.concat("path", F.lit("/"), "_k").alias("path"), "v")


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with status added, removed, changed or same; rows compare by a hash of their other columns."""
    others = [c for c in old.columns if c not in keys]
    digest = lambda df, n: df.select(*keys, F.sha2(F.to_json(F.struct(*others)), 256).alias(n), F.lit(True).alias(f"in_{n}"))
    both = digest(old, "a").join(digest(new, "b"), keys, "full")
    return both.select(*keys, F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("status"))


def checked(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, ok) from one-row frames with a column ok."""
    return reduce(DataFrame.unionAll, (df.select(F.lit(name).alias("rule"), "ok") for name, df in rules.items()))


def require(rules: DataFrame) -> None:
    """Raise with the names of the rules that don't hold."""
    failed = [r["rule"] for r in rules.where("NOT ok OR ok IS NULL").select("rule").collect()]  # a row for each rule
    if failed:
        raise ValueError(f"checks failed: {', '.join(sorted(failed))}")


def rewritten(df: DataFrame, column: str, known: list[float], new: list[float], digits: int = 9) -> DataFrame:
    """``df`` with ``status``: an array equal to ``known`` becomes ``new`` (rewritten), one equal to ``new`` stays (already), any other is left as it is (refused)."""
    same = lambda v: F.transform(F.col(column), lambda x: F.round(x, digits) + 0.0) == F.array(*(F.lit(round(float(x), digits) + 0.0) for x in v))
    status = F.when(same(known), "rewritten").when(same(new), "already").otherwise("refused")
    return df.withColumn("status", status).withColumn(column, F.when(F.col("status") == "rewritten", F.array(*(F.lit(float(x)) for x in new))).otherwise(F.col(column)))


def recording_facts(frames: DataFrame, cameras: DataFrame, files: DataFrame, required: list[str], width: int, degrees: float) -> DataFrame:
    """(recording, frames, seconds, per_second, cameras, global_shutter, missing, focal) of each recording.

    ``frames`` has rec_id and t_ns, ``cameras`` readout (null: global shutter), ``files`` rec_id and name. ``focal`` is that of a rectified picture of the field of view.
    """
    own = frames.groupBy("rec_id").agg(F.count("*").alias("frames"), ((F.max("t_ns") - F.min("t_ns")) / 1e9).alias("seconds"))
    rig = cameras.agg(F.count("*").alias("cameras"), F.count_if(F.col("readout").isNull()).alias("global_shutter"))
    there = files.groupBy("rec_id").agg(F.collect_set("name").alias("names"))
    missing = F.array_join(F.array_except(F.array(*map(F.lit, required)), F.coalesce("names", F.array().cast("array<string>"))), ",")
    focal = width / 2 / math.tan(math.radians(degrees) / 2)
    rate = F.when(F.col("seconds") > 0, (F.col("frames") - 1) / F.col("seconds"))
    return own.join(there, "rec_id", "left").join(F.broadcast(rig)).select("rec_id", "frames", "seconds", rate.alias("per_second"), "cameras", "global_shutter", missing.alias("missing"), F.lit(round(focal, 6)).alias("focal"))

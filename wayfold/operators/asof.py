"""As-of joins in either direction, with tolerance and ties.

Time is cut into buckets. Within (key, bucket) a window finds the neighbours; what lies beyond the bucket
comes from a table with one row for each (key, bucket). So no task needs all of a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def width(df: DataFrame, by: list[str], time: str, rows: int = 100_000) -> int:
    """A bucket's width at which the densest key has about ``rows`` rows in one: from the counts and spans of all keys."""
    per = df.where(F.col(time).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), (F.max(time) - F.min(time) + 1).alias("span"))
    return max(1, int(per.agg(F.min(F.col("span") * float(rows) / F.col("n"))).first()[0] or 1))


def neighbours(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tie: str, width: int) -> DataFrame:
    """``left`` with structs ``before`` (last row of ``right`` at or before) and ``after`` (first one later).

    Rows of ``right`` at one time are ordered by ``tie``; null times on the left get nulls, on the right they are ignored.
    """
    right = right.where(F.col(right_time).isNotNull())
    fields = F.struct(F.col(right_time).alias("t"), F.col(tie).alias("tie"), *(F.col(c) for c in right.columns if c not in (right_time, tie, *by)))
    l = left.select(*(F.col(c) for c in by), F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(fields.alias("x")).schema["x"].dataType).alias("_right"))
    r = right.select(*(F.col(c) for c in by), F.col(right_time).alias("_t"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), fields.alias("_right"))
    rows = l.unionAll(r).withColumn("_bucket", F.floor(F.col("_t") / width))
    # at one time: the right side first, so that ``before`` includes it
    order = Window.partitionBy(*by, "_bucket").orderBy("_t", F.col("_left").isNotNull(), F.col("_right.tie"))
    ends = rows.groupBy(*by, "_bucket").agg(
        F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_right.t", "_right.tie"))).alias("_last"),
        F.min_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_right.t", "_right.tie"))).alias("_first"),
    )
    line = Window.partitionBy(*by).orderBy("_bucket")  # a row for each bucket
    carried = ends.select(
        *by, "_bucket",
        F.last("_last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_from_before"),
        F.first("_first", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_from_after"),
    )
    near = rows.select(
        *by, "_bucket", "_left",
        F.last("_right", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_b"),
        F.first("_right", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_a"),
    ).where(F.col("_left").isNotNull())
    joined = near.join(carried, [*by, "_bucket"], "left")
    return joined.select(*(F.col("_left")[c].alias(c) for c in left.columns), F.coalesce("_b", "_from_before").alias("before"), F.coalesce("_a", "_from_after").alias("after"))


def nearest(q: Column, tolerance: Column | float | None = None, tie: str = "earlier") -> Column:
    """The nearer of ``before`` and ``after`` to time ``q``; null beyond the tolerance (inclusive)."""
    before, after = F.col("before"), F.col("after")
    back, ahead = q - before["t"], after["t"] - q
    first = back <= ahead if tie == "earlier" else back < ahead
    chosen = F.when(after.isNull() | (before.isNotNull() & first), before).otherwise(after)
    return chosen if tolerance is None else F.when(F.abs(chosen["t"] - q) <= tolerance, chosen)


def forward(q: Column) -> Column:
    """The first at or after ``q``; the last of all where there is none."""
    before, after = F.col("before"), F.col("after")
    return F.when(before["t"] == q, before).otherwise(F.coalesce(after, before))


def ratio(q: Column) -> Column:
    """Where ``q`` lies between ``before`` and ``after``: 0 on a sample, null outside of the samples."""
    before, after = F.col("before"), F.col("after")
    return F.when(before["t"] == q, 0.0).when(after.isNotNull(), (q - before["t"]) / (after["t"] - before["t"]).cast("double"))


def nearest_with_edges(q: Column, slack: int) -> Column:
    """Nearest with ties to the later sample; null further than ``slack`` outside of all samples.

    In the last interval the later sample is taken without a comparison.
    """
    before, after, last = F.col("before"), F.col("after"), F.col("last_t")
    inside = F.when(after.isNull(), before).when(before.isNull(), after).when(after["t"] == last, F.when(before["t"] == q, before).otherwise(after))
    chosen = inside.otherwise(nearest(q, tie="later"))
    return F.when((q >= F.col("first_t") - slack) & (q <= last + slack), chosen)

"""Ties, ends, tolerance and gaps of the as-of joins, over bucket borders."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import asof


@pytest.fixture(scope="module")
def around(spark):
    samples = [("a", t, i, t * 10) for i, t in enumerate((0, 10, 20, 100, 100, 1000))] + [("b", 50, 0, 500), ("c", None, 0, 1)]
    asked = [("a", q) for q in (-5, 0, 5, 10, 15, 99, 100, 550, 1000, 1001)] + [("b", 49), ("b", 50), ("b", 51), ("c", 5), ("d", 5), ("a", None)]
    right = spark.createDataFrame(samples, "rec string, t long, id long, v long")
    left = spark.createDataFrame(asked, "rec string, q long")
    return asof.neighbours(left, right, ["rec"], "q", "t", "id", 30)


def by_key(rows, column):
    return {(r["rec"], r["q"]): r[column] for r in rows}


def test_neighbours(around):
    rows = around.select("rec", "q", F.col("before.t").alias("b"), F.col("after.t").alias("a"), F.col("before.tie").alias("i"), F.col("after.tie").alias("j")).collect()
    assert len(rows) == 16
    assert by_key(rows, "b") == {("a", -5): None, ("a", 0): 0, ("a", 5): 0, ("a", 10): 10, ("a", 15): 10, ("a", 99): 20, ("a", 100): 100, ("a", 550): 100, ("a", 1000): 1000, ("a", 1001): 1000, ("b", 49): None, ("b", 50): 50, ("b", 51): 50, ("c", 5): None, ("d", 5): None, ("a", None): None}
    after = by_key(rows, "a")
    assert [after["a", q] for q in (-5, 0, 99, 100, 550, 1000)] == [0, 10, 100, 1000, 1000, None] and after["b", 49] == 50 and after["b", 50] is None
    assert by_key(rows, "i")["a", 550] == 4 and by_key(rows, "j")["a", 99] == 3


def test_presets(around):
    q = F.col("q")
    ends = around.withColumns({"first_t": F.lit(0), "last_t": F.when(F.col("rec") == "b", 50).otherwise(1000)})
    rows = ends.select("rec", "q", asof.nearest(q)["t"].alias("early"), asof.nearest(q, tie="later")["t"].alias("late"), asof.nearest(q, 5)["t"].alias("tolerant"), asof.forward(q)["t"].alias("forward"), asof.ratio(q).alias("ratio"), asof.nearest_with_edges(q, 1)["t"].alias("edges")).collect()
    early, late, tolerant, forward, ratio, edges = (by_key(rows, c) for c in ("early", "late", "tolerant", "forward", "ratio", "edges"))
    assert (early["a", 5], late["a", 5]) == (0, 10) and (early["a", 550], late["a", 550]) == (100, 1000)
    assert tolerant["a", 5] == 0 and tolerant["a", -5] == 0 and tolerant["a", 550] is None and tolerant["b", 51] == 50
    assert forward["a", 99] == 100 and forward["a", 1001] == 1000 and forward["a", 10] == 10 and forward["d", 5] is None
    assert ratio["a", 5] == 0.5 and ratio["a", 10] == 0.0 and ratio["a", 1000] == 0.0 and ratio["a", 1001] is None and ratio["a", -5] is None
    assert edges["a", 5] == 10 and edges["a", 101 - 1] == 100 and edges["a", 1001] == 1000 and edges["a", -5] is None and edges["a", 550] == 1000


def test_empty_sides(spark):
    left = spark.createDataFrame([("a", 1)], "rec string, q long")
    right = spark.createDataFrame([], "rec string, t long, id long")
    assert asof.neighbours(left, right, ["rec"], "q", "t", "id", 10).first().before is None
    assert asof.neighbours(left.limit(0), right, ["rec"], "q", "t", "id", 10).count() == 0


def test_frustum_borders(spark):
    points = [(0.0, 0.0, 1.0), (-1.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.0, -1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, -1.0)]
    df = spark.createDataFrame(points, "x double, y double, z double")
    uvz = g.project([F.col(c) for c in "xyz"], [F.lit(10.0)] * 2, [F.lit(10.0)] * 2)
    assert [r.seen for r in df.select(g.in_frame(uvz, F.lit(20), F.lit(20)).alias("seen")).collect()] == [True] + [False] * 5
    rounded = spark.range(1).select(*(F.rint(F.lit(x)).cast("int").alias(f"r{i}") for i, x in enumerate((0.5, 1.5, 2.5)))).first()
    assert tuple(rounded) == (0, 2, 2)


def test_quaternions_survive_matrices(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5), (-0.1, 0.7, -0.7, 0.1), (0.0, 0.0, 0.0, 2.0), (1.0, 0.0, 0.0, 0.0)], "w double, x double, y double, z double")
    q = [F.col(c) for c in "wxyz"]
    m = g.quaternion_to_matrix(q)
    for back in (g.matrix_to_quaternion(m), g.matrix_to_quaternion_by_largest(m)):
        alike = F.abs(g.dot(q, back)) / g.norm(q)
        assert [r.s for r in df.select(alike.alias("s")).collect()] == pytest.approx([1.0] * 4)
    b, t = g.inverse(m, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    whole, zero = g.compose((b, t), (m, [F.lit(1.0), F.lit(2.0), F.lit(3.0)]))
    r = df.select(*(c.alias(f"m{i}") for i, c in enumerate(whole)), *(c.alias(f"t{i}") for i, c in enumerate(zero))).collect()
    for row in r:
        assert list(row) == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0], abs=1e-12)


def test_width_follows_the_densest_key(spark):
    df = spark.createDataFrame([("a", t) for t in range(1000)] + [("b", 10**9), ("b", 0), ("c", None)], "k string, t long")
    assert asof.width(df, ["k"], "t", rows=10) == 10 and asof.width(df.limit(0), ["k"], "t") == 1

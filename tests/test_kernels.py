import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import kernels, quality, quantiles, spatial
from wayfold.plans import stages

RNG = np.random.default_rng(11)


def frame(spark, rows, names="x y z"):
    names = names.split()
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))


def turn(degrees, shift):
    t = np.eye(4)
    a = math.radians(degrees)
    t[:2, :2] = [[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]
    t[:3, 3] = shift
    return t


def test_plane_and_peel(spark):
    floor = np.column_stack([RNG.uniform(0, 5, 300), RNG.uniform(0, 5, 300), 1 + RNG.normal(0, 0.002, 300)])
    wall = np.column_stack([np.full(100, 2.0), RNG.uniform(0, 5, 100), RNG.uniform(1.2, 5, 100)])
    points = frame(spark, np.vstack([floor, wall]))
    normal, offset, n = kernels.plane(points, 0.02, upright=0.9)
    assert normal == pytest.approx([0, 0, 1], abs=0.01) and offset == pytest.approx(1, abs=0.01) and n >= 300
    normal, centre, rms, n, peel = kernels.peeled(points, 0.02, horizontal=False)
    assert peel == 2 and abs(normal[0]) == pytest.approx(1, abs=1e-3) and centre[0] == pytest.approx(2, abs=1e-3) and rms < 0.01 and n >= 100
    assert kernels.peeled(points, 0.02, horizontal=True)[4] == 1 and kernels.peeled(points.where("z < 1.1"), 0.02, horizontal=False) is None
    assert kernels.plane(points.limit(0), 0.02) is None


def test_similarity_recovers_a_transform(spark):
    p = RNG.normal(0, 1, (50, 3))
    t = turn(30, [1, 2, 3])
    t[:3, :3] *= 1.25
    q = p @ t[:3, :3].T + t[:3, 3]
    found, scale = kernels.similarity(frame(spark, np.hstack([p, q]), "x y z u v w"))
    assert found == pytest.approx(t, abs=1e-9) and scale == pytest.approx(1.25)


def test_mesh_distance_and_samples(spark):
    tri = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.5)], "fid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, area double")
    found = {r.id: r.d for r in kernels.mesh_distance(frame(spark, [(0.2, 0.2, 0.3), (-0.3, 0.0, 0.4), (5, 5, 5), (0.6, 0.6, 0)]), tri).collect()}
    assert [found[i] for i in range(4)] == pytest.approx([0.3, 0.5, math.sqrt(2 * 4.5**2 + 25), 0.2 / math.sqrt(2)])
    assert kernels.mesh_distance(frame(spark, [(0, 0, 0)]), tri.limit(0)).count() == 0
    rows = kernels.surface_samples(tri, 1e-3, 400, 1000)
    r = rows.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("y")).alias("s")).first()
    assert 499 <= r.n <= 501 and r.x == pytest.approx(1 / 3, abs=0.05) and r.y >= 0 and r.s <= 1
    assert kernels.surface_samples(tri.limit(0)).count() == 0


def test_shuffle_keeps_rows(spark):
    df = spark.range(100)
    a, b = ({r.place: r.id for r in kernels.shuffled(df, "id", s).collect()} for s in (1, 2))
    assert sorted(a) == sorted(b) == sorted(a.values()) == sorted(b.values()) == list(range(100)) and a != b


def test_nearest_with_points_far_away(spark):
    """One point 120 km away: neighbours stay exact, and no crowded cell makes pairs of all."""
    points = np.vstack([RNG.uniform(0, 10, (3000, 2)), [[120_000.0, 0.0]]])
    asked = RNG.uniform(0, 10, (400, 2))
    far = lambda p: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double")
    found = {r.id: r.nn for r in spatial.nearest(far(asked), far(points), ["x", "y"]).collect()}
    assert [found[i] for i in range(400)] == [int(((points - q) ** 2).sum(1).argmin()) for q in asked]


def test_quantiles(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 50)
    monkeypatch.setattr(quantiles, "RANGES", 4)
    for values in (RNG.normal(0, 1, 501), np.repeat([1.0, 2.0, 3.0], 100), np.append(RNG.uniform(0, 1, 300), 1e9), [4.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        assert quantiles.exact(df, "v", [0.0, 0.05, 0.5, 0.95, 1.0]) == pytest.approx(np.quantile(values, [0.0, 0.05, 0.5, 0.95, 1.0]))
    assert math.isnan(quantiles.exact(df.limit(0), "v", [0.5])[0])


def test_smallest_rotation():
    assert g.smallest_rotation([1, 0, 0], [0, 2, 0]) == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1])
    assert g.smallest_rotation([1, 0, 0], [-1, 0, 0]) == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_nearest_ties_duplicates_and_far_points(spark):
    right = frame(spark, [(0, 0, 0), (0, 0, 0), (10, 0, 0), (1000, 0, 0)])
    left = frame(spark, [(0, 0, 0), (5, 0, 0), (-900, 3, 4)])
    assert {r.id: r.nn for r in spatial.nearest(left, right, ["x", "y", "z"]).collect()} == {0: 0, 1: 0, 2: 0}
    assert [r["nn"] for r in spatial.nearest(left.where("id = 1"), right, ["x", "y", "z"], 3).orderBy("rank").collect()] == [0, 1, 2]
    assert spatial.nearest(left.limit(0), right, ["x"]).count() == 0


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="unknown camera label"):
        spark.range(1).select(quality.camera_kind(F.lit("camera-et"))).collect()


def test_stages_skip_check_and_stop(spark, tmp_path):
    runs = []

    def double(spark, have):
        runs.append("double")
        return have["numbers"].select((F.col("id") * 2).alias("id"))

    plan = [stages.Stage("double", double, ["numbers"], lambda df: {"rows": df.agg((F.count("*") == 3).alias("ok"))}), stages.Stage("sum", lambda s, h: h["double"].agg(F.sum("id").alias("s")), ["double"])]
    source = {"numbers": spark.range(3)}
    assert stages.run(spark, plan, str(tmp_path / "p"), source)["sum"].first().s == 6
    stages.run(spark, plan, str(tmp_path / "p"), source)
    assert runs == ["double"]
    assert list(stages.run(spark, plan, str(tmp_path / "p"), source, force=True, stop_after="double")) == ["double"]
    with pytest.raises(ValueError, match="checks failed: rows"):
        stages.run(spark, plan, str(tmp_path / "q"), {"numbers": spark.range(4)})
    # a forced run that breaks between two stages: the later one is made anew from the new output
    state = {"factor": 1, "broken": False}

    def scaled(spark, have):
        return have["numbers"].select((F.col("id") + state["factor"]).alias("x")).limit(1)

    def tenfold(spark, have):
        if state["broken"]:
            raise RuntimeError("broken")
        return have["a"].select((F.col("x") * 10).alias("y"))

    pair = [stages.Stage("a", scaled, ["numbers"], lambda df: {"small": df.agg((F.max("x") < 5).alias("ok"))}), stages.Stage("b", tenfold, ["a"])]
    run = lambda **more: stages.run(spark, pair, str(tmp_path / "s"), {"numbers": spark.range(1)}, **more)
    assert run()["b"].first().y == 10
    state.update(factor=2, broken=True)
    with pytest.raises(RuntimeError):
        run(force=True)
    state["broken"] = False
    assert (run()["a"].first().x, run()["b"].first().y) == (2, 20)
    state["factor"] = 9  # fails its check: the runs before stay
    with pytest.raises(ValueError, match="small"):
        run(force=True)
    assert (run()["a"].first().x, run()["b"].first().y) == (2, 20)
    with pytest.raises(ValueError, match="sum needs double"):
        stages.run(spark, plan[1:], str(tmp_path / "r"), source)

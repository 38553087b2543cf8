"""Rows made from few rows meet by key: none of these queries sends them whole to the driver and the tasks."""

from contextlib import contextmanager

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.operators import decimation
from wayfold.plans import catalog, proxies


@contextmanager
def held(spark, megabytes: int):
    """No table above that is sent whole."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", f"{megabytes}m")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """30,000 parts: 300 images of 1,024 pixels and channel, 30 tiles of a mesh."""
    d = str(tmp_path_factory.mktemp("parts"))
    k = F.col("id")
    parts = spark.range(30_000).select(k.alias("p_partkey"), (k * 7 % 50 + 1).cast("int").alias("p_size"))
    parts.coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def answers(spark, folder, name: str) -> tuple[list, list]:
    """The query's rows and those of its SQL."""
    with held(spark, 4):
        df = catalog.QUERIES[name](spark, folder)
        rows = sorted(map(tuple, df.collect()))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    wanted = con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    return rows, sorted(wanted)


def test_depths_at_places_of_images(spark, folder):
    rows, wanted = answers(spark, folder, "J23_bilinear")
    assert [r[0] for r in rows] == [r[0] for r in wanted]
    assert [r[1] for r in rows] == pytest.approx([r[1] for r in wanted], abs=1e-5)


def test_masks_are_resampled(spark, folder):
    rows, wanted = answers(spark, folder, "K12_mask_erosion")
    assert rows == wanted


@pytest.mark.parametrize("name", ["P26_fisheye_map", "P26_pinhole_map"])
def test_pictures_are_resampled(spark, folder, name):
    rows, wanted = answers(spark, folder, name)
    assert [r[:3] for r in rows] == [r[:3] for r in wanted]
    assert all(r[3:] == pytest.approx(w[3:], abs=2e-5) for r, w in zip(rows, wanted, strict=True))


def test_a_mesh_is_contracted(spark, folder):
    rows, wanted = answers(spark, folder, "K08_decimation")
    assert rows == wanted


def test_forms_are_of_all_vertices(spark, folder):
    faces = proxies.faces(spark, folder)
    with held(spark, 4):
        found = decimation.forms(faces, proxies.vertices(spark, folder)).count()
    assert found == faces.select(F.explode(F.array("a", "b", "c"))).distinct().count()

"""Files that many tasks write at once, against the same bytes made in one piece."""

import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.sinks import exports, pieces
from wayfold.sources import captures, package, ply

SPLAT = "gid long, x float, y float, z float, opacity float, f_dc array<float>, f_rest array<float>, scale array<float>, rot array<float>"


def left_over(folder):
    return sorted(p.name for p in folder.iterdir())


def splats(spark, n, start=0):
    k = F.col("id").cast("float")
    return spark.range(start, start + n, 1, 7).select(F.col("id").alias("gid"), k.alias("x"), (-k).alias("y"), (k / 8).alias("z"), F.lit(0.5).cast("float").alias("opacity"), F.array(k, k + 1, k + 2).alias("f_dc"), F.array().cast("array<float>").alias("f_rest"), F.array(k, k, k).alias("scale"), F.array(*(F.lit(v).cast("float") for v in (1.0, 0.0, 0.0, 0.0))).alias("rot"))


@pytest.mark.parametrize("in_order", [False, True])
def test_pieces_land_at_their_places(spark, tmp_path, in_order):
    rows = [(i * 10, bytes([i]) * 10) for i in range(50)]
    df = spark.createDataFrame(rows[::-1], "offset long, content binary").repartition(6)
    pieces.write(df, f"file:{tmp_path}/a.bin", 500, in_order)
    assert (tmp_path / "a.bin").read_bytes() == b"".join(c for _, c in rows) and left_over(tmp_path) == ["a.bin"]
    pieces.write(spark.createDataFrame([(0, b"new")], "offset long, content binary"), str(tmp_path / "a.bin"), 3, in_order)
    assert (tmp_path / "a.bin").read_bytes() == b"new"


@pytest.mark.parametrize("in_order", [False, True])
def test_a_failure_leaves_the_old_file_and_nothing_else(spark, tmp_path, in_order):
    (tmp_path / "a.bin").write_bytes(b"old")
    rows = spark.range(0, 40, 1, 4).select((F.col("id") * 2).alias("offset"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"xy")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        pieces.write(rows, str(tmp_path / "a.bin"), 80, in_order)
    short = spark.createDataFrame([(0, b"ab"), (2, b"c")], "offset long, content binary")
    with pytest.raises(Exception, match="3 bytes were written of 4"):
        pieces.write(short, str(tmp_path / "a.bin"), 4, in_order)
    hole = spark.createDataFrame([(0, b"ab"), (3, b"c")], "offset long, content binary")
    with pytest.raises(Exception, match="bytes"):
        pieces.write(hole, str(tmp_path / "a.bin"), 3, in_order)
    assert (tmp_path / "a.bin").read_bytes() == b"old" and left_over(tmp_path) == ["a.bin"]


def test_blocks_are_runs_of_the_order(spark):
    df = spark.createDataFrame([(i * 3, i) for i in range(1000)], "k long, v long").repartition(9)
    pack = lambda batch: [np.array(batch.column("v").to_pylist(), "<i8").tobytes()]
    for aligned in (False, True):
        rows = pieces.packed(df, ["k"], pack, 64, aligned=aligned).orderBy("place").collect()
        assert b"".join(r.content for r in rows) == np.arange(1000, dtype="<i8").tobytes()
        assert all(r.n <= 64 and len(r.content) == 8 * r.n for r in rows)
    assert [(r.place, r.n) for r in rows] == [(i, min(64, 1000 - i)) for i in range(0, 1000, 64)]
    assert pieces.packed(df.limit(0), ["k"], pack, 64).count() == 0


def test_splat_file_and_its_filtered_form(spark, tmp_path):
    n = 5000  # several blocks
    exports.splats(splats(spark, n).repartition(5), f"file:{tmp_path}/s.ply", 2)
    e = ply.parse((tmp_path / "s.ply").read_bytes())
    k = np.arange(n, dtype=np.float32)
    assert (e["vertex"]["x"] == k).all() and (e["vertex"]["f_dc_2"] == k + 2).all() and (e["vertex"]["z"] == k / 8).all() and e["metadata"]["sh_degree"].tolist() == [2]
    asked = spark.range(n).where("id % 7 = 3 and (id < 1000 or id > 4000)").select(F.col("id").alias("gid"))
    exports.filtered_splats(asked.unionAll(asked), f"file:{tmp_path}/s.ply", f"file:{tmp_path}/t.ply")
    f = ply.parse((tmp_path / "t.ply").read_bytes())
    want = e["vertex"][[i for i in range(n) if i % 7 == 3 and (i < 1000 or i > 4000)]]
    assert f["vertex"].tobytes() == want.tobytes() and f["vertex"].dtype == want.dtype and f["metadata"].tobytes() == e["metadata"].tobytes()
    exports.filtered_splats(asked.limit(0), str(tmp_path / "s.ply"), str(tmp_path / "u.ply"))
    assert len(ply.parse((tmp_path / "u.ply").read_bytes())["vertex"]) == 0
    with pytest.raises(Exception, match="no vertex 5000"):
        exports.filtered_splats(spark.range(n, n + 1).select(F.col("id").alias("gid")), str(tmp_path / "s.ply"), str(tmp_path / "v.ply"))
    assert left_over(tmp_path) == ["s.ply", "t.ply", "u.ply"]
    exports.splats(splats(spark, 0), str(tmp_path / "none.ply"))
    assert len(ply.parse((tmp_path / "none.ply").read_bytes())["vertex"]) == 0


def test_filtered_keeps_elements_on_both_sides(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\ncomment element vertex 3 of old\nelement camera 2\nproperty ushort w\nelement vertex 3\nproperty float x\nproperty uchar extra\nelement face 1\nproperty list uchar int vertex_index\nend_header\n"
    vertex = [np.float32(i).tobytes() + bytes([i + 5]) for i in range(3)]
    tail = b"\x03" + np.array([0, 1, 2], "<i4").tobytes()
    (tmp_path / "s.ply").write_bytes(head + b"\1\0\2\0" + b"".join(vertex) + tail)
    exports.filtered_splats(spark.createDataFrame([(2,), (0,)], "gid long"), str(tmp_path / "s.ply"), str(tmp_path / "t.ply"))
    data = (tmp_path / "t.ply").read_bytes()
    assert data.endswith(b"end_header\n\1\0\2\0" + vertex[0] + vertex[2] + tail) and b"\nelement vertex 2\n" in data and b"comment element vertex 3 of old\n" in data
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n0\n")
    with pytest.raises(ValueError, match="not a binary"):
        exports.filtered_splats(spark.createDataFrame([(0,)], "gid long"), str(tmp_path / "a.ply"), str(tmp_path / "b.ply"))


def test_check_sums_of_parts_join():
    rng = np.random.default_rng(3)
    parts = [rng.bytes(n) for n in (0, 1, 65_535, 7, 0, 1000)]
    whole = b"".join(parts)
    assert package.joined([(len(p), zlib.crc32(p)) for p in parts]) == (len(whole), zlib.crc32(whole)) and package.joined([]) == (0, 0)


def test_volume_is_a_sound_package_with_equal_bytes(spark, tmp_path):
    n = 20_000  # three blocks of every field
    exports.volume(splats(spark, n).repartition(4), f"file:{tmp_path}/a.zip", b"#usda 1.0")
    exports.volume(splats(spark, n).repartition(9), f"file:{tmp_path}/b.zip", b"#usda 1.0")
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and z.namelist() == ["root.usda", "volume.bin"] and z.read("root.usda") == b"#usda 1.0"
        found = package.fields(z.read("volume.bin"))
    k = np.arange(n, dtype=np.float32)
    want = {"positions": np.column_stack([k, -k, k / 8]), "opacities": np.full((n, 1), 0.5), "scales": np.column_stack([k] * 3), "rotations": np.tile([1.0, 0, 0, 0], (n, 1)), "colours": np.column_stack([k, k + 1, k + 2])}
    assert list(found) == ["version", *want] and found["version"] == 1
    for name, v in want.items():
        assert found[name].tobytes() == v.astype("<f2").tobytes() and found[name].shape == v.shape
    exports.volume(splats(spark, 0), str(tmp_path / "none.zip"), b"")
    with zipfile.ZipFile(tmp_path / "none.zip") as z:
        assert z.testzip() is None and package.fields(z.read("volume.bin")) == {"version": 1}
    with pytest.raises(ValueError, match="differ in length"):
        exports.volume(splats(spark, 3).withColumn("scale", F.slice("scale", 1, F.when(F.col("gid") == 0, 2).otherwise(3))), str(tmp_path / "c.zip"), b"")


def test_mesh_package_is_sound(spark, tmp_path):
    v = spark.range(0, 2500, 1, 3).select(F.col("id").alias("vid"), (F.col("id") / 4).alias("x"), F.lit(0.0).alias("y"), (-F.col("id")).cast("double").alias("z"))
    f = spark.range(0, 1800, 1, 5).select(F.col("id").alias("fid"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    exports.usd_mesh(v, f, f"file:{tmp_path}/m.usdz")
    with zipfile.ZipFile(tmp_path / "m.usdz") as z:
        assert z.testzip() is None and z.namelist() == ["root.usda", "mesh.usda"]
        layer = z.read("mesh.usda").decode()
    within = lambda name: layer.split(f"{name} = [")[1].split("]")[0]
    points = np.array([[float(x) for x in p.split(", ")] for p in within("points")[1:-1].split("), (")])
    k = np.arange(2500)
    assert np.allclose(points, np.column_stack([k / 4, 0 * k, -k]))
    assert within("faceVertexCounts") == ", ".join(["3"] * 1800) and within("faceVertexIndices") == ", ".join(f"{i}, {i + 1}, {i + 2}" for i in range(1800))
    exports.usd_mesh(v.limit(0), f.limit(0), str(tmp_path / "none.usdz"))
    with zipfile.ZipFile(tmp_path / "none.usdz") as z:
        assert z.testzip() is None and b"points = []" in z.read("mesh.usda")


def test_cameras_by_split(spark, tmp_path):
    rows = [("valid", 3, 1.5), ("train", 2, 2.5), ('a "b"', 1, 3.5), ("train", 1, 4.5)]
    exports.cameras_by_split(spark.createDataFrame(rows, "split string, id int, fx double").repartition(3), str(tmp_path / "c"))
    found = json.loads((tmp_path / "c" / "cameras.json").read_text())
    assert found == {'a "b"': [{"id": 1, "fx": 3.5}], "train": [{"id": 1, "fx": 4.5}, {"id": 2, "fx": 2.5}], "valid": [{"id": 3, "fx": 1.5}]} and list(found) == sorted(found)
    assert captures.cameras(spark, str(tmp_path / "c"), "valid").first().fx == 1.5
    exports.cameras_by_split(spark.createDataFrame([], "split string, id int, fx double"), str(tmp_path / "d"))
    assert (tmp_path / "d" / "cameras.json").read_text() == "{}"

import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.sinks import exports
from wayfold.sources import captures, ply, png


def test_csv_by_header_in_any_order(spark, tmp_path):
    text = "camera_serial,extra,frame_tracking_timestamp_us,uid\ns1,x,10,3\ns2,y,20,4\n"
    with gzip.open(tmp_path / "o.csv.gz", "wt") as f:
        f.write(text)
    rows = captures.observations(spark, str(tmp_path / "o.csv.gz")).orderBy("uid").collect()
    assert [tuple(r) for r in rows] == [(3, 10, "s1"), (4, 20, "s2")]
    assert captures.observations(spark, str(tmp_path / "o.csv.gz"), ["uid"]).columns == ["uid"]


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.csv").write_text("uid,px_world,py_world,pz_world,inv_dist_std,dist_std\n1,1,2,3,0.1,0.2\n")
    (tmp_path / "p" / "b.csv").write_text("uid,pz_world,py_world,px_world,more,dist_std,inv_dist_std\n2,3,2,1,x,0.2,0.1\n3,6,5,4,y,0.2,0.1\n")
    rows = captures.points(spark, str(tmp_path / "p")).orderBy("uid").collect()
    assert [tuple(r) for r in rows] == [(1, 1.0, 2.0, 3.0, 0.1, 0.2), (2, 1.0, 2.0, 3.0, 0.1, 0.2), (3, 4.0, 5.0, 6.0, 0.1, 0.2)]
    (tmp_path / "p" / "c.csv").write_text("uid,px_world\n9,1\n")
    with pytest.raises(ValueError, match="has no column py_world"):
        captures.points(spark, str(tmp_path / "p"))
    assert captures.points(spark, str(tmp_path / "p"), ["uid"]).count() == 4


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    for n in (3, 4):
        pixels = rng.integers(0, 256, (7, 5, n)).astype(np.uint8)
        assert (png.decode(png.encode(pixels)) == pixels).all()
    # every filter, made by hand
    lines = rng.integers(0, 256, (5, 4, 3)).astype(int)
    raw, before = b"", np.zeros((4, 3), int)
    for how, line in enumerate(lines):
        left = np.vstack([np.zeros((1, 3), int), line[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), before[:-1]])
        p = left + before - corner
        d = [abs(p - v) for v in (left, before, corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, corner))
        guess = [0 * line, left, before, (left + before) // 2, paeth][how]
        raw += bytes([how]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    whole = png.encode(lines.astype(np.uint8))
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", 0)
    assert (png.decode(whole[:33] + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")) == lines).all()
    rows = [("a", c, y, x, (c + 2 * y + x) / 20) for c in range(4) for y in range(3) for x in range(2)]
    exports.images(spark.createDataFrame(rows, "img string, c int, y int, x int, v double"), str(tmp_path / "png"))
    back = captures.images(spark, f"file://{tmp_path}/png").collect()
    assert len(back) == 18 and all(r.img == "a.png" and abs(r.v - (r.c + 2 * r.y + r.x) / 20) < 0.003 and abs(r["mask"] - (3 + 2 * r.y + r.x) / 20) < 0.003 for r in back)
    with pytest.raises(ValueError, match="not a PNG"):
        png.decode(b"GIF89a")


def test_ascii_and_filtered_ply(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_index\nend_header\n0 0 0\n1 0 0.5\n0 1 0\n3 0 1 2\n")
    v, f = ply.mesh(spark, f"file://{tmp_path}/a.ply")
    assert [(r.x, r.z) for r in v.orderBy("vid").collect()] == [(0, 0), (1, 0.5), (0, 0)] and [(r.a, r.b, r.c) for r in f.collect()] == [(0, 1, 2)]
    rows = [(i, float(i), 0.0, 0.0, 0.5, [1.0, 2.0, 3.0], [], [0.1] * 3, [1.0, 0.0, 0.0, 0.0]) for i in range(5)]
    splats = spark.createDataFrame(rows, "gid long, x float, y float, z float, opacity float, f_dc array<float>, f_rest array<float>, scale array<float>, rot array<float>")
    exports.splats(splats, str(tmp_path / "s.ply"), 2)
    exports.filtered_splats(splats.where("gid % 2 = 0").select("gid"), f"file://{tmp_path}/s.ply", str(tmp_path / "t.ply"))
    back = ply.splats(spark, f"file://{tmp_path}/t.ply").orderBy("gid").collect()
    assert [(r.x, r.sh_degree, r.f_dc) for r in back] == [(float(i), 2, [1.0, 2.0, 3.0]) for i in (0, 2, 4)]


def test_depth_files(spark, tmp_path):
    points = spark.createDataFrame([("rgb", f, u, 1.0 * u, 2.0, 3.0, 0.1, 0.2) for f in (1, 2) for u in (5, 4)], "camera_label string, frame long, uid long, u double, v double, z double, inverse_std double, distance_std double")
    frames = spark.createDataFrame([("rgb", 1), ("rgb", 2), ("rgb", 3)], "camera_label string, frame long")
    found = {r.frame: r.sparse_depth for r in exports.depth_files(points, frames, f"file://{tmp_path}/d", ["camera_label", "frame"]).collect()}
    assert found[3] is None and [r.uid for r in captures.sparse_depth(spark, found[2]).orderBy("uid").collect()] == [4, 5]


def test_calibration_takes_the_first_record(spark, tmp_path):
    camera = lambda label, serial, x: {"Label": label, "SerialNumber": serial, "T_Device_Camera": {"Translation": [x, 0, 1], "UnitQuaternion": [0.5, [0.1, 0.2, 0.3]]}, "Projection": {"Params": [1.0, 2, 3]}}
    lines = [{"CameraCalibrations": [camera("slam-left", "a", 1), camera("camera-rgb", None, 2)], "ReadoutTimesSec": {"slam-left": None, "camera-rgb": 0.01}}, {"CameraCalibrations": [camera("slam-left", "a", 9)]}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    rows = captures.calibration(spark, str(tmp_path / "c.jsonl"))
    assert {(r.label, r.tx, r.qw, r.qz, r.readout_s) for r in rows.collect()} == {("slam-left", 1.0, 0.5, 0.3, None), ("camera-rgb", 2.0, 0.5, 0.3, 0.01)}
    assert captures.tracking_cameras(rows).count() == 1
    assert captures.calibration(spark, str(tmp_path / "c.jsonl"), every_record=True).count() == 3


def test_frames_depth_cameras_keyframes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for n, model in (("a", "pinhole"), ("b", "fisheye")):
        frames = [{"fx": 1.0, "w": 4, "timestamp": t, "image_path": f"{n}{t}"} for t in (7, 8)]
        (tmp_path / "f" / f"{n}.json").write_text(json.dumps({"camera_model": model, "camera_label": n, "frames": frames}))
    rows = captures.frames(spark, str(tmp_path / "f"))
    assert {(r.camera_label, r.camera_model, r.timestamp, r.sparse_depth) for r in rows.collect()} == {(n, m, t, None) for n, m in (("a", "pinhole"), ("b", "fisheye")) for t in (7, 8)}
    (tmp_path / "d.json").write_text(json.dumps({"u": [1.0, 2], "v": [3.0, 4], "z": [5.0, 6], "inverseDistanceStd": [0.1, 0.2], "distanceStd": [0.3, 0.4]}))
    assert [(r.u, r.z, r.uid) for r in captures.sparse_depth(spark, str(tmp_path / "d.json")).orderBy("u").collect()] == [(1.0, 5.0, None), (2.0, 6.0, None)]
    (tmp_path / "k.json").write_text(json.dumps({"keyframe_timestamps_ns": [5, 2, 9]}))
    assert tuple(captures.keyframe_span(spark, str(tmp_path / "k.json")).first()) == (2, 9)
    (tmp_path / "c.json").write_text(json.dumps({"test": [{"id": 1, "width": 2, "fx": 3.5}]}))
    assert captures.cameras(spark, str(tmp_path / "c.json"), "test").first().fx == 3.5
    with pytest.raises(Exception, match="no split train"):
        captures.cameras(spark, str(tmp_path / "c.json"), "train").collect()
    assert captures.recordings("/r/a+b") == ["/r/a", "/r/b"]


def test_ply_round_trips(spark, tmp_path):
    cloud = spark.createDataFrame([(i, i * 1.0, 2.0, -i * 0.5, 0.2, 0.4, 1.0) for i in range(10)], "id long, x double, y double, z double, r double, g double, b double")
    exports.cloud(cloud, str(tmp_path / "cloud.ply"))
    back = ply.cloud(spark, str(tmp_path / "cloud.ply"), stride=3).orderBy("id").collect()
    assert [(r.id, r.z, round(r.g, 2)) for r in back] == [(i, -i * 0.5, 0.4) for i in (0, 3, 6, 9)]
    rest = [float(i) for i in range(12)]
    splats = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 0.5, [1.0, 2.0, 3.0], rest, [0.1, 0.2, 0.3], [1.0, 0.0, 0.0, 0.0])], "gid long, x float, y float, z float, opacity float, f_dc array<float>, f_rest array<float>, scale array<float>, rot array<float>")
    exports.splats(splats, str(tmp_path / "s.ply"), 1)
    r = ply.splats(spark, str(tmp_path / "s.ply")).first()
    assert r.f_rest == rest and r.sh_degree == 1 and r.rot == [1.0, 0.0, 0.0, 0.0]
    v = spark.createDataFrame([(i, i * 1.0, 0.0, 0.0) for i in range(4)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "fid long, a long, b long, c long")
    exports.mesh(v, f, str(tmp_path / "m.ply"))
    a, b = ply.mesh(spark, str(tmp_path / "m.ply"))
    assert a.count() == 4 and sorted((r.a, r.b, r.c) for r in b.collect()) == [(0, 1, 2), (1, 2, 3)]
    with pytest.raises(Exception, match="face list"):
        ply.mesh(spark, str(tmp_path / "cloud.ply"))[1].collect()
    with pytest.raises(ValueError):
        ply.parse(b"ply\nformat binary_big_endian 1.0\nend_header\n")
    assert ply.numbered(["f_rest_10", "f_rest_2", "x"], "f_rest_") == ["f_rest_2", "f_rest_10"]


def test_exports(spark, tmp_path):
    lists = spark.createDataFrame([(1, [3, 1]), (0, [2])], "point long, views array<long>")
    exports.visibility(lists, str(tmp_path / "v.bin"), 4)
    assert exports.read_visibility(str(tmp_path / "v.bin")) == (4, [[2], [1, 3]])
    views = spark.createDataFrame([(2, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 1, "b"), (1, 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 1, "a")], "id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string")
    lines = [r.value for r in exports.colmap_images(views).collect()]
    assert lines[0] == "1 1.0000000000 0.0000000000 0.0000000000 0.0000000000 0.5000000000 0.0000000000 0.0000000000 1 a" and lines[1] == "" and len(lines) == 4
    cams = spark.createDataFrame([(1, 4, 5, 1.0, 1.0, 1.5, 2.0)], "id int, w int, h int, fx double, fy double, cx double, cy double")
    assert exports.colmap_cameras(cams).first().value == "1 PINHOLE 4 5 1.00000000 1.00000000 2.00000000 2.50000000"
    frames = spark.createDataFrame([("rgb", 9, "b"), ("rgb", 3, "a")], "camera_label string, timestamp long, image_path string")
    exports.frame_set(frames, str(tmp_path / "set"), ["camera_label"])
    back = captures.frames(spark, str(tmp_path / "set"))
    assert [(r.uid, r.image_path) for r in back.orderBy("uid").collect()] == [(0, "a"), (1, "b")]
    value = exports.report(spark.range(1).select(F.struct(F.lit(1.5).alias("a"), F.lit(2).alias("b")).alias("floor")), str(tmp_path / "r.json"))
    assert value == json.loads((tmp_path / "r.json").read_text()) and "| floor.a | 1.5 |" in exports.markdown(value, "Report")
    log = spark.createDataFrame([("psnr", "a", 1.0), ("psnr", "b", 2.0)], "metric string, key string, value double")
    assert exports.metrics_log(log).first()["values"] == {"a": 1.0, "b": 2.0}
    points = spark.createDataFrame([("rgb", 1, 5, 1.0, 2.0, 3.0, 0.1, 0.2), ("rgb", 1, 4, 1.5, 2.0, 3.0, 0.1, 0.2)], "camera_label string, frame long, uid long, u double, v double, z double, inverse_std double, distance_std double")
    assert exports.depth_arrays(points, ["frame"]).first().uid == [4, 5]
    exports.sparse_depth(points, str(tmp_path / "depth"))
    assert spark.read.parquet(str(tmp_path / "depth")).count() == 2
    assert np.isclose(points.agg(F.sum("u")).first()[0], 2.5)


def test_visibility_is_packed_in_order(spark, tmp_path):
    rows = [(7, [3, 1]), (2, []), (5, None), (1, [4]), (9, [2, 2, 0])]
    lists = spark.createDataFrame(rows, "point long, views array<long>").repartition(3)
    exports.visibility(lists, f"{tmp_path}/seen.bin", 6)
    data = (tmp_path / "seen.bin").read_bytes()
    assert np.frombuffer(data[:16], "<u8").tolist() == [6, 5]
    assert np.frombuffer(data[16:], "<u4").tolist() == [1, 4, 0, 0, 2, 1, 3, 3, 0, 2, 2]
    exports.visibility(lists.limit(0), f"{tmp_path}/none.bin", 0)
    assert np.frombuffer((tmp_path / "none.bin").read_bytes(), "<u8").tolist() == [0, 0]

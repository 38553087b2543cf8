"""Queries over files: each writes a table in a capture's format, reads it back, and returns what was read.

Files lie in the folder that the cluster shares (spark.checkpoint.dir).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import quality, sequence, spatial
from wayfold.plans import proxies as px
from wayfold.plans import stages
from wayfold.plans.proxies import with_views
from wayfold.sinks import exports
from wayfold.sources import captures, package, ply

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def r(x: Column, n: int = 6) -> Column:
    return F.round(x, n) + 0.0


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{spatial.shared(spark)}/files/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def part(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


# --- sources


@query("select t_us as tracking_timestamp_us, round(tx, 9) + 0.0 as tx_world_device, round(qw, 9) + 0.0 as qw_world_device from px_pose", "px_pose")
def SRC01_trajectory(spark, d):
    path, q = folder(spark), ("qx", "qy", "qz", "qw")
    rows = px.poses(spark, d).select(F.col("t_us").alias("tracking_timestamp_us"), F.lit("x").alias("graph_uid"), *(F.col(c).alias(f"{c}_world_device") for c in ("tx", "ty", "tz", *q)))
    rows.write.csv(path, header=True)
    back = captures.trajectory(spark, path, ["tracking_timestamp_us", "tx_world_device", "qw_world_device"])
    return back.select("tracking_timestamp_us", r(F.col("tx_world_device"), 9).alias("tx_world_device"), r(F.col("qw_world_device"), 9).alias("qw_world_device"))


@query("select uid, px as px_world, pz as pz_world, dist_std from px_points", "px_points")
def SRC02_points(spark, d):
    """Two files of other column orders, compressed."""
    path, p = folder(spark), px.points(spark, d)
    names = {"uid": "uid", "px": "px_world", "py": "py_world", "pz": "pz_world", "inv_dist_std": "inv_dist_std", "dist_std": "dist_std"}
    for half, order in ((0, list(names)), (1, list(names)[::-1])):
        p.where(F.col("uid") % 2 == half).select(*(F.col(c).alias(names[c]) for c in order)).write.csv(f"{path}/{half}", header=True, compression="gzip")
    return captures.points(spark, [f"{path}/0", f"{path}/1"], ["uid", "px_world", "pz_world", "dist_std"])


@query("select uid, t_us as frame_tracking_timestamp_us, camera_serial from px_obs", "px_obs")
def SRC03_observations(spark, d):
    path = folder(spark)
    px.observations(spark, d).select("uid", F.lit(0.5).alias("u"), F.col("t_us").alias("frame_tracking_timestamp_us"), "camera_serial").write.csv(path, header=True, compression="gzip")
    return captures.observations(spark, path)


@query("select camera_serial as serial, label, round(cam_tx, 6) as tx, [f, cx, cy] as params, case when label = 'slam-2' then null else 0.01 end as readout_s from px_calib", "px_calib")
def SRC04_calibration(spark, d):
    """The first of several records; the others are shifted."""
    path, c = folder(spark), px.calibration(spark, d)
    camera = lambda k: F.struct(F.col("label").alias("Label"), F.col("camera_serial").alias("SerialNumber"), F.struct(F.array(F.col("cam_tx") + k, F.lit(0.0), F.lit(0.0)).alias("Translation"), F.array(F.lit(1.0), F.lit(0.0)).alias("_")).alias("T_Device_Camera"), F.struct(F.array("f", "cx", "cy").alias("Params")).alias("Projection"))
    readout = F.map_from_entries(F.collect_list(F.struct("label", F.when(F.col("label") != "slam-2", 0.01))))
    lines = [c.agg(F.to_json(F.struct(F.lit(k).alias("n"), F.array_sort(F.collect_list(camera(float(k)))).alias("CameraCalibrations"), readout.alias("ReadoutTimesSec")), {"ignoreNullFields": "false"}).alias("value")) for k in range(3)]
    lines[0].unionAll(lines[1]).unionAll(lines[2]).coalesce(1).write.text(path)
    found = captures.tracking_cameras(captures.calibration(spark, path))
    return found.select("serial", "label", F.round("tx", 6).alias("tx"), "params", "readout_s")


def frame_rows(spark, d) -> DataFrame:
    f = px.frames(spark, d)
    return f.select(F.concat(F.lit("rec"), "rec_id").alias("camera_label"), F.lit("fisheye").alias("camera_model"), F.col("t_ns").alias("timestamp"), F.concat(F.lit("images/"), F.col("t_ns").cast("string"), F.lit(".png")).alias("path"), "exposure_s", "gain")


NUMBERED = "select 'rec' || rec_id as camera_label, t_ns as timestamp, gain, row_number() over (partition by rec_id order by 'images/' || t_ns::varchar || '.png', t_ns) - 1 as uid from px_frames"


@query(NUMBERED, "px_frames")
def SRC06_raw_frames(spark, d):
    path = folder(spark)
    rows = frame_rows(spark, d).withColumnsRenamed({"path": "file_path", "exposure_s": "exposure_duration_s"})
    exports.frame_set(rows, path, ["camera_label", "camera_model"])
    return captures.frames(spark, path, rectified=False).select("camera_label", "timestamp", "gain", F.col("uid").cast("long").alias("uid"))


@query(NUMBERED, "px_frames")
def SRC07_SNK01_frame_sets(spark, d):
    path = folder(spark)
    rows = frame_rows(spark, d).withColumnsRenamed({"path": "image_path", "exposure_s": "exposure_duration_s"})
    exports.frame_set(rows, path, ["camera_label", "camera_model"])
    return captures.frames(spark, path).select("camera_label", "timestamp", "gain", F.col("uid").cast("long").alias("uid"))


@query("select uid % 25 as frame, count(*) as n, round(sum(px), 4) as u, round(sum(inv_dist_std), 6) as s, 'frame=' || (uid % 25) as place from px_points group by uid % 25", "px_points")
def SRC08_SNK02_depth_files(spark, d):
    """A file for each frame, whose place is written back on the frame; then all files are read."""
    path = folder(spark)
    p = px.points(spark, d).select(F.lit("rgb").alias("camera_label"), (F.col("uid") % 25).alias("frame"), "uid", F.col("px").alias("u"), F.col("py").alias("v"), F.col("pz").alias("z"), F.col("inv_dist_std").alias("inverse_std"), F.col("dist_std").alias("distance_std"))
    frames = exports.depth_files(p, p.select("camera_label", "frame").distinct(), path, ["camera_label", "frame"])
    back = captures.sparse_depth(spark, f"{path}/*/*").withColumn("frame", F.regexp_extract("source", r"frame=(\d+)", 1).cast("long"))
    sums = back.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("u"), 4).alias("u"), F.round(F.sum("inverseDistanceStd"), 6).alias("s"))
    return sums.join(frames.select("frame", F.substring_index("sparse_depth", "/", -1).alias("place")), "frame")


@query("select gid, round(x, 4) as x, round(opacity_logit::float::double, 4) + 0.0 as opacity, round(s0::float::double, 4) + 0.0 as scale, 7.0::double as tenth, 2 as sh_degree from px_splat", "px_splat")
def SRC09_SNK03_splats(spark, d):
    path = folder(spark)
    rest = F.array(*(F.lit(float(i)).cast("float") for i in range(24)))
    rows = px.splats(spark, d).select("gid", *(F.col(c).cast("float").alias(c) for c in "xyz"), F.col("opacity_logit").cast("float").alias("opacity"), F.array(*[F.lit(0.5).cast("float")] * 3).alias("f_dc"), rest.alias("f_rest"), F.array(*(F.col(f"s{i}").cast("float") for i in range(3))).alias("scale"), F.array(*(F.lit(v).cast("float") for v in (1.0, 0.0, 0.0, 0.0))).alias("rot"))
    numbered = spatial.dense_ids(rows, ["gid"], "place")
    exports.splats(rows, f"{path}/s.ply", 2)
    back = ply.splats(spark, f"{path}/s.ply").withColumnRenamed("gid", "place").join(numbered.select("place", "gid"), "place")
    return back.select("gid", F.round(F.col("x").cast("double"), 4).alias("x"), r(F.col("opacity").cast("double"), 4).alias("opacity"), r(F.col("scale")[0].cast("double"), 4).alias("scale"), F.col("f_rest")[7].cast("double").alias("tenth"), "sh_degree")


@query("select gid, round(x::float::double, 4) as x, 2 as sh_degree from px_splat where gid % 3 = 0", "px_splat")
def SNK03_filtered_splats(spark, d):
    """A splat file with some rows only; its metadata and properties stay."""
    path = folder(spark)
    one = lambda *v: F.array(*(F.lit(x).cast("float") for x in v))
    rows = px.splats(spark, d).select("gid", *(F.col(c).cast("float").alias(c) for c in "xyz"), F.lit(0.0).cast("float").alias("opacity"), one(0.5, 0.5, 0.5).alias("f_dc"), one().cast("array<float>").alias("f_rest"), one(0.1, 0.1, 0.1).alias("scale"), one(1.0, 0.0, 0.0, 0.0).alias("rot"))
    numbered = spatial.dense_ids(rows.select("gid"), ["gid"], "place")
    exports.splats(rows, f"{path}/s.ply", 2)
    exports.filtered_splats(numbered.where("gid % 3 = 0").select(F.col("place").alias("gid")), f"{path}/s.ply", f"{path}/t.ply")
    again = spatial.dense_ids(rows.where("gid % 3 = 0").select(F.col("gid").alias("own")), ["own"], "gid")
    return ply.splats(spark, f"{path}/t.ply").join(again, "gid").select(F.col("own").alias("gid"), F.round(F.col("x").cast("double"), 4).alias("x"), "sh_degree")


@query("select f.fid, a.vid as a, round(a.x::float::double, 4) as ax, round(c.z::float::double, 4) + 0.0 as cz from (select *, row_number() over (order by fid) - 1 as place from px_face) f join px_vertex a on a.vid = f.a join px_vertex c on c.vid = f.c", "px_vertex", "px_face")
def SRC10_SNK03_mesh(spark, d):
    path, f = folder(spark), px.faces(spark, d)
    exports.mesh(px.vertices(spark, d), f, f"{path}/m.ply")
    v, t = ply.mesh(spark, f"{path}/m.ply")
    places = spatial.dense_ids(f.select(F.col("fid").alias("own")), ["own"], "fid")
    corner = lambda k: v.select(F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in "xyz"))
    rows = t.join(corner("a"), "a").join(corner("c"), "c").join(places, "fid")
    return rows.select(F.col("own").alias("fid"), "a", F.round("ax", 4).alias("ax"), r(F.col("cz"), 4).alias("cz"))


@query("select place as id, round(x::float::double, 4) + 0.0 as x, round(round(least(1, greatest(0, z + 0.5))*255)/255, 4) as r from (select *, row_number() over (order by id) - 1 as place from px_cloud) where place % 3 = 0 and abs((least(1, greatest(0, z + 0.5))*255) % 1 - 0.5) > 1e-6", "px_cloud")
def SRC11_SNK03_cloud(spark, d):
    """Every third point of a coloured cloud; a colour half between two bytes is left out of the comparison."""
    path = folder(spark)
    red = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("z") + 0.5))
    rows = spatial.dense_ids(px.cloud(spark, d), ["id"], "place").select(F.col("place").alias("id"), "x", "y", "z", red.alias("r"), F.lit(0.5).alias("g"), F.lit(1.0).alias("b"))
    exports.cloud(rows, f"{path}/c.ply")
    kept = rows.where(F.abs((F.col("r") * 255) % 1 - 0.5) > 1e-6).select("id")
    return ply.cloud(spark, f"{path}/c.ply", 3).join(kept, "id", "left_semi").select("id", r(F.col("x"), 4).alias("x"), F.round("r", 4).alias("r"))


@query("select case when p_partkey % 8 = 0 then 'valid' else 'train' end as split, p_partkey::int as id, (480 + p_size)::int as width, 0.5::double as fov_x, p_size*1.0::double as tx from part")
def SRC12_SNK08_cameras(spark, d):
    path, s = folder(spark), F.col("p_size")
    c2w = F.array(*(F.array(*(F.lit(float(i == j)) if (i, j) != (0, 3) else s.cast("double") for j in range(4))) for i in range(4)))
    rows = part(spark, d).select(F.when(F.col("p_partkey") % 8 == 0, "valid").otherwise("train").alias("split"), F.col("p_partkey").cast("int").alias("id"), (480 + s).cast("int").alias("width"), F.lit(600).alias("height"), F.lit(0.5).alias("fov_x"), c2w.alias("c2w"))
    exports.cameras_by_split(rows, path)
    both = [captures.cameras(spark, path, n).select(F.lit(n).alias("split"), "id", "width", "fov_x", F.col("c2w")[0][3].alias("tx")) for n in ("train", "valid")]
    return both[0].unionAll(both[1])


@query("select img || '.png' as img, c, y, x, round(round(gt*255)/255.0, 6) as v, mask*1.0::double as mask from px_img where abs((gt*255) % 1 - 0.5) > 1e-6", "px_img")
def SRC13_SNK11_images(spark, d):
    """Images with an alpha channel, written as PNG files and read again."""
    path, rows = folder(spark), px.images(spark, d)
    alpha = rows.where("c = 0").select("img", F.lit(3).alias("c"), "y", "x", F.col("mask").cast("double").alias("v"))
    exports.images(rows.select("img", F.col("c").cast("int").alias("c"), "y", "x", F.col("gt").alias("v")).unionAll(alpha), path)
    return captures.images(spark, path).select("img", F.col("c").cast("long").alias("c"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("v", 6).alias("v"), "mask")


@query("select min(t_ns) as first, max(t_ns) as last from px_frames where frame_id % 5 = 0", "px_frames")
def SRC14_keyframe_span(spark, d):
    path = folder(spark)
    f = px.frames(spark, d).where("frame_id % 5 = 0").withColumn("file", F.pmod("rec_id", F.lit(3)))
    f.groupBy("file").agg(F.collect_list("t_ns").alias("keyframe_timestamps_ns")).select(F.to_json(F.struct("keyframe_timestamps_ns")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return captures.keyframe_span(spark, path)


@query("select event_type as recording, count(*) as n from events group by event_type")
def SRC15_recordings(spark, d):
    """The folders of one list of recordings, read side by side."""
    root = folder(spark)
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id")
    e.write.partitionBy("event_type").parquet(root)
    kinds = [x["event_type"] for x in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    folders = captures.recordings(f"{root}/" + "+".join(f"event_type={k}" for k in kinds))
    rows = spark.read.option("basePath", root).parquet(*folders)
    return rows.groupBy(F.col("event_type").alias("recording")).agg(F.count("*").alias("n"))


@query("select max(n_nationkey)*1000 as latest from nation")
def SRC18_latest_iteration(spark, d):
    root = folder(spark)
    nation = spark.read.parquet(f"{d}/nation.parquet")
    nation.select(F.concat(F.lit("iteration_"), F.col("n_nationkey") * 1000).alias("place"), F.lit("x").alias("value")).write.partitionBy("place").text(root)
    return spark.range(1).select(F.lit(captures.latest_iteration(spark, root)).cast("long").alias("latest"))


# --- sinks


@query("with o as (select distinct l_orderkey % 500 as point, l_suppkey % 40 as view from lineitem), p as (select point, count(*) as n, sum(view)::bigint as views, min(view) as first from o group by point) select row_number() over (order by point) - 1 as place, n, views, first, (select count(*) from p) as points from p")
def SNK04_visibility(spark, d):
    path = folder(spark)
    o = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 500).alias("point"), (F.col("l_suppkey") % 40).alias("view")).distinct()
    exports.visibility(o.groupBy("point").agg(F.collect_list("view").alias("views")), f"{path}/v.bin", 40)
    return exports.visibility_rows(spark, f"{path}/v.bin").select("place", "n", "views", "first", "points")


@query("@i as (select sample_id as id, printf('%d %.10f %.10f %.10f %.10f %.10f %.10f %.10f %d %s', sample_id, round(qw, 5), round(qx, 5), round(qy, 5), round(qz, 5), round(tx, 5), round(ty, 5), round(tz, 5), 1, 'f' || sample_id) as value from px_pose), c as (select p_partkey as id, printf('%d PINHOLE %d %d %.8f %.8f %.8f %.8f', p_partkey, 480, 600, 300.0::double, 300.0::double, 240.5::double, p_size + 0.5::double) as value from part) select 'images' as file, value, count(*) as n from (select value from i union all select '' from i) group by value union all select 'cameras', value, 1 from c", "px_pose")
def SNK05_text_models(spark, d):
    path = folder(spark)
    views = px.poses(spark, d).select(F.col("sample_id").alias("id"), *(F.round(c, 5).alias(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")), F.lit(1).alias("camera_id"), F.concat(F.lit("f"), "sample_id").alias("name"))
    cameras = part(spark, d).select(F.col("p_partkey").alias("id"), F.lit(480).alias("w"), F.lit(600).alias("h"), F.lit(300.0).alias("fx"), F.lit(300.0).alias("fy"), F.lit(240.0).alias("cx"), F.col("p_size").cast("double").alias("cy"))
    exports.text(exports.colmap_images(views), f"{path}/images")
    exports.text(exports.colmap_cameras(cameras), f"{path}/cameras")
    both = [spark.read.text(f"{path}/{n}").select(F.lit(n).alias("file"), "value") for n in ("images", "cameras")]
    return both[0].unionAll(both[1]).groupBy("file", "value").agg(F.count("*").alias("n"))


@query("select 'floor.points' as metric, count(*)::double as value from px_points union all select 'floor.height', round(avg(pz), 4) from px_points union all select 'views', count(distinct camera_serial)::double from px_obs", "px_points", "px_obs")
def SNK06_report(spark, d):
    """A report's Markdown table, read back line by line."""
    path = folder(spark)
    floor = px.points(spark, d).agg(F.count("*").alias("points"), F.round(F.avg("pz"), 4).alias("height")).select(F.struct("*").alias("floor"))
    row = floor.join(F.broadcast(px.observations(spark, d).agg(F.count_distinct("camera_serial").alias("views"))))
    value = exports.report(row, f"{path}/report.json")
    exports.text(spark.createDataFrame([(x,) for x in exports.markdown(value, "Report").splitlines()], "value string"), f"{path}/md")
    cells = F.split("value", r" *\| *")
    return spark.read.text(f"{path}/md").where("value LIKE '| %' AND value NOT LIKE '| metric%'").select(cells[1].alias("metric"), cells[2].cast("double").alias("value"))


@query("select m.metric, 'frame_' || img as key, round(case m.metric when 'l1' then l1 else mse end, 6) as value from (select img, avg(abs(pred-gt)) as l1, avg((pred-gt)**2) as mse from px_img group by img), (select unnest(['l1', 'mse']) as metric) m", "px_img")
def SNK07_test_log(spark, d):
    path = folder(spark)
    e = F.col("pred") - F.col("gt")
    per = px.images(spark, d).groupBy("img").agg(F.avg(F.abs(e)).alias("l1"), F.avg(e * e).alias("mse"))
    long = per.select(F.concat(F.lit("frame_"), "img").alias("key"), F.explode(F.create_map(F.lit("l1"), F.round("l1", 6), F.lit("mse"), F.round("mse", 6))).alias("metric", "value"))
    exports.metrics_log(long).select(F.to_json(F.struct("metric", "values")).alias("value")).write.text(path)
    return spark.read.schema("metric string, values map<string,double>").json(path).select("metric", F.explode("values").alias("key", "value"))


@query("select 'confident' as stage, count(*) filter (inv_dist_std < 0.005) as rows, 1 as runs from px_points union all select 'heights', (select count(*) from (select distinct floor(pz) from px_points where inv_dist_std < 0.005)), 1 union all select 'forced', count(*) filter (inv_dist_std < 0.005), 2 from px_points", "px_points")
def ORC1_ORC2_SNK13_stages(spark, d):
    """A pipeline of two stages, run twice (the second run makes nothing) and once by force up to its first stage."""
    path = folder(spark)
    plan = [
        stages.Stage("confident", lambda s, h: h["points"].where("inv_dist_std < 0.005"), ["points"], lambda df: {"some": df.agg((F.count("*") >= 0).alias("ok"))}),
        stages.Stage("heights", lambda s, h: h["confident"].select(F.floor("pz").alias("k")).distinct(), ["confident"]),
    ]
    source = {"points": px.points(spark, d)}
    for _ in range(2):
        made = stages.run(spark, plan, path, source)
    runs = spatial.keep(stages.finished(spark, f"{path}/_manifest"))
    forced = stages.run(spark, plan, path, source, force=True, stop_after="confident")
    again = stages.finished(spark, f"{path}/_manifest").where("stage = 'confident'")
    count = lambda df, name, done: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), "rows").join(F.broadcast(done.agg(F.count("*").cast("int").alias("runs"))))
    parts = [count(made[n], n, runs.where(F.col("stage") == n)) for n in ("confident", "heights")]
    return parts[0].unionAll(parts[1]).unionAll(count(forced["confident"], "forced", again))


@query("select 'train.steps' as name, '30000' as value union all select 'train.loss.l1', '0.5' union all select 'window.start', null union all select 'window.end', '12' union all select 'scene', '\"yard\"'")
def SRC16_settings(spark, d):
    """A settings file with overrides; a time of -1 is unset."""
    path = folder(spark)
    spark.createDataFrame([('{"train": {"steps": 1000, "loss": {"l1": 0.8}}, "window": {"start": -1, "end": -1}, "scene": "walk"}',)], "value string").coalesce(1).write.text(path)
    return captures.settings(spark, path, ["train.steps=30000", "train.loss.l1=0.5", "window.end=12", 'scene="yard"'])


@query("select row_number() over (order by gid) - 1 as row, round(s0, 2) as scale, true as exact, 'root.usda,volume.bin' as names, true as same from px_splat", "px_splat")
def SRC17_SNK09_volume_package(spark, d):
    """A scene package written twice: equal bytes, its entries in order, its payload in half floats."""
    path = folder(spark)
    lists = lambda *c: F.array(*(F.col(x).cast("float") if isinstance(x, str) else F.lit(x).cast("float") for x in c))
    rows = px.splats(spark, d).select("gid", *(F.col(c).cast("float").alias(c) for c in "xyz"), F.col("opacity_logit").cast("float").alias("opacity"), lists("s0", "s1", "s2").alias("scale"), lists(1.0, 0.0, 0.0, 0.0).alias("rot"), lists(0.5, 0.5, 0.5).alias("f_dc"))
    for n in ("a", "b"):
        exports.volume(rows, f"{path}/{n}.zip", b"#usda 1.0")
    e = package.entries(spark, f"{path}/*.zip")
    whole = e.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("names"), F.max(F.when(F.col("name") == "volume.bin", F.col("sha256"))).alias("sha")).agg(F.first("names").alias("names"), (F.count_distinct("sha") == 1).alias("same"))
    numbered = spatial.dense_ids(px.splats(spark, d).select("gid", "s0"), ["gid"], "row")
    scales = package.values(spark, f"{path}/a.zip", "volume.bin").where("field = 'scales'").join(numbered, "row")
    return scales.join(F.broadcast(whole)).select("row", F.round("s0", 2).alias("scale"), (F.abs(F.col("value")[0] - F.col("s0")) <= 0.001 * F.abs("s0") + 1e-3).alias("exact"), "names", "same")


FACTS = "f as (select rec_id, count(*) as frames, (max(t_ns) - min(t_ns))/1e9 as seconds from px_frames group by rec_id)"


@query(f"@{FACTS} select rec_id, frames, round(seconds, 3) as seconds, round(case when seconds > 0 then (frames - 1)/seconds end, 9) as per_second, 4 as cameras, 1 as global_shutter, case when rec_id % 3 = 0 then 'points.csv.gz' else '' end as missing, 1008.0::double as focal from f", "px_frames")
def ORC4_recording_facts(spark, d):
    cameras = px.calibration(spark, d).select(F.when(F.col("camera_serial") != "cam2", 0.01).alias("readout"))
    frames = px.frames(spark, d)
    names = F.when(F.col("rec_id") % 3 == 0, F.array(F.lit("trajectory.csv"))).otherwise(F.array(F.lit("trajectory.csv"), F.lit("points.csv.gz")))
    files = frames.select("rec_id").distinct().select("rec_id", F.explode(names).alias("name"))
    found = quality.recording_facts(frames, cameras, files, ["trajectory.csv", "points.csv.gz"], 2016, 90)
    return found.select("rec_id", "frames", F.round("seconds", 3).alias("seconds"), F.round("per_second", 9).alias("per_second"), F.col("cameras").cast("int").alias("cameras"), F.col("global_shutter").cast("int").alias("global_shutter"), "missing", "focal")


@query("select p_partkey as id, case p_partkey % 4 when 0 then 'rewritten' when 1 then 'already' else 'refused' end as status, case p_partkey % 4 when 0 then 1.0 when 1 then 1.0 else 2.0 end::double as first from part")
def ORC6_frame_fix(spark, d):
    """A transform is rewritten only where it is the known one."""
    known, eye = [-1.0, 0, 0, 0, 0, 0, -1, 0, 0, -1, 0, 0, 0, 0, 0, 1], [float(i % 5 == 0) for i in range(16)]
    k = F.col("p_partkey") % 4
    array = lambda v: F.array(*(F.lit(float(x)) for x in v))
    rows = part(spark, d).select(F.col("p_partkey").alias("id"), F.when(k == 0, array(known)).when(k == 1, array(eye)).otherwise(array([2.0, *eye[1:]])).alias("m"))
    return quality.rewritten(rows, "m", known, eye).select("id", "status", F.col("m")[0].alias("first"))


KEYS = "o as (select rec_id, tx + cos(sample_id)/10 as tx, 0.5 + sin(sample_id)/20 as fov, row_number() over w - 1 as k, count(*) over (partition by rec_id) as n from px_traj window w as (partition by rec_id order by t_us, sample_id)), v as (select *, lead(tx) over w as tx1, lead(fov) over w as fov1, 0.4*(lead(tx) over w - lag(tx) over w) as mx, 0.4*(lead(fov) over w - lag(fov) over w) as mf from o where n > 2 window w as (partition by rec_id order by k)), s as (select *, lead(mx) over w as ex, lead(mf) over w as ef from v window w as (partition by rec_id order by k)), q as (select rec_id, k, n, tx, fov, tx1, fov1, case when k = 0 then 1.5*(tx1-tx) - 0.5*ex else mx end as bx, case when k = 0 then 1.5*(fov1-fov) - 0.5*ef else mf end as bf, case when k = n-2 then 1.5*(tx1-tx) - 0.5*mx else ex end as ex, case when k = n-2 then 1.5*(fov1-fov) - 0.5*mf else ef end as ef from s where k < n-1), i as (select q.*, i, (n-1)*i/(2*n)::double as t from q, lateral (select unnest(range(ceil(k*2*n/(n-1)::double)::bigint, ceil((k+1)*2*n/(n-1)::double)::bigint)) as i)), u as (select *, t - k as h from i)"
BLEND = lambda a, b: f"(2*h*h*h - 3*h*h + 1)*{a} + (h*h*h - 2*h*h + h)*b{b} + (3*h*h - 2*h*h*h)*{a}1 + (h*h*h - h*h)*e{b}"


def sampled(spark, d) -> DataFrame:
    """Twice as many frames as key frames along each recording's trajectory."""
    keys = px.trajectory(spark, d).withColumns({"tx": F.col("tx") + F.cos("sample_id") / 10, "fov": 0.5 + F.sin("sample_id") / 20}).withColumn("at", F.struct("t_us", "sample_id"))
    n = keys.groupBy("rec_id").agg((2 * F.count("*")).alias("frames")).where("frames > 4")
    return sequence.spline(keys.join(n, "rec_id"), ["rec_id"], "at", ["tx", "fov"], "frames", tension=0.2)


@query(f"@{KEYS} select rec_id, i, round(t, 5) as t, round({BLEND('tx', 'x')}, 4) + 0.0 as tx, round({BLEND('fov', 'f')}, 5) + 0.0 as fov from u", "px_traj")
def P34_spline(spark, d):
    return sampled(spark, d).select("rec_id", "i", F.round("t", 5).alias("t"), r(F.col("tx"), 4).alias("tx"), r(F.col("fov"), 5).alias("fov"))


@query(f"@{KEYS} select rec_id, 30 as fps, count(*) as frames, round(sum({BLEND('fov', 'f')}), 3) as fov from u group by rec_id", "px_traj")
def SNK12_camera_paths(spark, d):
    """A file for each camera path, read back."""
    path = folder(spark)
    exports.camera_paths(sampled(spark, d).drop("t"), path, ["rec_id"], {"camera_type": "perspective", "fps": 30, "render_width": 1920})
    back = spark.read.schema("rec_id LONG, fps INT, camera_path ARRAY<STRUCT<i: LONG, tx: DOUBLE, fov: DOUBLE>>").json(path, multiLine=True)
    return back.select("rec_id", "fps", F.explode("camera_path").alias("c")).groupBy("rec_id", "fps").agg(F.count("*").alias("frames"), F.round(F.sum("c.fov"), 3).alias("fov"))


@query("@a as (select p_partkey as id, (20 + p_size)/40.0::double as aspect, 1e6*(1 + p_partkey % 30) as rays from part), h as (select *, greatest(least(1024, (round_even(sqrt(rays/30/aspect)/10, 0)*10)::int), 30) as h from a) select id, case when aspect > 1 then 1024 else trunc(1024*aspect)::int end as width, case when aspect > 1 then trunc(1024/aspect)::int else 1024 end as height, least(trunc(h*aspect)::int, 1024) as moving_width, case when trunc(h*aspect)::int > 1024 then trunc(1024/aspect)::int else h end as moving_height from h", "px_points")
def P35_picture_sizes(spark, d):
    """Sizes of a still picture, and of one that a budget of rays allows at 30 frames a second."""
    rows = part(spark, d).select(F.col("p_partkey").alias("id"), ((20 + F.col("p_size")) / 40.0).alias("aspect"), (1e6 * (1 + F.col("p_partkey") % 30)).alias("rays"))
    (a, b), (c, e) = g.fitting(1024, F.col("aspect")), g.affordable(1024, F.col("aspect"), F.col("rays"), 30.0)
    return rows.select("id", a.alias("width"), b.alias("height"), c.alias("moving_width"), e.alias("moving_height"))


@query("@f as (select *, row_number() over (order by fid) - 1 as place from px_face) select place, corner, case corner when 0 then a when 1 then b else c end as vid, true as aligned, 'root.usda,mesh.usda' as names from f, range(3) t(corner)", "px_vertex", "px_face")
def SNK10_mesh_package(spark, d):
    """A package of layers: the root first, all data at multiples of 64 bytes; the mesh layer's faces are read back."""
    path = folder(spark)
    exports.usd_mesh(px.vertices(spark, d), px.faces(spark, d), f"{path}/m.usdz")
    e = package.entries(spark, f"{path}/m.usdz")
    whole = e.agg(F.bool_and(F.col("at") % 64 == 0).alias("aligned"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("names"))
    listed = F.split(F.regexp_extract(F.col("content").cast("string"), r"faceVertexIndices = \[([^\]]*)\]", 1), ", ")
    rows = e.where("name = 'mesh.usda'").select(F.posexplode(listed).alias("n", "v")).join(F.broadcast(whole))
    return rows.select(F.floor(F.col("n") / 3).alias("place"), (F.col("n") % 3).cast("long").alias("corner"), F.col("v").cast("long").alias("vid"), "aligned", "names")

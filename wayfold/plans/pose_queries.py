"""Queries over observations, trajectories and cameras."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import asof, motion, sequence, spatial
from wayfold.plans import proxies as px
from wayfold.plans.proxies import with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TOLERANCE, DAY = 20 * 60 * 1_000_000, 86_400_000_000


def query(sql: str, *views: str):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def r(x: Column, n: int = 6) -> Column:
    return F.round(x, n) + 0.0


def confident(points: DataFrame, inverse: float = 0.005, distance: float = 0.01) -> DataFrame:
    return points.where((F.col("inv_dist_std") < inverse) & (F.col("dist_std") < distance))


CONFIDENT = "inv_dist_std < 0.005 and dist_std < 0.01"


@query(f"@o as (select distinct * from px_obs semi join (select uid from px_points where {CONFIDENT}) p using (uid)), n as (select uid, count(*) as n from o group by uid) select count(*) as n_points, sum(n)::bigint as n_obs, quantile_cont(n, 0.05) as p5, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.95) as p95 from n", "px_points", "px_obs")
def A03_obs_per_point(spark, d):
    seen = px.observations(spark, d).distinct().join(confident(px.points(spark, d)).select("uid"), "uid", "left_semi")
    n = seen.groupBy("uid").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_points"), F.sum("n").alias("n_obs"), *(F.percentile("n", F.lit(q)).alias(a) for q, a in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))))


@query("select p.uid, count(o.uid) as n from px_points p left join px_obs o on o.uid = p.uid group by p.uid", "px_points", "px_obs")
def A05_zero_filled_counts(spark, d):
    n = px.observations(spark, d).groupBy("uid").agg(F.count("*").alias("n"))
    return px.points(spark, d).select("uid").join(n, "uid", "left").select("uid", F.coalesce("n", F.lit(0)).alias("n"))


VIEWS = "v as (select t_us, camera_serial, row_number() over (order by t_us, camera_serial) - 1 as view_idx from (select distinct t_us, camera_serial from px_obs))"


def views(spark, d) -> DataFrame:
    return spatial.dense_ids(px.observations(spark, d).select("t_us", "camera_serial").distinct(), ["t_us", "camera_serial"], "view_idx")


@query(f"@{VIEWS} select * from v", "px_obs")
def W01_view_ids(spark, d):
    return views(spark, d)


@query("select c.label, count(*) as n_views from (select distinct t_us, camera_serial from px_obs) o join px_calib c using (camera_serial) group by c.label", "px_obs", "px_calib")
def A04_views_per_camera(spark, d):
    seen = px.observations(spark, d).select("t_us", "camera_serial").distinct()
    return seen.join(px.calibration(spark, d), "camera_serial").groupBy("label").agg(F.count("*").alias("n_views"))


@query(f"@{VIEWS}, o as (select distinct o.uid, v.view_idx from px_obs o join v using (t_us, camera_serial)), n as (select uid, count(*) as n from o group by uid), s as (select uid, sum(n) over (order by uid) - n as first from n) select o.uid, o.view_idx, row_number() over (partition by o.uid order by view_idx) - 1 as rank, (s.first + row_number() over (partition by o.uid order by view_idx) - 1)::bigint as place from o join s using (uid)", "px_obs")
def A06_visibility_lists(spark, d):
    # a view is one pair of time and camera, so rows stay distinct; one exchange by point serves ranks and counts
    seen = px.observations(spark, d).distinct().join(views(spark, d), ["t_us", "camera_serial"]).select("uid", "view_idx")
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy("view_idx")) - 1)
    first = spatial.offsets(seen.groupBy("uid").agg(F.count("*").alias("n")), "uid", "n", "first")
    return ranked.join(first, "uid").select("uid", "view_idx", "rank", (F.col("first") + F.col("rank")).alias("place"))


@query("select distinct camera_serial from (select 'cam' || (l_suppkey % 6) as camera_serial from lineitem) o anti join px_calib using (camera_serial)", "px_calib")
def J14_unknown_serials(spark, d):
    used = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("cam"), F.col("l_suppkey") % 6).alias("camera_serial")).distinct()
    return used.join(px.calibration(spark, d), "camera_serial", "left_anti")


# --- as-of joins

BOTH = "b as (select f.rec_id, f.frame_id, f.t_ns, f.q, t.t_us as bt, t.tx as btx, t.tz as btz, t.qw as bw, t.qz as bz from (select *, t_ns // 1000 as q from px_frames) f asof left join px_traj t on f.rec_id = t.rec_id and f.q >= t.t_us), n as (select b.*, t.t_us as nt, t.tx as atx, t.tz as atz, t.qw as aw, t.qz as az from b asof left join px_traj t on b.rec_id = t.rec_id and b.q < t.t_us), e as (select rec_id, min(t_us) as first_t, max(t_us) as last_t, arg_max(tx, t_us) as last_tx from px_traj group by rec_id)"


def around(spark, d) -> DataFrame:
    f, t = px.frames(spark, d).withColumn("q", F.floor(F.col("t_ns") / 1000)), px.trajectory(spark, d)
    return asof.neighbours(f, t, ["rec_id"], "q", "t_us", "sample_id", asof.width(t, ["rec_id"], "t_us"))


@query(f"@{BOTH}, w as (select *, case when bt = q then 0.0::double else (q - bt)/(nt - bt)::double end as w from n where bt is not null and (bt = q or nt is not null)), s as (select *, case when bt = q then 1.0::double else bw*aw + bz*az end as d from w), u as (select *, least(abs(d), 1.0) as c, case when d < 0 then -1 else 1 end as g from s), h as (select *, acos(c) as a from u), m as (select *, case when c > 0.9995 then 1 - w else sin((1 - w)*a)/sin(a) end as u1, case when c > 0.9995 then w else sin(w*a)/sin(a) end as u2 from h) select frame_id, round(w, 6) + 0.0 as w, round(btx + (coalesce(atx, btx) - btx)*w, 6) + 0.0 as tx, round(btz + (coalesce(atz, btz) - btz)*w, 6) + 0.0 as tz, round((u1*bw + u2*g*coalesce(aw, bw))/sqrt((u1*bw + u2*g*coalesce(aw, bw))**2 + (u1*bz + u2*g*coalesce(az, bz))**2), 5) + 0.0 as qw from m", "px_frames", "px_traj")
def J01_pose_interpolation(spark, d):
    near = around(spark, d).withColumn("w", asof.ratio(F.col("q"))).where("w IS NOT NULL")
    after = F.coalesce("after", "before")
    a, b = ([F.when(F.col("w") == 0, F.col("before")[c]).otherwise(after[c]) if k else F.col("before")[c] for c in ("qw", "qx", "qy", "qz")] for k in (0, 1))
    q = g.slerp(a, b, F.col("w"))
    return near.select("frame_id", r(F.col("w")).alias("w"), *(r(g.lerp(F.col("before")[c], after[c], F.col("w"))).alias(c) for c in ("tx", "tz")), r(q[0], 5).alias("qw"))


NEAR = "case when nt is null or (bt is not null and q - bt {op} nt - q) then bt else nt end"


@query(f"@{BOTH}, x as (select frame_id, q, {NEAR.format(op='<=')} as t from n) select frame_id, t from x where abs(t - q) <= {TOLERANCE}", "px_frames", "px_traj")
def J02_nearest_tolerance(spark, d):
    return around(spark, d).withColumn("near", asof.nearest(F.col("q"), TOLERANCE)).where("near IS NOT NULL").select("frame_id", F.col("near.t").alias("t"))


@query(f"@v as (select distinct t_us as q from px_obs), b as (select v.q, t.t_us as bt from v asof left join px_track t on v.q >= t.t_us), n as (select b.*, t.t_us as nt from b asof left join px_track t on b.q < t.t_us) select q, {NEAR.format(op='<=')} as t from n", "px_obs", "px_track")
def J03_nearest_clamped(spark, d):
    q = px.observations(spark, d).select(F.col("t_us").alias("q"), F.lit(0).alias("k")).distinct()
    track = px.track(spark, d).select("t_us", F.lit(0).alias("k"), F.lit(0).alias("one"))
    near = asof.neighbours(q, track, ["k"], "q", "t_us", "one", asof.width(q, ["k"], "q"))
    return near.select("q", asof.nearest(F.col("q"))["t"].alias("t"))


@query(f"@{BOTH} select frame_id, case when bt = q then bt else coalesce(nt, bt) end as t, round(case when bt = q then btx else coalesce(atx, btx) end, 6) as tx from n", "px_frames", "px_traj")
def J04_forward_clamped(spark, d):
    return around(spark, d).withColumn("f", asof.forward(F.col("q"))).select("frame_id", F.col("f.t").alias("t"), F.round("f.tx", 6).alias("tx"))


@query(f"@{BOTH} select frame_id, case when nt is null then bt when bt is null then nt when nt = last_t then (case when bt = q then bt else nt end) else {NEAR.format(op='<')} end as t from n join e using (rec_id) where q between first_t - 1000 and last_t + 1000", "px_frames", "px_traj")
def J05_nearest_tie_late(spark, d):
    ends = px.trajectory(spark, d).groupBy("rec_id").agg(F.min("t_us").alias("first_t"), F.max("t_us").alias("last_t"))
    near = around(spark, d).join(ends, "rec_id").withColumn("near", asof.nearest_with_edges(F.col("q"), 1000))
    return near.where("near IS NOT NULL").select("frame_id", F.col("near.t").alias("t"))


DAILY = f"cal as (select rec_id, t_us // {DAY} as day, min(t_us) as t_us, arg_min(quality, t_us) as quality from px_traj group by rec_id, day)"


@query(f"@{DAILY}, b as (select f.rec_id, f.frame_id, f.t_ns // 1000 as q, c.t_us as bt, c.quality as bq from px_frames f asof left join cal c on f.rec_id = c.rec_id and f.t_ns // 1000 >= c.t_us), n as (select b.*, c.t_us as nt, c.quality as aq from b asof left join cal c on b.rec_id = c.rec_id and b.q < c.t_us) select frame_id, case when nt is null or (bt is not null and q - bt <= nt - q) then bq else aq end as quality from n", "px_frames", "px_traj")
def J06_calibration_asof(spark, d):
    daily = px.trajectory(spark, d).groupBy("rec_id", F.floor(F.col("t_us") / DAY).alias("day")).agg(F.min("t_us").alias("t_us"), F.min_by("quality", "t_us").alias("quality"))
    f = px.frames(spark, d).select("rec_id", "frame_id", F.floor(F.col("t_ns") / 1000).alias("q"))
    near = asof.neighbours(f, daily, ["rec_id"], "q", "t_us", "day", asof.width(f, ["rec_id"], "q"))
    return near.select("frame_id", asof.nearest(F.col("q"))["quality"].alias("quality"))


@query("select count(*) as n_obs, count(p.uid) as matched, count(*) - count(p.uid) as unresolved, round(100.0*count(p.uid)/count(*), 4) as percent from px_obs o left join (select * from px_points where inv_dist_std < 0.01 and dist_std < 0.02) p using (uid)", "px_obs", "px_points")
def J07_observations_to_points(spark, d):
    p = confident(px.points(spark, d), 0.01, 0.02).select("uid", F.lit(1).alias("hit"))
    both = px.observations(spark, d).join(p, "uid", "left")
    return both.agg(F.count("*").alias("n_obs"), F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("unresolved"), F.round(100.0 * F.count("hit") / F.count("*"), 4).alias("percent"))


# --- poses

Q = ("qw", "qx", "qy", "qz")
T = ("tx", "ty", "tz")


def pose(prefix: str = "") -> tuple[list[Column], list[Column]]:
    return g.quaternion_to_matrix([F.col(prefix + c) for c in Q]), [F.col(prefix + c) for c in T]


#: Rotation matrix of a pose and the numbers of its rows, in SQL; quaternions are of length one.
MATRIX = {"m00": "1 - 2*(qy*qy + qz*qz)", "m01": "2*(qx*qy - qw*qz)", "m02": "2*(qx*qz + qw*qy)", "m10": "2*(qx*qy + qw*qz)", "m11": "1 - 2*(qx*qx + qz*qz)", "m12": "2*(qy*qz - qw*qx)", "m20": "2*(qx*qz - qw*qy)", "m21": "2*(qy*qz + qw*qx)", "m22": "1 - 2*(qx*qx + qy*qy)"}
ROTATED = "m as (select *, " + ", ".join(f"{v} as {k}" for k, v in MATRIX.items()) + " from px_pose)"


@query("select sample_id, " + ", ".join(f"round({v}, 6) + 0.0 as {k}" for k, v in MATRIX.items()) + " from px_pose", "px_pose")
def P01_quaternion_to_matrix(spark, d):
    # of twice the length: the function normalises first
    m = g.quaternion_to_matrix([2 * F.col(c) for c in Q])
    return px.poses(spark, d).select("sample_id", *(r(x).alias(n) for x, n in zip(m, MATRIX, strict=True)))


@query("select sample_id, " + ", ".join(f"round(case when qw < 0 then -{c} else {c} end, 5) + 0.0 as {c}" for c in ("qw", "qx", "qy", "qz")) + " from px_pose", "px_pose")
def P02_matrix_to_quaternion(spark, d):
    q = g.matrix_to_quaternion(pose()[0])
    return px.poses(spark, d).select("sample_id", *(r(x, 5).alias(n) for x, n in zip(q, Q, strict=True)))


#: By the largest of trace and diagonal; the number taken from it is positive, so the sign of qw follows from the branch.
LARGEST = "case when m00 + m11 + m22 > 0 then sign(qw) when m00 > m11 and m00 > m22 then sign(qx) when m11 > m22 then sign(qy) else sign(qz) end"


@query(f"@{ROTATED} select sample_id, " + ", ".join(f"round({c}*{LARGEST}, 5) + 0.0 as {c}" for c in ("qw", "qx", "qy", "qz")) + " from m", "px_pose")
def P03_matrix_to_quaternion_by_largest(spark, d):
    q = g.matrix_to_quaternion_by_largest(pose()[0])
    return px.poses(spark, d).select("sample_id", *(r(x, 5).alias(n) for x, n in zip(q, Q, strict=True)))


@query(f"@{ROTATED} select sample_id, round(-(m00*tx + m10*ty + m20*tz), 5) + 0.0 as x, round(-(m01*tx + m11*ty + m21*tz), 5) + 0.0 as y, round(-(m02*tx + m12*ty + m22*tz), 5) + 0.0 as z, round(m10, 5) + 0.0 as m01 from m", "px_pose")
def P04_pose_inverse(spark, d):
    m, t = g.inverse(*pose())
    return px.poses(spark, d).select("sample_id", *(r(c, 5).alias(n) for c, n in zip(t, "xyz", strict=True)), r(m[1], 5).alias("m01"))


@query(f"@{ROTATED} select sample_id, round(m00*1.5 - m01*0.25 + m02*2 + tx, 5) + 0.0 as x, round(m10*1.5 - m11*0.25 + m12*2 + ty, 5) + 0.0 as y, round(m20*1.5 - m21*0.25 + m22*2 + tz, 5) + 0.0 as z from m", "px_pose")
def P05_point_transform(spark, d):
    moved = g.transform(*pose(), [F.lit(1.5), F.lit(-0.25), F.lit(2.0)])
    return px.poses(spark, d).select("sample_id", *(r(c, 5).alias(n) for c, n in zip(moved, "xyz", strict=True)))


@query(f"@{ROTATED} select m.sample_id, k.camera_serial, round(m00*cam_tx + tx, 5) + 0.0 as x, round(m10*cam_tx + ty, 5) + 0.0 as y, round(m20*cam_tx + tz, 5) + 0.0 as z, round(m00, 5) + 0.0 as m00 from m, px_calib k", "px_pose", "px_calib")
def P04_J16_camera_poses(spark, d):
    eye = [F.lit(float(i % 4 == 0)) for i in range(9)]
    m, t = g.compose(pose(), (eye, [F.col("cam_tx"), F.lit(0.0), F.lit(0.0)]))
    both = every_camera(px.poses(spark, d), px.calibration(spark, d))
    return both.select("sample_id", "camera_serial", *(r(c, 5).alias(n) for c, n in zip(t, "xyz", strict=True)), r(m[0], 5).alias("m00"))


def every_camera(rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each row with each camera of the calibration, which has a handful: they travel as one broadcast list."""
    names = [c for c in cameras.columns if c not in rows.columns]
    listed = cameras.agg(F.collect_list(F.struct(*names)).alias("_cameras"))
    return rows.join(F.broadcast(listed)).select(*rows.columns, F.inline("_cameras"))


@query(f"@{ROTATED} select sample_id, round(m00, 6) + 0.0 as m00, round(-m01, 6) + 0.0 as m01, round(-m02, 6) + 0.0 as m02, round(m10, 6) + 0.0 as m10, round(-m11, 6) + 0.0 as m11, round(-m22, 6) + 0.0 as m22 from m", "px_pose")
def P22_axis_flip(spark, d):
    m = g.flipped(pose()[0])
    return px.poses(spark, d).select("sample_id", *(r(m[i]).alias(n) for i, n in ((0, "m00"), (1, "m01"), (2, "m02"), (3, "m10"), (4, "m11"), (8, "m22"))))


STEPS = "s as (select *, " + ", ".join(f"lag({c}) over w as p_{n}" for c, n in (("sample_id", "id"), ("t_us", "t"), *((c, c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")))) + " from px_pose window w as (partition by rec_id order by t_us, sample_id))"


def steps(spark, d) -> DataFrame:
    w = Window.partitionBy("rec_id").orderBy("t_us", "sample_id")
    return px.poses(spark, d).select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("sample_id", "t_us", *Q, *T))).where("p_sample_id IS NOT NULL")


DOT = "qw*p_qw + qx*p_qx + qy*p_qy + qz*p_qz"


# the trace of R_a^T R_b is 4 (q_a . q_b)^2 - 1
@query(f"@{STEPS} select sample_id, t_us - p_t as dt, round(degrees(acos(greatest(-1, least(1, 2*({DOT})**2 - 1)))), 3) + 0.0 as angle from s where p_id is not null", "px_pose")
def P09_W04_step_angles(spark, d):
    a, _ = pose()
    b, _ = pose("p_")
    return steps(spark, d).select("sample_id", (F.col("t_us") - F.col("p_t_us")).alias("dt"), r(g.rotation_angle(a, b), 3).alias("angle"))


BLEND = ", ".join(f"f*(p_{c} + sg*{c}) as b{c}" for c in ("qw", "qx", "qy", "qz"))
LENGTH = "sqrt(bqw*bqw + bqx*bqx + bqy*bqy + bqz*bqz)"


@query(f"@{STEPS}, u as (select *, {DOT} as d from s where p_id is not null), h as (select *, case when d < 0 then -1 else 1 end as sg, least(abs(d), 1.0) as c from u), k as (select *, case when c > 0.9995 then 0.5 else sin(0.5*acos(c))/sin(acos(c)) end as f from h where abs(d) > 1e-6), b as (select *, {BLEND} from k) select sample_id, " + ", ".join(f"round(b{c}/{LENGTH}, 5) + 0.0 as {c}" for c in ("qw", "qx", "qy", "qz")) + ", round((tx + p_tx)/2, 6) + 0.0 as tx from b", "px_pose")
def P11_slerp_midpoints(spark, d):
    half = F.lit(0.5)
    a, b = [F.col(f"p_{c}") for c in Q], [F.col(c) for c in Q]
    q = g.slerp(a, b, half)
    rows = steps(spark, d).where(F.abs(g.dot(a, b)) > 1e-6)  # at right angles either way round is as short
    return rows.select("sample_id", *(r(x, 5).alias(n) for x, n in zip(q, Q, strict=True)), r(g.lerp(F.col("p_tx"), F.col("tx"), half)).alias("tx"))


@query("@o as (select *, lead(t_us) over w as n_t, lead(tx) over w as n_tx, lead(ty) over w as n_ty, lead(tz) over w as n_tz, lead(quality) over w as n_q from px_traj window w as (partition by rec_id order by t_us, sample_id)), k as (select *, ((sample_id % 5) - 0.5)/3.0::double as ratio from o where n_t > t_us) select sample_id, round(ratio, 6) + 0.0 as ratio, ratio between 0 and 1 as ok, " + ", ".join(f"round(case when ratio between 0 and 1 then {c} + ({n} - {c})*ratio end, 6) + 0.0 as {c}" for c, n in (("tx", "n_tx"), ("ty", "n_ty"), ("tz", "n_tz"), ("quality", "n_q"))) + ", round(case when ratio between 0 and 1 then (n_tx - tx)/((n_t - t_us)/1e6)*ratio end, 9) + 0.0 as vx from k", "px_traj")
def P12_pose_quality_velocity(spark, d):
    w = Window.partitionBy("rec_id").orderBy("t_us", "sample_id")
    names = ("t_us", "tx", "ty", "tz", "quality")
    rows = px.trajectory(spark, d).select("*", *(F.lead(c).over(w).alias(f"n_{c}") for c in names)).where("n_t_us > t_us").withColumn("ratio", (F.col("sample_id") % 5 - 0.5) / 3.0)
    moved = g.interpolated({c: (F.col(c), F.col(f"n_{c}")) for c in ("tx", "ty", "tz", "quality")} | {"vx": (F.lit(0.0), (F.col("n_tx") - F.col("tx")) / ((F.col("n_t_us") - F.col("t_us")) / 1e6))}, F.col("ratio"))
    return rows.select("sample_id", r(F.col("ratio")).alias("ratio"), F.col("ratio").between(0, 1).alias("ok"), *(r(v, 9 if n == "vx" else 6).alias(n) for n, v in moved.items()))


CAMS = "k as (select camera_serial, cam_tx, f, cx, cy, 5.0 + 100*cam_tx as ox from px_calib), p as (select k.*, uid, px - ox as x, py - 5.0 as y, pz - 1.0 as z from px_points, k), q as (select *, case when z > 0 then f*x/z + cx end as u, case when z > 0 then f*y/z + cy end as v from p)"


def projected(spark, d) -> DataFrame:
    """Every point in each of the calibration's cameras, which look up from below, side by side."""
    rows = every_camera(px.points(spark, d), px.calibration(spark, d)).select("camera_serial", "uid", (F.col("px") - (5.0 + 100 * F.col("cam_tx"))).alias("x"), (F.col("py") - 5.0).alias("y"), (F.col("pz") - 1.0).alias("z"))
    u, v, _ = g.project([F.col(c) for c in "xyz"], [F.lit(300.0)] * 2, [F.lit(256.0)] * 2)
    return rows.withColumns({"u": u, "v": v})


SEEN = "z > 0 and u > 0 and u < 512 and v > 0 and v < 512"


def seen(rows: DataFrame) -> Column:
    return g.in_frame([F.col(c) for c in "uvz"], F.lit(512), F.lit(512))


@query(f"@{CAMS} select camera_serial, uid, round(u, 4) + 0.0 as u, round(v, 4) + 0.0 as v, round(z, 4) + 0.0 as z from q where {SEEN}", "px_points", "px_calib")
def P06_F04_project_frustum(spark, d):
    rows = projected(spark, d)
    return rows.where(seen(rows)).select("camera_serial", "uid", *(r(F.col(c), 4).alias(c) for c in "uvz"))


@query(f"@{CAMS} select camera_serial, uid, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y, round(z, 4) + 0.0 as z from q where {SEEN}", "px_points", "px_calib")
def P07_unproject(spark, d):
    rows = projected(spark, d)
    p = g.unproject(F.col("u"), F.col("v"), F.col("z"), [F.lit(300.0)] * 2, [F.lit(256.0)] * 2)
    return rows.where(seen(rows)).select("camera_serial", "uid", *(r(c, 4).alias(n) for c, n in zip(p, "xyz", strict=True)))


@query(f"@{CAMS} select camera_serial, count(*) filter ({SEEN}) as seen, count(*) filter (z <= 0) as behind from q group by camera_serial", "px_points", "px_calib")
def F05_A01_behind_camera(spark, d):
    rows = projected(spark, d)
    return rows.groupBy("camera_serial").agg(F.count_if(seen(rows)).alias("seen"), F.count_if(F.col("z") <= 0).alias("behind"))


@query("select p_partkey as id, round(2*atan(640/(2*(300.0 + p_size))), 6) as fov, round(640/(2*tan(atan(640/(2*(300.0 + p_size))))), 4) as focal from part")
def P08_field_of_view(spark, d):
    fov = g.field_of_view(F.lit(640), 300.0 + F.col("p_size"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.round(fov, 6).alias("fov"), F.round(g.focal_length(F.lit(640), fov), 4).alias("focal"))


@query(f"@{BOTH}, x as (select frame_id, q, {NEAR.format(op='<=')} as t from n), m as (select frame_id from x where abs(t - q) <= {TOLERANCE}) select (select count(*) from px_frames) as n_frames, count(*) as matched, round(100.0*count(*)/(select count(*) from px_frames), 4) as percent from m", "px_frames", "px_traj")
def A01_match_rate(spark, d):
    near = around(spark, d).withColumn("hit", asof.nearest(F.col("q"), TOLERANCE)["t"])
    return near.agg(F.count("*").alias("n_frames"), F.count("hit").alias("matched"), F.round(100.0 * F.count("hit") / F.count("*"), 4).alias("percent"))


@query(f"@{BOTH}, x as (select frame_id, rec_id, case when bt = q then btx else coalesce(atx, btx) end as tx, case when bt = q then btz else coalesce(atz, btz) end as tz from n where bt is not null or nt is not null), p as (select * from px_points where {CONFIDENT}), j as (select x.frame_id, p.uid, p.px - x.tx as dx, p.py - 5.0 as dy, p.pz - x.tz as dz from x join p on p.uid % 150 = x.rec_id % 150), q as (select *, 300*dx/dz + 256 as u, 300*dy/dz + 256 as v from j where dz > 0) select frame_id, count(*) as n, round(min(dz), 5) + 0.0 as nearest from q where u > 0 and u < 512 and v > 0 and v < 512 group by frame_id", "px_frames", "px_traj", "px_points")
def J16_sparse_depth(spark, d):
    f = around(spark, d).withColumn("f", asof.forward(F.col("q"))).where("f IS NOT NULL").select("frame_id", (F.col("rec_id") % 150).alias("k"), "f.tx", "f.tz")
    p = confident(px.points(spark, d)).withColumn("k", F.col("uid") % 150)
    rows = f.join(p, "k").select("frame_id", (F.col("px") - F.col("tx")).alias("x"), (F.col("py") - 5.0).alias("y"), (F.col("pz") - F.col("tz")).alias("z"))
    uvz = g.project([F.col(c) for c in "xyz"], [F.lit(300.0)] * 2, [F.lit(256.0)] * 2)
    return rows.where(g.in_frame(uvz, F.lit(512), F.lit(512))).groupBy("frame_id").agg(F.count("*").alias("n"), r(F.min("z"), 5).alias("nearest"))


@query("select count(*) filter (inv_dist_std < 0.005 and dist_std < 0.01) as meshing, count(*) filter (inv_dist_std < 0.01 and dist_std < 0.02) as training, count(*) filter (inv_dist_std < 0.001 and dist_std < 0.15) as preview from px_points", "px_points")
def F01_F02_F03_confidence(spark, d):
    c = lambda a, b: F.count_if((F.col("inv_dist_std") < a) & (F.col("dist_std") < b))
    return px.points(spark, d).agg(c(0.005, 0.01).alias("meshing"), c(0.01, 0.02).alias("training"), c(0.001, 0.15).alias("preview"))


@query("select p_partkey as id, trunc((480 + p_size)/1512*2016)::int as w, round(600.0*(480 + p_size)/1512, 4) as focal from part")
def P23_P28_resize(spark, d):
    h = 480 + F.col("p_size")
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), g.rescaled(F.lit(2016), F.lit(1512), h).alias("w"), F.round(600.0 * h / 1512, 4).alias("focal"))


# --- sequences


@query("select frame_id, rank, case when rank % 8 = 0 then 'valid' else 'train' end as split from (select frame_id, row_number() over (partition by rec_id order by t_ns, frame_id) - 1 as rank from px_frames)", "px_frames")
def O06_S03_holdout_split(spark, d):
    rank = F.row_number().over(Window.partitionBy("rec_id").orderBy("t_ns", "frame_id")) - 1
    return px.frames(spark, d).select("frame_id", rank.alias("rank")).withColumn("split", F.when(F.col("rank") % 8 == 0, "valid").otherwise("train"))


@query("select sample_id from (select sample_id, row_number() over (partition by rec_id order by t_us, sample_id) - 1 as rn from px_traj) where rn % 5 = 0", "px_traj")
def O04_systematic_sample(spark, d):
    return sequence.every(px.trajectory(spark, d), ["rec_id"], ["t_us", "sample_id"], 5).select("sample_id")


@query("@n as (select *, row_number() over (partition by rec_id order by t_us, sample_id) - 1 as rn, count(*) over (partition by rec_id) as n from px_traj), k as (select distinct rec_id, round_even(i*(n - 1)/9.0, 0)::bigint as rn from n, range(10) t(i)) select sample_id from n join k using (rec_id, rn)", "px_traj")
def O05_linspace_thin(spark, d):
    return sequence.thin(px.trajectory(spark, d), ["rec_id"], ["t_us", "sample_id"], 10).select("sample_id")


@query("@recursive_placeholder", "px_traj")
def W05_keyframes(spark, d):
    return sequence.keyframes(px.trajectory(spark, d), ["rec_id"], ["t_us", "sample_id"], 1.0, 40.0).select("sample_id", "kept")


ORACLE_SQL["W05_keyframes"] = f"""
with recursive px_traj as ({px.SQL['px_traj']}), o as (
  select *, row_number() over (partition by rec_id order by t_us, sample_id) as rn from px_traj
), k as (
  select rec_id, rn, sample_id, tx, ty, tz, qw, qz, true as kept from o where rn = 1
  union all
  select o.rec_id, o.rn, o.sample_id, case when m.move then o.tx else k.tx end, case when m.move then o.ty else k.ty end, case when m.move then o.tz else k.tz end,
    case when m.move then o.qw else k.qw end, case when m.move then o.qz else k.qz end, m.move
  from k join o on o.rec_id = k.rec_id and o.rn = k.rn + 1,
  lateral (select sqrt((o.tx - k.tx)**2 + (o.ty - k.ty)**2 + (o.tz - k.tz)**2) >= 1.0
    or degrees(2*acos(least(1, abs(o.qw*k.qw + o.qz*k.qz)))) >= 40.0 as move) m
) select sample_id, kept from k"""


@query("@e as (select rec_id, min(t_ns) as lo, max(t_ns) as hi from px_frames group by rec_id) select count(*) filter (t_ns between lo + 1000000 and hi - 1000000) as inner_ms, count(*) filter (t_ns >= lo + 86400000000000 and t_ns < lo + 10*86400000000000) as half_open, count(*) filter (t_ns between lo and lo + 5*86400000000000) as relative from px_frames join e using (rec_id)", "px_frames")
def F07_F08_F09_time_windows(spark, d):
    f, day, t = px.frames(spark, d), 86_400_000_000_000, F.col("t_ns")
    ends = f.groupBy("rec_id").agg(F.min("t_ns").alias("lo"), F.max("t_ns").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return f.join(ends, "rec_id").agg(F.count_if(t.between(lo + 1_000_000, hi - 1_000_000)).alias("inner_ms"), F.count_if((t >= lo + day) & (t < lo + 10 * day)).alias("half_open"), F.count_if(t.between(lo, lo + 5 * day)).alias("relative"))


@query("@m as (select rec_id, median(exposure_s*gain) as m from px_frames group by rec_id) select frame_id, round(exposure_s*gain, 8) as multiplier, round(1/m, 5) as radiance_weight, round(exposure_s*gain/m, 6) as relative from px_frames join m using (rec_id)", "px_frames")
def A09_P30_exposure_norm(spark, d):
    f = px.frames(spark, d).withColumn("x", F.col("exposure_s") * F.col("gain"))
    m = f.groupBy("rec_id").agg(F.median("x").alias("m"))
    return f.join(m, "rec_id").select("frame_id", F.round("x", 8).alias("multiplier"), F.round(1 / F.col("m"), 5).alias("radiance_weight"), F.round(F.col("x") / F.col("m"), 6).alias("relative"))


READOUT = "b as (select frame_id, exposure_s*1e9*3 as readout, exposure_s*3*1000/2*(1 + frame_id % 3) as wanted from px_frames), k as (select *, greatest(1, least(8, trunc(wanted)))::int as q from b)"


@query(f"@{READOUT} select frame_id, i::int as bucket, q, round_even(-readout/2 + (i + 0.5)*readout/q, 0)::bigint as shift from k, range(8) r(i) where i < q", "px_frames")
def W06_shutter_buckets(spark, d):
    rows = px.frames(spark, d).withColumns({"readout": F.col("exposure_s") * 1e9 * 3, "motion": 1 + F.col("frame_id") % 3})
    return sequence.shutter_buckets(rows, 2e6, 8).select("frame_id", "bucket", "q", "shift")


@query("@o as (select rec_id, sample_id, t_us, tx, ty, lead(t_us) over w as n_t, lead(tx) over w as n_tx, lead(ty) over w as n_ty, row_number() over w as rn from px_traj window w as (partition by rec_id order by t_us, sample_id)), f as (select rec_id, (n_t - t_us)/2.0::double as dt from o where rn = 1 and n_t is not null), k as (select o.*, f.dt, case when dt > 0 then greatest(1, ceil((n_t - t_us)/dt))::bigint else 1 end as k from o join f using (rec_id) where n_t is not null), x as (select *, case when n_t = t_us then 0 else i*dt/(n_t - t_us) end as w from k, lateral (select unnest(range(k)) as i)) select sample_id, i as step, round(i*dt, 3) as dt, round(tx + (n_tx - tx)*w, 5) + 0.0 as tx, round(ty + (n_ty - ty)*w, 5) + 0.0 as ty from x", "px_traj")
def W08_densify(spark, d):
    found = sequence.densify(px.trajectory(spark, d), ["rec_id"], "t_us", "sample_id", per_gap=2)
    return found.select("sample_id", "step", F.round("dt", 3).alias("dt"), r(F.col("tx"), 5).alias("tx"), r(F.col("ty"), 5).alias("ty"))


@query("@f as (select *, exposure_s*1e9/2 as half from px_frames) select frame_id, 'center' as mode, round_even(t_ns - half, 0)::bigint - t_ns as begins, 0::bigint as middle, round_even(t_ns + half, 0)::bigint - t_ns as ends from f union all select frame_id, 'readout_start', 0::bigint, round_even(t_ns + half, 0)::bigint - t_ns, round_even(t_ns + 2*half, 0)::bigint - t_ns from f", "px_frames")
def P27_P29_readout_brackets(spark, d):
    f, t = px.frames(spark, d), F.col("t_ns")
    parts = []
    for mode in ("center", "readout_start"):
        at = sequence.readout_bracket(t, F.col("exposure_s") * 1e9, mode)
        parts.append(f.select("frame_id", F.lit(mode).alias("mode"), *((c - t).alias(n) for c, n in zip(at, ("begins", "middle", "ends"), strict=True))))
    return parts[0].unionAll(parts[1])


@query("select camera_serial, readout is null as global_shutter, coalesce(readout, 0.0)*1e9 as readout_ns from (select camera_serial, case when camera_serial = 'cam2' then null else 0.01*(1 + 100*cam_tx) end as readout from px_calib)", "px_calib")
def P36_readout_time(spark, d):
    c = px.calibration(spark, d).withColumn("readout", F.when(F.col("camera_serial") != "cam2", 0.01 * (1 + 100 * F.col("cam_tx"))))
    return c.select("camera_serial", F.col("readout").isNull().alias("global_shutter"), (F.coalesce("readout", F.lit(0.0)) * 1e9).alias("readout_ns"))


@query("@a as (select rec_id, avg(tx) as mx, avg(ty) as my, avg(tz) as mz from px_traj group by rec_id) select rec_id, round(max(sqrt((tx - mx)**2 + (ty - my)**2 + (tz - mz)**2)), 5) as scale from px_traj join a using (rec_id) group by rec_id", "px_traj")
def A10_scene_scale(spark, d):
    t = px.trajectory(spark, d)
    mean = t.groupBy("rec_id").agg(*(F.avg(c).alias(f"m_{c}") for c in T))
    away = g.norm(g.minus([F.col(c) for c in T], [F.col(f"m_{c}") for c in T]))
    return t.join(mean, "rec_id").groupBy("rec_id").agg(F.round(F.max(away), 5).alias("scale"))


#: Points in camera axes at a sample and at the one before, in SQL: R^T (p - t).
CAMERA = lambda p: ", ".join(f"({m0})*(x - {p}tx) + ({m1})*(y - {p}ty) + ({m2})*(z - {p}tz) as {p}c{i}" for i, (m0, m1, m2) in enumerate(((MATRIX[f"m0{i}"], MATRIX[f"m1{i}"], MATRIX[f"m2{i}"]) for i in range(3))))


def camera_sql(p: str) -> str:
    text = CAMERA("")
    return text if not p else re.sub(r"\b(q[wxyz]|t[xyz]|c\d)\b", lambda m: p + m[1], text)


MOVED = f"pts as (select uid % 500 as k, uid, px as x, py as y, pz + 6 as z from px_points), j as (select s.rec_id, s.sample_id, {camera_sql('')}, {camera_sql('p_')} from s join pts on pts.k = s.sample_id % 500 where p_id is not null), uv as (select rec_id, sample_id, greatest(abs(300*c0/c2 - 300*p_c0/p_c2), abs(300*c1/c2 - 300*p_c1/p_c2)) as m from j where c2 > 0.5 and p_c2 > 0.5)"


@query(f"@{STEPS}, {MOVED} select sample_id, count(*) as n, round(quantile_cont(m, 0.25), 4) as p25, round(quantile_cont(m, 0.5), 4) as p50, round(quantile_cont(m, 0.75), 4) as p75 from uv group by sample_id", "px_pose", "px_points")
def A07_A32_A34_motion_percentiles(spark, d):
    """How far points move in the image between a sample's pose and the one before: each sample sees the points of its residue."""
    points = px.points(spark, d).select((F.col("uid") % 500).alias("k"), F.col("px").alias("x"), F.col("py").alias("y"), (F.col("pz") + 6).alias("z"))
    rows = steps(spark, d).withColumn("k", F.col("sample_id") % 500)
    found = motion.percentiles(rows, points, "k", "sample_id", g.inverse(*pose()), g.inverse(*pose("p_")), 300.0, 0.5, [0.25, 0.5, 0.75])
    return found.select("sample_id", "n", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p75"))))


@query(f"@{STEPS} select rec_id, round(quantile_cont(m, 0.25), 7) as p25, round(quantile_cont(m, 0.5), 7) as p50, round(quantile_cont(m, 0.75), 7) as p75 from (select rec_id, greatest(abs(tx - p_tx), abs(ty - p_ty)) as m from s where p_id is not null) group by rec_id", "px_pose")
def A07_step_percentiles(spark, d):
    m = F.greatest(F.abs(F.col("tx") - F.col("p_tx")), F.abs(F.col("ty") - F.col("p_ty")))
    rows = steps(spark, d).select("rec_id", m.alias("m")).groupBy("rec_id").agg(F.percentile("m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    return rows.select("rec_id", *(F.round(F.col("p")[i], 7).alias(n) for i, n in enumerate(("p25", "p50", "p75"))))


@query("@p as (select sample_id as id, tx, ty, tz, 1 - 2*qz*qz as c, 2*qz*qw as s from px_traj), d as (select q.id, round(2*(q.c - p.c)**2 + 2*(q.s - p.s)**2 + (q.tx - p.tx)**2 + (q.ty - p.ty)**2 + (q.tz - p.tz)**2, 9) as d2, p.id as other from p q, p where p.id <> q.id) select id, round(sqrt(min(d2)), 5) as distance from d group by id", "px_traj")
def J19_O08_nearest_pose(spark, d):
    c, s = 1 - 2 * F.col("qz") * F.col("qz"), 2 * F.col("qz") * F.col("qw")
    poses = px.trajectory(spark, d).select(F.col("sample_id").alias("id"), c.alias("c"), s.alias("s"), *T)
    return sequence.nearest_pose(poses, poses).select("id", F.round("distance", 5).alias("distance"))


@query("@f as (select frame_id, rec_id, t_ns, case when frame_id % 2 = 0 then t_ns // 10 else t_ns end as legacy from px_frames) select frame_id, row_number() over (partition by rec_id order by 'camera-rgb_' || legacy::varchar || '.png', frame_id) - 1 as by_path, row_number() over (partition by rec_id order by t_ns, frame_id) - 1 as by_time from f", "px_frames")
def O01_O02_O03_sort_orders(spark, d):
    f = px.frames(spark, d).withColumn("legacy", F.when(F.col("frame_id") % 2 == 0, F.floor(F.col("t_ns") / 10)).otherwise(F.col("t_ns")))
    path = F.concat(F.lit("camera-rgb_"), F.col("legacy").cast("string"), F.lit(".png"))
    rank = lambda *c: F.row_number().over(Window.partitionBy("rec_id").orderBy(*c)) - 1
    return f.withColumn("path", path).select("frame_id", rank("path", "frame_id").alias("by_path"), rank("t_ns", "frame_id").alias("by_time"))


@query("select frame_id from px_frames semi join (select frame_id from px_frames where frame_id % 10 <> 0) l using (frame_id)", "px_frames")
def F10_missing_files(spark, d):
    listing = px.frames(spark, d).where(F.col("frame_id") % 10 != 0).select("frame_id")
    return px.frames(spark, d).select("frame_id").join(listing, "frame_id", "left_semi")


@query("@s as (select *, row_number() over (partition by rec_id order by round(value/10), round(t_us/86400000000.0), sample_id) as r from (select rec_id, sample_id, t_us, tx*100 as value from px_traj)), k as (select rec_id, round(value/10) as a, round(t_us/86400000000.0) as b, max(value) as score from s group by all) select rec_id, a, b, rank, round(score, 4) as score from (select *, row_number() over (partition by rec_id order by round(score, 6) desc, a, b) as rank from k) where rank <= 4", "px_traj")
def O07_O09_top_distinct(spark, d):
    rows = px.trajectory(spark, d).select("rec_id", F.round(F.col("tx") * 100 / 10).alias("a"), F.round(F.col("t_us") / 86400000000.0).alias("b"), (F.col("tx") * 100).alias("value"))
    best = rows.groupBy("rec_id", "a", "b").agg(F.max("value").alias("score"))
    rank = F.row_number().over(Window.partitionBy("rec_id").orderBy(F.round("score", 6).desc(), "a", "b"))
    return best.withColumn("rank", rank).where("rank <= 4").select("rec_id", "a", "b", "rank", F.round("score", 4).alias("score"))


@query("select o_orderkey as step, least(o_orderkey // 1000, 3)::bigint as degree, round(0.01**(least(o_orderkey, 30000)/30000.0), 8) as decay from orders")
def W10_schedules(spark, d):
    """For every step that the table has: the degree warms up, the rate decays to a hundredth and stays there."""
    s = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(s.alias("step"), F.least(F.floor(s / 1000), F.lit(3)).alias("degree"), F.round(F.pow(F.lit(0.01), F.least(s, F.lit(30000)) / 30000.0), 8).alias("decay"))

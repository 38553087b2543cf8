"""Capture-shaped views of the driver's tables, as DataFrames and as SQL with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB text of each view.
SQL = {
    "px_points": "select o_orderkey as uid, (o_orderkey % 100)/10.0::double as px, ((o_orderkey // 100) % 100)/10.0::double as py, (o_custkey % 30)/10.0::double as pz, ((o_orderkey*7919) % 1009)/100000.0::double as inv_dist_std, ((o_orderkey*104729) % 2003)/100000.0::double as dist_std from orders",
    "px_obs": "select l_orderkey as uid, epoch_us(l_shipdate) as t_us, 'cam' || (l_suppkey % 4) as camera_serial from lineitem",
    "px_calib": "select 'cam' || i as camera_serial, 'slam-' || i as label, 0.01::double*i as cam_tx, 300.0::double as f, 256.0::double as cx, 256.0::double as cy from (select distinct s_suppkey % 4 from supplier) as t(i)",
    "px_traj": "select user_id as rec_id, event_id as sample_id, epoch_us(ts) as t_us, value/100 as tx, (event_id % 1000)/100.0::double as ty, 1.6683::double + (event_id % 7)*0.01::double as tz, cos(radians((event_id % 360)/2.0::double)) as qw, 0.0::double as qx, 0.0::double as qy, sin(radians((event_id % 360)/2.0::double)) as qz, 0.9::double + (event_id % 10)*0.01::double as quality from events where event_type <> 'purchase'",
    "px_pose": "select rec_id, sample_id, t_us, tx, ty, tz, a/n as qw, b/n as qx, c/n as qy, e/n as qz from (select *, sqrt(a*a + b*b + c*c + e*e) as n from (select user_id as rec_id, event_id as sample_id, epoch_us(ts) as t_us, value/100 as tx, (event_id % 1000)/100.0::double as ty, 1.6683::double + (event_id % 7)*0.01::double as tz, ((event_id*7 + 3) % 17 - 8)/8.0::double + 0.01 as a, ((event_id*5 + 1) % 13 - 6)/6.0::double as b, ((event_id*3 + 2) % 11 - 5)/5.0::double as c, ((event_id*11 + 4) % 19 - 9)/9.0::double as e from events where event_type <> 'purchase'))",
    "px_frames": "select user_id as rec_id, event_id as frame_id, epoch_us(ts)*1000 + event_id % 1000 as t_ns, value/100000 as exposure_s, 1.0::double + event_id % 4 as gain, 'camera-rgb' as camera_label from events where event_type = 'purchase'",
    "px_track": "select distinct epoch_us(o_orderdate) as t_us from orders",
    "px_cloud": "select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label from embeddings",
    "px_splat": "select p_partkey as gid, (p_partkey % 50)/10.0::double as x, ((p_partkey // 50) % 40)/10.0::double as y, case when p_partkey % 97 = 0 then 1000.0::double else 0.0::double end as z, (p_size - 25)/5.0::double as opacity_logit, ln(0.01::double + p_size/100.0::double) as s0, ln(0.02::double + (p_partkey % 7)/50.0::double) as s1, ln(0.015::double) as s2 from part",
    "px_vertex": "select 1690*k + i*41 + j as vid, 20.0::double*k + i*0.1::double as x, j*0.1::double as y, ((3*i + 5*j) % 7)/100.0::double as z from (select p_partkey // 1000 as k from part group by 1) q, range(41) a(i), range(41) b(j) union all select 1690*k + 1681 + n, 20.0::double*k + 10.0::double*(n % 2), 0.3::double*n, 0.0::double from (select p_partkey // 1000 as k from part group by 1) q, range(9) s(n)",
    "px_face": "select 3300*k + 2*(i*40 + j) + h as fid, 1690*k + i*41 + j as a, 1690*k + case when h = 0 then (i+1)*41 + j else (i+1)*41 + j + 1 end as b, 1690*k + case when h = 0 then (i+1)*41 + j + 1 else i*41 + j + 1 end as c from (select p_partkey // 1000 as k from part group by 1) q, range(40) a(i), range(40) b(j), range(2) c(h) where (i*j) % 11 <> 0 union all select 3300*k + 3200 + n, 1690*k + 1681 + 3*n, 1690*k + 1682 + 3*n, 1690*k + 1683 + 3*n from (select p_partkey // 1000 as k from part group by 1) q, range(3) s(n)",
    "px_img": "select i as img, c, y, x, ((7*x + 13*y + 29*i + 53*c) % 256)/255.0::double as gt, ((7*x + 13*y + 29*i + 53*c + (x*y) % 5) % 256)/255.0::double as pred, case when (x + y) % 9 <> 0 then 1 else 0 end as mask from (select p_partkey // 100 as i from part group by 1) a, range(3) b(c), range(32) d(y), range(32) e(x)",
}


def with_views(body: str, *names: str) -> str:
    """``body`` behind the named views."""
    lead = ", ".join(f"{n} as ({SQL[n]})" for n in names)
    return f"with {lead}{', ' if body.lstrip().startswith('@') else ' '}{body.lstrip().lstrip('@')}"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, d, "orders").select(
        k.alias("uid"), ((k % 100) / 10.0).alias("px"), (F.floor(k / 100) % 100 / 10.0).alias("py"), ((F.col("o_custkey") % 30) / 10.0).alias("pz"),
        ((k * 7919) % 1009 / 100000.0).alias("inv_dist_std"), ((k * 104729) % 2003 / 100000.0).alias("dist_std"),
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), _micros("l_shipdate").alias("t_us"), F.concat(F.lit("cam"), F.col("l_suppkey") % 4).alias("camera_serial"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    cameras = _read(spark, d, "supplier").select((F.col("s_suppkey") % 4).alias("id")).distinct()  # those that observations name
    return cameras.select(F.concat(F.lit("cam"), "id").alias("camera_serial"), F.concat(F.lit("slam-"), "id").alias("label"), (0.01 * F.col("id")).alias("cam_tx"), F.lit(300.0).alias("f"), F.lit(256.0).alias("cx"), F.lit(256.0).alias("cy"))


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    half = F.radians((e % 360) / 2.0)
    return _read(spark, d, "events").where("event_type <> 'purchase'").select(
        F.col("user_id").alias("rec_id"), e.alias("sample_id"), _micros("ts").alias("t_us"), (F.col("value") / 100).alias("tx"), ((e % 1000) / 100.0).alias("ty"), (1.6683 + (e % 7) * 0.01).alias("tz"),
        F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), (0.9 + (e % 10) * 0.01).alias("quality"),
    )


def poses(spark: SparkSession, d: str) -> DataFrame:
    """Trajectory samples with rotations about every axis."""
    e = F.col("event_id")
    raw = _read(spark, d, "events").where("event_type <> 'purchase'").select(
        F.col("user_id").alias("rec_id"), e.alias("sample_id"), _micros("ts").alias("t_us"), (F.col("value") / 100).alias("tx"), ((e % 1000) / 100.0).alias("ty"), (1.6683 + (e % 7) * 0.01).alias("tz"),
        (((e * 7 + 3) % 17 - 8) / 8.0 + 0.01).alias("a"), (((e * 5 + 1) % 13 - 6) / 6.0).alias("b"), (((e * 3 + 2) % 11 - 5) / 5.0).alias("c"), (((e * 11 + 4) % 19 - 9) / 9.0).alias("e"),
    )
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c") + F.col("e") * F.col("e"))
    return raw.select("rec_id", "sample_id", "t_us", "tx", "ty", "tz", *((F.col(v) / n).alias(q) for v, q in zip("abce", ("qw", "qx", "qy", "qz"), strict=True)))


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return _read(spark, d, "events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("rec_id"), e.alias("frame_id"), (_micros("ts") * 1000 + e % 1000).alias("t_ns"), (F.col("value") / 100000).alias("exposure_s"), (1.0 + e % 4).alias("gain"), F.lit("camera-rgb").alias("camera_label"),
    )


def track(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select(_micros("o_orderdate").alias("t_us")).distinct()


def cloud(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(v[i].cast("double").alias(c) for i, c in enumerate("xyz")), "label")


def splats(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return _read(spark, d, "part").select(
        k.alias("gid"), ((k % 50) / 10.0).alias("x"), (F.floor(k / 50) % 40 / 10.0).alias("y"), F.when(k % 97 == 0, 1000.0).otherwise(0.0).alias("z"), ((s - 25) / 5.0).alias("opacity_logit"),
        F.ln(0.01 + s / 100.0).alias("s0"), F.ln(0.02 + (k % 7) / 50.0).alias("s1"), F.ln(F.lit(0.015)).alias("s2"),
    )


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """(k): one piece of the mesh for each thousand parts."""
    return _read(spark, d, "part").select(F.floor(F.col("p_partkey") / 1000).alias("k")).distinct()


def of_tiles(spark: SparkSession, d: str, n: int) -> DataFrame:
    """(k, n): n numbers for each tile."""
    return tiles(spark, d).select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("n"))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    i, j, s = F.floor(n / 41), n % 41, n - 1681
    flat = n < 1681
    x, y, z = F.when(flat, i * 0.1).otherwise(10.0 * (s % 2)), F.when(flat, j * 0.1).otherwise(0.3 * s), F.when(flat, (3 * i + 5 * j) % 7 / 100.0).otherwise(0.0)
    return of_tiles(spark, d, 1690).select((1690 * k + n).alias("vid"), (20.0 * k + x).alias("x"), y.alias("y"), z.alias("z"))


def faces(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    cell = F.floor(n / 2)
    i, j, h, s = F.floor(cell / 40), cell % 40, n % 2, n - 3200
    flat, a = n < 3200, i * 41 + j
    corners = (F.when(flat, a).otherwise(1681 + 3 * s), F.when(flat, F.when(h == 0, a + 41).otherwise(a + 42)).otherwise(1682 + 3 * s), F.when(flat, F.when(h == 0, a + 42).otherwise(a + 1)).otherwise(1683 + 3 * s))
    rows = of_tiles(spark, d, 3203).where(~flat | ((i * j) % 11 != 0))
    return rows.select((3300 * k + n).alias("fid"), *((1690 * k + c).alias(name) for c, name in zip(corners, "abc", strict=True)))


def image_ids(spark: SparkSession, d: str) -> DataFrame:
    """(img): one image for each hundred parts."""
    return _read(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("img")).distinct()


def images(spark: SparkSession, d: str) -> DataFrame:
    rows = image_ids(spark, d).select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3 * 32 * 32 - 1).cast("long"))).alias("n"))
    n, i = F.col("n"), F.col("img")
    rows = rows.select("img", F.floor(n / 1024).alias("c"), (F.floor(n / 32) % 32).alias("y"), (n % 32).alias("x"))
    base = 7 * F.col("x") + 13 * F.col("y") + 29 * i + 53 * F.col("c")
    return rows.select("img", "c", "y", "x", (base % 256 / 255.0).alias("gt"), ((base + (F.col("x") * F.col("y")) % 5) % 256 / 255.0).alias("pred"), F.when((F.col("x") + F.col("y")) % 9 != 0, 1).otherwise(0).alias("mask"))

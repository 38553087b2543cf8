"""Queries over whole tables: unions, labels, checks and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import asof, quality, sequence, spatial
from wayfold.plans import proxies as px
from wayfold.plans.proxies import with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


@query("with a as (select 'walk' as scene, count(*) as frames, 'points' as source from events where event_type = 'view'), b as (select 'return', count(*), 'points' from events where event_type = 'click'), c as (select 'yard', count(*), 'cloud' from events where event_type = 'purchase'), f as (select * from a union all select * from b union all select * from c), p as (select 'points' as source, count(*) as n, sum(o_orderkey)::bigint as ids from orders union all select 'cloud', count(*), sum(vec_id)::bigint from embeddings) select f.scene, f.frames, f.source, p.n, p.ids from f join p using (source)")
def S01_S02_O03_union(spark, d):
    """Scenes side by side; a point cloud that several of them use is taken once."""
    e = events(spark, d)
    one = lambda kind: e.where(F.col("event_type") == kind).select("event_id")
    points = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    cloud = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"))
    frames, clouds = sequence.union_scenes([("walk", one("view"), "points", points), ("return", one("click"), "points", points), ("yard", one("purchase"), "cloud", cloud)])
    per = frames.groupBy("scene", "source").agg(F.count("*").alias("frames"))
    return per.join(clouds.groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids")), "source").select("scene", "frames", "source", "n", "ids")


@query("with k as (select event_type, count(*) as n from events group by 1), o as (select event_type, (sum(n) over (order by event_type) - n)::bigint as first from k) select e.event_id, (o.first + row_number() over (partition by e.event_type order by e.event_id) - 1)::bigint as place from events e join o using (event_type)")
def S07_concat_routing(spark, d):
    return spatial.dense_ids(events(spark, d).select("event_type", "event_id"), ["event_type", "event_id"], "place").select("event_id", "place")


@query("select distinct l_suppkey % 7 as k from lineitem except select s_suppkey % 5 from supplier")
def S04_serial_difference(spark, d):
    a = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 7).alias("k"))
    return a.subtract(spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") % 5).alias("k")))


@query("select event_id, case when starts_with(label, 'camera-slam') or starts_with(label, 'slam-') then 'tracking' when starts_with(label, 'camera-rgb') or starts_with(label, 'camera_rgb') then 'rgb' end as kind from (select event_id, case event_id % 4 when 0 then 'camera-slam-left' when 1 then 'slam-front' when 2 then 'camera-rgb' else 'camera_rgb_0' end as label from events)")
def F19_label_class(spark, d):
    k = F.col("event_id") % 4
    label = F.when(k == 0, "camera-slam-left").when(k == 1, "slam-front").when(k == 2, "camera-rgb").otherwise("camera_rgb_0")
    return events(spark, d).select("event_id", quality.camera_kind(label).alias("kind"))


@query("select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as labels, array_to_string(list_filter(['view', 'purchase', 'absent', 'click'], lambda x: list_contains(list(event_type), x)), ',') as wanted from events group by user_id")
def F20_S05_S06_labels(spark, d):
    have = events(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("have"))
    wanted = F.array(*map(F.lit, ("view", "purchase", "absent", "click")))
    return have.select("user_id", F.array_join("have", ",").alias("labels"), F.array_join(F.array_intersect(wanted, "have"), ",").alias("wanted"))


@query("with o as (select o_orderkey as k, o_totalprice as v from orders), m as (select o_orderkey as k, case when o_orderkey % 50 = 0 then o_totalprice + 1 else o_totalprice end as v from orders where o_orderkey % 70 <> 0) select case when m.k is null then 'removed' when o.k is null then 'added' when o.v <> m.v then 'changed' else 'same' end as status, count(*) as n from o full join m using (k) group by 1")
def ORC5_dataset_diff(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    m = o.where(F.col("k") % 70 != 0).withColumn("v", F.when(F.col("k") % 50 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return quality.difference(o, m, ["k"]).groupBy("status").agg(F.count("*").alias("n"))


@query(f"@v as (select distinct t_us as q from px_obs), b as (select v.q, t.t_us as bt from v asof left join px_track t on v.q >= t.t_us), n as (select b.*, t.t_us as nt from b asof left join px_track t on b.q < t.t_us), g as (select max(least(coalesce(q - bt, 1000000000000000000), coalesce(nt - q, 1000000000000000000))) as gap from n) select 'frames' as rule, count(*) > 0 as ok from px_frames union all select 'one intrinsics', count(distinct f) = 1 from px_calib union all select 'unique frames', count(*) = count(distinct (rec_id, frame_id)) from px_frames union all select 'known serials', count(*) = 0 from px_obs anti join px_calib using (camera_serial) union all select 'exposure', count(*) filter (exposure_s <= 0) = 0 from px_frames union all select 'camera model', count(*) filter (camera_label <> 'camera-rgb') = 0 from px_frames union all select 'time gap', gap <= 1000 from g union all select 'gap of a year', gap <= 31536000000000 from g union all select 'readout', count(*) filter (f is null) = 0 from px_calib", "px_frames", "px_calib", "px_obs", "px_track")
def F21_ORC3_checks(spark, d):
    """The time gap is the greatest distance of a view to its nearest sample."""
    f, c, o = px.frames(spark, d), px.calibration(spark, d), px.observations(spark, d)
    views = o.select(F.col("t_us").alias("q"), F.lit(0).alias("k")).distinct()
    track = px.track(spark, d).select("t_us", F.lit(0).alias("k"), F.lit(0).alias("one"))
    near = asof.nearest(F.col("q"))["t"]
    gap = asof.neighbours(views, track, ["k"], "q", "t_us", "one", asof.width(views, ["k"], "q")).select(F.abs(near - F.col("q")).alias("gap"))
    return quality.checked(
        {
            "frames": f.agg((F.count("*") > 0).alias("ok")),
            "one intrinsics": c.agg((F.count_distinct("f") == 1).alias("ok")),
            "unique frames": f.agg((F.count("*") == F.count_distinct("rec_id", "frame_id")).alias("ok")),
            "known serials": o.join(c, "camera_serial", "left_anti").agg((F.count("*") == 0).alias("ok")),
            "exposure": f.agg((F.count_if(F.col("exposure_s") <= 0) == 0).alias("ok")),
            "camera model": f.agg((F.count_if(F.col("camera_label") != "camera-rgb") == 0).alias("ok")),
            "time gap": gap.agg((F.max("gap") <= 1000).alias("ok")),
            "gap of a year": gap.agg((F.max("gap") <= 31_536_000_000_000).alias("ok")),
            "readout": c.agg((F.count_if(F.col("f").isNull()) == 0).alias("ok")),
        }
    )


@query("@ids as (select o_orderkey as id, o_custkey as c, o_orderkey % 7 as a from orders), o as (select id, unnest(['/meta/c', '/meta/deep/a', '/values']) as path, unnest([c::varchar, a::varchar, '[' || a || ',' || c || ']']) as v from ids), n as (select id, unnest(case when id % 11 = 0 then ['/meta/c', '/meta/deep/b', '/values'] else ['/meta/c', '/meta/deep/a', '/values'] end) as path, unnest([c::varchar, a::varchar, '[' || case when id % 5 = 0 then a + 1 else a end || ',' || c || ']']) as v from ids where id % 13 <> 0) select path, case when n.v is null then 'removed' when o.v is null then 'added' when o.v <> n.v then 'changed' else 'same' end as status, count(*) as n from o full join n using (id, path) group by all", "px_points")
def ORC5_package_diff(spark, d):
    """Two packages of nested entries, opened to any depth and compared by digests of their leaves and arrays."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), c.alias("c"), (k % 7).alias("a"))
    nested = lambda name, a: F.to_json(F.struct(F.struct("c", F.struct(F.col("a").alias(name)).alias("deep")).alias("meta"), F.array(a, F.col("c")).alias("values")))
    old = rows.select("id", nested("a", F.col("a")).alias("j"))
    shifted = F.when(F.col("id") % 5 == 0, F.col("a") + 1).otherwise(F.col("a"))
    new = rows.where(F.col("id") % 13 != 0).select("id", F.when(F.col("id") % 11 == 0, nested("b", shifted)).otherwise(nested("a", shifted)).alias("j"))
    found = quality.difference(quality.flattened(old, ["id"], "j"), quality.flattened(new, ["id"], "j"), ["id", "path"])
    return found.groupBy("path", "status").agg(F.count("*").alias("n"))


@query("select frame_id, rec_id, 'rec' || rec_id || '/' || camera_label as source, 300.0::double as fl, [0.1, 0.2, 0.3, 0.4][1 + (frame_id % 4)::int]::double as k, 512 as w from px_frames", "px_frames")
def P37_frame_flatten(spark, d):
    params = F.array(*(F.lit(x) for x in (300.0, 256.0, 256.0, 0.1, 0.2, 0.3, 0.4)))
    nested = px.frames(spark, d).select("frame_id", "rec_id", F.struct(params.alias("params"), F.lit(512).alias("w"), "camera_label").alias("cam"))
    return nested.select("frame_id", "rec_id", F.concat(F.lit("rec"), "rec_id", F.lit("/"), "cam.camera_label").alias("source"), F.col("cam.params")[0].alias("fl"), F.get(F.slice("cam.params", 4, 4), (F.col("frame_id") % 4).cast("int")).alias("k"), F.col("cam.w").alias("w"))


@query("select uid, camera_serial, inv_dist_std as inverse_std, dist_std as distance_std from px_points p join px_obs o using (uid) where p.inv_dist_std < 0.005", "px_points", "px_obs")
def P14_J12_observation_stds(spark, d):
    p = px.points(spark, d).where(F.col("inv_dist_std") < 0.005)
    return px.observations(spark, d).join(p, "uid").select("uid", "camera_serial", F.col("inv_dist_std").alias("inverse_std"), F.col("dist_std").alias("distance_std"))


@query("select o.uid, count(*) as n from (select distinct * from px_obs) o semi join (select * from px_points where inv_dist_std < 0.005 and dist_std < 0.01) p using (uid) group by o.uid", "px_points", "px_obs")
def J11_A02_semi_join(spark, d):
    p = px.points(spark, d).where("inv_dist_std < 0.005 AND dist_std < 0.01")
    return px.observations(spark, d).distinct().join(p, "uid", "left_semi").groupBy("uid").agg(F.count("*").alias("n"))


@query("select frame_id, strftime(make_timestamp(t_ns // 1000), '%Y-%m-%d') as day, lpad((t_ns % 1000000000)::varchar, 9, '0') as ns, printf('%.3f', gain) as gain from px_frames", "px_frames")
def SCALARS_strings_and_times(spark, d):
    t = F.col("t_ns")
    return px.frames(spark, d).select("frame_id", F.date_format(F.timestamp_micros(F.floor(t / 1000)), "yyyy-MM-dd").alias("day"), F.lpad((t % 1_000_000_000).cast("string"), 9, "0").alias("ns"), F.format_string("%.3f", F.col("gain")).alias("gain"))

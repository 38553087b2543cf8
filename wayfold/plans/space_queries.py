"""Queries over point clouds, meshes, floors and splats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import color
from wayfold.functions import geometry as g
from wayfold.operators import metrics, neighbours, quality, quantiles, spatial
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


def r(x: Column, n: int = 6) -> Column:
    return F.round(x, n) + 0.0


def xyz(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in "xyz"]


@query("@m as (select median(x) mx, median(y) my, median(z) mz from px_splat) select count(*) as n, count(*) filter (sqrt((x-mx)**2+(y-my)**2+(z-mz)**2) <= 50) as kept, min(z) filter (sqrt((x-mx)**2+(y-my)**2+(z-mz)**2) <= 50) as z_low, max(z) filter (sqrt((x-mx)**2+(y-my)**2+(z-mz)**2) <= 50) as z_high, max(z) as z_before from px_splat, m", "px_splat")
def F11_A08_radius_filter(spark, d):
    rows = px.splats(spark, d)
    centre = [F.lit(quantiles.exact(rows, c, [0.5])[0]) for c in "xyz"]
    near = g.norm(g.minus(xyz(), centre)) <= 50
    return rows.agg(F.count("*").alias("n"), F.count_if(near).alias("kept"), F.min(F.when(near, F.col("z"))).alias("z_low"), F.max(F.when(near, F.col("z"))).alias("z_high"), F.max("z").alias("z_before"))


@query("select count(*) filter (z < 500) as in_radius, count(*) filter (z < 500 and 1/(1+exp(-opacity_logit)) < 0.1) as dropped, count(*) filter (z < 500 and 1/(1+exp(-opacity_logit)) >= 0.1) as kept from px_splat", "px_splat")
def F12_opacity_filter(spark, d):
    inside, o = F.col("z") < 500, color.sigmoid(F.col("opacity_logit"))
    return px.splats(spark, d).agg(F.count_if(inside).alias("in_radius"), F.count_if(inside & (o < 0.1)).alias("dropped"), F.count_if(inside & (o >= 0.1)).alias("kept"))


@query("select gid, round(1/(1+exp(-opacity_logit)), 6) as opacity, round(ln((1/(1+exp(-opacity_logit)))/(1 - 1/(1+exp(-opacity_logit)))), 4) + 0.0 as back, round(exp(s0), 6) as scale from px_splat", "px_splat")
def P15_activations(spark, d):
    o = color.sigmoid(F.col("opacity_logit"))
    return px.splats(spark, d).select("gid", F.round(o, 6).alias("opacity"), r(color.logit(o), 4).alias("back"), F.round(F.exp("s0"), 6).alias("scale"))


@query("select gid, round((x/10 - 0.5)/0.28209479177387814, 6) + 0.0 as dc from px_splat", "px_splat")
def P16_sh_dc(spark, d):
    return px.splats(spark, d).select("gid", r(color.to_sh(F.col("x") / 10)).alias("dc"))


FILTER = "f as (select max((0.02 + cam_tx)/f*sqrt(0.2::double)) as f from px_calib), a as (select gid, exp(s0)**2 as a, exp(s1)**2 as b, exp(s2)**2 as c, 1/(1+exp(-opacity_logit)) as o, (40*f.f)**2 as q from px_splat, f)"


@query(f"@{FILTER} select gid, round(sqrt(a + q), 6) as s0, round(sqrt(c + q), 6) as s2, round(o*sqrt(a*b*c/((a+q)*(b+q)*(c+q)) + 1e-7), 6) as opacity from a", "px_splat", "px_calib")
def P17_smoothing_filter(spark, d):
    """The widest filter over all cameras, from their least depth and focal length (lengths here are 40 times larger)."""
    widest = px.calibration(spark, d).agg((40 * F.max(color.depth_filter(0.02 + F.col("cam_tx"), F.col("f")))).alias("f"))
    s = [F.exp(f"s{i}") for i in range(3)]
    rows = px.splats(spark, d).join(F.broadcast(widest))
    scales = color.smoothed_scales(s, F.col("f"))
    return rows.select("gid", F.round(scales[0], 6).alias("s0"), F.round(scales[2], 6).alias("s2"), F.round(color.smoothed_opacity(color.sigmoid(F.col("opacity_logit")), s, F.col("f")), 6).alias("opacity"))


@query("select gid, i::int as i, ((i % 3)*15 + i // 3)*1.0::double + gid as v from px_splat, range(45) t(i)", "px_splat")
def P18_coefficient_order(spark, d):
    rest = F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: i.cast("double") + F.col("gid"))
    return px.splats(spark, d).select("gid", F.posexplode(color.coefficient_major(rest, 3, 15)).alias("i", "v"))


@query("select round(avg(1/(1+exp(-opacity_logit))), 6) as opacity, round(avg((exp(s0)+exp(s1)+exp(s2))/3), 6) as scale from px_splat", "px_splat")
def A28_regularisers(spark, d):
    return px.splats(spark, d).agg(F.round(F.avg(color.sigmoid(F.col("opacity_logit"))), 6).alias("opacity"), F.round(F.avg((F.exp("s0") + F.exp("s1") + F.exp("s2")) / 3), 6).alias("scale"))


@query("@b as (select min(x)-0.1 lx, max(x)+0.1 hx from px_cloud where id % 2 = 1) select count(*) as n from px_cloud, b where id % 2 = 0 and x >= lx and x <= hx and y >= -0.2 and y <= 0.2", "px_cloud")
def F06_bounding_box(spark, d):
    c = px.cloud(spark, d)
    box = c.where(F.col("id") % 2 == 1).agg((F.min("x") - 0.1).alias("lx"), (F.max("x") + 0.1).alias("hx"))
    return c.where(F.col("id") % 2 == 0).join(F.broadcast(box)).where(F.col("x").between(F.col("lx"), F.col("hx")) & F.col("y").between(-0.2, 0.2)).agg(F.count("*").alias("n"))


@query("@g as (select min(z) as g, max(z) as t from px_cloud) select count(*) filter (z > g+0.1 and z < g+0.2) as band, count(*) filter (z >= g-1 and z <= t+0.3) as footprint, count(*) filter (z <= g+0.3) as contact from px_cloud, g", "px_cloud")
def F17_height_bands(spark, d):
    c = px.cloud(spark, d)
    low = c.agg(F.min("z").alias("g"), F.max("z").alias("t"))
    z, ground = F.col("z"), F.col("g")
    return c.join(F.broadcast(low)).agg(F.count_if((z > ground + 0.1) & (z < ground + 0.2)).alias("band"), F.count_if(z.between(ground - 1, F.col("t") + 0.3)).alias("footprint"), F.count_if(z <= ground + 0.3).alias("contact"))


TWO = "v as (select p_partkey as id, case p_partkey % 5 when 0 then 'nan'::double when 1 then '-inf'::double when 2 then 1e-9 when 3 then -0.5 else 7.0 end as a, p_size/25.0::double as b from part)"


@query(f"@{TWO} select id, not (isnan(a) or isnan(b) or isinf(a) or isinf(b)) and (abs(a) < 1 or abs(b) < 1) as valid from v", "px_points")
def F18_valid_values(spark, d):
    k = F.col("p_partkey") % 5
    a = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).when(k == 2, 1e-9).when(k == 3, -0.5).otherwise(7.0)
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), a.alias("a"), (F.col("p_size") / 25.0).alias("b"))
    return rows.select("id", quality.valid([F.col("a"), F.col("b")], 1.0).alias("valid"))


NN = "e as (select * from px_cloud where id % 2 = 0), o as (select * from px_cloud where id % 2 = 1), w as (select 'p' as way, e.id, min(sqrt((e.x-o.x)**2+(e.y-o.y)**2+(e.z-o.z)**2)) as d from e, o group by e.id union all select 'r', o.id, min(sqrt((e.x-o.x)**2+(e.y-o.y)**2+(e.z-o.z)**2)) from e, o group by o.id)"


def both_ways(spark, d) -> DataFrame:
    c = px.cloud(spark, d)
    even, odd = c.where(F.col("id") % 2 == 0), c.where(F.col("id") % 2 == 1)
    near = lambda a, b, w: spatial.nearest(a, b, ["x", "y", "z"]).select(F.lit(w).alias("way"), "id", F.sqrt("d2").alias("d"))
    return near(even, odd, "p").unionAll(near(odd, even, "r"))


@query(f"@{NN} select way, id, round(d, 6) as d from w", "px_cloud")
def J09_nearest_3d(spark, d):
    return both_ways(spark, d).select("way", "id", F.round("d", 6).alias("d"))


TAUS = [0.02, 0.05, 0.10, 0.20]


@query(f"@{NN}, t as (select unnest([0.02, 0.05, 0.10, 0.20])::double as tau), s as (select tau, avg(case when way='p' then (d<tau)::int::double end) as p, avg(case when way='r' then (d<tau)::int::double end) as q from w, t group by tau) select tau, round(p, 6) as precision, round(q, 6) as recall, round(case when p+q=0 then 0 else 2*p*q/(p+q) end, 6) as f, tau >= 0.06 as trustworthy from s", "px_cloud")
def A15_precision_recall(spark, d):
    s = metrics.scores(both_ways(spark, d), TAUS, 0.03)
    return s.select("tau", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f")), "trustworthy")


@query(f"@{NN} select way, count(*) as n, round(100*avg(d), 4) as mean_cm, round(100*quantile_cont(d, 0.5), 4) as median_cm, round(100*quantile_cont(d, 0.95), 4) as p95_cm, round(avg((d<0.05)::int::double), 6) as below_5cm, round(avg((d<0.10)::int::double), 6) as below_10cm from w group by way", "px_cloud")
def A11_distance_summary(spark, d):
    w = spatial.keep(both_ways(spark, d))
    parts = []
    for way in ("p", "r"):
        one = w.where(F.col("way") == way)
        median, p95 = quantiles.exact(one, "d", [0.5, 0.95])
        parts.append(one.agg(F.lit(way).alias("way"), *metrics.distance_summary(F.col("d"), median, p95)))
    return parts[0].unionAll(parts[1])


@query(f"@{NN} select round(sqrt(avg(d*d) filter (d < 0.2)), 6) as inlier_rmse, round(avg((d<0.2)::int::double), 6) as fitness, round(median(d), 6) as median, round(sqrt(0.03**2 + avg(d*d)), 6) as budget from w where way = 'p'", "px_cloud")
def A16_A31_registration_fitness(spark, d):
    x = F.col("d")
    w = spatial.keep(both_ways(spark, d).where("way = 'p'"))
    median = quantiles.exact(w, "d", [0.5])[0]
    return w.agg(F.round(F.sqrt(F.avg(F.when(x < 0.2, x * x))), 6).alias("inlier_rmse"), F.round(F.avg((x < 0.2).cast("double")), 6).alias("fitness"), F.round(F.lit(median), 6).alias("median"), F.round(F.hypot(F.lit(0.03), F.sqrt(F.avg(x * x))), 6).alias("budget"))


@query("@p as (select a.id, (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 as d2, b.id as nn from px_cloud a, px_cloud b), k as (select *, row_number() over (partition by id order by d2, nn) as rank from p) select id, round(sqrt(sum(d2)/3), 6) as scale from k where rank between 2 and 4 group by id", "px_cloud")
def J10_knn_scale(spark, d):
    c = px.cloud(spark, d)
    near = spatial.nearest(c, c, ["x", "y", "z"], 4).where("rank > 1")
    return near.groupBy("id").agg(F.round(F.sqrt(F.sum("d2") / 3), 6).alias("scale"))


@query("select floor(x/0.05)::bigint as i, floor(y/0.05)::bigint as j, round(quantile_cont(z, 0.1), 6) + 0.0 as low, round(max(z), 6) + 0.0 as top, round(median(z) filter (z > 0), 6) as mid from px_cloud group by all", "px_cloud")
def A14_cell_quantiles(spark, d):
    z = F.col("z")
    return px.cloud(spark, d).groupBy(spatial.cell(F.col("x"), 0.05).alias("i"), spatial.cell(F.col("y"), 0.05).alias("j")).agg(r(F.percentile(z, F.lit(0.1))).alias("low"), r(F.max(z)).alias("top"), F.round(F.percentile(F.when(z > 0, z), F.lit(0.5)), 6).alias("mid"))


CELLS = "c as (select floor(x/0.05)::bigint as i, floor(y/0.05)::bigint as j, min(z) as low from px_cloud group by all)"


@query(f"@{CELLS} select a.i, a.j, round(least(min(b.low), case when count(*) < 25 then 0 end), 6) + 0.0 as low, round(greatest(max(b.low), case when count(*) < 25 then 0 end), 6) + 0.0 as high, count(*) as n from c a join c b on abs(a.i-b.i) <= 2 and abs(a.j-b.j) <= 2 group by all", "px_cloud")
def W09_grid_filter(spark, d):
    """Least and greatest value within two cells of each cell; cells that are not there count as 0."""
    c = px.cloud(spark, d).groupBy(spatial.cell(F.col("x"), 0.05).alias("i"), spatial.cell(F.col("y"), 0.05).alias("j")).agg(F.min("z").alias("low"))
    return spatial.grid_extremes(c, "low", 2, 0.0).select("i", "j", r(F.col("least")).alias("low"), r(F.col("most")).alias("high"), "n")


@query(f"@{CELLS}, k as (select i, j from c where low > 0.1), g as (select distinct k.i + a.o as i, k.j + b.o as j from k, (select unnest(range(-3, 4)) as o) a, (select unnest(range(-3, 4)) as o) b) select i, j from g", "px_cloud")
def W09_dilation(spark, d):
    c = px.cloud(spark, d).groupBy(spatial.cell(F.col("x"), 0.05).alias("i"), spatial.cell(F.col("y"), 0.05).alias("j")).agg(F.min("z").alias("low"))
    return spatial.dilated(c.where("low > 0.1").select("i", "j"), 3)


@query(f"@{CELLS} select p.id, c.low is not null as inside, round(p.z - c.low, 6) + 0.0 as above from px_cloud p left join c on floor((p.x+0.05)/0.05) = c.i and floor(p.y/0.05) = c.j", "px_cloud")
def J18_J20_cell_lookup(spark, d):
    p = px.cloud(spark, d)
    c = p.groupBy(spatial.cell(F.col("x"), 0.05).alias("i"), spatial.cell(F.col("y"), 0.05).alias("j")).agg(F.min("z").alias("low"))
    asked = p.select("id", "z", spatial.cell(F.col("x") + 0.05, 0.05).alias("i"), spatial.cell(F.col("y"), 0.05).alias("j"))
    return asked.join(c, ["i", "j"], "left").select("id", F.col("low").isNotNull().alias("inside"), r(F.col("z") - F.col("low")).alias("above"))


@query("select distinct floor(x/0.1)::bigint as i, floor(y/0.1)::bigint as j from px_cloud where x >= -0.3 and x < 0.3 and y >= -0.3 and y < 0.3", "px_cloud")
def A35_occupancy(spark, d):
    inside = (F.col("x") >= -0.3) & (F.col("x") < 0.3) & (F.col("y") >= -0.3) & (F.col("y") < 0.3)
    return px.cloud(spark, d).where(inside).select(spatial.cell(F.col("x"), 0.1).alias("i"), spatial.cell(F.col("y"), 0.1).alias("j")).distinct()


@query("select floor(x/0.1)::bigint as i, floor(y/0.1)::bigint as j, floor(z/0.1)::bigint as k, count(*) as n, round(avg(x), 6) + 0.0 as x, round(avg(y), 6) + 0.0 as y, round(avg(z), 6) + 0.0 as z from px_cloud group by 1, 2, 3", "px_cloud")
def O12_voxel_downsample(spark, d):
    keys = [spatial.cell(F.col(c), 0.1).alias(n) for c, n in zip("xyz", "ijk", strict=True)]
    return px.cloud(spark, d).groupBy(*keys).agg(F.count("*").alias("n"), *(r(F.avg(c)).alias(c) for c in "xyz"))


@query("@e as (select min(pz) as lo, max(pz) as hi from px_points), b as (select least(floor((pz - lo)/(hi - lo)*60)::bigint, 59) as bin, lo, hi, count(*) as n from px_points, e group by all) select bin, n, round(lo + (bin + 0.5)*(hi - lo)/60, 6) as middle from b order by n desc, bin limit 1", "px_points")
def A17_histogram_mode(spark, d):
    return metrics.histogram_mode(px.points(spark, d), "pz", F.min("pz"), F.max("pz"), 60).select("bin", "n", F.round("middle", 6).alias("middle"))


@query("@b as (select least(floor((z + 0.31)/(0.98)*49)::bigint, 48) as bin, count(*) as n from px_cloud where z >= -0.31 and z <= -0.31 + 0.98 group by all) select bin, n, round(-0.31 + (bin + 0.5)*0.98/49, 6) + 0.0 as middle from b order by n desc, bin limit 1", "px_cloud")
def A17_two_centimetre_mode(spark, d):
    found = metrics.histogram_mode(px.cloud(spark, d), "z", F.lit(-0.31), F.lit(-0.31 + 0.98), 49)
    return found.select("bin", "n", r(F.col("middle")).alias("middle"))


PATH = "path as (select sample_id as pid, tx*20 as x, ty as y from px_traj)"


def path(spark, d) -> DataFrame:
    return px.trajectory(spark, d).select(F.col("sample_id").alias("id"), (F.col("tx") * 20).alias("x"), F.col("ty").alias("y"))


@query(f"@{PATH}, n as (select uid, min((p.px*2-h.x)**2+(p.py-h.y)**2) as d2 from px_points p, path h group by uid) select uid, round(sqrt(d2), 5) as d, sqrt(d2) <= 0.75 as near, sqrt(d2) < 4.0 as visible from n", "px_points", "px_traj")
def J08_F15_F16_path_distance(spark, d):
    p = px.points(spark, d).select(F.col("uid").alias("id"), (F.col("px") * 2).alias("x"), F.col("py").alias("y"))
    # many points share a place; each place is looked up once
    places = p.groupBy("x", "y").agg(F.min("id").alias("id"))
    near = spatial.nearest(places, path(spark, d), ["x", "y"]).select("id", F.sqrt("d2").alias("d"))
    found = places.join(near, "id").select("x", "y", "d")
    return p.join(found, ["x", "y"]).select(F.col("id").alias("uid"), F.round("d", 5).alias("d"), (F.col("d") <= 0.75).alias("near"), (F.col("d") < 4.0).alias("visible"))


TRI = "t as (select f.fid, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz from px_face f join px_vertex a on a.vid = f.a join px_vertex b on b.vid = f.b join px_vertex c on c.vid = f.c), l as (select *, greatest(sqrt((ax-bx)**2+(ay-by_)**2+(az-bz)**2), sqrt((bx-cx)**2+(by_-cy)**2+(bz-cz)**2), sqrt((cx-ax)**2+(cy-ay)**2+(cz-az)**2)) as edge, sqrt(((by_-ay)*(cz-az)-(bz-az)*(cy-ay))**2 + ((bz-az)*(cx-ax)-(bx-ax)*(cz-az))**2 + ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))**2)/2 as area from t)"


def triangles(spark, d) -> DataFrame:
    """Faces with the places of their corners."""
    rows, v = px.faces(spark, d), px.vertices(spark, d)
    for k in "abc":
        rows = rows.join(spatial.many(v.select(F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in "xyz"))), k)
    corners = [[F.col(k + c) for c in "xyz"] for k in "abc"]
    return rows.withColumn("edge", g.longest_edge(*corners)).withColumn("area", g.triangle_area(*corners))


@query(f"@{TRI}, k as (select f.* from px_face f join l using (fid) where edge <= 2.0), u as (select v, row_number() over (order by v) - 1 as nid from (select a as v from k union select b from k union select c from k)) select k.fid, ua.nid as a, ub.nid as b, uc.nid as c from k join u ua on ua.v = k.a join u ub on ub.v = k.b join u uc on uc.v = k.c", "px_vertex", "px_face")
def F13_J13_P33_spike_filter(spark, d):
    kept = triangles(spark, d).where("edge <= 2.0").select("fid", "a", "b", "c")
    used = spatial.dense_ids(kept.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct(), ["v"], "nid")
    for k in "abc":
        kept = kept.join(used.select(F.col("v").alias(k), F.col("nid").alias(f"n{k}")), k)
    return kept.select("fid", *(F.col(f"n{k}").alias(k) for k in "abc"))


@query(f"@{TRI}, e as (select a, b from px_face union select b, c from px_face union select c, a from px_face), r0 as (select a, b from e union select b, a from e) select 1 as one", "px_vertex", "px_face")
def A29_A30_mesh_hygiene(spark, d):
    f = px.faces(spark, d)
    edges = f.select("a", "b").unionAll(f.select("b", "c")).unionAll(f.select("c", "a"))
    nodes = f.select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    part = spatial.components(edges, nodes)
    areas = triangles(spark, d).join(part, F.col("a") == F.col("id")).groupBy("component").agg(F.sum("area").alias("area"))
    return areas.agg(F.count("*").alias("n_components"), F.round(F.coalesce(F.sum(F.when(F.col("area") < 0.1, F.col("area"))), F.lit(0.0)), 5).alias("small_area"), F.round(F.max("area"), 5).alias("largest"), F.round(F.sum("area"), 5).alias("total"))


ORACLE_SQL["A29_A30_mesh_hygiene"] = f"""with recursive px_vertex as ({px.SQL['px_vertex']}), px_face as ({px.SQL['px_face']}), {TRI},
e as (select a, b from px_face union select b, c from px_face union select c, a from px_face),
b as (select a, b from e union select b, a from e),
reach as (select distinct a as id, a as root from b where a % 1690 in (0, 1681, 1684, 1687) or a not in (select b from b where b < a)
  union select b.b, reach.root from reach join b on b.a = reach.id),
part as (select id, min(root) as component from reach group by id),
s as (select component, sum(area) as area from l join px_face f using (fid) join part on part.id = f.a group by component)
select count(*) as n_components, round(coalesce(sum(area) filter (area < 0.1), 0), 5) as small_area, round(max(area), 5) as largest, round(sum(area), 5) as total from s"""


GRID = "g as (select 1600*k + i*40 + j as id, 20.0::double*k + i*0.1::double + 0.03 as x, j*0.1::double + 0.04 as y from (select p_partkey // 1000 as k from part group by 1) q, range(40) a(i), range(40) b(j))"


def grid(spark, d) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    return px.of_tiles(spark, d, 1600).select((1600 * k + n).alias("id"), (20.0 * k + F.floor(n / 40) * 0.1 + 0.03).alias("x"), (n % 40 * 0.1 + 0.04).alias("y"))


HITS = f"{TRI}, {GRID}, q as (select g.id, az, bz, cz, ((by_-cy)*(x-cx)+(cx-bx)*(y-cy))/((by_-cy)*(ax-cx)+(cx-bx)*(ay-cy)) as u, ((cy-ay)*(x-cx)+(ax-cx)*(y-cy))/((by_-cy)*(ax-cx)+(cx-bx)*(ay-cy)) as v from g join l on x between least(ax,bx,cx) - 1e-9 and greatest(ax,bx,cx) + 1e-9 and y between least(ay,by_,cy) - 1e-9 and greatest(ay,by_,cy) + 1e-9 where edge <= 2.0 and (by_-cy)*(ax-cx)+(cx-bx)*(ay-cy) <> 0), h as (select id, max(u*az+v*bz+(1-u-v)*cz) as z from q where u >= -1e-9 and v >= -1e-9 and u+v <= 1+1e-9 and u*az+v*bz+(1-u-v)*cz <= 0.5 group by id)"


def hits(spark, d) -> DataFrame:
    return spatial.ray_down(grid(spark, d).withColumn("top", F.lit(0.5)), triangles(spark, d).where("edge <= 2.0"), 0.2)


@query(f"@{HITS} select id, round(z, 6) + 0.0 as z from h", "px_vertex", "px_face")
def K01_vertical_rays(spark, d):
    return hits(spark, d).select("id", r(F.col("z")).alias("z"))


@query(f"@{HITS} select count(*) as n_cells, count(h.id) filter (abs(z - 0.03) <= 0.15) as covered, round(count(h.id) filter (abs(z - 0.03) <= 0.15)/count(*)::double, 6) as coverage, round(count(*)*0.01, 4) as area from g left join h using (id)", "px_vertex", "px_face")
def A12_F14_floor_coverage(spark, d):
    hit = F.coalesce(F.abs(F.col("z") - 0.03) <= 0.15, F.lit(False))
    rows = grid(spark, d).join(hits(spark, d), "id", "left")
    return rows.agg(F.count("*").alias("n_cells"), F.count_if(hit).alias("covered"), F.round(F.avg(hit.cast("double")), 6).alias("coverage"), F.round(F.count("*") * 0.01, 4).alias("area"))


@query(None)
def A13_largest_hole(spark, d):
    missing = grid(spark, d).join(hits(spark, d), "id", "left_anti").select("id").withColumn("i", F.floor(F.col("id") / 40)).withColumn("j", F.col("id") % 40)
    beside = F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in ((0, 1), (1, 0))))
    edges = missing.select(F.col("id").alias("a"), F.explode(beside).alias("n")).join(missing.select(F.col("id").alias("b"), "i", "j"), (F.col("n.i") == F.col("i")) & (F.col("n.j") == F.col("j"))).select("a", "b")
    sizes = spatial.components(edges, missing.select("id")).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_holes"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


ORACLE_SQL["A13_largest_hole"] = f"""with recursive px_vertex as ({px.SQL['px_vertex']}), px_face as ({px.SQL['px_face']}), {HITS},
m as (select id, id // 40 as i, id % 40 as j from g anti join h using (id)),
w as (select id, id as root, i, j from m union select m.id, w.root, m.i, m.j from w join m on abs(m.i - w.i) + abs(m.j - w.j) = 1),
c as (select id, min(root) as component from w group by id), s as (select component, count(*) as n from c group by component)
select count(*) as n_holes, coalesce(max(n), 0) as largest from s"""


EYE, BAND, BUFFER, CELL = 0.3, 0.5, 0.75, 0.25
A18 = f"@h as (select sample_id as pid, tx*20 as x, ty as y, tz as z from px_traj), s as (select px*2 as x, py as y, pz as z from px_points), q as (select distinct x, y from s), n as (select q.x, q.y, min(struct_pack(d2 := (q.x-h.x)*(q.x-h.x) + (q.y-h.y)*(q.y-h.y), pid := h.pid, z := h.z)) as m from q, h group by q.x, q.y), k as (select sqrt(m.d2) <= {BUFFER} as near, abs(s.z - (m.z - {EYE})) <= {BAND} as low from s join n using (x, y)), c as (select count(*) filter (near and low) as floor_band, count(*) filter (near and not low) as above, count(*) filter (not near) as far from k), w as (select count(*) as cells from (select distinct floor(x/{CELL}) + u as i, floor(y/{CELL}) + v as j from (select distinct x, y from h), range(-3, 4) a(u), range(-3, 4) b(v) where sqrt(((floor(x/{CELL}) + u + 0.5)*{CELL} - x)*((floor(x/{CELL}) + u + 0.5)*{CELL} - x) + ((floor(y/{CELL}) + v + 0.5)*{CELL} - y)*((floor(y/{CELL}) + v + 0.5)*{CELL} - y)) <= {BUFFER})) select floor_band, above, far, round(floor_band/greatest(1, floor_band + above)::double, 6) as share, cells, round(floor_band/(cells*{CELL}*{CELL}), 5) as per_m2 from c, w"


@query(A18, "px_points", "px_traj")
def A18_floor_band(spark, d):
    """Points by the path within a band about the floor under their nearest pose, others near it, points far from it; the band's share of those near, and its points per square metre of walked cells."""
    poses = px.trajectory(spark, d).select(F.col("sample_id").alias("id"), (F.col("tx") * 20).alias("x"), F.col("ty").alias("y"), F.col("tz").alias("pose"))
    p = px.points(spark, d).select(F.col("uid").alias("id"), (F.col("px") * 2).alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    places = spatial.keep(p.groupBy("x", "y").agg(F.min("id").alias("id")))
    near = neighbours.Index(poses, neighbours.Points(["x", "y"]), ["pose"]).nearest(places).select("x", "y", F.sqrt("d2").alias("d"), "pose")
    by, low = F.col("d") <= BUFFER, F.abs(F.col("z") - (F.col("pose") - EYE)) <= BAND
    counts = p.join(near, ["x", "y"]).agg(F.count_if(by & low).alias("floor_band"), F.count_if(by & ~low).alias("above"), F.count_if(~by).alias("far"))
    # walked cells: those with their centre within reach of a pose
    n = math.ceil(BUFFER / CELL)
    steps = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in range(-n, n + 1) for v in range(-n, n + 1)))
    cells = poses.select("x", "y").distinct().select("x", "y", F.inline(steps)).select("x", "y", (spatial.cell(F.col("x"), CELL) + F.col("u")).alias("i"), (spatial.cell(F.col("y"), CELL) + F.col("v")).alias("j"))
    dx, dy = (F.col("i") + 0.5) * CELL - F.col("x"), (F.col("j") + 0.5) * CELL - F.col("y")
    walked = cells.where(F.sqrt(dx * dx + dy * dy) <= BUFFER).select("i", "j").distinct().agg(F.count("*").alias("cells"))
    band, above = F.col("floor_band"), F.col("above")
    return counts.join(walked).select("floor_band", "above", "far", F.round(band / F.greatest(F.lit(1), band + above).cast("double"), 6).alias("share"), "cells", F.round(F.try_divide(band.cast("double"), F.col("cells") * CELL * CELL), 5).alias("per_m2"))

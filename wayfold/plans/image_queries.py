"""Queries over images, colours and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import color
from wayfold.functions import geometry as g
from wayfold.operators import metrics, rectify, spatial
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


def gt() -> Column:
    return F.col("gt")


def pred() -> Column:
    return F.col("pred")


def mask() -> Column:
    return F.col("mask")


def err() -> Column:
    return pred() - gt()


@query("select img, round(avg(abs(pred-gt)), 6) as l1, round(avg((pred-gt)**2), 6) as l2, round(avg(case when abs(pred-gt) <= 0.1 then 0.5*(pred-gt)**2 else 0.1*(abs(pred-gt)-0.05) end), 6) as huber, round(sum(abs(pred-gt)*mask)/sum(mask), 6) as l1_masked from px_img group by img", "px_img")
def A20_pixel_losses(spark, d):
    return px.images(spark, d).groupBy("img").agg(F.round(F.avg(F.abs(err())), 6).alias("l1"), F.round(F.avg(err() * err()), 6).alias("l2"), F.round(F.avg(metrics.huber(err(), 0.1)), 6).alias("huber"), F.round(metrics.masked_mean(F.abs(err()), mask()), 6).alias("l1_masked"))


@query("@m as (select img, sum((pred-gt)**2*mask)/sum(mask) as mse from px_img group by img), c as (select img, c, avg((pred-gt)**2) as mse from px_img group by img, c), p as (select img, avg(20*log10(1/sqrt(mse))) as p from c group by img) select img, round(20*log10(1/sqrt(m.mse)), 5) as masked, round(p.p, 5) as by_channel from m join p using (img)", "px_img")
def A19_psnr(spark, d):
    rows = px.images(spark, d)
    masked = rows.groupBy("img").agg(metrics.masked_mean(err() * err(), mask()).alias("mse")).select("img", F.round(metrics.psnr(F.col("mse")), 5).alias("masked"))
    by_channel = rows.groupBy("img", "c").agg(F.avg(err() * err()).alias("mse")).groupBy("img").agg(F.round(F.avg(metrics.psnr(F.col("mse"))), 5).alias("by_channel"))
    return masked.join(by_channel, "img")


GAUSS = "k as (select i - 5 as o, exp(-((i-5)**2)/4.5)/(select sum(exp(-((i-5)**2)/4.5)) from range(11) t(i)) as w from range(11) t(i))"


SSIM = f"{GAUSS}, s as (select img, c, y, x, pred as p, gt as t, pred*pred as pp, gt*gt as tt, pred*gt as pt from px_img), bx as (select img, c, y, x + o as x, sum(w*p) as p, sum(w*t) as t, sum(w*pp) as pp, sum(w*tt) as tt, sum(w*pt) as pt from s, k where x + o between 0 and 31 group by all), b as (select img, c, y + o as y, x, sum(w*p) as p, sum(w*t) as t, sum(w*pp) as pp, sum(w*tt) as tt, sum(w*pt) as pt from bx, k where y + o between 0 and 31 group by all)"
INDEX = "avg((2*p*t+1e-4)*(2*(pt-p*t)+9e-4)/((p*p+t*t+1e-4)*(pp-p*p+tt-t*t+9e-4)))"


@query(f"@{SSIM} select img, round({INDEX}, 5) as ssim, round(1 - {INDEX}, 5) as dssim from b group by img", "px_img")
def A21_ssim(spark, d):
    return metrics.ssim(px.images(spark, d), ["img"]).select("img", F.round("ssim", 5).alias("ssim"), F.round(1 - F.col("ssim"), 5).alias("dssim"))


#: The mask eroded by two pixels.
ERODED = "er as (select a.img, a.y, a.x, min(b.mask) as mask from (select distinct img, y, x from px_img) a join (select distinct img, y, x, mask from px_img) b on a.img=b.img and abs(a.y-b.y) <= 2 and abs(a.x-b.x) <= 2 group by all)"


@query(f"@{ERODED}, r as (select i.img, gt, case when i.img % 3 = 2 then 0 else pred end as p, er.mask from px_img i join er using (img, y, x) where c = 0), z as (select img, sum(p*p*mask) <= 1e-6 as zero from r group by img), q as (select r.img, gt, mask, case when zero then 1 else p end as p from r join z using (img)), s as (select img, sum(gt*p*mask)/sum(p*p*mask) as s from q group by img) select img, round(s, 6) as scale, round(sum((s*p-gt)**2*mask)/sum(mask), 8) as error from q join s using (img) group by img, s", "px_img")
def A24_scale_invariant_depth(spark, d):
    rows = px.images(spark, d).where("c = 0").withColumn("pred", F.when(F.col("img") % 3 == 2, 0.0).otherwise(F.col("pred")))
    return metrics.scale_invariant(rows, ["img"]).select("img", F.round("scale", 6).alias("scale"), F.round("error", 8).alias("error"))


WIDE = "w as (select img, y, x, mask, max(gt) filter (c=0) g0, max(gt) filter (c=1) g1, max(gt) filter (c=2) g2, max(pred) filter (c=0) p0, max(pred) filter (c=1) p1, max(pred) filter (c=2) p2 from px_img group by all)"


def wide(spark, d) -> DataFrame:
    """A row for each pixel, with its channels side by side."""
    pick = lambda v, c: F.max(F.when(F.col("c") == c, F.col(v)))
    return px.images(spark, d).groupBy("img", "y", "x", "mask").agg(*(pick(v, c).alias(f"{n}{c}") for v, n in (("gt", "g"), ("pred", "p")) for c in range(3)))


@query(f"@{WIDE}, {ERODED} select img, round(sum((1 - (g0*p0+g1*p1+g2*p2))*er.mask)/sum(er.mask), 7) + 0.0 as distance from w join er using (img, y, x) group by img", "px_img")
def A25_normal_cosine(spark, d):
    a, b = ([F.col(f"{n}{c}") for c in range(3)] for n in "gp")
    rows = metrics.eroded(wide(spark, d), ["img"])
    return rows.groupBy("img").agg(r(metrics.masked_mean(1 - g.dot(a, b), mask()), 7).alias("distance"))


@query("select case when grouping(img) = 1 then -1 else img end as img, round(avg(m), 7) as l1 from (select img, avg(abs(pred-gt)) as m from px_img group by img) group by rollup(img)", "px_img")
def A26_frame_and_overall(spark, d):
    per = px.images(spark, d).groupBy("img").agg(F.avg(F.abs(err())).alias("m"))
    return per.rollup("img").agg(F.round(F.avg("m"), 7).alias("l1"), F.grouping("img").alias("g")).select(F.when(F.col("g") == 1, -1).otherwise(F.col("img")).alias("img"), "l1")


INVERSE = "e as (select img, case when gt>0.1 then 1/gt else 0 end - case when pred>0.1 then 1/pred else 0 end as e, 0.1+y/100.0 as std from px_img where c = 0), h as (select *, case when abs(e) <= 0.1 then 0.5*e*e else 0.1*(abs(e)-0.05) end as hu from e)"


@query(f"@{INVERSE} select img, round(avg(abs(e)), 5) as l1, round(avg(hu), 5) as huber, round(avg(e*e), 4) as l2, round(avg(abs(e)/std), 4) as l1_weighted, round(avg(hu/std), 4) as huber_weighted, round(avg(e*e/(std*std)), 3) as l2_weighted from h group by img", "px_img")
def P13_A27_inverse_depth_loss(spark, d):
    losses = metrics.inverse_depth_losses(g.inverse_depth(gt()) - g.inverse_depth(pred()), 0.1 + F.col("y") / 100.0)
    digits = {"l1": 5, "huber": 5, "l2": 4, "l1_weighted": 4, "huber_weighted": 4, "l2_weighted": 3}
    return px.images(spark, d).where("c = 0").groupBy("img").agg(*(F.round(v, digits[n]).alias(n) for n, v in losses.items()))


@query("@m as (select c, avg(1/(1+exp(-4*(pred-0.8)))) as rho, avg((pred-gt)**2) as mse from px_img group by c) select round(avg(0.05*ln(0.05/(rho+1e-5)) + 0.95*ln(0.95/(1-rho+1e-5))), 6) as kl, round(max(mse), 7) as worst_mse from m", "px_img")
def A36_bernoulli_kl(spark, d):
    per = px.images(spark, d).groupBy("c").agg(F.avg(color.sigmoid(4 * (pred() - 0.8))).alias("rho"), F.avg(err() * err()).alias("mse"))
    return per.agg(F.round(F.avg(metrics.bernoulli_kl(0.05, F.col("rho"))), 6).alias("kl"), F.round(F.max("mse"), 7).alias("worst_mse"))


@query(f"@{SSIM}, q as (select img, {INDEX} as ssim from b group by img), {INVERSE}, i as (select img, avg(abs(e)) as inv from e group by img), m as (select img, avg(abs(pred-gt)) as l1, avg((pred-gt)**2) as mse from px_img group by img) select 'cam' || (img % 2) as camera, round(avg(l1), 6) as l1, round(avg(ssim), 5) as ssim, round(avg(20*log10(1/sqrt(mse))), 4) as psnr, round(avg(inv), 5) as inverse_depth_l1 from m join q using (img) join i using (img) group by 1", "px_img")
def A37_validation_means(spark, d):
    """Means over a camera's frames of each frame's scores."""
    rows = px.images(spark, d)
    per = rows.groupBy("img").agg(F.avg(F.abs(err())).alias("l1"), metrics.psnr(F.avg(err() * err())).alias("psnr"), F.avg(F.when(F.col("c") == 0, F.abs(g.inverse_depth(gt()) - g.inverse_depth(pred())))).alias("inverse"))
    both = per.join(metrics.ssim(rows, ["img"]), "img")
    return both.groupBy(F.concat(F.lit("cam"), F.col("img") % 2).alias("camera")).agg(F.round(F.avg("l1"), 6).alias("l1"), F.round(F.avg("ssim"), 5).alias("ssim"), F.round(F.avg("psnr"), 4).alias("psnr"), F.round(F.avg("inverse"), 5).alias("inverse_depth_l1"))


@query(f"@{WIDE} select img, y, x, round(0.299*g0+0.587*g1+0.114*g2, 6) as luma, round(-0.168736*g0-0.331264*g1+0.5*g2+0.5, 6) as cb, round(0.5*g0-0.418688*g1-0.081312*g2+0.5, 6) as cr from w", "px_img")
def P19_luma_ycbcr(spark, d):
    y, cb, cr = color.to_ycbcr(*(F.col(f"g{c}") for c in range(3)))
    return wide(spark, d).select("img", "y", "x", F.round(y, 6).alias("luma"), F.round(cb, 6).alias("cb"), F.round(cr, 6).alias("cr"))


@query("select img, c, y, x, round(case when gt<0.0031308 then 12.92*gt else 1.055*gt**(1/2.4)-0.055 end, 6) as encoded, round(case when gt<=0.04045 then gt/12.92 else ((gt+0.055)/1.055)**2.4 end, 6) as decoded, round(case when gt<0.5 then gt**1.6 else gt**2.2 end, 6) as two from px_img", "px_img")
def P20_gamma(spark, d):
    return px.images(spark, d).select("img", "c", "y", "x", F.round(color.srgb_encode(gt()), 6).alias("encoded"), F.round(color.srgb_decode(gt()), 6).alias("decoded"), F.round(color.two_segment_gamma(gt()), 6).alias("two"))


@query("@v as (select y, x, 1 - ((x-15.5)**2+(y-15.5)**2)/2000 as vig from range(32) a(y), range(32) b(x)), l as (select img, c, y, x, mask, (case when gt<=0.04045 then gt/12.92 else ((gt+0.055)/1.055)**2.4 end)*1.5*vig as lin from px_img join v using (y, x)) select img, c, y, x, round(greatest(0, least(1, (case when lin<0.0031308 then 12.92*lin else 1.055*lin**(1/2.4)-0.055 end)*mask)), 6) as exposed, round(lin*mask, 6) as irradiance from l", "px_img")
def P21_P32_J21_exposure(spark, d):
    k = F.col("id")
    y, x = F.floor(k / 32), k % 32
    vignette = spark.range(1024).select(y.alias("y"), x.alias("x"), (1 - ((x - 15.5) ** 2 + (y - 15.5) ** 2) / 2000).alias("vig"))
    rows = px.images(spark, d).join(vignette, ["y", "x"])
    return rows.select("img", "c", "y", "x", F.round(color.expose(gt(), F.lit(1.5), F.col("vig"), mask()), 6).alias("exposed"), F.round(color.srgb_decode(gt()) * 1.5 * F.col("vig") * mask(), 6).alias("irradiance"))


@query("select img, c, y, x, case when trunc(gt*256-1) < 0 then 255 else trunc(gt*256-1) end::int as i from px_img", "px_img")
def P25_palette_index(spark, d):
    return px.images(spark, d).select("img", "c", "y", "x", color.palette_index(gt()).alias("i"))


#: Fisheye parameters of a camera; a picture of half the size divides the first four and drops what is left over.
FISHEYE = [41.0, 43.0, 31.0, 32.0, 0.1, -0.02, 0.003, -0.0004]
TAPS = "f as (select img, y, x, floor(u) as x0, floor(v) as y0, u - floor(u) as a, v - floor(v) as b, u, v from t), k as (select img, y, x, u, v, x0 + dx as sx, y0 + dy as sy, (case when dx=1 then a else 1-a end)*(case when dy=1 then b else 1-b end) as w from f, range(2) q(dx), range(2) z(dy)) select k.img, k.y, k.x, round(min(k.u), 5) + 0.0 as u, round(min(k.v), 5) + 0.0 as v, round(sum(w*coalesce(i.gt, 0)), 6) as value from k left join px_img i on i.c = 0 and i.img = k.img and i.x = k.sx and i.y = k.sy group by all"


def resampled(spark, d, u: Column, v: Column) -> DataFrame:
    rows = px.images(spark, d).where("c = 0")
    asked = rows.where("img IS NOT NULL").select("img", F.struct("y", "x").alias("id"), u.alias("u"), v.alias("v"))
    found = metrics.remapped(rows, asked, ["img"], "gt", ["u", "v"])
    return found.select("img", "id.y", "id.x", r(F.col("u"), 5).alias("u"), r(F.col("v"), 5).alias("v"), F.round("gt", 6).alias("value"))


@query(f"@p as (select img, y, x, (x-15)/20.0 as px, (y-16)/21.0 as py from px_img where c = 0), q as (select *, sqrt(px*px+py*py) as th from p), s as (select *, 1+0.1*th**2-0.02*th**4+0.003*th**6-0.0004*th**8 as k from q), t as (select img, y, x, 20*px*k + 15 as u, 21*py*k + 16 as v from s), {TAPS}", "px_img")
def P26_fisheye_map(spark, d):
    return resampled(spark, d, *g.fisheye_map(F.col("x"), F.col("y"), FISHEYE, 2))


@query(f"@p as (select img, y, x, (x-15.5)/20.0 as px, (y-15.5)/21.0 as py from px_img where c = 0), q as (select *, px*px+py*py as r2 from p), t as (select img, y, x, 20*(px*(1+0.1*r2-0.02*r2*r2) + 2*0.003*px*py + -0.0004*(r2+2*px*px)) + 15.5 as u, 21*(py*(1+0.1*r2-0.02*r2*r2) + 0.003*(r2+2*py*py) + 2*-0.0004*px*py) + 15.5 as v from q), {TAPS}", "px_img")
def P26_pinhole_map(spark, d):
    return resampled(spark, d, *g.pinhole_map(F.col("x"), F.col("y"), [20.0, 21.0, 15.5, 15.5], [0.1, -0.02, 0.003, -0.0004]))


def P26_pinhole_rectified(spark, d):
    """Pictures under the optimal matrix of their own camera, with a mask of what is inside."""
    k = F.array(0.1 - 0.02 * (F.col("img") % 3), F.lit(-0.02), F.lit(0.003), F.lit(-0.0004))
    cameras = px.image_ids(spark, d).select("img", *(F.lit(v).alias(c) for c, v in (("fx", 20.0), ("fy", 21.0), ("cx", 15.5), ("cy", 15.5), ("width", 32), ("height", 32))), k.alias("k"))
    found = rectify.pinhole(px.images(spark, d).where("c = 0"), cameras, ["img"], ["gt"])
    return found.select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("gt", 5).alias("value"), "mask")


QUERIES["P26_pinhole_rectified"] = P26_pinhole_rectified
#: The border is straightened by plain repetition here, by Newton steps in the operator.
ORACLE_SQL["P26_pinhole_rectified"] = f"""with recursive px_img as ({px.SQL['px_img']}), cam as (select distinct img, 0.1::double - 0.02::double*(img % 3) as k1 from px_img),
s(side, a0, a1, b0, b1) as (values ('left', 0, 0, 0, 1), ('right', 1, 0, 0, 1), ('top', 0, 1, 0, 0), ('bottom', 0, 1, 1, 0)),
p as (select k1, side, i, ((a0 + a1*i/8.0::double)*31 - 15.5)/20 as x, ((b0 + b1*i/8.0::double)*31 - 15.5)/21 as y from (select distinct k1 from cam), s, range(9) r(i)),
it as (select k1, side, i, x, y, x as u, y as v, 0 as n from p union all
  select k1, side, i, x, y, (x - (2*0.003*u*v - 0.0004*(u*u+v*v + 2*u*u)))/(1 + k1*(u*u+v*v) - 0.02*(u*u+v*v)**2), (y - (0.003*(u*u+v*v + 2*v*v) - 2*0.0004*u*v))/(1 + k1*(u*u+v*v) - 0.02*(u*u+v*v)**2), n + 1 from it where n < 80),
e as (select k1, max(u) filter (side = 'left') as x0, min(u) filter (side = 'right') as x1, max(v) filter (side = 'top') as y0, min(v) filter (side = 'bottom') as y1 from it where n = 80 group by k1),
q as (select img, y, x, k1, x0 + x*(x1 - x0)/31 as u, y0 + y*(y1 - y0)/31 as v from cam join e using (k1), range(32) a(y), range(32) b(x)),
t as (select img, y, x, 20*(u*(1 + k1*(u*u+v*v) - 0.02*(u*u+v*v)**2) + 2*0.003*u*v - 0.0004*(u*u+v*v + 2*u*u)) + 15.5 as u, 21*(v*(1 + k1*(u*u+v*v) - 0.02*(u*u+v*v)**2) + 0.003*(u*u+v*v + 2*v*v) - 2*0.0004*u*v) + 15.5 as v from q),
f as (select img, y, x, floor(u) as x0, floor(v) as y0, u - floor(u) as a, v - floor(v) as b from t),
k as (select img, y, x, x0 + dx as sx, y0 + dy as sy, (case when dx = 1 then a else 1 - a end)*(case when dy = 1 then b else 1 - b end) as w from f, range(2) q(dx), range(2) z(dy))
select k.img, k.y, k.x, round(sum(w*coalesce(i.gt, 0)), 5) as value, floor(round(255*sum(case when i.gt is null then 0 else w end), 6))::int as mask from k left join px_img i on i.c = 0 and i.img = k.img and i.x = k.sx and i.y = k.sy group by all"""


#: Fixed parameters of a fisheye camera: six radial, two tangential and four thin prism terms.
LENS = {"k": [0.05, -0.01, 0.002, 0.0, 0.0, 0.0001], "p": [0.001, -0.002], "s": [0.0005, 0.0001, -0.0004, 0.0]}


@query("@q as (select img, y, x, (x - 11.5)/14 as a, (y - 11.5)/14 as b, 18.0::double + img % 2 as f from (select distinct img from px_img), range(24) r(y), range(24) s(x)), n as (select *, sqrt(a*a+b*b) as r, atan(sqrt(a*a+b*b)) as t from q), g as (select *, t*(1 + 0.05*t**2 - 0.01*t**4 + 0.002*t**6 + 0.0001*t**12)/r as k from n), h as (select img, y, x, f, k*a as u, k*b as v, (k*a)**2 + (k*b)**2 as r2 from g), t as (select img, y, x, f*(u + 2*u*(0.001*u - 0.002*v) + 0.001*r2 + 0.0005*r2 + 0.0001*r2*r2) + 15.5 as u, f*(v + 2*v*(0.001*u - 0.002*v) - 0.002*r2 - 0.0004*r2) + 15.5 as v from h), m as (select *, case when u >= 0 and u <= 31 and v >= 0 and v <= 31 then 1 else 0 end as inside from t), c as (select *, floor(u) as x0, floor(v) as y0, u - floor(u) as a, v - floor(v) as b from m), k as (select c.*, x0 + dx as sx, y0 + dy as sy, (case when dx = 1 then a else 1 - a end)*(case when dy = 1 then b else 1 - b end) as w from c, range(2) q(dx), range(2) z(dy)) select k.img, k.y, k.x, inside*round(sum(w*coalesce(i.gt, 0)), 5) as value, (inside*floor(round(sum(w*coalesce(case when i.gt is not null then 255*(1 - ((sx-15.5)**2 + (sy-15.5)**2)/2000) end, 0)), 6)))::int as vignette, 255*inside as mask, (inside*floor(round(255*v/31, 6)))::int as row from k left join px_img i on i.c = 0 and i.img = k.img and i.x = k.sx and i.y = k.sy group by k.img, k.y, k.x, inside, v", "px_img")
def K11_fisheye_rectified(spark, d):
    """Fisheye pictures as a linear camera sees them, with their vignette, mask and rows of read-out."""
    fixed = [F.lit(v).alias(c) for c, v in (("cx", 15.5), ("cy", 15.5), ("width", 32), ("height", 32))]
    cameras = px.image_ids(spark, d).select("img", (18.0 + F.col("img") % 2).alias("f"), *fixed, *(F.array(*map(F.lit, v)).alias(c) for c, v in LENS.items()))
    vignette = 255 * (1 - ((F.col("x") - 15.5) ** 2 + (F.col("y") - 15.5) ** 2) / 2000)
    found = rectify.fisheye(px.images(spark, d).where("c = 0").withColumn("vignette", vignette), cameras, ["img"], ["gt", "vignette"], 14.0, 24)
    return found.select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("gt", 5).alias("value"), F.floor(F.round("vignette", 6)).cast("int").alias("vignette"), "mask", "row")


@query("@d as (select img, y, x, 1 + gt as z, (1+gt)*(x-15.5)/30 as wx, (1+gt)*(y-15.5)/30 as wy from px_img where c = 0), n as (select d.*, (ry.wx-ly.wx) as ax, (ry.wy-ly.wy) as ay, (ry.z-ly.z) as az, (rx.wx-lx.wx) as bx, (rx.wy-lx.wy) as by_, (rx.z-lx.z) as bz from d left join d rx on rx.img=d.img and rx.y=d.y and rx.x=d.x+1 left join d lx on lx.img=d.img and lx.y=d.y and lx.x=d.x-1 left join d ry on ry.img=d.img and ry.x=d.x and ry.y=d.y+1 left join d ly on ly.img=d.img and ly.x=d.x and ly.y=d.y-1), c as (select img, y, x, ay*bz-az*by_ as nx, az*bx-ax*bz as ny, ax*by_-ay*bx as nz from n) select img, y, x, coalesce(round(nx/sqrt(nx*nx+ny*ny+nz*nz), 5), 0) + 0.0 as nx, coalesce(round(ny/sqrt(nx*nx+ny*ny+nz*nz), 5), 0) + 0.0 as ny, coalesce(round(nz/sqrt(nx*nx+ny*ny+nz*nz), 5), 0) + 0.0 as nz from c", "px_img")
def P24_W11_depth_to_normal(spark, d):
    z = 1 + gt()
    p = px.images(spark, d).where("c = 0").select("img", "y", "x", (z * (F.col("x") - 15.5) / 30).alias("wx"), (z * (F.col("y") - 15.5) / 30).alias("wy"), z.alias("wz"))
    return metrics.surface_normals(p, ["img"]).select("img", "y", "x", *(r(F.col(k), 5).alias(k) for k in ("nx", "ny", "nz")))


@query("@q as (select p_partkey as id, p_partkey // 100 as img, (p_partkey % 310)/10.0::double as u, (p_size % 31)*1.0::double + 0.25 as v from part), f as (select *, floor(u)::bigint as x0, floor(v)::bigint as y0, u - floor(u) as a, v - floor(v) as b from q), k as (select id, img, x0 + dx as x, y0 + dy as y, (case when dx=1 then a else 1-a end)*(case when dy=1 then b else 1-b end) as w from f, range(2) s(dx), range(2) t(dy)) select id, round(sum(w*gt), 6) as depth from k join px_img i on i.img = k.img and i.c = 0 and i.x = k.x and i.y = k.y group by id", "px_img")
def J23_bilinear(spark, d):
    """A depth at a place of each part's own image."""
    p = spark.read.parquet(f"{d}/part.parquet")
    u, v = (F.col("p_partkey") % 310) / 10.0, (F.col("p_size") % 31) * 1.0 + 0.25
    q = p.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 100).alias("img"), F.floor(u).alias("x0"), F.floor(v).alias("y0"), (u - F.floor(u)).alias("a"), (v - F.floor(v)).alias("b"))
    corner = lambda i, j: F.struct((F.col("x0") + i).alias("x"), (F.col("y0") + j).alias("y"), ((F.col("a") if i else 1 - F.col("a")) * (F.col("b") if j else 1 - F.col("b"))).alias("w"))
    k = q.select("id", "img", F.inline(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))))
    raster = px.images(spark, d).where("c = 0").select("img", "x", "y", "gt")
    return k.join(spatial.many(raster), ["img", "x", "y"]).groupBy("id").agg(F.round(F.sum(F.col("w") * gt()), 6).alias("depth"))


@query("select img // 4 as frame, c, y, x, img % 4 as rs, round(pred, 6) as v from px_img where img % 4 = round_even(y/31.0*3, 0)::bigint", "px_img")
def J22_P31_shutter_gather(spark, d):
    """Of a frame's four samples, each pixel comes from the one that its row was read out in."""
    sample = F.col("img") % 4
    rows = px.images(spark, d).where(sample == F.rint(F.col("y") / 31.0 * 3).cast("long"))
    return rows.select(F.floor(F.col("img") / 4).alias("frame"), "c", "y", "x", sample.alias("rs"), F.round(pred(), 6).alias("v"))


@query("select img // 2 as rs, c, y, x, round(avg(pred), 7) as v from px_img group by 1, 2, 3, 4", "px_img")
def A33_W07_exposure_mean(spark, d):
    return px.images(spark, d).groupBy(F.floor(F.col("img") / 2).alias("rs"), "c", "y", "x").agg(F.round(F.avg("pred"), 7).alias("v"))


@query("@m as (select i.img, y, x, case when (x*y + img) % 50 = 7 then 0 else 1 end as mask from (select distinct img from px_img) i, range(32) a(y), range(48) b(x)), e as (select a.img, a.y, a.x, min(b.mask) as mask from m a join m b on a.img=b.img and abs(a.y-b.y) <= 2 and abs(a.x-b.x) <= 2 group by all), t as (select img, y, x, (x + 0.5)*48/32 - 0.5 as fx from (select distinct img, y from e) q, range(32) b(x)), k as (select img, y, x, greatest(0, least(47, floor(fx) + o)) as sx, case when o = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end as w from t, range(2) r(o)) select k.img, k.y, k.x, (sum(w*e.mask) > 0.5)::int as mask from k join e on e.img = k.img and e.y = k.y and e.x = k.sx group by all", "px_img")
def K12_mask_erosion(spark, d):
    """Masks of 48 x 32 pixels, eroded and resampled to squares of their height."""
    n = F.col("n")
    cells = px.image_ids(spark, d).select("img", F.explode(F.sequence(F.lit(0), F.lit(32 * 48 - 1))).alias("n")).select("img", F.floor(n / 48).cast("int").alias("y"), (n % 48).cast("int").alias("x"))
    rows = cells.withColumn("mask", F.when((F.col("x") * F.col("y") + F.col("img")) % 50 == 7, 0).otherwise(1))
    return metrics.squared_mask(metrics.eroded(rows, ["img"]), ["img"], 48, 32)


TRUTH = "truth as (select 'frame_' || (p_partkey // 100) || '.png' as name, p_partkey as nth, p_size*1.0::double as value from part)"


@query(f"@{TRUTH}, last as (select name, arg_max(value, nth) as value from truth group by name), runs as (select img, 'frame_' || img || '.png' as name, avg(pred) as pred from px_img group by img) select img, name, round(pred, 6) as mean_pred, value as truth from runs join last using (name)", "px_img")
def J15_join_by_basename(spark, d):
    """Predictions by the last part of their path; of several truths of one name the last one counts."""
    path = F.concat(F.lit("/runs/"), "img", F.lit("/frame_"), "img", F.lit(".png"))
    runs = px.images(spark, d).groupBy("img").agg(F.avg("pred").alias("pred")).withColumn("name", F.substring_index(path, "/", -1))
    part = spark.read.parquet(f"{d}/part.parquet")
    truth = part.select(F.concat(F.lit("frame_"), F.floor(F.col("p_partkey") / 100), F.lit(".png")).alias("name"), F.col("p_partkey").alias("nth"), F.col("p_size").cast("double").alias("value"))
    return metrics.matched(runs, truth, "name", "nth").select("img", "name", F.round("pred", 6).alias("mean_pred"), F.col("truth.value").alias("truth"))


LUMA = "l as (select img, y, x, max(mask) as mask, sum((pred-gt)*case c when 0 then 0.299 when 1 then 0.587 else 0.114 end) as e from px_img group by all)"


@query(f"@{LUMA}, w as (select i, j, [[-1,-2,0,2,1],[-2,-4,0,4,2],[-3,-6,0,6,3],[-2,-4,0,4,2],[-1,-2,0,2,1]][(i+1)::int][(j+1)::int] as wx, [[-1,-2,0,2,1],[-2,-4,0,4,2],[-3,-6,0,6,3],[-2,-4,0,4,2],[-1,-2,0,2,1]][(j+1)::int][(i+1)::int] as wy from range(5) a(i), range(5) b(j)), g as (select l.img, l.y, l.x, l.mask, sum(n.e*wx) as gx, sum(n.e*wy) as gy from l, w join l n on n.img = l.img and n.y = l.y + w.i - 2 and n.x = l.x + w.j - 2 group by all) select img, round(sum((abs(gx)+abs(gy))*mask)/sum(mask), 5) as l1 from g group by img", "px_img")
def A22_gradient_l1(spark, d):
    weight = F.when(F.col("c") == 0, 0.299).when(F.col("c") == 1, 0.587).otherwise(0.114)
    rows = px.images(spark, d).groupBy("img", "y", "x").agg(F.max("mask").alias("mask"), F.sum(err() * weight).alias("e"))
    return metrics.gradient_l1(rows, ["img"], "e").select("img", F.round("l1", 5).alias("l1"))

"""Neighbours, cells and components in space. Points meet by equality of grid cells, never as all pairs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import neighbours


def shared(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); only on one machine, a local one stands in."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/wayfold"
    return root


#: Tables to be deleted at the end of each part that is open, the innermost last.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())
#: Whether shuffle files go when a query of the session has run.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, label: str = "space", beyond: bool = False) -> DataFrame:
    """Write to the shared folder and read back; cuts the lineage. In a part under :func:`passing` the table goes with it, with ``beyond`` only with the part around it."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{label}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if len(parts := _PASSING.get()) > beyond:
        parts[-1 - beyond].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A part of a job: at its end the tables that it kept go, and shuffle files go as soon as a query of it has run."""
    held: list[str] = []
    before, token = spark.conf.get(_CLEAN, None), _PASSING.set((*_PASSING.get(), held))
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        _PASSING.reset(token)
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
        for name in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def many(df: DataFrame) -> DataFrame:
    """``df`` for a join in which it is never sent whole: rows made by explode count as one each for the planner, which would send any number through the driver."""
    return df.hint("merge")


def cell(x: Column, size: Column | float) -> Column:
    return F.floor(x / size)


def nearest(left: DataFrame, right: DataFrame, axes: list[str], k: int = 1, digits: int | None = None, apart: bool = False) -> DataFrame:
    """(id, nn, d2, rank): the ``k`` nearest of ``right`` for each row of ``left`` (id and axes); ties to the lower id.

    ``digits`` rounds squared distances before ties are decided; ``apart`` leaves out the row of the same id. To ask the same rows
    again and again, build a ``neighbours.Index`` once.
    """
    return neighbours.Index(right, neighbours.Points(axes), same=k + apart).nearest(left, k, digits=digits, apart=apart).select("id", "nn", "d2", "rank")


def grid_extremes(cells: DataFrame, value: str, by: int, border: float) -> DataFrame:
    """(i, j, least, most, n): the least and greatest ``value`` within ``by`` cells, and how many there are; absent cells count as ``border``."""
    steps = range(-by, by + 1)
    sent = cells.select(value, F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in steps for b in steps))).alias("c"))
    found = sent.groupBy("c.i", "c.j").agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n")).join(cells.select("i", "j"), ["i", "j"])
    beyond = F.when(F.col("n") < len(steps) ** 2, border)
    return found.select("i", "j", F.least("least", beyond).alias("least"), F.greatest("most", beyond).alias("most"), "n")


def dilated(cells: DataFrame, times: int) -> DataFrame:
    """The cells (i, j) and all that touch them, again and again."""
    out = cells
    for _ in range(times):
        out = out.select(F.inline(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1))))).distinct()
    return out


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of every node: the least id it reaches over ``edges`` (a, b).

    Labels spread along edges and jump to the label of their label, so rounds grow with the logarithm of a path.
    """
    both = keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        spread = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = spread.alias("s").join(spread.alias("t"), F.col("s.component") == F.col("t.id")).select("s.id", F.col("t.component").alias("component"))
        new = keep(jump)
        changed = new.alias("n").join(labels.alias("l"), "id").where("n.component <> l.component").limit(1).count()
        labels = new
        if not changed:
            return labels


def ray_down(rays: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """(id, z): the highest triangle point under each ray (id, x, y, top), straight down; rays that miss are absent.

    ``triangles`` has ax..cz. Triangles are put into every cell their bounds touch.
    """
    low = lambda c: cell(F.least(*(F.col(v + c) for v in "abc")), size)
    high = lambda c: cell(F.greatest(*(F.col(v + c) for v in "abc")), size)
    spread = triangles.withColumn("i", F.explode(F.sequence(low("x"), high("x")))).withColumn("j", F.explode(F.sequence(low("y"), high("y"))))
    asked = rays.select("id", "x", "y", "top", cell(F.col("x"), size).alias("i"), cell(F.col("y"), size).alias("j"))
    both = asked.join(spread, ["i", "j"])
    c = F.col
    det = (c("by") - c("cy")) * (c("ax") - c("cx")) + (c("cx") - c("bx")) * (c("ay") - c("cy"))
    u = ((c("by") - c("cy")) * (c("x") - c("cx")) + (c("cx") - c("bx")) * (c("y") - c("cy"))) / det
    v = ((c("cy") - c("ay")) * (c("x") - c("cx")) + (c("ax") - c("cx")) * (c("y") - c("cy"))) / det
    hit = both.where(det != 0).select("id", "top", u.alias("u"), v.alias("v"), "az", "bz", "cz")
    hit = hit.where((c("u") >= -1e-9) & (c("v") >= -1e-9) & (c("u") + c("v") <= 1 + 1e-9)).withColumn("z", c("u") * c("az") + c("v") * c("bz") + (1 - c("u") - c("v")) * c("cz"))
    return hit.where(c("z") <= c("top")).groupBy("id").agg(F.max("z").alias("z"))


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the total order of ``order``, by offsets of sorted ranges, not in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row for each range
    within = Window.partitionBy("_part").orderBy(*order)
    return ranged.withColumn("_rn", F.row_number().over(within)).join(F.broadcast(first), "_part").select(*df.columns, (F.col("_first") + F.col("_rn") - 1).alias(name))


def offsets(df: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """(key, name): the sum of ``n`` over all lower keys, by sums of sorted ranges, not in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(df.select(key, n).repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    first = ranged.groupBy("_part").agg(F.sum(n).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row for each range
    own = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_own", own).join(F.broadcast(first), "_part").select(key, (F.col("_first") + F.col("_own")).alias(name))

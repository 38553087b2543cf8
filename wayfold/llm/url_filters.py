"""Temporal list join: which dated list entries were active when each capture was fetched.

List entries are dated changes (``add`` or ``remove``) of a pattern. They become validity
intervals, from an addition to the next removal. Every capture is looked up under its URL, its host and all
parent domains; an interval applies when ``valid_from <= fetched_at < valid_to``.

Only patterns that some list has go on from a capture. Time is cut into buckets: captures
and intervals meet by equality on (pattern, bucket) before their times are compared, and an open interval is
continued into a bucket only if a capture of its pattern asks there, so neither a long history nor a
wrong year among the captures makes rows. A frequent pattern's captures are counted first and dealt over as many
copies of its intervals as they need; rows of one host never meet in one task.

Patterns: ``url:<url without fragment>``, ``host:<host>`` (that host only), ``domain:<domain>``
(the domain and everything below it), in lower case.

Cases: several changes of a pattern at one moment count as ``add`` if any adds. A repeated
addition or a removal of what is not listed changes nothing. Entries with a null field or an unknown action are
ignored. A capture without url or time, or whose url has no host, matches nothing (except
``url:`` entries) and is returned as not blocked. Repeated captures are all returned.
Other columns are ignored; empty tables give no matches or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)"


def host(url: Column) -> Column:
    """The host in lower case, or null."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def patterns(url: Column, name: Column) -> Column:
    """All patterns that a capture can match."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n), ".")))
    whole = F.array(F.concat(F.lit("url:"), F.lower(F.regexp_replace(url, "#.*$", ""))))
    by_host = F.when(name.isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), name)), domains)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(whole, by_host), lambda p: p.isNotNull()))


def intervals(entries: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(list, pattern, bucket, valid_from, valid_to) within one bucket each, for the (pattern, bucket) of ``asked`` alone."""
    keys = ["list", "pattern"]
    changes = (
        entries.where(F.col("action").isin("add", "remove"))
        .dropna(subset=["list", "pattern", "at"])
        .groupBy("list", F.lower("pattern").alias("pattern"), F.col("at").cast("long").alias("at"))
        .agg(F.max(F.col("action") == "add").alias("on"))
        .withColumn("bucket", F.floor(F.col("at") / width))
    )
    by_time = Window.partitionBy(*keys, "bucket").orderBy("at")
    inside = changes.select(*keys, "bucket", "on", F.col("at").alias("valid_from"), F.coalesce(F.lead("at").over(by_time), (F.col("bucket") + 1) * width).alias("valid_to"))
    inside = inside.where("on").drop("on").join(asked, ["pattern", "bucket"], "left_semi")
    # the state at the beginning of an asked bucket is that after the last bucket with changes before it
    ends = changes.groupBy(*keys, "bucket").agg(F.max_by("on", "at").alias("on"), F.min("at").alias("begins"))
    lines = ends.select(*keys).distinct().join(asked, "pattern").select(*keys, "bucket", F.lit(None).cast("boolean").alias("on"), F.lit(None).cast("long").alias("begins"), F.lit(True).alias("asked"))
    rows = ends.withColumn("asked", F.lit(False)).unionByName(lines).groupBy(*keys, "bucket").agg(F.max("on").alias("on"), F.min("begins").alias("begins"), F.max("asked").alias("asked"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.withColumn("held", F.last("on", True).over(before)).where(F.col("asked") & F.col("held"))
    start, end = F.col("bucket") * width, (F.col("bucket") + 1) * width
    carried = carried.select(*keys, "bucket", start.alias("valid_from"), F.coalesce("begins", end).alias("valid_to"))
    return inside.select(*carried.columns).unionAll(carried).where(F.col("valid_from") < F.col("valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame, width: int = 30 * 86400, share: int = 100_000) -> DataFrame:
    """capture_id, url, fetched_at, host, n_entries, lists, blocked for each row of ``captures``.

    ``captures`` has capture_id, url and fetched_at, ``entries`` has list, pattern, action and at;
    times are seconds. ``share``: captures of one pattern and bucket that meet a copy of its intervals, about.
    """
    own = ["capture_id", "url", "fetched_at", "host"]
    rows = captures.groupBy("capture_id", "url", F.col("fetched_at").cast("long").alias("fetched_at")).agg(F.count("*").alias("copies")).withColumn("host", host(F.col("url")))
    listed = entries.select(F.lower("pattern").alias("pattern")).where("pattern IS NOT NULL").distinct()
    looked = rows.select(*own, F.explode(patterns(F.col("url"), F.col("host"))).alias("pattern"), F.floor(F.col("fetched_at") / width).alias("bucket")).where("bucket IS NOT NULL")
    looked = looked.join(listed, "pattern", "left_semi")
    asked = looked.groupBy("pattern", "bucket").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    valid = intervals(entries, asked.select("pattern", "bucket"), width).join(asked, ["pattern", "bucket"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = looked.join(asked, ["pattern", "bucket"]).withColumn("salt", F.pmod(F.xxhash64(*own), F.col("salts")).cast("int"))
    active = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("fetched_at") < F.col("valid_to"))
    hit = dealt.drop("salts").join(valid.drop("salts"), ["pattern", "bucket", "salt"]).where(active)
    both = rows.select(*own, "copies", F.lit(None).cast("string").alias("list")).unionAll(hit.select(*own, F.lit(0).cast("long").alias("copies"), "list"))
    found = both.groupBy(*own).agg(F.sum("copies").alias("copies"), F.count("list").alias("n_entries"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*own, "n_entries", "lists", (F.col("n_entries") > 0).alias("blocked"))

"""Extendible hashing of rows into shards of at most a given number of bytes.

A row's key is hashed to 60 bits. The directory is addressed by leading bits: it starts as one
bucket, and only buckets over the limit split on their next bit, so a shard is the shortest
prefix whose rows fit. Byte sums are taken once at a depth a little below the expected one and
rolled up to every shorter prefix, some levels at a time; only buckets that are still too large there go on with more
bits. Rows are never gathered: sums are pre-aggregated, and the directory is a table.

Cases: a row over the limit is a shard of its own (its ``overflow`` is ``"row"``). Rows of one
hash that do not fit together (repeated rows, a hot key) are dealt into pages by running byte
sums within each input partition (``overflow`` is ``"page"``). A null key counts as the empty
text, null text has 0 bytes. Columns with other names are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._shared import keep

BITS = 60
LEVELS = 6  #: of the directory that are summed from one level's sums


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _split(cells: DataFrame, root: int, depth: int, limit: int) -> DataFrame:
    """(cell, leaf): the first depth at which the cell's prefix fits; null where none does.

    Sums are rolled up ``LEVELS`` levels at a time: the shorter prefixes start from the sums of the last level.
    """
    low = max(root, depth - LEVELS)
    shorter = lambda d: F.call_function("shiftright", F.col("cell"), (F.lit(depth) - d).cast("int"))
    nodes = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"))
    nodes = nodes.select("cell", "bytes", "depth", shorter(F.col("depth")).alias("prefix"))
    fits = nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("depth", "prefix")
    found = nodes.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("leaf"))
    out = cells.join(found, "cell", "left").select("cell", "leaf")
    if low == root:
        return out
    coarse = cells.groupBy(shorter(F.lit(low)).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    above = _split(coarse, root, low, limit).select(F.col("cell").alias("top"), F.col("leaf").alias("higher"))
    return out.join(above, shorter(F.lit(low)) == F.col("top")).select("cell", F.coalesce("higher", "leaf").alias("leaf"))


def shard(rows: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """(key, bytes, shard, depth, overflow) for every row; shard is unique across the result."""
    sized = keep(
        rows.select(F.col(key).alias("key"), key_hash(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")),
        "sized",
    )
    big = sized.where(F.col("bytes") > limit)
    out = big.select("key", "bytes", F.concat(F.lit("row-"), "nth").alias("shard"), F.lit(BITS).alias("depth"), F.lit("row").alias("overflow"))
    rest = sized.where(F.col("bytes") <= limit)
    total = rest.agg(F.sum("bytes")).first()[0] or 0
    root, depth = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 2))
    while True:
        cells = rest.groupBy(prefix(F.col("h"), F.lit(depth)).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        leaves = keep(_split(cells, root, depth, limit), "leaves")
        dealt = rest.withColumn("cell", prefix(F.col("h"), F.lit(depth))).join(leaves, "cell")
        here = dealt.where(F.col("leaf").isNotNull())
        bits = F.when(F.col("leaf") == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix(F.col("h"), F.col("leaf"))), F.col("leaf"), F.lit("0")))
        out = out.unionAll(here.select("key", "bytes", bits.alias("shard"), F.col("leaf").cast("int").alias("depth"), F.lit("").alias("overflow")))
        if leaves.where(F.col("leaf").isNull()).limit(1).count() == 0:
            return out
        rest = dealt.where(F.col("leaf").isNull()).select(*rest.columns)
        if depth == BITS:
            return out.unionAll(_pages(rest, limit))
        root, depth = depth + 1, min(BITS, depth + 12)


def _pages(rest: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash, dealt into pages: half a limit of running bytes, so that a page's last row fits."""
    half = max(1, limit // 2)
    rest = rest.withColumn("small", F.when(F.col("bytes") <= half, F.col("bytes")).otherwise(F.lit(0)))
    parts = rest.groupBy("h", "part").agg(F.sum("small").alias("small"))
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("h", "part", F.coalesce(F.sum("small").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("h", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("small").over(within), F.lit(0))
    page = F.when(F.col("bytes") > half, F.concat(F.lit("row-"), "nth")).otherwise(F.concat(F.lit("page-"), F.floor(start / half)))
    name = F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lit("-"), page)
    return rest.join(parts, ["h", "part"]).select("key", "bytes", name.alias("shard"), F.lit(BITS).alias("depth"), F.lit("page").alias("overflow"))

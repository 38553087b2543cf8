"""One-permutation MinHash fingerprints, in DataFrame expressions only.

A text's five-word shingles are hashed once. The top seven bits of a hash choose one of 128
bins, and each bin keeps its least hash. An empty bin takes over the bin that comes first in
its own random order of all bins (optimal densification): of the bins that are not empty, the one with
the least hash of the two bin numbers. Of every bin the low eight bits are stored; likeness corrects the
share of equal bins for the 1/256 that agree by chance.

Cases: null text counts as empty. Without words the fingerprint is all zeros and alike only to
another such one; with fewer than five words the whole sequence is the one shingle. Case is
ignored. Equal texts have equal fingerprints. Rows without an id come after all others, repeated ids and rows one after
another (see :func:`with_next`); an only row is its own next one. Texts of any length are read whole, other columns ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._shared import parts

BINS, SHIFT, WORDS = 128, 57, 5
NULL_BITS = 6  #: of the text's hash that deal rows without an id
CHANCE = 1 / 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the five-word shingles; empty without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        long = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < WORDS, F.array(F.xxhash64(h))).otherwise(long)

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def fingerprint(text: Column) -> Column:
    """128 low-order bytes, each less 128 (as tinyint); an empty array without words."""

    def firsts(s: Column) -> Column:
        here = lambda x: F.shiftright(x, SHIFT)
        return F.filter(s, lambda x, i: (i == 0) | (here(x) != here(F.get(s, i - 1))))

    def dense(least: Column) -> Column:
        def fill(bins: Column) -> Column:
            def one(b: Column) -> Column:
                other = F.array_min(F.transform(least, lambda e: F.xxhash64(b, F.shiftright(e, SHIFT)).bitwiseAND(F.lit(-256)).bitwiseOR(e.bitwiseAND(F.lit(255)))))
                own = F.call_function("array_position", bins, b)
                return F.when(own > 0, F.get(least, (own - 1).cast("int"))).otherwise(other)

            every = F.sequence(F.lit(-BINS // 2).cast("long"), F.lit(BINS // 2 - 1).cast("long"))
            return F.transform(every, lambda b: (one(b).bitwiseAND(F.lit(255)) - 128).cast("tinyint"))

        return F.when(F.size(least) == 0, F.array().cast("array<tinyint>")).otherwise(let(F.transform(least, lambda e: F.shiftright(e, SHIFT)), fill))

    return let(let(F.sort_array(shingle_hashes(text)), firsts), dense)


def packed(print_: Column) -> Column:
    """The fingerprint as 256 hexadecimal digits."""
    digits = F.array_join(F.transform(print_, lambda v: F.lpad(F.lower(F.hex(v.cast("int") + 128)), 2, "0")), "")
    return F.when(F.size(print_) == 0, F.lit("0" * (2 * BINS))).otherwise(digits)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the two shingle sets, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / BINS
    better = F.greatest(F.lit(0.0), (same - CHANCE) / (1 - CHANCE))
    none = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(none == 2, 1.0).when(none == 1, 0.0).otherwise(better)


def _bucket(doc_id: Column, tops: Column, lists: Column) -> Column:
    """How many of the sorted bounds are at most the id, looked up in two levels: the lists' first bounds, then one list."""

    def inner(k: Column) -> Column:
        before = F.aggregate(F.slice(F.transform(lists, lambda x: F.size(x)), 1, F.greatest(k - 1, F.lit(0))), F.lit(0), lambda a, x: a + x)
        return F.when(k == 0, 0).otherwise(before + F.size(F.filter(F.get(lists, k - 1), lambda x: x <= doc_id)))

    return let(F.size(F.filter(tops, lambda x: x <= doc_id)), inner)


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it by descending doc_id; the first comes after the last.

    Ids are cut into ranges of about equal counts; each range is a window of its own, and the
    first row of a range is copied to the end of the range before it. The ranges' bounds are a table of one row. Equal ids, and the
    rows without an id, which come last, follow the hash of their text and their text; rows without an id are cut into ranges by that hash.
    """
    n = 4 * parts(docs.sparkSession)
    ask = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / n) for i in range(1, n))), 10 * n).alias("q"))
    step = max(1, int(n**0.5))
    bounds = ask.select(F.array_sort(F.array_distinct(F.coalesce("q", F.array().cast("array<bigint>")))).alias("_q"))
    count = F.ceil(F.size("_q") / step).cast("int")
    lists = F.when(F.size("_q") > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice("_q", i * step + 1, step))).otherwise(F.array().cast("array<array<bigint>>"))
    bounds = bounds.select(lists.alias("_lists")).select("_lists", F.transform("_lists", lambda x: F.get(x, F.lit(0))).alias("_tops"))
    hashed = docs.join(F.broadcast(bounds)).withColumn("_hash", F.xxhash64("text"))  # one row
    none = -1 - F.shiftrightunsigned("_hash", 64 - NULL_BITS)
    ranged = hashed.withColumn("_range", F.when(F.col("doc_id").isNull(), none).otherwise(_bucket(F.col("doc_id"), F.col("_tops"), F.col("_lists"))).cast("long")).drop("_tops", "_lists")
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", (-F.shiftrightunsigned("_hash", 1)).alias("hash"))  # descending, so the greatest is first; no text, it is broadcast
    heads = ranged.groupBy("_range").agg(F.max(place).alias("_head"))  # a row for each range
    by_range = Window.orderBy("_range")
    goes = heads.select(F.col("_range").alias("_from"), F.col("_head"), F.lead("_range").over(by_range).alias("_up"), F.min("_range").over(by_range).alias("_low"))
    goes = goes.select("_from", "_head", F.coalesce("_up", "_low").alias("_to"))
    marked = ranged.withColumn("_place", place).join(F.broadcast(goes), (F.col("_range") == F.col("_from")) & F.col("_place").eqNullSafe(F.col("_head")), "left")
    own = F.struct(F.col("_range").alias("at"), F.lit(0).alias("ghost"))
    copies = F.when(F.col("_from").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("at"), F.lit(1).alias("ghost"))))
    rows = marked.withColumn("_copy", F.explode(copies))
    order = Window.partitionBy(F.col("_copy.at")).orderBy(F.col("_copy.ghost"), F.col("_place.doc_id").desc_nulls_last(), F.col("_place.hash").desc(), F.desc("text"))
    out = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where(F.col("_copy.ghost") == 0)
    return out.select(*docs.columns, *(f"next_{c}" for c in columns))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the next one's beginning."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(base.withColumn("print", fingerprint(F.col("text"))), "text", "print")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = both.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", "print", "next_print", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("print")).alias("fingerprint"), packed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )

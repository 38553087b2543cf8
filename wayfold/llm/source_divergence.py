"""Divergence of the sources of each language, exact to the last unit, by inclusion and exclusion over supports.

A language keeps the terms that at least ``least`` of its documents hold. With c occurrences of a kept term in a group
(all documents of a source in a language), N occurrences of all kept terms and V kept terms, the term's share is
p = 1 + floor(10^9 (c + 1) / (N + V)), and two shares differ by f(p, q) = floor((p - q)^2 / q). ``audit`` sums f over all kept terms for
each two sources of a language, and names the terms that a source has more of than its language.

The sum over all terms never meets a term that neither source has: with g and h for the shares of absent terms,

    sum f = sum over one's terms f(p, h)  +  sum over the other's terms f(g, q)  +  (V - both sizes) f(g, h)
            + sum over shared terms  f(p, q) - f(p, h) - f(g, q) + f(g, h)

The first two need a histogram of counts of each group, the third is a constant, and only the last reads postings: each
term's list of (source, share), in which pairs of sources are made and summed within a batch.

Tasks count terms by source before anything is shuffled, so a source with a third of all rows costs what it reads. A
term's list has a row for each source at most. Pairs of a list are made in blocks of ``PAIRS``.

Cases: null text, language and source count as ''. Groups whose documents hold no kept term, or no term at all, take part with
counts of zero; a language without kept terms gives pairs of value 0. Repeated documents count each time, ids
are not read, extra columns are ignored, an empty table gives an empty result. Ties are ranked by the item's UTF-8 bytes.
A very long text takes the memory of its distinct terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._shared import ARROW_ROWS, keep, parts, released, small_batches

#: Counts that a task holds before it hands them on, and pairs of sources made at once.
HELD, PAIRS = 400_000, 1 << 20
UNIT = 10**9

#: Bytes of terms, with A-Z as a-z; all others are spaces.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM).split()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within tasks; a term has several rows."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        holds: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in uses.items():
                found, docs = list(n), holds[lang, source]
                for lo in range(0, len(found), 1 << 14):
                    some = found[lo : lo + (1 << 14)]
                    columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)
            uses.clear()
            holds.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, n = Counter(terms(text)), uses[lang, source]
                held -= len(n)
                n.update(own)
                held += len(n)
                holds[lang, source].update(own.keys())
                if held > HELD:
                    yield from handed()
                    held = 0
        yield from handed()
        released()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*text, "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 1) / total), exact for any counts."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(first) else value


def overlaps(lists: DataFrame) -> DataFrame:
    """(lang, source, item, value): what pairs of sources that share terms add, summed by batch.

    ``lists`` has a row for each term: lang, and posts of (source, p, none), none the share of absent terms.
    """
    names = ["lang", "source", "item", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posts = batch.column(1)
            first = posts.offsets.to_numpy().astype(np.int64)
            flat = posts.values
            langs, sources = batch.column(0).dictionary_encode(), flat.field("source").dictionary_encode()
            lang, code = langs.indices.to_numpy(), sources.indices.to_numpy().astype(np.int64)
            p, none = (flat.field(c).to_numpy().astype(np.int64) for c in ("p", "none"))
            width = len(sources.dictionary)
            size = np.diff(first)
            # a row for each post, which meets all posts of its term
            at = np.arange(first[0], first[-1])
            term = np.repeat(np.arange(len(size)), size)
            made = np.cumsum(size[term])
            lo, found = 0, []
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(made, (made[lo - 1] if lo else 0) + PAIRS, "right")))
                n = size[term[lo:hi]]
                a = np.repeat(at[lo:hi], n)
                b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[term[lo:hi]], n)
                a, b = a[a != b], b[a != b]
                value = _differ(p[a], p[b]) - _differ(p[a], none[b]) - _differ(none[a], p[b]) + _differ(none[a], none[b])
                of = np.repeat(term[lo:hi], n - 1)
                found.append(_summed((lang[of].astype(np.int64) * width + code[a]) * width + code[b], value))
                lo = hi
            if found:
                key, value = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
                columns = [langs.dictionary.take(pa.array(key // width // width)), sources.dictionary.take(pa.array(key // width % width)), sources.dictionary.take(pa.array(key % width)), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return lists.mapInArrow(run, "lang string, source string, item string, value long")


#: Terms whose lists are one Arrow batch.
LISTS = 4096


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,0)"))


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: every other source ('pair'), and the ``top`` terms over the language's share ('term')."""
    spark = docs.sparkSession
    found = counts(docs).repartition(parts(spark), "lang", "term")  # both groupings below stay where this puts them
    by_source = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts"))
    kept = keep(by_term.where(F.col("docs") >= least).drop("docs"), "terms")
    flat = kept.select("lang", "term", "total", F.inline("posts"))

    uses = keep(flat.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "histograms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("of_lang"))
    sizes = uses.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("of_group"), F.sum("terms").alias("has"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = keep(groups.select("lang", "source", zero("v"), zero("of_lang"), zero("of_group"), zero("has")).withColumn("none", share(F.lit(0), F.col("of_group") + F.col("v"))), "groups")

    p = share(F.col("n"), F.col("of_group") + F.col("v")).alias("p")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("of_item"))
    one_sided = (
        uses.join(groups, ["lang", "source"]).select("lang", "source", "terms", p).join(other, "lang").where("source <> item")
        .groupBy("lang", "source", "item")
        .agg(_exact(F.col("terms") * differ(F.col("p"), F.col("of_item"))).alias("to"), _exact(F.col("terms") * differ(F.col("of_item"), F.col("p"))).alias("from"))
    )
    priced = flat.join(groups, ["lang", "source"]).select("lang", "term", "source", p, "none", share(F.col("total"), F.col("of_lang") + F.col("v")).alias("q"))
    lists = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("posts")).where(F.size("posts") > 1).select("lang", "posts")
    shared = keep(overlaps(lists).groupBy("lang", "source", "item").agg(_exact(F.col("value")).alias("value")), "overlaps", LISTS)

    pairs = groups.join(other.join(groups.select("lang", F.col("source").alias("item"), F.col("has").alias("item_has")), ["lang", "item"]), "lang").where("source <> item")
    absent = F.when(F.col("v") > 0, (F.col("v") - F.col("has") - F.col("item_has")) * differ(F.col("none"), F.col("of_item")))
    terms = [
        pairs.select("lang", "source", "item", F.coalesce(absent, F.lit(0)).cast("decimal(38,0)").alias("value")),
        one_sided.select("lang", "source", "item", F.col("to").alias("value")),
        one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("from").alias("value")),
        shared.select("lang", "source", "item", "value"),
    ]
    total = terms[0].unionAll(terms[1]).unionAll(terms[2]).unionAll(terms[3]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    over = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(total, "pair").unionAll(ranked(over, "term").where(F.col("rank") <= top))

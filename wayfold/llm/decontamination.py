"""Benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment of words.

The benchmark is read in blocks of bounded bytes; each block is held by every task while all
documents stream by, so texts are never shuffled. All usual benchmarks together are one block. A pair is two words with at most one between them.

No passage at the threshold is lost. Let an alignment of an item of n words have m matches and e errors
(mismatches and gaps), so its score is 2m - e. Of its m - 1 steps from a match to the next, one without an error
or with one error is a pair in both texts, that begins at an own place of the item; the others have two errors or
more. So a score of s needs pairs at (s - 2) / 2 of the item's n - 1 places or more, and of any places, one
more than the others can miss, one has its pair in the passage. These places are the item's seeds: the ones
whose pairs the fewest documents hold, counted in a first pass. The counts choose among sufficient sets
of seeds, so they set the cost and not the result. A second pass joins documents to items on seeds, cuts the passage
that an alignment through the seed can cover at most, and aligns passage and item word by word. The score is
the alignment's, divided by that of an exact copy.

Cases: null and empty texts have no words. Items with fewer than three words are not searched,
null items are ignored, items of equal text are found alike, items with one id and different
texts count as one (the best score). Every row of documents is judged by itself: repeated documents, documents of one id
and documents without an id each get their rows. Ties go to the earlier passage. Texts of any length are aligned whole. Other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._shared import small_batches
from wayfold.llm._words import Words, mix, portions, words

MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.5  #: least share of an exact copy's score; above 1/3, so that the shortest item needs a pair
    block: int = 8 << 20  #: bytes of items in a block, about; each task holds one


@dataclass
class Block:
    """The items of a block: their words' hashes and their pairs."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray  #: sorted distinct pair hashes
    gram: np.ndarray  #: for each (item, place) its number in ``grams``, sorted by it
    item: np.ndarray
    place: np.ndarray


def pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's number of each two words of one text that have at most one word between them."""
    found = []
    for step in (1, 2):
        n = max(0, len(w.hash) - step)
        at = np.flatnonzero(w.text[:n] == w.text[step:])
        found.append((mix(w.hash[at] * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + step] * np.uint64(0xD6E8FEB86659FD93)), at))
    h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, at


def least_score(n: int, threshold: float) -> int:
    """The least score of an item of n words whose share reaches the threshold."""
    s = max(0, math.floor(threshold * MATCH * n) - 1)
    while s / (MATCH * n) < threshold:
        s += 1
    return s


def block_of(rows: list[tuple[int, str]]) -> Block:
    w = words([t.encode() for _, t in rows])
    h, at = pairs(w)
    item, place = w.text[at], at - w.first[w.text[at]]
    grams, number = np.unique(h, return_inverse=True)
    order = np.argsort(number, kind="stable")
    own = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(rows))]
    return Block([i for i, _ in rows], own, grams, number[order], item[order], place[order])


def _hits(w: Words, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word's number and number in ``grams`` of each pair that is there."""
    h, at = pairs(w)
    if not len(grams):
        return at[:0], at[:0]
    k = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
    hit = np.flatnonzero(grams[k] == h)
    return at[hit], k[hit]


def _document_counts(docs: DataFrame, block: Block) -> np.ndarray:
    grams = block.grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            for _, some in portions(batch.column(0).to_pylist()):
                w = words(some)
                at, k = _hits(w, grams)
                both = np.unique(w.text[at] * np.int64(len(grams)) + k)
                total += np.bincount(both % len(grams), minlength=len(grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    out = np.zeros(len(grams), np.int64)
    for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # the block's grams at most
        out[r["gram"]] = r["n"]
    return out


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each pair, with the first and the last aligned word of the passage.

    All pairs advance together, one item word at a time; a running maximum carries gaps along the passage.
    """
    n, wide, long = len(items), max(map(len, passages)), max(map(len, items))
    text, own = np.zeros((n, wide), np.uint64), np.ones((n, long), np.uint64)
    real, some = np.zeros((n, wide), bool), np.zeros((n, long), bool)
    for k, (a, b) in enumerate(zip(items, passages, strict=True)):
        own[k, : len(a)], some[k, : len(a)] = a, True
        text[k, : len(b)], real[k, : len(b)] = b, True
    # score and (negated) start in one number: the start of the earliest best path
    unit = np.int64(1) << 32
    slide = -GAP * unit * np.arange(wide)
    last = np.zeros((n, wide), np.int64)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fresh = unit - 1 - np.arange(wide, dtype=np.int64)
    for i in range(long):
        same = (text == own[:, i : i + 1]) & real & some[:, i : i + 1]
        corner = np.concatenate([np.zeros((n, 1), np.int64), last[:, :-1]], 1)
        step = np.where(corner >= unit, corner, fresh[None, :]) + np.where(same, MATCH, MISMATCH) * unit
        new = np.maximum(step, last + GAP * unit)
        new = np.maximum.accumulate(new + slide, 1) - slide
        new = np.where(real & some[:, i : i + 1] & (new >= unit), new, 0)
        at = new.argmax(1)
        top = new[np.arange(n), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
        last = new
    return best // unit, np.where(best > 0, unit - 1 - best % unit, 0), end


def _seeds(block: Block, counts: np.ndarray, least: np.ndarray) -> Block:
    """The block with the pairs of its items' seeds alone."""
    size = np.array([len(x) for x in block.words])
    first = np.concatenate([[0], np.cumsum(size)])
    cost = np.zeros(first[-1])
    np.add.at(cost, first[block.item] + block.place, counts[block.gram])
    chosen = np.zeros(len(cost), bool)
    for i in np.flatnonzero(size >= 3):
        places = size[i] - 1
        hit = (least[i] - 2 + 1) // 2  # places at least, of an alignment with the least score
        chosen[first[i] + np.argsort(cost[first[i] : first[i] + places], kind="stable")[: max(0, places - hit + 1)]] = True
    left = chosen[first[block.item] + block.place]
    used, gram = np.unique(block.gram[left], return_inverse=True)
    return Block(block.ids, block.words, block.grams[used], gram, block.item[left], block.place[left])


def _passages(w: Words, seeds: Block, least: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, end) of what alignments through the seeds can cover, those that begin close together in one."""
    at, k = _hits(w, seeds.grams)
    if not len(at):
        return []
    lo, hi = np.searchsorted(seeds.gram, k), np.searchsorted(seeds.gram, k, "right")
    each = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
    at = np.repeat(at, hi - lo)
    text, item, place = w.text[at], seeds.item[each], seeds.place[each]
    size = np.array([len(x) for x in seeds.words])[item]
    # every part of a best alignment before or after a match has a score above 0: at most two gaps for each word
    gaps = MATCH * size - least[item]
    lows = np.maximum(at - place - np.minimum(MATCH * place, gaps), w.first[text])
    highs = np.minimum(at - place + size + np.minimum(MATCH * (size - place), gaps), w.first[text + 1])
    near = lows // np.maximum(1, size // 4)
    order = np.lexsort((near, item, text))
    text, item, near, lows, highs = (x[order] for x in (text, item, near, lows, highs))
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (near[1:] != near[:-1])))
    columns = text[new], item[new], np.minimum.reduceat(lows, new), np.maximum.reduceat(highs, new)
    return list(zip(*(x.tolist() for x in columns), strict=True))


@dataclass
class Search:
    """What a task needs to find a block's items."""

    block: Block
    seeds: Block
    least: np.ndarray
    threshold: float

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, share, first word, last word) of the passages at the threshold."""
        block = self.block
        for first, some in portions(texts):
            w = words(some)
            spots = sorted(_passages(w, self.seeds, self.least), key=lambda s: s[3] - s[2])
            while spots:  # by width, so that few pairs of wide passages go together
                many = min(256, len(spots))
                while many > 1 and many * (spots[many - 1][3] - spots[many - 1][2]) > 1 << 19:
                    many //= 2
                part, spots = spots[:many], spots[many:]
                scores, starts, ends = align([block.words[j] for _, j, _, _ in part], [w.hash[a:b] for _, _, a, b in part])
                for (t, j, a, _), s, x, y in zip(part, scores.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    share = s / (MATCH * len(block.words[j]))
                    if share >= self.threshold:
                        base = a - int(w.first[t])
                        yield first + t, j, share, base + x, base + y


def _searches(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> list[Search]:
    """A search for each block of items; one pass over ``docs`` a block counts its pairs."""
    if settings.threshold <= 1 / 3:
        raise ValueError("threshold must be above 1/3")
    small_batches(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = math.ceil(size / settings.block), []
    for b in range(blocks):
        # by item and text, so that many texts of one id are dealt as well
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about settings.block bytes
        block = block_of([(r["item_id"], r["text"]) for r in rows])
        if len(block.grams):
            least = np.array([least_score(max(1, len(x)), settings.threshold) for x in block.words])
            out.append(Search(block, _seeds(block, _document_counts(docs, block), least), least, settings.threshold))
    return out


def _matches(docs: DataFrame, search: Search) -> DataFrame:
    names, own = ["row", "doc_id", "item_id", "score", "first_word", "last_word"], search.block.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [(row + t, ids[t], own[j], share, x, y) for t, j, share, x, y in search.found(batch.column(1).to_pylist())]
            row += len(batch)
            if found:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, "row long, doc_id long, item_id long, score double, first_word long, last_word long")


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): the best passage of each row of ``docs`` and item at the threshold."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = texts.sparkSession.createDataFrame([], "row long, doc_id long, item_id long, score double, first_word long, last_word long")
    for search in _searches(texts, benchmark, settings):
        out = out.unionAll(_matches(texts, search))
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"), -F.col("last_word")))
    return out.groupBy("row", "doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item. Each row is judged by its own text, whatever its id."""
    out, text = docs, docs.columns.index("text")
    for search in _searches(docs, benchmark, settings):

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[t for t, *_ in search.found(batch.column(text).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out

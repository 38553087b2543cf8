"""Brown class-based bigram model: exchange clustering of words, smoothed log probabilities.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)), over words and one end per text.

* Counts of all training words are a table (hash, count). Words with the highest counts (at
  most ``Settings.lexicon``, all words of one count together) are also held as arrays.
* Exchanged are *types*: the end, the most frequent words one by one (at most
  ``Settings.types``), and for all others one type for each hash of their last four bytes, so the map has a fixed size.
* Each of the other words then gets a class of its own neighbours: the class in which the classes before and after
  all its uses are likeliest, by the transitions between words clustered one by one. Neighbours that are
  themselves such words count by the class of their ending. All words' classes and counts are a table.
* Exchange needs each type's neighbours. One pass counts bigrams of types, dealt by type
  range; a range keeps the counts of both directions, so an exchange step reads its
  range and the current classes and moves its types, one after another, to the class with the highest likelihood. The types of a quarter
  of the ranges, or of fewer where that loses likelihood, move at a time, until a turn of all types hardly adds likelihood. A step
  reads the ranges that move and no others: the new class table is the old one and what their bigrams change. Only class tables and the class map reach the driver.
* Class counts and scores find frequent words in the arrays; the others are joined with the table.
  A word without training uses has no neighbours and takes the class of its ending.

Smoothing: class transitions are interpolated with the class distribution, emissions have one
added to each count of the class's words and one unknown word, as the base score has for all words.

Cases: null text counts as empty and has the end alone. Without training texts all counts are 0
and scores those of one unknown word. Repeated rows and ids are scored one by one, ties in counts are kept or left out
together, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm._shared import BLOB_ROWS, batches_of, keep, parts, released, small_batches
from wayfold.llm._words import Words, mix, portions, words


#: Parts of the bigram table that lie apart in storage.
PARTS = 16
#: Words that a task gathers before it counts them.
GATHERED = 2_500_000


@dataclass(frozen=True)
class Settings:
    classes: int = 64
    types: int = 49_151  #: words clustered one by one, at most
    endings: int = 16_384  #: types of all other words
    lexicon: int = 1 << 20  #: words whose counts are held as arrays, at most
    ranges: int = 128  #: parts of the bigram table, rounded up to a power of two
    gain: float = 4e-3  #: exchange ends when a turn of all types adds less than this share of the log likelihood above that of one class
    weight: float = 16.0  #: of the class distribution in a class's transitions

    @property
    def ranges_(self) -> int:
        """Parts of the bigram table: a multiple of the parts that are left out whole, and a power of two."""
        return 1 << max(0, self.ranges - 1).bit_length()


class Lookup:
    """Where each range of leading bits begins in sorted hashes: spread evenly, a range has few of them."""

    def __init__(self, sorted_hash: np.ndarray) -> None:
        self.hash, bits = sorted_hash, min(24, 1 + max(1, len(sorted_hash)).bit_length())
        self.shift = np.uint64(64 - bits)
        held = np.bincount((sorted_hash >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = np.concatenate([[0], np.cumsum(held)[:-1]]).astype(np.int32)
        self.most = int(held.max(initial=0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted hashes and whether each is there."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        last = len(self.hash) - 1
        at = np.minimum(self.start[(h >> self.shift).astype(np.int64)], last).astype(np.int64)
        seen = self.hash[at]
        there = seen == h
        left = np.flatnonzero(seen < h)
        for _ in range(1, self.most):
            if not len(left):
                break
            next_ = np.minimum(at[left] + 1, last)
            seen, own = self.hash[next_], h[left]
            at[left], there[left] = next_, seen == own
            left = left[seen < own]
        return at, there


@dataclass
class Lexicon:
    """The most frequent words: sorted hashes, counts, types (-1: by the ending)."""

    hash: np.ndarray
    count: np.ndarray
    type: np.ndarray
    own: np.ndarray | None = None  #: classes
    lookup: Lookup | None = None  #: made in each task that needs it

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes and whether each is there."""
        if self.lookup is None:
            self.lookup = Lookup(self.hash)
        return self.lookup.find(h)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lookup": None}


@dataclass
class Model:
    settings: Settings
    lexicon: Lexicon
    tokens: int  #: all training tokens
    distinct: int  #: distinct ones
    ends: int
    of_type: np.ndarray  #: class of each type
    transition: np.ndarray  #: log10 P(class | class)
    size: np.ndarray  #: tokens and words of each class, and one
    counts: DataFrame  #: (h, n, class) of all training words


def endings(w: Words, n: int) -> np.ndarray:
    """A number below n from the last four bytes of each word."""
    tail = np.zeros(len(w.start), np.uint64)
    for k in range(1, 5):
        at = w.end - k
        tail = tail * np.uint64(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)], 256).astype(np.uint64)
    return (mix(tail) % np.uint64(n)).astype(np.int64)


def _find(sorted_hash: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For few hashes: places in the sorted hashes and whether each is there."""
    if not len(sorted_hash):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hash, h), len(sorted_hash) - 1)
    return at, sorted_hash[at] == h


def types_of(w: Words, lexicon: Lexicon, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's type, its place in the lexicon, and whether it is there; type 0 is the end."""
    at, there = lexicon.find(w.hash)
    own = np.where(there, lexicon.type[at] if len(lexicon.type) else -1, -1)
    return np.where(own >= 0, own, 1 + settings.types + endings(w, settings.endings)), at, there


def _with_ends(values: np.ndarray, w: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` with an end after each text's words, and the places of the ends."""
    ends = w.first[1:] + np.arange(len(w.first) - 1)
    out = np.full(len(values) + len(ends), end, values.dtype)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = values
    return out, ends


def _by_part(part: np.ndarray, parts_: int, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by part, and by ``key`` inside one (None: as they come), and where each part begins, with the end."""
    first = np.argsort(key) if key is not None else None
    if parts_ <= 1 << 16:
        part = part.astype(np.uint16)  # sorted by its digits
    at = np.argsort(part if first is None else part[first], kind="stable")
    return at if first is None else first[at], np.append(0, np.cumsum(np.bincount(part, minlength=parts_)))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


class Tally:
    """Counts of keys, merged when many have gathered."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.keys, self.counts = most, 0, [], []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * self.most:
            self.keys, self.counts = ([x] for x in _merged(self.keys, self.counts))
            self.held = len(self.keys[0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _merged(self.keys, self.counts)
        self.held, self.keys, self.counts = 0, [], []
        return out


def word_counts(train: DataFrame, settings: Settings) -> DataFrame:
    """(h, ending, n) for every distinct training word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            hashes, which = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
            held.clear()
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(hashes)))
            return pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(which[order[first]]), pa.array(n.astype(np.int64))], ["h", "ending", "n"])

        for batch in batches:
            for _, some in portions(batch.column(0).to_pylist()):
                w = words(some)
                held.append((w.hash, endings(w, settings.endings).astype(np.int32)))
                if sum(len(x[0]) for x in held) > GATHERED:
                    yield flush()
        yield flush()
        released()

    made = train.select("text").mapInArrow(run, "h long, ending int, n long")
    return keep(made.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "words")


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more."""
    # as many groups as there are distinct counts: below the root of twice the tokens
    groups = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()
    total, least = 0, 1 << 62
    for r in groups:
        total += r["k"]
        if total > most:
            break
        least = r["n"]
    return least


def _lexicon(counts: DataFrame, settings: Settings) -> Lexicon:
    least = _threshold(counts, settings.lexicon)
    rows = counts.where(F.col("n") >= least).select("h", "n").toArrow()  # at most settings.lexicon rows
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    kind = np.full(len(h), -1, np.int64)
    one = np.flatnonzero(n >= _threshold(counts, settings.types))
    kind[one] = 1 + np.arange(len(one))
    return Lexicon(h, n, kind)


def bigrams(train: DataFrame, lexicon: Lexicon, settings: Settings) -> DataFrame:
    """Table (range, after, after_n, before, before_n): counts of neighbours after and before each type of a range.

    A key is type * 2^32 + neighbour; one range has what its types' neighbours can be at most, whatever the corpus.
    """
    ranges = settings.ranges_

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else _merged([], [])
            held.clear()
            a, b = keys >> 32, keys & 0xFFFFFFFF
            for way, (x, y) in enumerate(((a, b), (b, a))):
                k = (x << 32) | y
                order, bounds = _by_part(x % ranges, ranges, None if way == 0 else k)  # sorted ones merge fast
                both = k[order], n[order]
                for r in range(ranges):
                    k, c = (v[bounds[r] : bounds[r + 1]] for v in both)
                    if len(k):
                        small = np.column_stack([k >> 32, k & 0xFFFFFFFF]).astype("<u4")
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([way], pa.int32()), pa.array([small.tobytes()]), pa.array([c.astype("<i8").tobytes() if c.max() > 65535 else c.astype("<u2").tobytes()])], ["range", "way", "keys", "counts"])

        for batch in batches:
            for _, some in portions(batch.column(0).to_pylist()):
                w = words(some)
                t, ends = _with_ends(types_of(w, lexicon, settings)[0], w, 0)
                before = np.concatenate([[0], t[:-1]])
                before[ends[:-1] + 1] = 0
                held.append((before << 32) | t)
                if sum(map(len, held)) > GATHERED:
                    yield from flush()
        yield from flush()
        released()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Tally] = {}
        for batch in batches:
            for r, way, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                k = np.frombuffer(keys, "<u4").reshape(-1, 2).astype(np.int64)
                n = np.frombuffer(counts, "<i8" if len(counts) == len(keys) else "<u2").astype(np.int64)
                held.setdefault((r, way), Tally(1_000_000)).add((k[:, 0] << 32) | k[:, 1], n)
        for r in sorted({r for r, _ in held}):
            blobs = [x.astype("<i8").tobytes() for way in (0, 1) for x in held.get((r, way), Tally(1)).take()]
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], ["range", "after", "after_n", "before", "before_n"])
        held.clear()
        released()

    schema = "range int, way int, keys binary, counts binary"
    dealt = train.select("text").mapInArrow(count, schema).repartition(ranges, "range")
    made = dealt.mapInArrow(merge, "range int, after binary, after_n binary, before binary, before_n binary")
    return keep(made.withColumn("part", F.col("range") % PARTS), "bigrams", BLOB_ROWS, by="part")


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _rows(key: np.ndarray, n: np.ndarray, of_type: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """For each type of a range how often its neighbours are of each class."""
    if not len(key):
        return {}
    t = key >> 32
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
    m = np.bincount(at * k + of_type[key & 0xFFFFFFFF], n, len(first) * k).reshape(-1, k)
    return dict(zip(t[first].tolist(), m, strict=True))


def _moves(table: DataFrame, of_type: np.ndarray, settings: Settings, classes: np.ndarray, turn: int, parts_: int) -> pa.Table:
    """(type, class) of the types that change their class, in every ``parts_``-th range from ``turn``: a row for each type at most."""
    k = settings.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                after_key, after_n, before_key, before_n = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in range(4))
                g, m, moved = classes.astype(float), classes.sum(1).astype(float), []
                phi, phi_m = _phi(g), _phi(m)
                rows = _rows(after_key, after_n, of_type, k), _rows(before_key, before_n, of_type, k)
                none = np.zeros(k)
                often = {t: max(rows[0].get(t, none).sum(), rows[1].get(t, none).sum()) for t in rows[0].keys() | rows[1].keys() if t}
                for t, n in sorted(often.items(), key=lambda x: (-x[1], x[0])):  # the most frequent settle first
                    after, before, old = rows[0].get(t, none), rows[1].get(t, none), of_type[t]
                    held = g[old].copy(), g[:, old].copy(), m[old], phi[old].copy(), phi[:, old].copy(), phi_m[old]
                    g[old] = np.maximum(g[old] - after, 0)
                    g[:, old] = np.maximum(g[:, old] - before, 0)
                    m[old] = max(m[old] - n, 0)
                    phi[old], phi[:, old], phi_m[old] = _phi(g[old]), _phi(g[:, old]), _phi(m[old])
                    has_after, has_before = np.flatnonzero(after), np.flatnonzero(before)
                    gain = (_phi(g[:, has_after] + after[has_after]) - phi[:, has_after]).sum(1) + (_phi(g[has_before].T + before[has_before]) - phi[has_before].T).sum(1) - 2 * (_phi(m + n) - phi_m)
                    gain[0] = -np.inf  # the end's own class
                    best = int(np.argmax(gain))
                    if best != old and gain[best] > gain[old] + 1e-9:
                        moved.append((t, best))  # what moves later in this range sees it there
                        g[best] += after
                        g[:, best] += before
                        m[best] += n
                        phi[best], phi[:, best], phi_m[best] = _phi(g[best]), _phi(g[:, best]), _phi(m[best])
                    else:
                        g[old], g[:, old], m[old], phi[old], phi[:, old], phi_m[old] = held
                if moved:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*moved, strict=True)], ["a", "b"])

    with batches_of(table.sparkSession, BLOB_ROWS):
        return _of_turn(table, turn, parts_).select("after", "after_n", "before", "before_n").mapInArrow(run, "a long, b long").toArrow()


def _of_turn(table: DataFrame, turn: int, parts_: int) -> DataFrame:
    """The ranges of a turn; whole parts of the table are left out before they are read."""
    if parts_ <= PARTS:
        return table.where(F.col("part").isin([p for p in range(PARTS) if p % parts_ == turn]))
    return table.where((F.col("part") == turn % PARTS) & (F.col("range") % parts_ == turn))


def _changed(table: DataFrame, before: np.ndarray, after: np.ndarray, settings: Settings, turn: int, parts_: int) -> np.ndarray:
    """What the class table gains and loses when the types of a turn's ranges change their classes, from these ranges alone."""
    k, ranges = settings.classes, settings.ranges_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(k * k, np.int64)

        def add(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
            for of_type, sign in ((after, 1), (before, -1)):
                found[:] += sign * np.bincount(of_type[a] * k + of_type[b], n, k * k).astype(np.int64)

        for batch in batches:
            for i in range(len(batch)):
                after_key, after_n, before_key, before_n = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in range(4))
                add(after_key >> 32, after_key & 0xFFFFFFFF, after_n)
                a = before_key & 0xFFFFFFFF
                other = a % ranges % parts_ != turn  # a pair of two moving types has been counted from its first
                add(a[other], before_key[other] >> 32, before_n[other])
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["cell", "n"])
        released()

    out = np.zeros(k * k, np.int64)
    with batches_of(table.sparkSession, BLOB_ROWS):
        rows = _of_turn(table, turn, parts_).select("after", "after_n", "before", "before_n").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # classes^2 at most
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def _class_table(table: DataFrame, of_type: np.ndarray, settings: Settings) -> np.ndarray:
    """How often each class follows each."""
    k, out = settings.classes, np.zeros((settings.classes, settings.classes), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k, k), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                key, n = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in range(2))
                found += np.bincount(of_type[key >> 32] * k + of_type[key & 0xFFFFFFFF], n, k * k).astype(np.int64).reshape(k, k)
        a, b = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(found[a, b])], ["a", "b", "n"])
        released()

    with batches_of(table.sparkSession, BLOB_ROWS):
        rows = table.select("after", "after_n").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # classes^2 at most
    for r in rows:
        out[r["a"], r["b"]] = r["n"]
    return out


def likelihood(classes: np.ndarray) -> float:
    """Log likelihood of the class bigrams given the classes' own counts, from the table of class bigrams."""
    full = classes.astype(float)
    return float(_phi(full).sum() - _phi(full.sum(1)).sum() - _phi(full.sum(0)).sum() + _phi(full.sum()))


def exchange(table: DataFrame, lexicon: Lexicon, settings: Settings) -> np.ndarray:
    """The class of each type: a start that deals words by their frequency and endings by hash, then steps that move the types of a part of the ranges each, a quarter of them at first.

    Ranges of one step move by the counts before it, so a step may lose likelihood. Such a step is taken back; where most steps of a
    turn are, the parts are halved, down to those that lie apart in storage. Exchange ends when a turn of all parts adds less than ``settings.gain`` of the likelihood.
    """
    n = 1 + settings.types + settings.endings
    of_type = 1 + (mix(np.arange(n, dtype=np.uint64)) % np.uint64(max(1, settings.classes - 1))).astype(np.int64)
    one = lexicon.type >= 0
    of_type[lexicon.type[one]] = 1 + np.argsort(np.argsort(-lexicon.count[one], kind="stable"), kind="stable") % max(1, settings.classes - 1)
    of_type[0] = 0
    classes, parts_ = _class_table(table, of_type, settings), min(4, settings.ranges_)
    now = likelihood(classes)
    while True:
        first, refused = now, 0
        for turn in range(parts_):
            moved = _moves(table, of_type, settings, classes, turn, parts_)
            if moved.num_rows:
                tried = of_type.copy()
                tried[moved.column("a").to_numpy()] = moved.column("b").to_numpy()
                there = classes + _changed(table, of_type, tried, settings, turn, parts_)
                new = likelihood(there)
                if new >= now:
                    of_type, classes, now = tried, there, new
                else:
                    refused += 1
        if 2 * refused >= parts_ and 2 * parts_ <= min(PARTS, settings.ranges_):
            parts_ *= 2
        elif now <= first + settings.gain * now:
            return of_type


def _transitions(classes: np.ndarray, weight: float) -> np.ndarray:
    share = (classes.sum(0) + 1) / (classes.sum() + len(classes))
    return np.log10((classes + weight * share) / (classes.sum(1, keepdims=True) + weight))


def assigned(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, table: DataFrame, of_type: np.ndarray, settings: Settings) -> DataFrame:
    """(h, n, class) of every training word; words not clustered one by one by their own neighbours."""
    k, spark = settings.classes, docs.sparkSession
    apart = _class_table(table, np.where(np.arange(len(of_type)) > settings.types, k, of_type), replace(settings, classes=k + 1))[:k, :k]
    step = _transitions(apart, settings.weight)
    # log likelihood of a use between two classes, for each class of the word; never the end's own
    fit = (step[:, None, :] + step.T[None, :, :] - np.log10(apart.sum(0) + 1.0)).reshape(k * k, k)
    fit[:, 0] = -np.inf
    uses = counts.where(F.col("n") < _threshold(counts, settings.types)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ranges = max(parts(spark), uses // 2_000_000 + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, cell = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            part = (mix(h) % np.uint64(ranges)).astype(np.int64)
            order, bounds = _by_part(part, ranges, h)
            some = np.flatnonzero(np.diff(bounds))
            blobs = [[x[order[bounds[r] : bounds[r + 1]]].tobytes() for r in some] for x in (h, cell.astype("<u4"))]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["range", "words", "cells"])

        for batch in batches:
            for _, some in portions(batch.column(0).to_pylist()):
                w = words(some)
                t, ends = _with_ends(types_of(w, lexicon, settings)[0], w, 0)
                c = of_type[t]
                before = np.concatenate([[0], c[:-1]])
                before[ends[:-1] + 1] = 0
                at = np.flatnonzero(t > settings.types)
                held.append((_with_ends(w.hash, w, 0)[0][at], before[at] * k + c[at + 1]))
                if sum(len(x[0]) for x in held) > 1_000_000:
                    yield flush()
        if held:
            yield flush()
        released()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r, *blobs in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.setdefault(r, []).append([np.frombuffer(b, t) for b, t in zip(blobs, ("<u8", "<u4"), strict=True)])
        for r in list(held):
            h, cell = (np.concatenate(x) for x in zip(*held.pop(r), strict=True))
            h, at, n = np.unique(h, return_inverse=True, return_counts=True)
            key, times = np.unique(at * (k * k) + cell, return_counts=True)
            word, cell = key // (k * k), key % (k * k)
            first = np.searchsorted(word, np.arange(len(h) + 1))
            best, a = np.zeros(len(h), np.int32), 0
            while a < len(h):  # some words at a time; one has k * k cells at most
                b = max(a + 1, int(np.searchsorted(first, first[a] + (1 << 16), "right")) - 1)
                x, y = first[a], first[b]
                best[a:b] = np.add.reduceat(fit[cell[x:y]] * times[x:y, None], first[a:b] - x).argmax(1)
                a = b
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(best)], ["h", "n", "class"])
        released()

    one = np.flatnonzero(lexicon.type >= 0)
    clustered = pa.table({"h": lexicon.hash[one].view(np.int64), "n": lexicon.count[one], "class": of_type[lexicon.type[one]].astype(np.int32)})
    schema = "h long, n long, class int"
    dealt = docs.select("text").mapInArrow(deal, "range long, words binary, cells binary").repartition(ranges, "range")
    return keep(dealt.mapInArrow(choose, schema).unionAll(spark.createDataFrame(clustered, schema)), "classed", BLOB_ROWS)


@dataclass
class Sequences:
    """Classes along texts. Steps to or from a word that is not in the lexicon wait for its class."""

    before: np.ndarray  #: class before each word or end
    own: np.ndarray
    owner: np.ndarray  #: its text
    ready: np.ndarray  #: whether both are known
    bounds: np.ndarray  #: of each text's words that are not in the lexicon
    rare: np.ndarray  #: these words, in order
    around: np.ndarray  #: class before (-1: of the rare word before), after (-1: a rare word), by the ending


def sequences(w: Words, lexicon: Lexicon, of_type: np.ndarray, settings: Settings) -> tuple[Sequences, np.ndarray, np.ndarray]:
    kind, at, there = types_of(w, lexicon, settings)
    by_ending = of_type[kind]
    c, last = _with_ends(np.where(there, lexicon.own[at], by_ending) if len(lexicon.hash) else by_ending, w, 0)
    known, _ = _with_ends(there, w, True)
    n = len(w.first) - 1
    before, ready = np.concatenate([[0], c[:-1]]), np.concatenate([[True], known[:-1]])
    before[last[:-1] + 1], ready[last[:-1] + 1] = 0, True
    places = np.flatnonzero(~known)
    around = np.column_stack([np.where(ready[places], before[places], -1), np.where(known[places + 1], c[places + 1], -1), by_ending[~there]]).astype("<i2")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(w.text[~there], minlength=n)[:n])]).astype(np.int64)
    return Sequences(before, c, np.repeat(np.arange(n), np.diff(w.first) + 1), ready & known, bounds, w.hash[~there].view(np.int64), around), at, there


def late_steps(around: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, next class) of the steps of one text that waited, given its rare words' classes."""
    inner = around[:, 0] >= 0
    before = np.where(inner, around[:, 0], np.concatenate([[0], own[:-1]]))
    out = around[:, 1] >= 0
    return np.concatenate([before, own[out]]), np.concatenate([own, around[out, 1]])


def _with_classes(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (row, rare, ...) with ``found``: the words among ``rare`` that the table has."""
    asked = rows.select("row", F.explode("rare").alias("h")).distinct()
    found = asked.join(counts, "h").groupBy("row").agg(F.collect_list("h").alias("found"), F.collect_list("n").alias("found_n"), F.collect_list("class").alias("found_class"))
    return rows.join(found, "row", "left")


def _looked_up(rare: list[int], around: bytes, found: list[int] | None, n: list[int] | None, own: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes before and after, classes and counts of one text's rare words; a count of 0 where the table has none."""
    h, around_ = np.array(rare, np.int64), np.frombuffer(around, "<i2").reshape(-1, 3).astype(np.int64)
    if not found:
        return around_, around_[:, 2], np.zeros(len(h), np.int64)
    order = np.argsort(found)
    at, there = _find(np.array(found, np.int64)[order], h)
    return around_, np.where(there, np.array(own)[order][at], around_[:, 2]), np.where(there, np.array(n)[order][at], 0)


def _class_counts(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, of_type: np.ndarray, settings: Settings) -> np.ndarray:
    """How often each class follows each in ``docs``, with every word in its own class."""
    k = settings.classes

    def cells(table: np.ndarray) -> pa.Array:
        return pa.array([table.astype("<i8").tobytes()], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = np.zeros(k * k, np.int64), TaskContext.get().partitionId() << 40
        names = ["row", "rare", "around", "cells"]
        for batch in batches:
            for first, some in portions(batch.column(0).to_pylist()):
                q = sequences(words(some), lexicon, of_type, settings)[0]
                table += np.bincount(q.before[q.ready] * k + q.own[q.ready], minlength=k * k)
                texts = np.flatnonzero(np.diff(q.bounds))
                if len(texts):
                    parts_ = [(q.rare[q.bounds[i] : q.bounds[i + 1]], q.around[q.bounds[i] : q.bounds[i + 1]].tobytes()) for i in texts]
                    rare, around = zip(*parts_, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(row + first + texts), pa.array(rare, pa.list_(pa.int64())), pa.array(around, pa.binary()), pa.nulls(len(texts), pa.binary())], names)
            row += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([[]], pa.list_(pa.int64())), pa.array([b""]), cells(table)], names)

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k * k, np.int64)
        for batch in batches:
            for rare, around, found, n, own in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                around_, classes, _ = _looked_up(rare, around, found, n, own)
                a, b = late_steps(around_, classes)
                table += np.bincount(a * k + b, minlength=k * k)
        yield pa.RecordBatch.from_arrays([cells(table)], ["cells"])

    rows = keep(docs.select("text").mapInArrow(run, "row long, rare array<long>, around binary, cells binary"), "steps")
    waited = _with_classes(rows.where("row >= 0"), counts).select("rare", "around", "found", "found_n", "found_class").mapInArrow(late, "cells binary")
    made = rows.where("row < 0").select("cells").unionAll(waited)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sum((np.frombuffer(b, "<i8") for batch in batches for b in batch.column(0).to_pylist()), np.zeros(k * k, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(table)], ["cell", "n"])

    out = np.zeros(k * k, np.int64)
    for r in made.mapInArrow(add, "cell long, n long").where("n > 0").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # classes^2 at most
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from every row of ``docs`` (text)."""
    small_batches(docs.sparkSession)
    counts = word_counts(docs, settings)
    ends = docs.count()
    lexicon = _lexicon(counts, settings)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    table = bigrams(docs, lexicon, settings)
    of_type = exchange(table, lexicon, settings)
    classed = assigned(docs, counts, lexicon, table, of_type, settings)
    rows = classed.where(F.col("n") >= (int(lexicon.count.min()) if len(lexicon.count) else 1 << 62)).select("h", "class").toArrow()  # the lexicon's words
    lexicon.own = rows.column("class").to_numpy().astype(np.int64)[np.argsort(rows.column("h").to_numpy().view(np.uint64))]
    classes = _class_counts(docs, classed, lexicon, of_type, settings)
    transition = _transitions(classes, settings.weight)
    distinct = np.zeros(settings.classes, np.int64)
    for r in classed.groupBy("class").agg(F.count("*").alias("v")).collect():  # settings.classes at most
        distinct[r["class"]] += r["v"]
    distinct[0] += ends > 0
    return Model(settings, lexicon, int(total["n"]) + ends, int(total["v"]) + (ends > 0), ends, of_type, transition, classes.sum(0) + distinct + 1, classed)


def score(docs: DataFrame, model: Model, *extra: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, and the ``extra`` columns, for every row."""
    small_batches(docs.sparkSession)
    settings, lexicon, of_type, transition = model.settings, model.lexicon, model.of_type, model.transition
    size, tokens, distinct, ends = np.log10(model.size), model.tokens, model.distinct, model.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_log = np.log10(lexicon.count + 1.0)
        nth = TaskContext.get().partitionId() << 40
        for batch in batches:
            made = []
            for _, some in portions(batch.column(1).to_pylist()):
                w = words(some)
                q, at, there = sequences(w, lexicon, of_type, settings)
                n = len(some)
                own = np.zeros(len(w.hash))
                own[there] = known_log[at[there]]
                logs, _ = _with_ends(own, w, np.log10(ends + 1.0))
                # logs of counts: the same addend in both scores; rare words' are joined later
                add = np.bincount(q.owner, logs, n)
                classed = np.bincount(q.owner[q.ready], (transition[q.before, q.own] - size[q.own])[q.ready], n)
                many = np.diff(w.first) + 1
                seen = np.bincount(w.text[there], minlength=n)[:n] + (ends > 0)
                around = [q.around[a:b].tobytes() for a, b in zip(q.bounds[:-1], q.bounds[1:], strict=True)]
                made.append(
                    [pa.array(many), pa.array(seen.astype(np.int64)), pa.array(add - many * np.log10(tokens + distinct + 1.0)), pa.array(add + classed), pa.ListArray.from_arrays(pa.array(q.bounds.astype(np.int32)), pa.array(q.rare)), pa.array(around, pa.binary())]
                )
            if made:
                cols = [pa.concat_arrays(x) for x in zip(*made, strict=True)]
                row = pa.array(np.arange(nth, nth + len(batch)))
                nth += len(batch)
                yield pa.RecordBatch.from_arrays([row, batch.column(0), *batch.columns[2:], *cols], ["row", "doc_id", *batch.schema.names[2:], "n_tokens", "n_known", "base_score", "score", "rare", "around"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in asked.schema.fields[2:])
    rows = keep(asked.mapInArrow(run, f"row long, doc_id long{more}, n_tokens long, n_known long, base_score double, score double, rare array<long>, around binary"), "scored")

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rare, around, found, n, own in zip(*(batch.column(c).to_pylist() for c in ("rare", "around", "found", "found_n", "found_class")), strict=True):
                around_, classes, counts = _looked_up(rare, around, found, n, own)
                a, b = late_steps(around_, classes)
                made.append((int((counts > 0).sum()), float(np.log10(counts + 1.0).sum()), float((transition[a, b] - size[b]).sum())))
            if made:
                known, add, classed = (np.array(x) for x in zip(*made, strict=True))
                values = {"n_known": known, "base_score": add, "score": add + classed}
                cols = [pa.array(batch.column(c).to_numpy() + values[c]) if c in values else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", *(f.name for f in asked.schema.fields[2:]), "n_tokens", "n_known", "base_score", "score"]
    scored = _with_classes(rows, model.counts).drop("row").mapInArrow(late, f"doc_id long{more}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(*names[:-2], F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")

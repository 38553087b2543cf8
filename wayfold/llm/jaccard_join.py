"""N-gram Jaccard join with filters under several global token orders.

A document is the set of its five-word shingles (64-bit hashes). Two documents link when their
sets' Jaccard similarity is at least ``Settings.percent`` / 100.

1. Documents with equal sets are one node, named by 64 bits of the set's signature.
2. Under any order of all shingles, similar sets share one of their first
   n - ceil(p * n) + 1 shingles. Order one puts frequent shingles last, by a table of counts of
   hashed shingles over all documents; its prefixes, dealt by shingle, give groups of
   documents. Candidates must share a prefix shingle under two further orders (frequency class, then another hash) as well;
   these prefixes meet before sets do, so a pair is verified only if all orders have it.
3. Groups don't become all pairs. First each member is compared with the group's leader (the
   document of the most common shingles). Then components are known, and in groups where they
   still differ the members outside the largest component are compared with the members of other
   components. So no link that joins two components is lost, and a large group of
   near copies costs little more than its size where they are close to their leader.
4. Before the further orders, sizes and parity bitmaps of a bit for each shingle filter the pairs: bitmaps
   of similar sets differ in no more bits than the sets in shingles.
5. A comparison needs both sets (or bitmaps): these are dealt into blocks of bounded size, and documents with
   lists of partners stream past each block; only lists of links leave.

Components come from repeated star contraction. One shingle's group is held by one task as 20 bytes a document.

Cases: null or empty text or text without words has an empty set, linked with nothing. Fewer than five
words are one shingle. Every row is returned; rows of one doc_id are documents of their own, and a row with a null
doc_id takes part, but names no component. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._shared import BLOB_ROWS, keep, released, small_batches
from wayfold.llm._shared import parts as dealt
from wayfold.llm._words import mix, portions, shingles, words
from wayfold.llm.components import components

CELLS = 1 << 20  #: counts of hashed shingles
PIECES = 256  #: parts in which counts are summed
MOST_BITS = 1 << 28  #: of the filter of wanted sets (32 MB)


@dataclass(frozen=True)
class Settings:
    n: int = 5
    percent: int = 75
    postings: int = 1_500_000  #: prefix entries dealt to one task, about
    block: int = 4000  #: documents whose sets are held at a time, about
    heads: int = 8000  #: documents whose prefixes are held at a time, about
    marks: int = 60_000  #: documents whose bitmaps are held at a time, about


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, some in portions(texts):
        h, owner = shingles(words(some), n)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        yield from np.split(h, np.searchsorted(owner, np.arange(1, len(some))))


def _node(s: np.ndarray) -> int | None:
    """A signed 64-bit number that equal sets share; none for the empty set."""
    if not len(s):
        return None
    a = np.array([mix(s).sum(dtype=np.uint64)]) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(a + np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))).view(np.int64)[0])


def _counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' shingles fall into each cell; a fixed size, whatever the corpus."""
    width = CELLS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in _sets(batch.column(0).to_pylist(), n):
                np.add.at(total, (s >> np.uint64(44)).astype(np.int64), 1)
        small = total.astype("<u4") if total.max(initial=0) < 1 << 32 else total.astype("<i8")
        for p in range(PIECES):
            part = small[p * width : (p + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([part.tobytes()])], ["piece", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[p] = held.get(p, 0) + np.frombuffer(cells, "<u4" if len(cells) == 4 * width else "<i8").astype(np.int64)
        for p, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total.tobytes()])], ["piece", "cells"])

    schema, out = "piece int, cells binary", np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(count, schema).repartition(min(PIECES, 4 * dealt(docs.sparkSession)), "piece").mapInArrow(add, schema).collect():  # CELLS numbers
        out[r["piece"] * width : (r["piece"] + 1) * width] = np.frombuffer(r["cells"], np.int64)
    return out


def orders(s: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The set under three global orders, each with frequent shingles late."""
    c = counts[(s >> np.uint64(44)).astype(np.int64)]
    level = np.floor(np.log2(c + 1.0))
    return [s[np.lexsort((s, c))], s[np.lexsort((mix(s), level))], s[np.lexsort((mix(s * np.uint64(0x9FB21C651E98DF25)), level))]]


def bitmap(s: np.ndarray) -> bytes:
    """The set's size and, for about as many bits, whether an odd number of its shingles falls on each."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ np.uint64(0x3C79AC492BA7B653)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def further_heads(s: np.ndarray, counts: np.ndarray, percent: int) -> bytes:
    """The prefixes under orders two and three, 32 bits a shingle."""
    size = prefix_size(len(s), percent)
    return b"".join(np.sort((o[:size] >> np.uint64(32)).astype("<u4")).tobytes() for o in orders(s, counts)[1:])


class Heads:
    """A document's prefixes under the two further orders."""

    __slots__ = ("known", "orders")

    def __init__(self, raw: bytes) -> None:
        self.orders = np.frombuffer(raw, "<u4").reshape(2, -1)
        self.known: list[frozenset] | None = None

    def meets(self, other: Heads) -> bool:
        """Whether the two share a shingle under both."""
        if self.known is None:
            self.known = [frozenset(h.tolist()) for h in self.orders]
        return not any(a.isdisjoint(b.tolist()) for a, b in zip(self.known, other.orders, strict=True))


def mark(raw: bytes) -> tuple[int, int, int]:
    """Size, bits and bitmap."""
    return int.from_bytes(raw[:8], "little"), 8 * (len(raw) - 8), int.from_bytes(raw[8:], "little")


def may_be_similar(a: tuple[int, int, int], b: tuple[int, int, int], percent: int) -> bool:
    """False only for pairs whose sizes or bitmaps rule similarity out; each is (size, bits, bitmap)."""
    if a[1] < b[1]:
        a, b = b, a
    if 100 * min(a[0], b[0]) < percent * max(a[0], b[0]):
        return False
    wide, bits = a[2], a[1]
    while bits > b[1]:
        bits //= 2
        wide = (wide >> bits) ^ (wide & ((1 << bits) - 1))
    # |a - b| + |b - a| <= (100 - p) / (100 + p) * (|a| + |b|) for similar sets
    return (100 + percent) * (wide ^ b[2]).bit_count() <= (100 - percent) * (a[0] + b[0])


def _classes(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, key, n, node) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), _node(s)) for s in _sets(batch.column(1).to_pylist(), settings.n)]
            if found:
                n, node = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["doc_id", "key", "n", "node"])
        released()

    return keep(docs.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, key long, n long, node long"), "classes")


def _heads(docs: DataFrame, counts: np.ndarray, settings: Settings) -> DataFrame:
    """(node, central, head, mark): how common the shingles are, the prefix under order one, and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in _sets(batch.column(0).to_pylist(), settings.n):
                if len(s):
                    c = counts[(s >> np.uint64(44)).astype(np.int64)]
                    head = s[np.lexsort((s, c))][: prefix_size(len(s), settings.percent)]
                    rows.append((_node(s), float(np.log2(c + 1.0).mean()), head.tobytes(), bitmap(s)))
            if rows:
                kinds = (pa.int64(), pa.float32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "central", "head", "mark"])
        released()

    made = docs.select("text").mapInArrow(run, "node long, central float, head binary, mark binary")
    return keep(made.groupBy("node").agg(F.first("central").alias("central"), F.first("head").alias("head"), F.first("mark").alias("mark")), "heads")


def _groups(heads: DataFrame, settings: Settings) -> DataFrame:
    """(docs, lead): distinct lists of documents that share a prefix shingle; lead has the most common shingles."""
    total = heads.agg(F.sum(F.octet_length("head") / 8)).first()[0] or 0
    ranges = max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // settings.postings) + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> Iterator[pa.RecordBatch]:
            token = np.concatenate([h for h, _, _ in held])
            size = [len(h) for h, _, _ in held]
            doc, central = np.repeat([d for _, d, _ in held], size), np.repeat(np.array([c for _, _, c in held], "<f4"), size)
            part = (token % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(ranges + 1))
            at = [(r, order[bounds[r] : bounds[r + 1]]) for r in range(ranges) if bounds[r] < bounds[r + 1]]
            blobs = [[x[i].tobytes() for _, i in at] for x in (token, doc.astype("<i8"), central)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in at], pa.int64()), *map(pa.array, blobs)], ["part", "token", "doc", "central"])

        held, size = [], 0
        for batch in batches:
            for doc, central, head in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.append((np.frombuffer(head, np.uint64), doc, central))
                size += len(held[-1][0])
                if size > 2_000_000:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)
        held.clear()
        released()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r, *blobs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.setdefault(r, []).append([np.frombuffer(b, t) for b, t in zip(blobs, ("<u8", "<i8", "<f4"), strict=True)])
        for parts in held.values():
            token, doc, central = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((doc, token))
            token, doc, central = token[order], doc[order], central[order]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            last = np.append(first[1:], len(token))
            seen: set[bytes] = set()
            docs, leads = [], []
            for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
                own = doc[a:b].tobytes()
                if own not in seen:
                    seen.add(own)
                    docs.append(own)
                    leads.append(int(doc[a + int(central[a:b].argmax())]))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.binary()), pa.array(leads, pa.int64())], ["docs", "lead"])
        held.clear()
        released()

    sent = heads.select("node", "central", "head").mapInArrow(deal, "part long, token binary, doc binary, central binary")
    made = sent.repartition(ranges, "part").mapInArrow(group, "docs binary, lead long")
    return keep(made.groupBy(F.md5("docs").alias("gid")).agg(F.min("docs").alias("docs"), F.min("lead").alias("lead")), "groups", BLOB_ROWS)


def _unpacked(groups: DataFrame) -> DataFrame:
    """(gid, doc, lead) of every member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                some = batch.slice(i, 64)
                docs = [np.frombuffer(b, "<i8") for b in some.column(1).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), pa.array(np.concatenate(docs)), some.column(2).take(at)], ["gid", "doc", "lead"])

    return groups.select("gid", "docs", "lead").mapInArrow(run, "gid string, doc long, lead long")


def _wanted(docs: DataFrame, ids: DataFrame, counts: np.ndarray, settings: Settings) -> DataFrame:
    """(doc_id, heads, held: the packed shingles) of the nodes in ``ids``. Most others stop at a filter of 8 bits an id.

    The filter is a table of bits that every task holds: from ``MOST_BITS`` on there is none, and the join alone decides.
    """
    spark, bits = docs.sparkSession, 1 << max(15, (8 * ids.count()).bit_length())
    field = _field(ids, bits) if bits <= MOST_BITS else None
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            rows = []
            for s in _sets(batch.column(0).to_pylist(), settings.n):
                if len(s):
                    node = _node(s)
                    x = int(mix(np.array([node]).view(np.uint64))[0]) % bits
                    if field is None or field[x >> 3] >> (x & 7) & 1:
                        rows.append((node, further_heads(s, counts, settings.percent), s.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "heads", "held"])
        released()

    made = docs.select("text").mapInArrow(run, "doc_id long, heads binary, held binary").groupBy("doc_id").agg(F.first("heads").alias("heads"), F.first("held").alias("held"))
    return keep(made.join(ids, "doc_id", "left_semi"), "sets")


def _field(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each id, at a hash of it."""
    spark = ids.sparkSession
    page = 4096  #: bytes of the filter that travel together

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            x = mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(bits)
            np.bitwise_or.at(held, (x >> np.uint64(3)).astype(np.int64), np.left_shift(1, (x & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        pages = held.reshape(-1, page)
        some = np.flatnonzero(pages.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pages[i].tobytes() for i in some], pa.binary())], ["page", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, np.uint8(0)) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["page", "bits"])

    noted = ids.repartition(min(dealt(spark), 1 + bits // (1 << 22))).mapInArrow(note, "page long, bits binary")
    field = np.zeros((bits // 8 // page, page), np.uint8)
    for r in noted.repartition(dealt(spark), "page").mapInArrow(merge, "page long, bits binary").collect():  # MOST_BITS / 8 bytes at most
        field[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return field.ravel()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _matched(pairs: DataFrame, held_: DataFrame, per_block: int, prepare: Callable[[bytes], object], match: Callable[[object, object], bool]) -> DataFrame:
    """``pairs`` (a, partners: packed ids) with the partners that ``match``, by what ``held_`` (doc_id, held) has of both."""
    blocks = max(1, held_.count() // per_block + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, partners in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.unique(np.frombuffer(partners, "<i8"))
                part = (mix(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
                rows += [(a, int(p), ids[part == p].tobytes()) for p in np.unique(part)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "part", "partners"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = (mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part), batch.column(1)], ["doc_id", "part", "held"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            found = []
            for part, kind, doc, own, partners in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if part != now:
                    now, held = part, {}
                if kind == 0:
                    held[doc] = prepare(own)
                    continue
                own = prepare(own)
                near = [b for b in np.frombuffer(partners, "<i8").tolist() if b != doc and match(own, held[b])]
                if near:
                    found.append((doc, np.array(near, "<i8").tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.binary()), strict=True)], ["a", "partners"])
        held.clear()
        released()

    asks = pairs.mapInArrow(split, "doc_id long, part long, partners binary").join(held_, "doc_id").select("part", F.lit(1).alias("kind"), "doc_id", "held", "partners")
    have = held_.mapInArrow(place, "doc_id long, part long, held binary").select("part", F.lit(0).alias("kind"), "doc_id", "held", F.lit(None).cast("binary").alias("partners"))
    rows = have.unionAll(asks).repartition(blocks, "part").sortWithinPartitions("part", "kind")
    return keep(rows.mapInArrow(compare, "a long, partners binary"), "matched")


def _links(docs: DataFrame, pairs: DataFrame, marks: DataFrame, counts: np.ndarray, settings: Settings) -> DataFrame:
    """(a, b) of ``pairs`` (a, partners: packed ids) whose sets are similar. Sets are compared of pairs that all filters leave."""
    percent = settings.percent
    left = _matched(pairs, marks, settings.marks, mark, lambda a, b: may_be_similar(a, b, percent))
    wanted = _wanted(docs, keep(_partners(left).select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids"), counts, settings)
    left = _matched(left, wanted.select("doc_id", F.col("heads").alias("held")), settings.heads, Heads, lambda a, b: a.meets(b))
    return keep(_partners(_matched(left, wanted.select("doc_id", "held"), settings.block, lambda raw: np.frombuffer(raw, np.uint64), lambda a, b: similar(a, b, percent))), "similar")


def _partners(pairs: DataFrame) -> DataFrame:
    """(a, b) of packed lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                some = batch.slice(i, 64)
                lists = [np.frombuffer(b, "<i8") for b in some.column(1).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), pa.array(np.concatenate(lists))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _rest(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, partners): in groups of several components, members outside the largest against the other components' members."""
    known = groups.where(F.octet_length("docs") > 16)  # of two members, one is the leader
    members = _unpacked(known).join(parts.select(F.col("id").alias("doc"), "component"), "doc", "left").select("gid", "doc", "lead", F.coalesce("component", "doc").alias("component"))
    mixed = members.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[int, list[np.ndarray]] = {}
            for docs, comps, lead in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                docs, comps = np.array(docs, np.int64), np.array(comps, np.int64)
                kinds, at, size = np.unique(comps, return_inverse=True, return_counts=True)
                large = size.argmax()
                for i in np.flatnonzero((at != large) & (docs != lead)):
                    # of two documents outside the largest component, the greater asks
                    other = docs[(at != at[i]) & ((at == large) | (docs < docs[i])) & (docs != lead)]
                    if len(other):
                        rows.setdefault(int(docs[i]), []).append(other)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([np.unique(np.concatenate(x)).astype("<i8").tobytes() for x in rows.values()])], ["a", "partners"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.unique(np.concatenate(held)).tobytes()])], ["a", "partners"])
        for batch in batches:
            for a, partners in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if a != now and held:
                    yield out()
                    held = []
                now = a
                held.append(np.frombuffer(partners, "<i8"))
                if len(held) > 200:
                    held = [np.unique(np.concatenate(held))]
        if held:
            yield out()

    lists = members.join(mixed, "gid", "left_semi").groupBy("gid").agg(F.collect_list("doc").alias("docs"), F.collect_list("component").alias("comps"), F.min("lead").alias("lead")).select("docs", "comps", "lead")
    asked = lists.mapInArrow(run, "a long, partners binary")
    return keep(asked.repartition(dealt(groups.sparkSession), "a").sortWithinPartitions("a").mapInArrow(union, "a long, partners binary"), "rest")


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    rows = named_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("key")), settings)
    return rows.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def named_rows(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, key, n_shingles, component, component_id) of every row of ``docs`` (doc_id, text, key).

    ``component`` is a number that linked rows share, null without words; ``component_id`` the least doc_id in it.
    """
    small_batches(docs.sparkSession)
    classes = _classes(docs, settings)
    counts = _counts(docs, settings.n)
    heads = _heads(docs, counts, settings)
    marks = heads.select(F.col("node").alias("doc_id"), F.col("mark").alias("held"))
    groups = _groups(heads, settings)
    star = _unpacked(groups).where("doc <> lead").select("doc", "lead").distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x, "<i8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary())], ["a", "partners"])

    asked = star.groupBy("doc").agg(F.collect_list("lead").alias("leads")).mapInArrow(packed, "a long, partners binary")
    near = _links(docs, asked, marks, counts, settings)
    more = _links(docs, _rest(groups, keep(components(near), "parts")), marks, counts, settings)
    whole = components(near.unionAll(more)).select(F.col("id").alias("node"), "component")
    least = classes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(whole, "node", "left")
    least = least.select("node", "least", F.coalesce("component", "node").alias("component"))
    named = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component", "component_id")
    return classes.join(named, "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), "component", "component_id")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stay: one of each component, and every row without words.

    The row that stays is the one with the least doc_id (a null id comes after all others), of rows with
    one doc_id the one with the least hash of its text, and of rows equal in both any one. So unrelated texts
    with one doc_id both stay, and of copies without an id one does.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = named_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key")), settings)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    texts = rows.where("component IS NOT NULL").groupBy("component", "doc_id", "key").agg(F.count("*").alias("n"))
    chosen = texts.groupBy("component").agg(F.min_by(F.struct("doc_id", "key", "n"), first).alias("c")).select("c.doc_id", "c.key", (F.col("c.n") > 1).alias("twins"))
    wordless = rows.where("component IS NULL").select("doc_id", "key", F.lit(False).alias("twins")).distinct()
    decided = chosen.unionAll(wordless).select(F.struct(F.col("doc_id").alias("id"), "key").alias("of"), "twins")
    row = F.struct(*docs.columns)
    packed = docs.select(row.alias("row"), F.struct(F.col("doc_id").cast("long").alias("id"), key.alias("key")).alias("at"))
    kept = packed.join(decided, F.col("at").eqNullSafe(F.col("of")))
    once = kept.where("NOT twins").select("row").unionAll(kept.where("twins").dropDuplicates(["at"]).select("row"))
    return once.select(*(F.col("row")[c].alias(c) for c in docs.columns))

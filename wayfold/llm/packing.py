"""Best-two-fit packing of documents into token sequences of a fixed length.

Documents are tokenized (ids, then an end id); only those longer than a sequence are cut. How
pieces are packed depends on their lengths alone, so the driver packs the histogram of lengths,
which has ``size`` entries however large the corpus: it repeats whole patterns (lists of lengths
that make one sequence) as often as the counts allow. Every piece then finds its place from its
rank among the pieces of its length; ranks come from counts by task, never from one sorted group.

One pattern: take the longest piece, then again and again the longest that fits the gap. While a
gap is left, try to replace the pattern's smallest piece with two unpacked ones that fit the gap
and its room more tightly.

Cases: null or empty text is one piece with the end id alone. Repeated documents and equal
lengths are pieces of their own; which of several equal pieces goes where is arbitrary. Null
ids are kept, extra columns ignored, an empty table gives an empty result. Long texts
become many pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm import _bpe
from wayfold.llm._shared import keep, lent, small_batches

#: Encoded between words to tell them apart: a digit is always a token of its own.
_MARK = "0"


class WordIds:
    """Packed ids of words between white space, in a memo of two generations of bounded size.

    The vocabulary drops white space before it merges, so words are encoded independently. New
    words are encoded many at a time in one text, with a mark between them.
    """

    def __init__(self, vocabulary: str, most: int = 800_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.of_letters = _bpe.of_letters(self.tokenizer)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(names.values()) + 1, bool)
        self.is_end[[i for name, i in names.items() if name.endswith("</w>")]] = True
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and self.tokenizer.encode(f"a {_MARK} b", add_special_tokens=False).ids.count(mark[0]) == 1 else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of new words; those of Latin-1 words from their lower case without marks behind a last letter.

        The vocabulary lowers letters itself, and such marks are always a token run of their own.
        What is left of most is letters alone, which need neither its normalizer nor its pattern.
        """
        now, old = self.now, self.old
        latin = [w for w in new if w.isascii() or max(w) <= "\xff"]
        lower = " ".join(latin).lower().split(" ") if latin else []
        bases = [c if c.isalpha() else _bpe.ended(c) for c in lower]
        todo = set(bases)
        if len(latin) < len(new):
            todo.update(set(new).difference(latin))
        letters, other = [], []
        for w in todo.difference(now):
            if w in old:
                now[w] = old[w]
            else:
                (letters if w.isalpha() and (w.isascii() or max(w) <= "\xff") else other).append(w)
        for i in range(0, len(letters), 500):
            some = letters[i : i + 500]
            ids = np.array(self.of_letters("\n".join(some)), "<u4")
            self._keep(some, ids, np.flatnonzero(self.is_end[ids]) + 1, 0)
        plain = [w for w in other if _MARK not in w] if self.mark is not None else []
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            self._keep(some, ids, np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        rest = [w for w in other if _MARK in w] if self.mark is not None else other
        now.update(zip(rest, self._ids(rest), strict=True))
        if ends := list({c[len(b) :] for c, b in zip(lower, bases, strict=True) if c is not b}.difference(self.ends)):
            self.ends.update(zip(ends, self._ids(ends), strict=True))
        for w, c, base in zip(latin, lower, bases, strict=True):
            if c is not base:
                now[w] = now[base] + self.ends[c[len(base) :]]
            elif w != c:
                now[w] = now[c]

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Remember the words' ids, which end at ``ends``; ``gap`` ids lie between two words."""
        raw, upto = ids.tobytes(), (4 * ends).tolist()
        self.now.update(zip(words, [raw[s:e] for s, e in zip([0, *(e + 4 * gap for e in upto[:-1])], upto, strict=True)], strict=True))

    def encode(self, texts: list[str] | pa.Array | pa.ChunkedArray) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        words, index, bounds = _bpe.numbered(pc.ascii_split_whitespace(_bpe.strings(texts)))
        got = [self.now.get(w) if w else b"" for w in words]  # none beside white space at an end
        lacking = [k for k, v in enumerate(got) if v is None]
        if len(self.now) + len(lacking) > self.most:
            self.old, self.now = self.now, {}
        self._learn([words[k] for k in lacking])
        for k in lacking:
            got[k] = self.now[words[k]]
        return _bpe.taken(got, index, bounds)


@lru_cache(1)
def words_of(vocabulary: str) -> WordIds:
    """One for each worker process while tasks ask for it, by ``lent``."""
    return WordIds(vocabulary, 600_000)


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, nth): nth of its length in task part."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        with lent(words_of, vocabulary) as words:
            for found in _bpe.gathered(batches):
                rows: list[tuple] = []
                for doc, ids in zip(found.column(0).to_pylist(), words.encode(found.column(1)), strict=True):
                    ids += tail
                    for i in range(0, len(ids), 4 * size):
                        piece = ids[i : i + 4 * size]
                        n = len(piece) // 4
                        rows.append((doc, i // (4 * size), i // 4, n, zlib.crc32(piece), part, int(seen[n])))
                        seen[n] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in (1, 5) else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    )


def _fitting(left: np.ndarray, gap: int) -> int:
    """The longest length of at most ``gap`` that is left, or 0."""
    at = np.flatnonzero(left[1 : gap + 1])
    return int(at[-1]) + 1 if len(at) else 0


def _two(left: np.ndarray, room: int, more: int) -> tuple[int, int] | None:
    """Two lengths that are left, of at most ``room`` and over ``more`` together, as long as can be."""
    has = left > 0
    for total in range(room, more, -1):
        a = np.flatnonzero(has[1 : total // 2 + 1] & has[total - 1 : total - total // 2 - 1 : -1]) + 1
        for x in a[::-1]:
            if 2 * x != total or left[x] > 1:
                return int(x), total - int(x)
    return None


def patterns(counts: np.ndarray, size: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: uses}) of each pattern; ``counts`` has the pieces of each length to ``size``."""
    left, out = counts.astype(np.int64).copy(), []
    while first := _fitting(left, size):
        before, gap, uses = left.copy(), size, {}

        def take(n: int, k: int) -> None:
            left[n] -= k
            uses[n] = uses.get(n, 0) + k
            if not uses[n]:
                del uses[n]

        nxt = first
        while nxt:
            k = 1 if nxt == first and not uses else int(min(left[nxt], gap // nxt))
            take(nxt, k)
            gap -= k * nxt
            nxt = _fitting(left, gap)
        while gap and len(uses):
            small = min(uses)
            pair = _two(left, gap + small, small)
            if pair is None:
                break
            take(small, -1)
            for n in pair:
                take(n, 1)
            gap += small - sum(pair)
        times = int(min(before[n] // u for n, u in uses.items()))
        left = before
        for n, u in uses.items():
            left[n] -= times * u
        out.append((times, uses))
    return out


def _places(found: list[tuple[int, dict[int, int]]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, uses, first sequence and offset of each run of ranks."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank, sequence = np.zeros(size + 1, np.int64), 0
    for times, uses in found:
        offset = 0
        for n in sorted(uses, reverse=True):
            runs.setdefault(n, []).append((int(rank[n]), uses[n], sequence, offset))
            rank[n] += times * uses[n]
            offset += n * uses[n]
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for n, x in runs.items()}


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    if not 1 <= size <= 1 << 16:
        raise ValueError("size must be between 1 and 65536")
    made = keep(pieces(docs, vocabulary, size, end), "pieces")
    by_task = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `size` rows at most
        counts[r["length"]] = r["n"]
    places = _places(patterns(counts, size), size)
    # a row for each task in a group, not for each piece
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = made.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                start, uses, base, off = places[int(n)]
                k = np.searchsorted(start, ranks[at], "right") - 1
                q = ranks[at] - start[k]
                sequence[at], offset[at] = base[k] + q // uses[k], off[k] + q % uses[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

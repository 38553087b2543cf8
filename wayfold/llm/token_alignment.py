"""Alignment of two tokenizers' ids: smallest groups of tokens with common ends, and how many documents link two ids.

Two tokens of the two sides overlap if they share a byte. The connected components of this bipartite graph are
exactly the smallest groups: where tokens of both sides end, nothing overlaps across, and between two such places every end
lies inside a token of the other side. ``components`` is a union-find over all overlaps of many texts at once. A group links each
of its one side's tokens with each of the other's.

Texts are cut where both tokenizers always end a token (see ``_bpe``), and each distinct chunk is tokenized and aligned once while
it is remembered. ``portions`` turns about ``PORTION`` bytes of documents into one row: what the documents
hold, by chunks, and the distinct pairs of ids with the number of the portion's documents that link them. These numbers are summed
by pair over all rows; each portion then asks for its own distinct pairs, and gets every document's sums from them. What is
shuffled is a row for each portion and distinct pair, never an occurrence; a pair that all documents hold has one row a portion.

Cases: null and empty texts, and those whose tokens of either side don't give the text back byte by byte, have no tokens: zeros,
and '' as digest. Rows of one doc_id are documents of their own; extra columns are ignored; an empty table gives
an empty result. A group of very many tokens is expanded by its distinct ids, never by its occurrences. A text longer
than ``PORTION`` is a portion of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _bpe
from wayfold.llm._shared import BLOB_ROWS, keep, released, small_batches

PORTION = 8 << 20
#: Groups of more links than this are expanded by distinct ids.
LINKS = 256


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is connected with by the edges (a, b): roots are hung under smaller roots, then paths halved."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low < high
        if not open_.any():
            return parent
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of either side, and the number of groups; both sides end at the same byte."""
    cuts = np.union1d(ends_a, ends_b)
    n = len(ends_a)
    root = components(n + len(ends_b), np.searchsorted(ends_a, cuts), n + np.searchsorted(ends_b, cuts))
    first = root[:n] == np.arange(n)  # a group's least node is its first token of the one side
    number = np.cumsum(first) - 1
    return number[root[:n]], number[root[n:]], int(first.sum())


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(first) else value


def expanded(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of some rows of a table in compressed rows, and for each the number of its row among ``rows``."""
    n = ptr[rows + 1] - ptr[rows]
    of = np.repeat(np.arange(len(rows)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + ptr[rows][of], of


class Aligned:
    """Chunks by number: how many tokens, groups and links each has, its digest's text, and its links (pair, times)."""

    def __init__(self, vocabulary: str, pieces: str, most: int = 600_000) -> None:
        import sentencepiece

        one = _bpe.tokenizer(vocabulary)
        other = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.tokens_a = _bpe.token_bytes(one)
        self.tokens_b = [bytes([int(p[3:5], 16)]) if other.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(other.id_to_piece(list(range(other.vocab_size()))))]
        self.sizes_a, self.sizes_b = _bpe.lengths(self.tokens_a), _bpe.lengths(self.tokens_b)
        self._a = lambda t: one.encode_batch_fast([t], add_special_tokens=False)[0].ids
        self._b = lambda t: other.encode(t[1:], num_threads=1)  # it adds the space itself
        self.width = len(self.tokens_b)
        self.most = most
        digits = [str(i).encode() for i in range(max(len(self.tokens_a), self.width))]
        self.digits = np.zeros((len(digits), len(digits[-1]) + 1), np.uint8)
        self.n_digits = np.array([len(d) for d in digits])
        for k in np.unique(self.n_digits):
            own = np.flatnonzero(self.n_digits == k)
            self.digits[own, :k] = np.frombuffer(b"".join(digits[i] for i in own), np.uint8).reshape(-1, k)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # -1: its tokens don't give it back
        self.loose: set[str] = set()  # odd parts seen; some are chunks as well, where a text ends with them
        self.text: list[bytes] = []
        self.stats = np.zeros((1 << 16, 4), np.int64)
        self.ptr = np.zeros((1 << 16) + 1, np.int64)
        self.pair, self.times = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _room(self, n: int, m: int) -> None:
        while len(self.stats) < n:
            self.stats, self.ptr = np.concatenate([self.stats, np.zeros_like(self.stats)]), np.concatenate([self.ptr, np.zeros(len(self.stats), np.int64)])
        while len(self.pair) < m:
            self.pair, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pair, self.times))

    def learn(self, found: list[str]) -> None:
        for lo in range(0, len(found), 8 * _bpe.TOGETHER):
            some = found[lo : lo + 8 * _bpe.TOGETHER]
            a, b = _bpe.encode_chunks(some, self._a, self.sizes_a), _bpe.encode_chunks(some, self._b, self.sizes_b)
            if not self._same(some, a[0], self.tokens_a) or not self._same(some, b[0], self.tokens_b):
                own = lambda ids, at, i: ids[at[i] : at[i + 1]]
                bad = {w for i, w in enumerate(some) if not self._same([w], own(*a, i), self.tokens_a) or not self._same([w], own(*b, i), self.tokens_b)}
                self.number |= dict.fromkeys(bad, -1)
                self.learn([w for w in some if w not in bad])
            else:
                self._add(some, *a, *b)

    @staticmethod
    def _same(found: list[str], ids: np.ndarray, tokens: list[bytes]) -> bool:
        return b"".join(map(tokens.__getitem__, ids.tolist())) == "".join([f" {w}" for w in found]).encode()

    def _add(self, found: list[str], ids_a: np.ndarray, at_a: np.ndarray, ids_b: np.ndarray, at_b: np.ndarray) -> None:
        n, base = len(found), len(self.text)
        if not n:
            return
        of_a, of_b = np.repeat(np.arange(n), np.diff(at_a)), np.repeat(np.arange(n), np.diff(at_b))
        in_a, in_b, n_groups = groups(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]))
        m_a, m_b = np.bincount(in_a, minlength=n_groups), np.bincount(in_b, minlength=n_groups)
        chunk = np.zeros(n_groups, np.int64)  # no group reaches over two chunks
        chunk[in_a] = of_a
        stats = np.stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(chunk, minlength=n), np.zeros(n, np.int64)], axis=1)
        np.add.at(stats[:, 3], chunk, m_a * m_b)
        # links of small groups by occurrences; each token of the one side meets the other's run
        first_a, first_b = np.cumsum(m_a) - m_a, np.cumsum(m_b) - m_b
        small = m_a * m_b <= LINKS
        own = np.flatnonzero(small[in_a])
        ptr_b = np.append(first_b, len(ids_b))
        to, of = expanded(ptr_b, in_a[own])
        space = len(self.tokens_a) * self.width
        keys, times = [of_a[own][of] * space + ids_a[own][of] * self.width + ids_b[to]], [np.ones(len(to), np.int64)]
        for g in np.flatnonzero(~small):  # by distinct ids
            x, k = np.unique(ids_a[first_a[g] : first_a[g] + m_a[g]], return_counts=True)
            y, j = np.unique(ids_b[first_b[g] : first_b[g] + m_b[g]], return_counts=True)
            keys.append((chunk[g] * space + x[:, None] * self.width + y).ravel())
            times.append((k[:, None] * j).ravel())
        key, count = _summed(np.concatenate(keys), np.concatenate(times))
        # the digest's text: a group's one side, then its other side
        place_a, place_b = np.arange(len(ids_a)) + first_b[in_a], np.arange(len(ids_b)) + (first_a + m_a)[in_b]
        ids, mark = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark[place_a[first_a + m_a - 1]], mark[place_b[first_b + m_b - 1]] = ord("|"), ord(";")
        cells, size = self.digits[ids], self.n_digits[ids]
        cells[np.arange(len(ids)), size] = mark
        raw = cells[np.arange(cells.shape[1]) <= size[:, None]].tobytes()
        ends = np.cumsum(np.bincount(np.append(of_a, of_b), np.append(size[place_a], size[place_b]) + 1, n)).astype(np.int64).tolist()

        at = int(self.ptr[base])
        self._room(base + n, at + len(key))
        self.stats[base : base + n] = stats
        self.pair[at : at + len(key)], self.times[at : at + len(key)] = key % space, count
        self.ptr[base + 1 : base + n + 1] = at + np.searchsorted(key, np.arange(1, n + 1) * space)
        self.text += [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        self.number.update(zip(found, range(base, base + n), strict=True))

    def chunked(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's chunks; none where its tokens don't give it back."""
        cut = [t.split(" ") if t else [] for t in texts]
        found = set().union(*cut)
        new = found.difference(self.number)
        self.loose.update(w for w in new if _bpe.odd(w))
        loose = self.loose & found  # known ones, too, belong to their neighbours
        if loose:
            cut = [x if loose.isdisjoint(x) else _bpe.chunks(x) for x in cut]
            new = set().union(*cut).difference(self.number)
        self.learn(list(new))
        get, out = self.number.__getitem__, []
        for text, x in zip(texts, cut, strict=True):
            own = list(map(get, x))
            if -1 in own:  # decided by the whole text
                if text not in self.number:
                    self.learn([text])
                own = [self.number[text]] if self.number[text] >= 0 else []
            out.append(own)
        return out


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


_ROW = "portion long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs binary, docs binary, words binary, word_pairs binary, word_times binary, doc_words binary, held binary, held_times binary"


def portions(docs: DataFrame, vocabulary: str, pieces: str, most: int = 600_000) -> DataFrame:
    """A row for about ``PORTION`` bytes of documents; arrays are packed 64-bit or 32-bit numbers."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in _ROW.split(", ")]
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 8]

    def made(aligned: Aligned, number: int, ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        if len(aligned.number) > aligned.most:
            aligned.clear()
        found: list[list[int]] = []
        for lo in range(0, len(texts), 64):
            found += aligned.chunked(texts[lo : lo + 64])
        digests = [hashlib.sha256(b"".join(map(aligned.text.__getitem__, own))[:-1]).hexdigest() if own else "" for own in found]
        size = np.array([len(own) for own in found], np.int64)
        word = np.fromiter((w for own in found for w in own), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(found)), size)
        stats = np.stack([np.bincount(doc, aligned.stats[word, k], len(found)).astype(np.int64) for k in range(3)] + [np.zeros(len(found), np.int64)])
        np.add.at(stats[3], doc, aligned.stats[word, 3])
        # what each document holds: distinct chunks and how often
        key, held_times = np.unique(doc << 32 | word, return_counts=True)
        of, held = key >> 32, key & 0xFFFFFFFF
        words, held = np.unique(held, return_inverse=True)
        at, of_word = expanded(aligned.ptr, words)
        pairs, own = np.unique(aligned.pair[at], return_inverse=True)
        ptr = np.concatenate([[0], np.cumsum(np.bincount(of_word, minlength=len(words)))]).astype(np.int64)
        # distinct pairs of each document, some documents at a time
        n_docs, doc_words = np.zeros(len(pairs), np.int64), np.searchsorted(of, np.arange(len(found) + 1))
        total = np.concatenate([[0], np.cumsum(ptr[held + 1] - ptr[held])])
        lo = 0
        while lo < len(found):
            hi = max(lo + 1, int(np.searchsorted(total[doc_words], total[doc_words[lo]] + (1 << 21), "right")) - 1)
            some = held[doc_words[lo] : doc_words[hi]]
            to, row = expanded(ptr, some)
            n_docs += np.bincount(np.unique((of[doc_words[lo] : doc_words[hi]][row] - lo) * len(pairs) + own[to]) % max(len(pairs), 1), minlength=len(pairs))
            lo = hi
        columns = [number, ids, *(stats[k].tolist() for k in range(4)), digests]
        columns += [_packed(x.astype(kind)) for x, kind in ((pairs, "<i8"), (n_docs, "<i8"), (ptr, "<i8"), (own, "<u4"), (aligned.times[at], "<i8"), (doc_words, "<i8"), (held, "<u4"), (held_times, "<i8"))]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, number = None, TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            aligned = aligned or Aligned(vocabulary, pieces, most)
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held + len(text or "") > PORTION:
                    yield made(aligned, number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text or "")
                held += len(text or "")
        if ids:
            yield made(aligned, number, ids, texts)
        aligned = None
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


def _pairs(rows: DataFrame) -> DataFrame:
    """(portion, pair, n) of packed portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, n = _unpacked(pairs, "<i8"), _unpacked(docs, "<i8")
                for lo in range(0, len(pair), 1 << 14):
                    cut = slice(lo, lo + (1 << 14))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[cut]), number)), pa.array(pair[cut]), pa.array(n[cut])], ["portion", "pair", "n"])

    return rows.select("portion", "pairs", "docs").mapInArrow(run, "portion long, pair long, n long")


def align(docs: DataFrame, vocabulary: str, pieces: str, width: int | None = None, most: int = 600_000) -> tuple[DataFrame, DataFrame]:
    """The documents' sums, and the table of pairs: (a, b, n, best), n the documents that link them, best if no other b has more for a."""
    if width is None:
        import sentencepiece

        width = sentencepiece.SentencePieceProcessor(model_file=pieces).vocab_size()
    made = keep(portions(docs, vocabulary, pieces, most), "portions", BLOB_ROWS)
    summed = _pairs(made).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / width))
    summed = keep(summed, "pairs", BLOB_ROWS)
    highest = summed.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    counts = keep(summed.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        pair, n, best = (right.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        n, best = n[order], best[order].astype(np.int64)
        ptr, own, times = _unpacked(row["words"], "<i8"), _unpacked(row["word_pairs"], "<u4"), _unpacked(row["word_times"], "<i8")
        doc_words, held, held_times = _unpacked(row["doc_words"], "<i8"), _unpacked(row["held"], "<u4"), _unpacked(row["held_times"], "<i8")

        def sums(of_pair: np.ndarray) -> np.ndarray:
            by_word = np.append(0, np.cumsum(times * of_pair[own]))
            by_word = by_word[ptr[1:]] - by_word[ptr[:-1]]
            by_doc = np.append(0, np.cumsum(held_times * by_word[held]))
            return by_doc[doc_words[1:]] - by_doc[doc_words[:-1]]

        columns = [pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        columns += [pa.array(sums(best)), pa.array(sums(n)), pa.array(row["groups_sha256"], pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    asked = _pairs(made).select("portion", "pair").join(counts, "pair").groupBy("portion")
    sums = made.drop("pairs", "docs").groupBy("portion").cogroup(asked)
    result = sums.applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    pairs = counts.select(F.floor(F.col("pair") / width).cast("int").alias("a"), (F.col("pair") % width).cast("int").alias("b"), "n", "best")
    return result, pairs

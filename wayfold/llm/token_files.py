"""Token ids in files of Simple-8b words: written by tasks, read back block by block.

A 64-bit word holds a selector of four bits above 60 bits of payload; the selector says how many ids of which
width the payload has (``SELECTORS``). An id of over 60 bits is an escape: its word holds its number
among the block's escapes, which follow the block's words as they are. ``BLOCK`` ids make a block, whose
first word has the numbers of its words and of its escapes; a file's footer has each block's offset, so any block
can be decoded without the ones before it, and all words of a selector are decoded together.

A file: the blocks; offsets of blocks in words, one more than blocks; document ids; a byte for each document, 1 where its
id is null; lengths of documents, coded like ids; their blocks' offsets; the trailer ``TRAILER``. All little-endian.

``write`` deals documents out by ranges of (doc_id, hash of the text, row), so files are in ascending order of doc_id,
null ids first, and neither repeated ids nor equal rows fill one task. A task encodes and writes its own file in the
storage that ``path`` names, under a new name for each attempt; the table ``manifest`` beside the files is committed by
Spark when all tasks are through, and only files that it names count. So a lost executor costs a task, and a failed
job leaves nothing that can be read. No row goes through the driver.

Cases: null and empty texts are the end id alone. Rows of one doc_id are documents of their own, ordered by a hash of the text.
Equal rows are kept, extra columns ignored. Very long texts take the memory of their own ids. An empty table gives a manifest without
files, and reading it gives no rows. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm import _bpe
from wayfold.llm._shared import parts, small_batches

#: Ids and bits of each, by selector. Selector 0 is the escape.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 512
TRAILER, MAGIC = struct.Struct("<QQQQ8s"), b"WAYS8B01"

_COUNT = np.array([c for c, _ in SELECTORS])
_LIMITS = np.array([1 << w for _, w in SELECTORS[1:]], np.uint64)
_MOST = int(_COUNT.max())
_LEVEL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.int8)
_FOUR = np.uint64(60)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks of ``values``, and where each block begins, with the end."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, "<u8"), np.zeros(1, np.int64)
    held = np.zeros((blocks, BLOCK + _MOST), np.uint64)  # what a word lacks at a block's end is zeros
    whole = n // BLOCK
    held[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    held[whole:, : n - whole * BLOCK] = values[whole * BLOCK :]
    # the first selector, less one, whose width holds it
    level = np.zeros(held.shape, np.int8)
    level[:, :BLOCK] = _LEVEL[held[:, :BLOCK]] if held.max() < len(_LEVEL) else np.searchsorted(_LIMITS, held[:, :BLOCK], "right")
    # a selector that fits has more ids than all later ones, and these fit as well: only blocks where one fits need the one before it
    last = len(SELECTORS) - 1
    chosen = np.where(level[:, :BLOCK] < last, np.int8(last), np.int8(0))
    every = min(last, int(level.max()) + 1)
    if every < last:
        chosen[:] = every
    some = np.arange(blocks)
    for s in range(every - 1, 0, -1):
        over, n_seen = level[some] > s - 1, 1  # any too wide among the next n_seen
        while n_seen < _COUNT[s]:
            more = min(n_seen, int(_COUNT[s]) - n_seen)
            over, n_seen = over[:, :-more] | over[:, more:], n_seen + more
        fits = ~over[:, :BLOCK]
        own = chosen[some]
        own[fits] = s
        chosen[some] = own
        some = some[fits.any(axis=1)]
        if not len(some):
            break
    # all blocks take their next word together
    live, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(live):
        s = chosen[live, at]
        steps.append((live, at, s))
        at = at + _COUNT[s]
        on = at < np.minimum(BLOCK, n - live * BLOCK)
        live, at = live[on], at[on]
    block, at, s = (np.concatenate([x[k] for x in steps]) for k in range(3))
    step = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
    n_words, n_escapes = np.bincount(block, minlength=blocks), np.bincount(block[s == 0], minlength=blocks)
    offsets = np.concatenate([[0], np.cumsum(1 + n_words + n_escapes)])
    words = np.zeros(offsets[-1], "<u8")
    words[offsets[:-1]] = n_words.astype(np.uint64) | (n_escapes.astype(np.uint64) << np.uint64(32))
    target = offsets[block] + 1 + step
    for k in np.unique(s):
        (count, width), own = SELECTORS[k], np.flatnonzero(s == k)
        if k == 0:
            own = own[np.lexsort((at[own], block[own]))]
            number = np.arange(len(own)) - np.concatenate([[0], np.cumsum(n_escapes)])[block[own]]
            words[target[own]] = number
            words[offsets[block[own]] + 1 + n_words[block[own]] + number] = held[block[own], at[own]]
        elif width:
            some = held[block[own, None], at[own, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(width))
            words[target[own]] = np.bitwise_or.reduce(some, axis=1) | (np.uint64(k) << _FOUR)
        else:
            words[target[own]] = np.uint64(k) << _FOUR
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of consecutive whole blocks; ``offsets`` where each begins in ``words``, with the end."""
    blocks = len(offsets) - 1
    out = np.zeros((blocks, BLOCK + _MOST), np.uint64)
    heads = words[offsets[:-1]]
    n_words = (heads & np.uint64(0xFFFFFFFF)).astype(np.int64)
    block = np.repeat(np.arange(blocks), n_words)
    first = np.concatenate([[0], np.cumsum(n_words)])
    source = offsets[block] + 1 + np.arange(first[-1]) - first[block]
    w = words[source]
    s = (w >> _FOUR).astype(np.int8)
    before = np.concatenate([[0], np.cumsum(_COUNT[s])])
    at = before[:-1] - before[first[block]]
    for k in np.unique(s):
        (count, width), own = SELECTORS[k], np.flatnonzero(s == k)
        if k == 0:
            out[block[own], at[own]] = words[offsets[block[own]] + 1 + n_words[block[own]] + w[own].astype(np.int64)]
        elif width:
            mask = np.uint64((1 << width) - 1)
            out[block[own, None], at[own, None] + np.arange(count)] = (w[own, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & mask
    return out[:, :BLOCK].reshape(-1)[:n]


class Texts:
    """Ids of whole texts by a byte-level vocabulary; those of chunks are kept, in two generations of bounded size.

    A chunk is remembered as it is if a space comes before it, and behind a space if none does. A line feed between two
    characters other than white space is a token run of its own: it begins a chunk too, which is remembered with it.
    """

    def __init__(self, vocabulary: str, most: int = 600_000) -> None:
        self.tokenizer = _bpe.tokenizer(vocabulary)
        self.sizes = _bpe.lengths(_bpe.token_bytes(self.tokenizer))
        self.most = most
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.feed = self._whole(["\n"])[0]
        own = _bpe.of_letters(self.tokenizer)
        self._of_letters = lambda t: own(t.replace(" ", "\n ")[1:])
        self._of_first = lambda t: own(t.replace(" ", "\n"))
        self._of_text = lambda t: self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, found: list[str]) -> None:
        """Ids of new chunks, by the pattern's own cuts: at line feeds between two other characters and before marks behind a last letter.
        Words of letters alone need no pattern."""
        now, old, todo, seen = self.now, self.old, list(found), set(found)
        fed, lines, marked, letters, first, other = [], [], [], [], [], []

        def want(w: str) -> str:
            if w not in now and w not in seen:
                seen.add(w)
                todo.append(w)
            return w

        for w in todo:  # which grows
            if w in old:
                now[w] = old[w]
            elif w.isalpha():
                (letters if w.isascii() or _bpe.lettered(w) else other).append(w)
            elif w[0] == "\n":
                fed.append((w, want(f" {w[1:]}")))
            elif "\n" in w and (cut := _by_line(w)):
                lines.append((w, [want(x) for x in cut[::2]], cut[1::2]))
            elif (base := _bpe.ended(w)) is not w:
                marked.append((w, want(base), w[len(base) :]))
            else:
                (first if w[0] == " " and _bpe.lettered(w[1:]) else other).append(w)
        spaced = [w for w in other if w[0] != " "]
        for new, ids, space in ((letters, self._of_letters, " "), ([w[1:] for w in first], self._of_first, ""), (spaced, self._of_text, " ")):
            raw, bounds = _bpe.encode_chunks(new, ids, self.sizes, space)
            bounds = (4 * bounds).tolist()
            raw = raw.astype("<u4").tobytes()
            now.update(zip(new if space else first, [raw[s:e] for s, e in zip(bounds, bounds[1:], strict=False)], strict=False))
        if len(spaced) < len(other):
            bare = [w for w in other if w[0] == " "]
            now.update(zip(bare, self._whole([w[1:] for w in bare]), strict=True))
        if ends := list({e for _, _, e in marked}.difference(self.ends)):
            self.ends.update(zip(ends, self._whole(ends), strict=True))
        for w, base, end in marked:
            now[w] = now[base] + self.ends[end]
        for w, rest in fed:
            now[w] = self.feed + now[rest]
        feeds = {x: self._whole([x[:-1]])[0] + self.feed for x in {x for _, _, gaps in lines for x in gaps}}  # of many the last stands apart
        for w, some, gaps in lines:
            now[w] = now[some[0]] + b"".join([feeds[x] + now[y] for x, y in zip(gaps, some[1:], strict=True)])

    def encode(self, texts: list[str] | pa.Array | pa.ChunkedArray) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        found = _bpe.strings(texts)
        words, index, bounds = _bpe.numbered(pc.split_pattern(pc.replace_substring(found, "\n", " \n"), " "))
        got = list(map(self.now.get, words))
        loose = np.zeros(len(words), bool)
        loose[[k for k, v in enumerate(got) if v is None and not words[k].isalpha() and _bpe.odd(words[k].removeprefix("\n"))]] = True
        heads = [words[k] for k in index[bounds[:-1]].tolist()]
        again = set((np.searchsorted(bounds, np.flatnonzero(loose[index]), "right") - 1).tolist())
        again.update(i for i, h in enumerate(heads) if _bpe.odd(h))
        more: dict[str, int] = {}
        pieces, at, sizes = [], 0, np.diff(bounds)
        for i in sorted(again):
            heads[i], *own = _bpe.chunks(found[i].as_py().split(" "))
            pieces += [index[at : bounds[i]], np.array([0, *(more.setdefault(w, len(words) + len(more)) for w in own)], index.dtype)]
            at, sizes[i] = bounds[i + 1], 1 + len(own)
        index, bounds = np.concatenate([*pieces, index[at:]]), np.concatenate([[0], np.cumsum(sizes)])
        index[bounds[:-1]] = [more.setdefault(f" {h}", len(words) + len(more)) for h in heads]
        words += more
        got += map(self.now.get, more)
        used = np.bincount(index, minlength=len(words)).tolist()
        lacking = [k for k, v in enumerate(got) if v is None and used[k]]
        if len(self.now) + len(lacking) > self.most:
            self.old, self.now = self.now, {}
        self._learn([words[k] for k in lacking])
        for k in lacking:
            got[k] = self.now[words[k]]
        return _bpe.taken(got, index, bounds)


def _by_line(word: str) -> list[str] | None:
    """What line feeds cut, as it is remembered, and the line feeds between; nothing where other white space touches them."""
    cut = re.split("(\n+)", word)
    if not all(cut) or any(x[-1].isspace() for x in cut[:-1:2]) or any(x[0].isspace() for x in cut[2::2]):
        return None
    cut[2::2] = [f" {x}" for x in cut[2::2]]
    return cut


@lru_cache(1)
def texts_of(vocabulary: str) -> Texts:
    """One for each worker process, so that a task knows what earlier ones have learned."""
    return Texts(vocabulary)


class _Writer:
    """One file: ids come in, whole blocks go out once a million ids are held."""

    def __init__(self, path: str, name: str) -> None:
        storage, base = fs.FileSystem.from_uri(path)
        storage.create_dir(base, recursive=True)
        self.out = storage.open_output_stream(f"{base}/{name}")
        self.held: list[bytes] = []
        self.n_held = self.n_ids = self.at = 0
        self.offsets: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= 1 << 20:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        raw = b"".join(self.held)
        words, offsets = encode(np.frombuffer(raw, "<u4", n).astype(np.uint64))
        self.out.write(words.tobytes())
        self.offsets.append(offsets[:-1] + self.at)
        self.at += len(words)
        self.n_ids += n
        self.n_held -= n
        self.held = [raw[4 * n :]]

    def close(self) -> tuple[int, int]:
        self._flush(self.n_held)
        offsets = np.concatenate([*self.offsets, [self.at]]).astype("<u8")
        words, of_lengths = encode(np.array(self.lengths, np.uint64))
        self.out.write(offsets.tobytes())
        self.out.write(np.array([x or 0 for x in self.ids], "<i8").tobytes())
        self.out.write(bytes(x is None for x in self.ids))
        self.out.write(words.tobytes())
        self.out.write(of_lengths.astype("<u8").tobytes())
        self.out.write(TRAILER.pack(self.n_ids, len(self.ids), len(offsets) - 1, len(words), MAGIC))
        self.out.close()
        return len(self.ids), self.n_ids


MANIFEST = "part int, file string, n_docs long, n_ids long"


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 0, files: int | None = None) -> None:
    """Encode ``text`` of each row by ``vocabulary``, add the id ``end``, and write all ids in ascending order of ``doc_id``."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, out = None, None
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.s8b"
        tail = np.array([end], "<u4").tobytes()
        for rows in _bpe.gathered(batches):
            texts, out = texts or texts_of(vocabulary), out or _Writer(path, name)
            for doc_id, own in zip(rows.column(0).to_pylist(), texts.encode(rows.column(1)), strict=True):
                out.add(doc_id, own + tail)
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])], ["part", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(files or parts(spark), "doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie", "_row")
    dealt.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")


def _blocks(path: str, name: str, start: int, most: int = 2048) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[bytes]]]:
    """Documents of a file in turn: ids, starts, lengths and packed token ids, about a million ids at a time."""
    storage, base = fs.FileSystem.from_uri(path)
    with storage.open_input_file(f"{base}/{name}") as f:
        size = f.size()
        n_ids, n_docs, n_blocks, n_words, magic = TRAILER.unpack(f.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        of_lengths = -(-n_docs // BLOCK) + 1
        foot = 8 * (n_blocks + 1) + 9 * n_docs + 8 * (n_words + of_lengths)
        raw, at = f.read_at(foot, size - TRAILER.size - foot), 0
        taken = []
        for kind, n in (("<u8", n_blocks + 1), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_words), ("<u8", of_lengths)):
            taken.append(np.frombuffer(raw, kind, n, at))
            at += taken[-1].nbytes
        offsets, ids, nulls, words, by_block = taken
        offsets = offsets.astype(np.int64)
        sizes = decode(words, by_block.astype(np.int64), n_docs).astype(np.int64)
        ends = np.cumsum(sizes)
        rest, doc = b"", 0
        for b in range(0, n_blocks, most):
            own = offsets[b : min(b + most, n_blocks) + 1]
            words = np.frombuffer(f.read_at(8 * int(own[-1] - own[0]), 8 * int(own[0])), "<u8")
            upto = min((b + most) * BLOCK, n_ids)
            rest += decode(words, own - own[0], upto - b * BLOCK).astype("<u4").tobytes()
            last = int(np.searchsorted(ends, upto, "right"))
            if last > doc:
                n, first = sizes[doc:last], int(ends[doc] - sizes[doc])
                cuts = 4 * (ends[doc:last] - first)
                yield [None if x else int(i) for i, x in zip(ids[doc:last], nulls[doc:last], strict=True)], start + ends[doc:last] - n, n, [rest[c - 4 * k : c] for c, k in zip(cuts.tolist(), n.tolist(), strict=True)]
                rest, doc = rest[int(cuts[-1]) :], last


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document; start counts all ids of the documents before it."""
    small_batches(spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for ids, starts, n, raw in _blocks(path, name, start):
                    for lo in range(0, len(ids), 256):
                        cut = slice(lo, lo + 256)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[cut], pa.int64()), pa.array(starts[cut]), pa.array(n[cut]), pa.array(raw[cut], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.repartition(parts(spark), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

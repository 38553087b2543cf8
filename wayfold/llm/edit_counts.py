"""Token counts kept up to date under edits.

For each document a segment tree is kept over its pre-tokens: a leaf holds the lengths and token
counts of a run of pre-tokens, an inner node the sums of characters, pre-tokens and tokens below. ``build`` makes the trees,
as packed columns of a table that can be written; ``apply`` takes such a table, edits trees without encoding their texts
again, and returns them with their new counts, ready for the next edits. An edit finds
its place by descending the character sums, goes back over a few characters of context, and
splits and encodes from there until a new boundary meets an old one after the edit; all
else keeps its counts, and only the sums above the touched leaves change.

A boundary's match depends on the text after it only, and a match on at most ``context``
characters after its end, so the result is that of encoding the edited text anew. How many characters that are
follows from the pattern; ``CONTEXTS`` lists the patterns for which it has been shown, others are refused.

Cases: null text counts as empty; it can be edited. Edits (start, removed, inserted) apply in order, each to
the result of the one before; start and removed are cut to the text's ends, null fields count as 0 or nothing. Repeated rows and ids
are documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm._shared import small_batches

#: SHA-256 of a pattern: characters after a pre-token that its match can look at. The byte-level pattern of
#: contractions, letters, digits, other signs and white space looks at an apostrophe and two letters.
CONTEXTS = {"eeb55ba74cc544ae7067587b680d16521d9891de9e94c7ba9412c0e0e93b1c36": 3}
LEAF, MOST = 64, 256  #: pre-tokens in a new leaf, and in any


class Counter:
    """Pre-tokens of a text and token counts of pre-tokens, in a memo of two generations of bounded size."""

    def __init__(self, ranks: str, pattern: str, most: int = 400_000) -> None:
        import tiktoken

        self.context = CONTEXTS.get(hashlib.sha256(pattern.encode()).hexdigest())
        if self.context is None:
            raise ValueError("it is not known how far this pattern looks ahead; see CONTEXTS")
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.most, self.now, self.old, self.encoded = most, {}, {}, 0

    def counts(self, pieces: list[str]) -> list[int]:
        now = self.now
        for p in set(pieces).difference(now):
            now[p] = self.old[p] if p in self.old else len(self.encoding.encode_ordinary(p))
        out = [now[p] for p in pieces]
        if len(now) > self.most:
            self.old, self.now = now, {}
        return out


def _packed(values: list[int]) -> bytes:
    """Unsigned numbers of 1 or 4 bytes, whichever is needed; the first byte tells."""
    kind = "B" if max(values, default=0) < 256 else "I"
    a = array(kind, values)
    if sys.byteorder == "big":
        a.byteswap()
    return kind.encode() + a.tobytes()


def _unpacked(raw: bytes) -> list[int]:
    a = array(chr(raw[0]))
    a.frombytes(raw[1:])
    if sys.byteorder == "big":
        a.byteswap()
    return a.tolist()


class Tree:
    """A document's text and the segment tree of its pre-tokens."""

    def __init__(self, text: str, counter: Counter, kept: tuple[bytes, bytes, bytes] | None = None) -> None:
        """From the text, or from what :meth:`kept` gave, without encoding anything."""
        self.text, self.counter, self.encoded = text, counter, 0
        if kept is None:
            pieces = counter.pattern.findall(text)
            self._build(list(map(len, pieces)), counter.counts(pieces))
        else:
            lengths, counts, sizes = (_unpacked(x) for x in kept)
            lengths, counts = iter(lengths), iter(counts)
            self._over([(list(islice(lengths, n)), list(islice(counts, n))) for n in sizes])

    def kept(self) -> tuple[bytes, bytes, bytes]:
        """Lengths and counts of all pre-tokens and the sizes of the leaves, packed."""
        return tuple(_packed(x) for x in ([v for x, _ in self.leaves for v in x], [v for _, n in self.leaves for v in n], [len(x) for x, _ in self.leaves]))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self._over([(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])])

    def _over(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        self.leaves = leaves
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.width)
        for i, (x, n) in enumerate(self.leaves):
            self.sums[self.width + i] = sum(x), len(x), sum(n)
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = tuple(map(sum, zip(self.sums[2 * i], self.sums[2 * i + 1], strict=True)))

    @property
    def tokens(self) -> int:
        return self.sums[1][2]

    @property
    def pretokens(self) -> int:
        return self.sums[1][1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last leaf at the end), and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place >= before + self.sums[node][0] and self.sums[node + 1][1]:
                before += self.sums[node][0]
                node += 1
        return node - self.width, before

    def edit(self, start: int, removed: int, inserted: str) -> None:
        context = self.counter.context
        start = min(max(start, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - start)
        old_end, shift = start + removed, len(inserted) - removed
        self.text = self.text[:start] + inserted + self.text[old_end:]
        # the last boundary whose pre-token, and what its match looked at, lie before the edit
        first, begin = self._leaf_at(max(0, start - context))
        while first and not (self.leaves[first][0] and begin + self.leaves[first][0][0] + context <= start):
            first -= 1
            begin -= self.sums[self.width + first][0]
        lengths, counts = self.leaves[first]
        kept, place = 0, begin
        while kept < len(lengths) and place + lengths[kept] + context <= start:
            place += lengths[kept]
            kept += 1
        new_lengths, pieces = lengths[:kept], []
        # old boundaries from the end of the edit on, leaf by leaf
        last, index, old = first, kept, place
        new = place
        for match in self.counter.pattern.finditer(self.text, place):
            pieces.append(match.group())
            new = match.end()
            while old < new - shift or old < old_end:
                while index >= len(self.leaves[last][0]) and last + 1 < len(self.leaves):
                    last, index = last + 1, 0
                if index >= len(self.leaves[last][0]):
                    break
                old += self.leaves[last][0][index]
                index += 1
            if old >= old_end and old == new - shift and new >= start + len(inserted):
                break
        else:
            last, index = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.encoded += len(pieces)
        rest = self.leaves[last]
        merged = new_lengths + list(map(len, pieces)) + rest[0][index:], counts[:kept] + self.counter.counts(pieces) + rest[1][index:]
        self.leaves[first] = merged
        for i in range(first + 1, last + 1):
            self.leaves[i] = [], []
        if len(merged[0]) > MOST:
            lengths, counts = ([x for leaf in self.leaves for x in leaf[k]] for k in (0, 1))
            self._build(lengths, counts)
            return
        touched = range(first, last + 1)
        for i in touched:
            x, n = self.leaves[i]
            self.sums[self.width + i] = sum(x), len(x), sum(n)
        nodes = {(self.width + i) // 2 for i in touched}
        while nodes - {0}:
            for i in nodes:
                self.sums[i] = tuple(map(sum, zip(self.sums[2 * i], self.sums[2 * i + 1], strict=True)))
            nodes = {i // 2 for i in nodes if i > 1}


_TREE = "doc_id long, text string, lengths binary, counts binary, leaves binary, pretokens long, tokens long"
_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())


def build(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, text, lengths, counts, leaves, pretokens, tokens): the tree of every row of ``docs``, packed."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = Tree(text or "", counter)
                rows.append((doc, tree.text, *tree.kept(), tree.pretokens, tree.tokens))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], ["doc_id", "text", "lengths", "counts", "leaves", "pretokens", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TREE)


def apply(trees: DataFrame, edits: Column, ranks: str, pattern: str) -> DataFrame:
    """The trees after ``edits``, an array of (start int, removed int, inserted string) for each row.

    The columns of ``build`` and n_edits, pretokens_before, tokens_before, reencoded (pre-tokens that were encoded).
    """
    small_batches(trees.sparkSession)
    names = ["doc_id", "text", "lengths", "counts", "leaves", "pretokens", "tokens", "n_edits", "pretokens_before", "tokens_before", "reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for batch in batches:
            rows = []
            for doc, text, *kept, before, tokens, changes in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                tree = Tree(text, counter, tuple(kept))
                changes = [c for c in changes or [] if c is not None]
                for c in changes:
                    tree.edit(c["start"] or 0, c["removed"] or 0, c["inserted"] or "")
                rows.append((doc, tree.text, *tree.kept(), tree.pretokens, tree.tokens, len(changes), before, tokens, tree.encoded))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*_KINDS, *[pa.int64()] * 4), strict=True)], names)

    return trees.select("doc_id", "text", "lengths", "counts", "leaves", "pretokens", "tokens", edits.alias("edits")).mapInArrow(run, f"{_TREE}, n_edits long, pretokens_before long, tokens_before long, reencoded long")


def counted(edited: DataFrame) -> DataFrame:
    """The counts that ``apply`` returned: doc_id, n_edits, tokens_before, tokens_after, pretokens_before, pretokens_after, reencoded, n_chars."""
    return edited.select("doc_id", "n_edits", "tokens_before", F.col("tokens").alias("tokens_after"), "pretokens_before", F.col("pretokens").alias("pretokens_after"), "reencoded", F.char_length("text").cast("long").alias("n_chars"))

"""Suffix-array dedup: every byte under a string of ``length`` bytes that occurs anywhere else.

1. Each window of ``length`` bytes belongs to one anchor, the least hash among the 64-byte strings in it, so equal
   windows have equal anchors at equal places. The windows of one anchor occurrence
   are consecutive; the text under them is a fragment of less than twice ``length`` bytes.
2. Anchor occurrences are dealt by anchor hash. An anchor that occurs once has windows that occur once. Of all others,
   each different fragment is compared, with two of its occurrences if it has them: further ones follow (two 64-bit
   hashes, of the anchor and of the whole fragment, tell equal fragments), and get what is decided for these two.
3. Fragments are put into blocks, and each block is sorted as one suffix array in two stages: suffixes smaller
   than their successors are sorted directly, all others are induced by scanning the buckets in order.
   Common prefixes of neighbours show which windows repeat.
4. A frequent anchor's fragments are spread over blocks. Windows that its block leaves alone, and one
   of each kind that repeats there, are dealt by two 64-bit hashes of their own, packed, and meet there.
5. Repeated windows return to their documents.

Matches never cross documents. Every window is decided, on the input; the block size limits memory only.

Cases: null text counts as empty. Texts of any length are cut whole. Texts shorter than ``length`` bytes lose nothing. Repeated rows are occurrences
of their own and lose everything (from ``length`` bytes on). Null ids are kept. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._shared import BLOB_ROWS, keep, small_batches
from wayfold.llm._words import mix, portions, prefix_hash, span_hash


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 64  #: bytes of an anchor, less than ``length``
    fragments: int = 500  #: in one suffix array, about
    occurrences: int = 1_000_000  #: dealt to one task, about


@dataclass
class Anchors:
    """Occurrences: hash, fragment's hash, text number, first and last window, in bytes of its text."""

    hash: np.ndarray
    fragment: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int) -> Anchors:
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Anchors(none.view(np.uint64), none.view(np.uint64), none, none, none)
    sums = prefix_hash(data)
    start = np.arange(len(data) - gram + 1)
    h = span_hash(sums, start, start + gram)
    offsets = np.cumsum([0, *map(len, texts)])
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    chosen = (_least((h >> bits) << bits | start.astype(np.uint64), length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    first = np.arange(len(chosen))
    valid = np.flatnonzero(offsets[text[: len(chosen)] + 1] - first >= length)
    if not len(valid):
        return Anchors(none.view(np.uint64), none.view(np.uint64), none, none, none)
    place, owner = chosen[valid], text[valid]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
    low, high, at = valid[new], valid[np.append(new[1:], len(valid)) - 1], place[new]
    fragment = mix(span_hash(sums, low, high + length) + (at - low).astype(np.uint64))
    return Anchors(h[at], fragment, owner[new], low - offsets[owner[new]], high - offsets[owner[new]])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (small numbers, 0 lowest) in order of their first ``depth`` symbols at least."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(-1)))
    # the type of a run of equal symbols is that of its end
    ends = np.flatnonzero(step != 0)
    smaller = step[ends[np.searchsorted(ends, np.arange(n))]] > 0
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct])
    direct = direct[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    by_symbol = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    if n and not smaller[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        larger = [front]
        while len(front):  # a larger suffix before another one with the same symbol
            front = front[front > 0] - 1
            front = front[text[front] == c]
            larger.append(front)
        bucket = np.concatenate([*larger, direct[by_symbol[c] : by_symbol[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            induced[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order``, ``depth`` at most."""
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 16384):
        a, b = windows[order[i - 1 : i + 16383]][: len(order[i : i + 16384])], windows[order[i : i + 16384]]
        differs = a != b
        out[i : i + len(b)] = np.where(differs.any(1), differs.argmax(1), depth)
    return out


def repeated_windows(fragments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, window, kind) of all windows: equal windows have one kind."""
    joined = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8)
    sizes = np.array([len(f) for f in fragments])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.ones(len(joined), bool)
    inside[starts[1:] - 1] = False
    symbols = np.unique(joined[inside])  # UTF-8 leaves some byte values out, so 0 stays free
    text = np.where(inside, np.searchsorted(symbols, joined) + 1, 0).astype(np.uint8)
    order = suffix_array(text, length)
    owner = np.repeat(np.arange(len(fragments)), sizes + 1)
    left = starts[owner + 1] - 1 - np.arange(len(text))
    whole = left[order] >= length
    new = common_prefixes(text, order, length) < length
    kind = np.cumsum(new)[whole]
    at = order[whole]
    return owner[at], at - starts[owner[at]], kind


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, none (it is null), row (the other columns), key."""
    text, row = F.coalesce("text", F.lit("")), F.struct(*(c for c in docs.columns if c != "text"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("text").isNull().alias("none"), row.alias("row"))
    return found.withColumn("key", F.xxhash64("doc_id", "text"))


_DEALT = "part long, hash binary, fragment binary, key binary, low binary, high binary"
_KINDS = ("<u8", "<u8", "<i8", "<i4", "<i4")
_SPAN = "key long, low int, high int, hash long, fragment long, block long, split boolean, led boolean"


def _spans(key: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray, f: np.ndarray, block: np.ndarray | None = None, split: np.ndarray | None = None, led: np.ndarray | None = None) -> pa.RecordBatch:
    """Fragments whose text is compared in ``block``, ``led``: for others too; without a block, those that follow."""
    n = len(key)
    rest = [pa.nulls(n, k) if x is None else pa.array(x, k) for x, k in ((block, pa.int64()), (split, pa.bool_()), (led, pa.bool_()))]
    known = [pa.array(x, k) for x, k in ((key, pa.int64()), (low, pa.int32()), (high, pa.int32()), (h.view(np.int64), pa.int64()), (f.view(np.int64), pa.int64()))]
    return pa.RecordBatch.from_arrays([*known, *rest], ["key", "low", "high", "hash", "fragment", "block", "split", "led"])


#: Windows on their way to others of their hash; ``asks``: whether it is open if this one repeats.
_WINDOW = np.dtype([("hash", "<u8"), ("more", "<u8"), ("key", "<i8"), ("at", "<i4"), ("asks", "u1")])


_FOUND = ["key", "low", "high", "part", "windows", "hash", "fragment"]


def _runs_of(key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Spans of consecutive windows of a text."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(key) != 0))) if len(at) else order
    last = np.append(first[1:], len(at)) - 1 if len(at) else order
    return pa.RecordBatch.from_arrays([pa.array(key[first], pa.int64()), pa.array(at[first], pa.int32()), pa.array(at[last], pa.int32()), *(pa.nulls(len(first), k) for k in (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], _FOUND)


def _statuses(docs: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """Fragments whose text has to be compared and those that follow; and the number of ranges."""
    length, gram, limit = settings.length, settings.gram, settings.fragments
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size / ((length - gram + 2) / 2) // settings.occurrences) + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            h, f, key, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(h):
                return
            order = np.lexsort((f, h))
            h, f, key, low, high = (x[order] for x in (h, f, key, low.astype("<i4"), high.astype("<i4")))
            nth = _nth(h, f)
            sent = np.flatnonzero(nth < 2)
            part = (h[sent] % np.uint64(ranges)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[by], np.arange(ranges + 1))
            used = [r for r in range(ranges) if bounds[r] < bounds[r + 1]]
            blobs = [[x[sent[by[bounds[r] : bounds[r + 1]]]].tobytes() for r in used] for x in (h, f, key, low, high)]
            names = ["part", "hash", "fragment", "key", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], names)
            rest = np.flatnonzero(nth >= 2)
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *(pa.array([x[rest].tobytes()], pa.binary()) for x in (h, f, key, low, high))], names)

        for batch in batches:
            keys = batch.column(1).to_numpy()
            for first, some in portions(batch.column(0).to_pylist()):
                a = anchors(some, length, gram)
                held.append((a.hash, a.fragment, keys[first + a.text], a.low, a.high))
                count += len(a.hash)
            if count > 1_000_000:
                yield from out()
                held, count = [], 0
        if held:
            yield from out()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r, *blobs in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                h, f, key, low, high = cols = [np.frombuffer(b, t) for b, t in zip(blobs, _KINDS, strict=True)]
                if r < 0:
                    yield _spans(key, low, high, h, f)
                else:
                    held.setdefault(r, []).append(cols)
        for r, parts in held.items():
            h, f, key, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((f, h))
            h, f, key, low, high = (x[order] for x in (h, f, key, low, high))
            nth = _nth(h, f)
            rest = np.flatnonzero(nth >= 2)
            yield _spans(key[rest], low[rest], high[rest], h[rest], f[rest])
            # an anchor that occurs once has nothing to compare
            new_h = np.append(True, h[1:] != h[:-1])
            group = np.cumsum(new_h) - 1
            asked = np.flatnonzero((nth < 2) & (np.bincount(group)[group] > 1))
            if len(asked):
                # both occurrences of a fragment go into one block
                kind = np.cumsum(nth[asked] == 0) - 1
                first = np.flatnonzero(np.append(True, np.diff(group[asked]) != 0))
                g = np.cumsum(np.append(False, np.diff(group[asked]) != 0))
                sizes = np.diff(np.append(first, len(asked)))
                wide = sizes > limit  # a frequent anchor has blocks of its own
                within = kind - kind[first][g]
                blocks_of = np.where(wide, -(-2 * np.maximum.reduceat(within + 1, first) // limit), 0)
                small = np.cumsum(np.where(wide, 0, sizes)) // limit
                base = small.max(initial=0) + 1 + np.concatenate([[0], np.cumsum(blocks_of)[:-1]])
                block = np.where(wide[g], base[g] + 2 * within // limit, small[g])
                # others follow where a task sent two: there may be more
                twice = np.append(nth[1:] == 1, False) | (nth == 1)
                yield _spans(key[asked], low[asked], high[asked], h[asked], f[asked], (r << 32) + block, wide[g], twice[asked])

    dealt = docs.select("text", "key").mapInArrow(deal, _DEALT)
    # fragments that follow need no range; they are spread
    where = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.pmod(F.xxhash64("key"), F.lit(ranges)))
    return keep(dealt.repartition(ranges, where).mapInArrow(decide, _SPAN), "statuses", BLOB_ROWS), ranges


def _nth(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """0, 1, ... along each run of equal pairs."""
    if not len(h):
        return np.zeros(0, np.int64)
    new = np.append(True, (h[1:] != h[:-1]) | (f[1:] != f[:-1]))
    at = np.arange(len(h))
    return at - at[new][np.cumsum(new) - 1]


def _compared(docs: DataFrame, statuses: DataFrame, ranges: int, settings: Settings) -> DataFrame:
    """(key, low, high): spans of windows that suffix arrays find repeated, and of the fragments that follow them."""
    length = settings.length
    asked = statuses.where("block IS NOT NULL")
    # a list, not a set: equal rows have one key, and a fragment of both is compared twice
    lists = asked.groupBy("key").agg(F.collect_list(F.struct("low", "high", "block", "split", "hash", "fragment", "led")).alias("spans"))
    texts = docs.select("key", "text").dropDuplicates(["key"]).join(lists, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode()
                for i in range(0, len(spans), 5000):
                    cols = list(zip(*((key, s["low"], s["block"], s["split"], s["hash"], s["fragment"], s["led"], raw[s["low"] : s["high"] + length]) for s in spans[i : i + 5000]), strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "low", "block", "split", "hash", "fragment", "led", "bytes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            owner, window, kind = repeated_windows([x[7] for x in held], length)
            key = np.array([x[0] for x in held], np.int64)
            at = np.array([x[1] for x in held], np.int64)[owner] + window
            times = np.bincount(kind)[kind] if len(kind) else kind
            found = np.flatnonzero(times > 1)
            yield _runs_of(key[owner[found]], at[found])
            # fragments of which every window repeats decide for those that follow
            whole = np.bincount(owner, times > 1, len(held)) == np.bincount(owner, minlength=len(held))
            led = [i for i in np.flatnonzero(whole).tolist() if held[i][6]]
            if led:
                none = [pa.nulls(len(led), k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, *(pa.array([held[i][c] for i in led], pa.int64()) for c in (4, 5))], _FOUND)
            if held[0][3] and len(kind):  # lone windows and one of each kind go on, by hash
                some = np.unique(kind, return_index=True)[1]
                joined = np.frombuffer(b"".join(x[7] for x in held), np.uint8)
                sums, other = prefix_hash(joined), prefix_hash(joined ^ np.uint8(0x5A))
                begin = np.concatenate([[0], np.cumsum([len(x[7]) for x in held])])[owner[some]] + window[some]
                out_ = np.zeros(len(some), _WINDOW)
                out_["hash"], out_["more"] = span_hash(sums, begin, begin + length), span_hash(other, begin, begin + length)
                out_["key"], out_["at"], out_["asks"] = key[owner[some]], at[some], times[some] == 1
                part = (out_["hash"] % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(ranges + 1))
                used = [r for r in range(ranges) if bounds[r] < bounds[r + 1]]
                blobs = [out_[order[bounds[r] : bounds[r + 1]]].tobytes() for r in used]
                none = [pa.nulls(len(used), k) for k in (pa.int64(), pa.int32(), pa.int32())]
                more = [pa.nulls(len(used), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int64()), pa.array(blobs, pa.binary()), *more], _FOUND)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if held and row[2] != held[0][2]:
                    yield from out()
                    held = []
                held.append(row)
        if held:
            yield from out()

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    fragments = texts.mapInArrow(cut, "key long, low int, block long, split boolean, hash long, fragment long, led boolean, bytes binary")
    shape = "key long, low int, high int, part long, windows binary, hash long, fragment long"
    found = keep(fragments.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(sort, shape), "compared")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(np.frombuffer(blob, _WINDOW))
        for blobs in held.values():
            w = np.concatenate(blobs)
            w = w[np.lexsort((w["more"], w["hash"]))]
            new = np.append(True, (w["hash"][1:] != w["hash"][:-1]) | (w["more"][1:] != w["more"][:-1]))
            at = np.cumsum(new) - 1
            w = w[(np.bincount(at)[at] > 1) & (w["asks"] == 1)]
            yield _runs_of(w["key"], w["at"])

    met = found.where("part IS NOT NULL").select("part", "windows").repartition(ranges, "part").mapInArrow(meet, shape)
    decided = found.where("hash IS NOT NULL").select("hash", "fragment").distinct()
    following = statuses.where("block IS NULL").join(decided, ["hash", "fragment"])
    spans = [df.select("key", "low", "high") for df in (found.where("key IS NOT NULL"), met, following)]
    return spans[0].unionAll(spans[1]).unionAll(spans[2])


def _repeats(keyed: DataFrame, settings: Settings) -> DataFrame:
    """(key, low, high): lists of the spans of repeated windows of each text that has any."""
    statuses, ranges = _statuses(keyed, settings)
    spans = _compared(keyed, statuses, ranges, settings)
    return keep(spans.groupBy("key").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")), "spans")


def _runs(low: list[int] | None, high: list[int] | None, length: int) -> list[list[int]]:
    """The maximal runs of bytes under the windows from low to high."""
    runs: list[list[int]] = []
    for a, b in sorted(zip(low or (), high or (), strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b + length)
        else:
            runs.append([a, b + length])
    return runs


def _without(raw: bytes, runs: list[list[int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, spans (start, end of each removed run) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    keyed, length = _keyed(docs), settings.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, low, high in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw, runs = text.encode(), _runs(low, high, length)
                kept = _without(raw, runs)
                rows.append((doc, kept, len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in runs]))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    both = keyed.join(_repeats(keyed, settings), "key", "left").select("doc_id", "text", "low", "high")
    return both.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")


def cleaned(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with their columns; ``text`` without repeated bytes, ``n_chars``, if there, to match.

    Bytes of a character that is cut in two go with it. Null texts stay null.
    """
    small_batches(docs.sparkSession)
    keyed, length = _keyed(docs), settings.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t.encode(), _runs(low, high, length)).decode(errors="ignore") for t, low, high in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["row", "none", "kept"])

    both = keyed.join(_repeats(keyed, settings), "key", "left").select("row", "none", "text", "low", "high")
    shape = both.select("row", "none").schema.add("kept", "string")
    found = both.mapInArrow(cut, shape)
    new = {"text": F.when(~F.col("none"), F.col("kept")), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))



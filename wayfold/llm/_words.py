"""Words of many texts at once: positions and 64-bit hashes as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2^64; kept up to about a million."""
    name = str(base)
    if name not in _powers or len(_powers[name]) <= n:
        out = np.full(max(n, 1 << 20) + 1, base, np.uint64)
        out[0] = 1
        made = np.multiply.accumulate(out)
        if n > 1 << 20:
            return made
        _powers[name] = made
    return _powers[name]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any substring follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings from start to end; equal substrings have equal hashes."""
    raw = (sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of some texts in order: where each begins and ends in ``data``, its hash, its text's number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray  #: first word of each text, and the number of words


def words(texts: list[bytes]) -> Words:
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    space = _SPACE[data]
    inside = np.empty(len(data) + 1, np.int8)
    inside[0], inside[-1] = 0, 0
    inside[1:] = ~space
    change = np.diff(inside)
    start = np.flatnonzero(change == 1)
    end = np.flatnonzero(change == -1)
    if len(start) > len(end):
        end = np.append(end, len(data))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, span_hash(prefix_hash(data), start, end), text, first)


def portions(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``most`` bytes together, with the number of the first; null is empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if held and size + len(b) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield at, held


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and the number of each one's text; a shorter text is one shingle."""
    count = np.diff(w.first)
    total = np.zeros(len(w.hash), np.uint64)
    for k in range(n):  # position k weighs differently, so order matters
        part = w.hash * np.uint64((2 * k + 3) * 0x2545F4914F6CDD1D % (1 << 64) | 1)
        total[: len(total) - k] += part[k:]
    left = w.first[w.text + 1] - np.arange(len(w.hash))
    whole = left >= n
    got, owner = mix(total[whole]), w.text[whole]
    if (few := np.flatnonzero((count > 0) & (count < n))).size:
        short = []
        for t in few:
            h = np.uint64(count[t])
            for k, x in enumerate(w.hash[w.first[t] : w.first[t + 1]]):
                h = mix(np.array([h ^ x]))[0] + np.uint64(k)
            short.append(h)
        got, owner = np.append(got, np.array(short, np.uint64)), np.append(owner, few)
    return got, owner

"""Texts cut into chunks that byte-pair tokenizers encode independently, and ids of many chunks at once.

A cut is made before every space that stands between two characters other than white space. The byte-level
vocabulary's own pattern always begins a new pre-token there, and no piece of the other vocabulary holds
a space behind another character, so neither tokenizer ever merges across a cut.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: New chunks that are encoded together as one text.
TOGETHER = 1000
#: Bytes of text that are cut together: a word that repeats in them is looked up once.
PORTION = 1 << 22
#: Marks that are neither letters nor digits nor white space; the apostrophe, which begins contractions, is left out.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def odd(part: str) -> bool:
    """Whether a part between spaces is empty or has white space at an end, so that its neighbours belong to it."""
    return not part or part.strip() != part


def chunks(parts: list[str]) -> list[str]:
    """The parts of ``text.split(" ")``, joined again where the space between two is no cut."""
    out, loose = [parts[0]], not parts[0] or parts[0][-1].isspace()
    for part in parts[1:]:
        if loose or not part or part[0].isspace():
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
        loose = not part or part[-1].isspace()
    return out


def ended(word: str) -> str:
    """The word without up to three marks of ASCII at its end, which behind a letter are one pre-token of their own."""
    base = word.rstrip(_MARKS)
    return base if 0 < len(word) - len(base) < 4 and base[-1:].isalpha() else word


def gathered(batches: Iterator[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.Table]:
    """The rows of all batches in turn, by about ``most`` bytes of the texts in column 1; a longer text comes alone."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            if size and size + n > most:
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, size, at = [], 0, i
            size += n + 64  # rows without text count too
        held.append(batch.slice(at))
    if size:
        yield pa.Table.from_batches(held)


def strings(texts: list[str | None] | pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as one array, null ones empty."""
    one = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    return pc.fill_null(one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one, "")


def numbered(cut: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of all lists, the number of each part in turn, and where each list's begin, with the end."""
    bounds, made = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
    return made.dictionary.to_pylist(), made.indices.to_numpy(), bounds - bounds[0]


def taken(values: list[bytes], index: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The values that ``index`` names, joined from each bound to the next."""
    if not len(index):
        return [b""] * (len(bounds) - 1)
    made = pa.array(values, pa.large_binary()).take(pa.array(index))
    _, ends, data = made.buffers()
    ends, raw = np.frombuffer(ends, np.int64, len(index) + 1)[bounds].tolist(), memoryview(data or b"")
    return [raw[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)]


def byte_values() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer(vocabulary: str):  # noqa: ANN201  the library is imported in tasks only
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


def lettered(word: str) -> bool:
    """Whether a word has letters alone, of blocks that are letters by every version of Unicode."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def of_letters(made) -> Callable[[str], list[int]]:  # noqa: ANN001
    """``made``'s ids of words of letters alone by its merges only: its pattern makes each, with a space before it or not, one pre-token.
    Line feeds before the words mark the cuts."""
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer(made.model)
    own.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    letters = {b: c for c, b in byte_values().items()} | {ord("\n"): " "}
    table = "".join(letters[b] for b in range(256))
    return lambda t: own.encode_batch_fast([codecs.charmap_decode(t.encode(), "strict", table)[0]], add_special_tokens=False)[0].ids


def token_bytes(made) -> list[bytes]:  # noqa: ANN001
    """The bytes of each id of a byte-level vocabulary; added tokens stand for their own text."""
    values, names = byte_values(), made.get_vocab(with_added_tokens=True)
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(values[c] for c in name) if all(c in values for c in name) else name.encode()
    return out


def lengths(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in tokens], np.int64)


def encode_chunks(found: list[str], encode: Callable[[str], list[int]], sizes: np.ndarray, space: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunks, each behind a space, and where each chunk's begin, with the end; many are encoded as one text.

    ``sizes`` has the bytes of each id; ``encode`` gets the text with its first space. A chunk has no ids if
    its tokens don't end with it. With an empty ``space``, spaces in the text are only cuts.
    """
    if not found:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    if len(found) > TOGETHER:
        made = [encode_chunks(found[i : i + TOGETHER], encode, sizes, space) for i in range(0, len(found), TOGETHER)]
    else:
        ids = np.array(encode(space + " ".join(found)), np.int64)
        ends = np.cumsum(sizes[ids])
        want = np.cumsum([len(space) + (len(w) if w.isascii() else len(w.encode())) for w in found])
        at = np.searchsorted(ends, want)
        if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
            return ids, np.append(0, at + 1)
        if len(found) == 1:
            return np.zeros(0, np.int64), np.zeros(2, np.int64)
        half = len(found) // 2  # find the one that its tokens don't give back
        made = [encode_chunks(some, encode, sizes, space) for some in (found[:half], found[half:])]
    before = np.cumsum([0, *(len(x) for x, _ in made)])
    return np.concatenate([x for x, _ in made]), np.concatenate([[0], *(b[1:] + n for (_, b), n in zip(made, before, strict=False))])

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import suffix_dedup
from wayfold.llm.suffix_dedup import Settings


def expected(texts, length):
    """By counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n, alphabet):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices(alphabet, k=k))
    passages = [word(rng.choice([30, 45, 60, 90])) for _ in range(6)]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice([word(rng.randint(0, 50)), rng.choice(passages)]) for _ in range(rng.randint(1, 5))))
    return [*out, out[0], out[1], "", None, "a" * 200, word(3), passages[0] * 3]


@pytest.mark.parametrize("fragments", [3, 500])
def test_against_counting_windows(spark, fragments):
    rows = texts(3, 60, "abcd éñ日")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(None, rows[2], "x")], "doc_id long, text string, key string").repartition(5)
    found = suffix_dedup.digest(suffix_dedup.removed(df, Settings(length=40, gram=12, fragments=fragments))).collect()
    want = dict(zip([*range(len(rows)), None], expected([*rows, rows[2]], 40), strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in found} == want


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(100):
        t = rng.integers(0, rng.integers(2, 6), rng.integers(1, 120)).astype(np.uint8)
        order = suffix_dedup.suffix_array(t, 200)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: bytes(t[i:]))
        prefixes = suffix_dedup.common_prefixes(t, order, 200)
        for a, b, n in zip(order[:-1], order[1:], prefixes[1:], strict=True):
            x, y = bytes(t[a:]) + b"\0" * 200, bytes(t[b:]) + b"\0" * 200
            assert x[:n] == y[:n]


def test_cleaned_keeps_columns_and_whole_characters(spark):
    shared = "é" * 30
    rows = [(1, "start " + shared, 5, "a"), (2, shared + " ends", 7, "b"), (3, None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string")
    found = {r.doc_id: r for r in suffix_dedup.cleaned(df, Settings(length=20, gram=8)).collect()}
    assert {k: (r.text, r.key) for k, r in found.items()} == {1: ("start ", "a"), 2: (" ends", "b"), 3: (None, "c")}
    assert found[1].n_chars == 6 and list(found[1].asDict()) == df.columns


def test_many_copies_and_very_long_texts(spark):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passage, long = word(300), word(60_000)
    rows = [f"{word(50)}{passage}{word(50)}" for _ in range(40)] + [passage] * 30 + [long, word(10) + long[20_000:21_000], word(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(0, rows[0])] * 3, "doc_id long, text string").repartition(4)
    for fragments in (4, 500):
        found = suffix_dedup.digest(suffix_dedup.removed(df, Settings(length=60, gram=20, fragments=fragments))).collect()
        want = expected([*rows, *[rows[0]] * 3], 60)
        assert sorted(tuple(r) for r in found) == sorted((i, *w) for i, w in zip([*range(len(rows)), 0, 0, 0], want, strict=True))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removed(df).count() == 0

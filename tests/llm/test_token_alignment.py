import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wayfold.llm import _bpe, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ONE, OTHER = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
ONE.encode_special_tokens = True
BYTES = _bpe.byte_values()
TEXTS = [
    "", None, " ", "Hello, World! it's 2024", "two  spaces and \n lines \n\n x ", " \t lead", "É ß é İ Σας 日本語 🙂", "x" * 3000, "a\x1cb \x1f c\x00d", "der the 10.000 words, " * 300, "<|endoftext|> plain <s> <0x41>", "same words", "same words",
    "a▁b under", "nbsp wide\u0085line   x", "line\nnext\r\n word;\r\n", "ｆｕｌｌ ﬁ ²", "".join(random.Random(1).choices("abcdefghij0123", k=4000)), "unrelated thinghs ofnd anderst, onheretionshon." * 9, " " * 50,
]


def plainly(text):
    """The groups of a text, [([a, ...], [b, ...]), ...], by walking over the ends."""
    if not text:
        return []
    want = f" {text}".encode()
    a = [(i, bytes(BYTES[c] for c in ONE.id_to_token(i))) for i in ONE.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, bytes([int(OTHER.id_to_piece(i)[3:5], 16)]) if OTHER.is_byte(i) else OTHER.id_to_piece(i).replace("▁", " ").encode()) for i in OTHER.encode(text)]
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    cuts, out, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
    for c in cuts:
        upto = [side.index(c) + 1 for side in ends]
        out.append(tuple([i for i, _ in side[s:e]] for side, s, e in zip((a, b), at, upto, strict=True)))
        at = upto
    return out


def want(rows):
    found = [(doc, plainly(text)) for doc, text in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    docs = Counter(pair for own in links for pair in own)
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc, g), own in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sums = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(k for p, k in own.items() if docs[p] == best[p[0]]), sum(k * docs[p] for p, k in own.items()))
        out.append((doc, *sums, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str), {(x, y, n, n == best[x]) for (x, y), n in docs.items()}


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (None, "no id"), (3, "an id again")]


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, pairs string, n long").repartition(3)
    docs, pairs = token_alignment.align(df, A, B, **more)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in names) for r in docs.collect()), key=str), {tuple(r) for r in pairs.collect()}


def test_against_whole_texts(spark, rows):
    docs, pairs = result(spark, rows)
    assert (docs, pairs) == want(rows)
    zero = {d[0] for d in docs if not d[1]}
    assert {0, 1, 13} <= zero and 2 not in zero and 10 not in zero


def test_in_small_portions(spark, rows, monkeypatch):
    monkeypatch.setattr(token_alignment, "PORTION", 60)
    monkeypatch.setattr(token_alignment, "LINKS", 2)
    assert result(spark, rows, most=5) == want(rows)


def test_parts_that_earlier_texts_end_with():
    aligned = token_alignment.Aligned(A, B)
    later = ["two  spaces", "indented:\n        x = 1", "ends\n  again", "ends\n \n lines", "a tab\t  \n", " " * 7, "x" + " " * 17]
    for i in range(20):  # what an empty text leaves behind depends on the order of a set
        aligned.clear()
        assert aligned.chunked(["", f"word{i}"])[0] == []
        aligned.chunked(["ends\n", f"tab{i}\t", "\n"])
        for text, own in zip(later, aligned.chunked(later), strict=True):
            g = plainly(text)
            assert aligned.stats[own].sum(axis=0).tolist() == [sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(len(a) * len(b) for a, b in g)]
            assert b"".join(aligned.text[w] for w in own) == "".join(f"{','.join(map(str, a))}|{','.join(map(str, b))};" for a, b in g).encode()


def test_components_of_any_graph():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n, m = rng.integers(1, 60), rng.integers(0, 80)
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        least = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                least[x] = least[y] = min(least[x], least[y])
        assert token_alignment.components(n, a, b).tolist() == least


def test_empty_table(spark, rows):
    assert result(spark, rows[:1])[0] == [(0, 0, 0, 0, 0, 0, 0, "")]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert [x.collect() for x in token_alignment.align(df, A, B)] == [[], []]

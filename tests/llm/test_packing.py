import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import packing
from wayfold.llm._shared import lent

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World! it's 2024 0 00 a0b", " \t\n ", "É Ñ ß é İ Σας ΟΔΟΣ áb", "x" * 3000, "a\x1cb \x1f c", "der the 10.000 words, " * 700, "<|endoftext|> plain", "same", "same", " nbsp wide\u0085line", "Stop. stop, STOP., it's. 9. É. ß, µ. ... ,. a.b. İ. Σας."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, sequence_id string").repartition(3)


def reference(text):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_are_encoded_as_whole_texts():
    words = packing.WordIds(VOCABULARY, most=3)
    for _ in range(2):
        for text, ids in zip(TEXTS, words.encode([t or "" for t in TEXTS]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference(text)[:-1]


@pytest.mark.parametrize("size", [16, 2048])
def test_pieces_and_places(docs, size):
    rows = packing.pack(docs, VOCABULARY, size).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for doc, own in by_doc.items():
        ids, at = reference(TEXTS[doc]), 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == size for r in sorted(own, key=lambda r: r.piece)[:-1])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // size) + 1


def test_patterns_use_every_piece_once_and_refine():
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = np.zeros(101, np.int64)
        counts[rng.integers(1, 101, 12)] = rng.integers(1, 40, 12)
        used = np.zeros(101, np.int64)
        for times, uses in packing.patterns(counts, 100):
            assert sum(n * u for n, u in uses.items()) <= 100
            for n, u in uses.items():
                used[n] += times * u
        assert (used == counts).all()
    # greedy fill gives 60 + 30; replacing the 30 by 25 and 15 fills the sequence
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 25, 15]] = 1
    assert packing.patterns(counts, 100)[0] == (1, {60: 1, 15: 1, 25: 1})


def test_empty_table(docs):
    assert packing.pack(docs.where("doc_id < 0"), VOCABULARY).collect() == []


def test_letters_need_the_merges_alone():
    made = packing.words_of(public_tokenizers.path("word_bpe_49k.json"))
    assert made is packing.words_of(public_tokenizers.path("word_bpe_49k.json"))  # tasks of a worker share it
    texts = ["", " Straße, ÀÉÎ. ªº µm Word. word, WORD", "don't re's ll0 a.b. x,, .", "İstanbul Σας ŉ ﬁ 日本 été", "a\x1cb word", "<|endoftext|> zzqxj ÿÿ ß."]
    for _ in range(2):
        want = made.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert made.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in want]
    small = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), most=3)
    for t, e in zip(texts * 2, want * 2, strict=True):
        assert small.encode([t]) == [np.array(e.ids, "<u4").tobytes()]


def test_workers_give_up_what_they_know_when_no_task_asks_for_it(spark):
    def kept(batches):
        import time

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing.words_of.cache_info().currsize])], ["n"])
            with lent(packing.words_of, VOCABULARY, idle=0.3) as words:
                assert words.encode(["a b"]) == words.encode(["a b"])
            with lent(packing.words_of, VOCABULARY, idle=0.3) as again:
                time.sleep(0.6)  # a task that has it keeps it
                yield pa.RecordBatch.from_arrays([pa.array([packing.words_of.cache_info().currsize + 2 * (again is words)])], ["n"])
            time.sleep(0.6)
            yield pa.RecordBatch.from_arrays([pa.array([packing.words_of.cache_info().currsize])], ["n"])

    assert [r.n for r in spark.range(1, numPartitions=1).mapInArrow(kept, "n long").collect()][1:] == [3, 0]
    packing.pieces(spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1), VOCABULARY).collect()
    found = lambda batches: (pa.RecordBatch.from_arrays([pa.array([packing.words_of.cache_info().currsize])], ["n"]) for _ in batches)
    time.sleep(2)
    assert {r.n for r in spark.range(8, numPartitions=8).mapInArrow(found, "n long").collect()} == {0}


class Asked(dict):
    """A memo that counts what it is asked for."""

    n = 0

    def get(self, *given):
        self.n += 1
        return super().get(*given)


def test_words_that_repeat_are_looked_up_once():
    made = packing.WordIds(VOCABULARY)
    made.now = Asked()
    texts = ["the same, the words\nand the lines"] * 500
    assert np.frombuffer(made.encode(texts)[499], "<u4").tolist() == reference(texts[0])[:-1]
    assert 0 < made.now.n < 20


def test_marks_need_the_merges_alone():
    made = packing.WordIds(VOCABULARY)
    assert made.encode(["stop!! Stop$$$ stop). Éa; $$$ stop!?"])
    assert {"stop", "éa"} <= set(made.now) and {"!!", "$$$", ").", ";"} <= set(made.ends) and "stop!?" in made.now


SMALL, WHOLE = packing.WordIds(VOCABULARY, most=3), Tokenizer.from_file(VOCABULARY)
WHOLE.encode_special_tokens = True


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\n", " ", "\t", "\r\n", "\xa0", "\x1d", "\u2028", "\x0b", "a", "Über", "it's", "'ll", ".", "!!", "$$$$", "'", "0", "7", "½", "日", "Σ", "İ", "_", "·", "=", "e\u0301", "\u0338", "<|endoftext|>"]), max_size=14).map("".join), min_size=1, max_size=4))
def test_any_white_space_and_marks(texts):
    for ids, text in zip(SMALL.encode(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids

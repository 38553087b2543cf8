import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm import _bpe, token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "Hello, World! it's 2024", "two  spaces and \n lines \n\n x ", " \t lead", "É ß é İ Σας 日本語 🙂", "x" * 3000, "a\x1cb \x1f c\x00", "der the 10.000 words, " * 3000, "<|endoftext|> plain", "same", "same", " nbsp wide\u0085line   x", "line\nnext\r\n word\n"]


WHOLE = Tokenizer.from_file(VOCABULARY)
WHOLE.encode_special_tokens = True
CHUNKED = token_files.Texts(VOCABULARY, most=3)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 1 << 16), st.integers(0, (1 << 64) - 1)), max_size=1500))
def test_words_give_back_all_values(values):
    v = np.array(values, np.uint64)
    words, offsets = token_files.encode(v)
    assert (token_files.decode(words, offsets, len(v)) == v).all()
    for b in range(len(offsets) - 1):  # any block by itself
        own = words[offsets[b] : offsets[b + 1]]
        part = v[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]
        assert (token_files.decode(own, np.array([0, len(own)]), len(part)) == part).all()


def test_words_are_as_few_as_the_selectors_allow():
    for value, per_word in ((0, 120), (1, 60), (7, 20), (255, 7), (1023, 6), (32767, 4), (50256, 3), ((1 << 60) - 1, 1)):
        words, _ = token_files.encode(np.full(token_files.BLOCK, value, np.uint64))
        assert len(words) == 1 + -(-token_files.BLOCK // per_word)
    words, _ = token_files.encode(np.array([1 << 60, 5, (1 << 64) - 1], np.uint64))
    assert words[0] == 3 | 2 << 32 and words[-2:].tolist() == [1 << 60, (1 << 64) - 1]
    assert (words[1] >> np.uint64(60), words[1], words[3]) == (0, 0, 1)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(" \n\t a'bZ1.é日\x1c\r"), max_size=40))
def test_chunks_are_encoded_as_the_whole(text):
    cut = _bpe.chunks(text.split(" "))
    assert " ".join(cut) == text
    assert np.frombuffer(CHUNKED.encode([text])[0], "<u4").tolist() == ids_of(text)


def test_texts_whatever_is_known():
    for _ in range(2):
        for text, ids in zip(TEXTS, CHUNKED.encode([t or "" for t in TEXTS]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 15, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "id again", "x", 1), (3, "id again", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)


def test_files_give_back_every_document(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write(docs, path, VOCABULARY, files=4)
    rows = token_files.read(spark, path).withColumn("crc", F.crc32("ids")).collect()
    want = sorted(((r.doc_id, tuple([*ids_of(r.text), 0])) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.crc) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == sorted((str(d), ids) for d, ids in want)


def test_long_files_are_read_in_portions(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id, ' of many, '), 12000)").alias("text"))
    token_files.write(df, path, VOCABULARY, files=1)
    rows = token_files.read(spark, path).orderBy("doc_id").collect()
    assert sum(r.n_tokens for r in rows) > 2 << 20
    for r in rows[::13]:
        assert np.frombuffer(r.ids, "<u4").tolist() == [*ids_of(f"word{r.doc_id} of many, " * 12000), 0]


def test_one_id_for_many_rows_is_dealt_over_files(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    df = spark.range(0, 400, 1, 4).select(F.lit(1).alias("doc_id"), F.lit("the same row").alias("text"))
    token_files.write(df, path, VOCABULARY, files=4)
    files = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(r.n_docs for r in files) == 400 and max(r.n_docs for r in files) < 200
    assert token_files.read(spark, path).select("start").distinct().count() == 400


def test_empty_table(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write(docs.where("start > 1"), path, VOCABULARY)
    assert token_files.read(spark, path).collect() == []


def test_letters_need_the_merges_alone():
    texts = ["", " Straße, ÀÉÎ. ªº µm Word. word, WORD", "don't re's ll0 a.b. x,, .", "x İstanbul Σας ŉ ﬁ 日本 été", "a\x1cb  word\n\nends\n", "x ends\n  ends\n .", "<|endoftext|> zzqxj ÿÿ ß."]
    made = token_files.Texts(public_tokenizers.path("byte_bpe_50k.json"), most=3)
    own, calls = made._of_letters, []
    made._of_letters = lambda t: calls.append(t) or own(t)
    for some in (texts, texts[::-1], *([t] for t in texts)):
        want = made.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        assert made.encode(some) == [np.array(e.ids, "<u4").tobytes() for e in want]
    assert " ÀÉÎ" in calls[0] and "日" not in "".join(calls)


class Asked(dict):
    """A memo that counts what it is asked for."""

    n = 0

    def get(self, *given):
        self.n += 1
        return super().get(*given)


def test_words_that_repeat_are_looked_up_once():
    made = token_files.Texts(VOCABULARY)
    made.now = Asked()
    texts = ["the same, the words\nand the lines"] * 500
    assert np.frombuffer(made.encode(texts)[499], "<u4").tolist() == ids_of(texts[0])
    assert 0 < made.now.n < 20


def test_lines_and_marks_need_the_merges_alone():
    made = token_files.Texts(VOCABULARY)
    made._of_text = lambda t: pytest.fail(f"the pattern is asked for {t!r}")
    text = "First words!!\nNext ends$$$ of a line).\nLast, they"
    assert np.frombuffer(made.encode([text])[0], "<u4").tolist() == ids_of(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\n", " ", "\n\n", "\n\n\n", "\t", "\r\n", "\xa0", "\x1d", " ", "a", "Über", "it's", "'ll", ".", "!!", "$$$$", "'", "7", "½", "日", "_", "·", "é", "<|endoftext|>"]), max_size=14).map("".join), min_size=1, max_size=4))
def test_lines_and_marks_are_encoded_as_the_whole(texts):
    for ids, text in zip(CHUNKED.encode(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("most", [1, 700, 1 << 20])
def test_portions_have_every_row_in_turn(most):
    rows = [(i, ["x" * (i * 37 % 500), None, ""][i % 3]) for i in range(100)]
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows[lo : lo + 7]], pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) for lo in range(0, 100, 7)]
    found = list(_bpe.gathered(iter([batches[0].slice(0, 0), *batches]), most))
    assert [(r["doc_id"], r["text"]) for t in found for r in t.to_pylist()] == rows
    assert all(len(t) == 1 or sum(len(x or "") + 64 for x in t["text"].to_pylist()) <= most + 64 for t in found)
    assert _bpe.strings(found[0]["text"]).to_pylist() == [t or "" for _, t in rows[: len(found[0])]]
    assert list(_bpe.gathered(iter([]))) == []

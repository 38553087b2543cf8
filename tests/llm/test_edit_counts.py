import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayfold.llm import edit_counts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["the ", "It's", "'re", "'", "  ", "\n", "\t ", "2024", "é", "ñ,", "!!", " a", "b", "'l", "l ", "x" * 40, "日本", " "]


@pytest.fixture(scope="module")
def counter():
    return edit_counts.Counter(RANKS, PATTERN, most=50)


def expected(counter, text):
    return len(counter.encoding.encode_ordinary(text)), len(counter.pattern.findall(text))


def test_random_edits_count_as_the_whole_text(counter):
    rng = random.Random(7)
    for _ in range(150):
        tree = edit_counts.Tree("".join(rng.choices(PARTS, k=rng.choice([0, 1, 5, 80, 900]))), counter)
        for _ in range(12):
            n = len(tree.text)
            start, removed = rng.randint(0, n), rng.choice([0, 1, 2, 5, 40, 700])
            inserted = "".join(rng.choices(PARTS, k=rng.choice([0, 1, 2, 9, 300])))
            text = tree.text[:start] + inserted + tree.text[start + removed :]
            tree.edit(start, removed, inserted)
            assert tree.text == text
            assert (tree.tokens, tree.pretokens) == expected(counter, text)
            assert [p for x, _ in tree.leaves for p in x] == [len(p) for p in counter.pattern.findall(text)]
            if rng.random() < 0.3:  # written and read again
                encoded = tree.encoded
                tree = edit_counts.Tree(tree.text, counter, tree.kept())
                assert (tree.tokens, tree.pretokens, tree.encoded) == (*expected(counter, text), 0) and encoded >= 0


def test_small_edits_encode_little(counter):
    tree = edit_counts.Tree("some words of text, and more " * 2000, counter)
    for place in (0, 10, 30_000, len(tree.text)):
        before = tree.encoded
        tree.edit(place, 3, "other")
        assert tree.encoded - before < 12
    assert (tree.tokens, tree.pretokens) == expected(counter, tree.text)


def test_other_patterns_are_refused():
    with pytest.raises(ValueError, match="looks ahead"):
        edit_counts.Counter(RANKS, PATTERN + "|x")


def test_frame(spark, counter, tmp_path):
    rows = [(1, "a text", [(0, 1, "b")]), (1, None, [(5, 9, "new"), None, (None, None, None)]), (None, "", None), (4, "long " * 30_000, [(-5, 3, ""), (10**9, 1, " end")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, e array<struct<start:int,removed:int,inserted:string>>").withColumn("tokens_before", F.lit("x"))
    trees = edit_counts.build(df, RANKS, PATTERN)
    assert sorted((str(r.doc_id), r.tokens, r.pretokens) for r in trees.collect()) == sorted((str(d), *expected(counter, x or "")) for d, x, _ in rows)
    trees.withColumn("e", F.when(F.col("doc_id") == 4, F.array(F.struct(F.lit(-5).alias("start"), F.lit(3).alias("removed"), F.lit("").alias("inserted"))))).write.parquet(f"file://{tmp_path}/trees")
    kept = spark.read.parquet(f"file://{tmp_path}/trees")
    once = edit_counts.apply(kept, F.col("e"), RANKS, PATTERN)
    again = edit_counts.counted(edit_counts.apply(once, F.expr("array(named_struct('start', 1000000000, 'removed', 1, 'inserted', ' end'))"), RANKS, PATTERN)).collect()
    texts = [(1, "a text end"), (1, " end"), (None, " end"), (4, ("long " * 30_000)[3:] + " end")]
    assert sorted((str(r.doc_id), r.tokens_after, r.pretokens_after, r.n_chars) for r in again) == sorted((str(d), *expected(counter, x), len(x)) for d, x in texts)
    assert all(r.reencoded < 5 for r in again)
    edits = "case when doc_id = 1 and text <> '' then array(named_struct('start', 0, 'removed', 1, 'inserted', 'b')) when doc_id = 1 then array(named_struct('start', 5, 'removed', 9, 'inserted', 'new'), null, named_struct('start', int(null), 'removed', int(null), 'inserted', string(null))) end"
    found = edit_counts.counted(edit_counts.apply(kept, F.expr(edits), RANKS, PATTERN)).collect()
    want = {("1", 1, "b text"), ("1", 2, "new"), ("None", 0, ""), ("4", 0, "long " * 30_000)}
    assert sorted((str(r.doc_id), r.n_edits, r.tokens_after, r.n_chars) for r in found) == sorted((d, n, expected(counter, x)[0], len(x)) for d, n, x in want)
    assert edit_counts.build(df.where("doc_id > 9"), RANKS, PATTERN).count() == 0 and edit_counts.apply(kept.where("doc_id > 9"), F.col("e"), RANKS, PATTERN).count() == 0

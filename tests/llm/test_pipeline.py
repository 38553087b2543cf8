"""Each stage of the pipeline against a plain version, on what the stage before kept."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW%%%", "$$$", "CLICK!!"]) for _ in range(60))
    shared, item = prose(60), prose(30)
    docs = {i: junk() if i % 6 == 5 else prose(rng.randint(40, 120)) for i in range(90)}
    docs[6], docs[7] = docs[0], docs[1] + " end"  # an exact and a near copy
    docs[12], docs[13] = f"{prose(80)} {shared}", f"{shared} {prose(80)}"
    docs[18] = f"{prose(50)} {item} {prose(50)}"
    docs[19] = "long " + prose(6000)
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(90, None, None, None, None), (91, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5)) for i in docs], "doc_id long, quality int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", docs, shared, item


def test_stages(spark, tables, tmp_path):
    sf_dir, docs, shared, item = tables
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, sf_dir).write.parquet(f"file://{tmp_path}/{name}")
        frame = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert frame.columns == columns
            kept[name] = {r.doc_id: r.text for r in frame.collect()}
    good = {i for i in docs if i % 6 != 5}
    assert good <= set(kept["quality"]) and not set(kept["quality"]) & (set(docs) - good)
    assert set(kept["quality"]) - set(kept["near_copies"]) == {6, 7}
    assert set(kept["repeats"]) == set(kept["near_copies"])
    changed = {i for i, t in kept["repeats"].items() if t != kept["near_copies"][i]}
    assert changed == {12, 13} and not any(shared in (kept["repeats"][i] or "") for i in changed)
    assert set(kept["repeats"]) - set(kept["decontamination"]) == {18}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in frame.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept["decontamination"].items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in frame.collect())


def test_empty_documents(spark, tables):
    sf_dir = tables[0]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, sf_dir).count() == 0

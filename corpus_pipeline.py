"""The corpus pipeline: five text operators, one after another, over ``documents``.

Quality: documents predicted bad go. Near copies: the least doc_id of each component stays. Repeats:
bytes under repeated 200-byte strings go, from every place, and the document stays. Decontamination: documents
that hold a benchmark item go. Packing: what is left becomes token sequences.

Cases: every stage works by rows, never by ids. Null and empty texts are kept by all stages but quality, which scores them like
any text, and become one end id each. Rows without a doc_id and rows that share one are judged by their own
texts; of rows equal in id and text one stays. Extra columns pass through, whatever their names. Empty tables
give empty results. Null benchmark items and labels are ignored.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontamination, jaccard_join, packing, quality_classifier, suffix_dedup
from wayfold.llm._shared import keep, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality"))
    return quality_classifier.good(docs, quality_classifier.fit(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("decontamination", decontaminate), ("packing", pack)]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

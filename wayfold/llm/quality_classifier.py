"""Compression classifier: two zstandard dictionaries, one calibrated score.

One dictionary is built from text labelled good and one from text labelled bad. A text is
cut into blocks; each block is compressed with either dictionary. The difference of the two
total sizes, divided by their sum, is the only feature. A logistic curve fitted on sampled
rows that the dictionaries have not seen turns it into the probability of the good label.

The fit reads the whole texts of a bounded sample (``Settings.sample`` labelled rows a class, chosen by hash);
scoring reads every whole text. ``Settings.dictionaries`` names the kind: "trained" by zstandard's trainer, or
"content", the sample's text itself. One never stands in for the other.

Cases: null text counts as empty and has the feature 0. Labels that are null or neither 0 nor 1
are ignored, repeated equal labels count once; an id with both labels counts for both. Without a label of one class, or where the
trainer refuses because there is too little text (the fit warns), every score is the share of good labels among the sampled ones
(0.5 without labels). Ids that hash alike are taken by id, rows of one id by the hash of their text. Repeated and tied rows are scored
alike; extra columns are ignored, a column ``quality`` of the documents too; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._shared import small_batches


@dataclass(frozen=True)
class Settings:
    sample: int = 2000  #: labelled rows of each class that the fit reads at most
    dictionaries: str = "trained"  #: or "content"
    dict_bytes: int = 65536  #: size of each dictionary
    block: int = 256  #: bytes compressed at a time
    level: int = 3
    threshold: float = 0.3  #: least score predicted good


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    raw: bool
    intercept: float
    slope: float
    settings: Settings

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
            d = zstandard.ZstdCompressionDict(content, dict_type=kind)
            d.precompute_compress(level=self.settings.level)
            out.append(zstandard.ZstdCompressor(level=self.settings.level, dict_data=d, write_content_size=False, write_dict_id=False))
        return out

    def probability(self, difference: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -40, 40))))


def difference(text: bytes, compressors: list[zstandard.ZstdCompressor], block: int) -> float:
    """(bad size - good size) / (bad size + good size), over all blocks of the text."""
    if not text:
        return 0.0
    good = bad = 0
    by_good, by_bad = (c.compress for c in compressors)
    for i in range(0, len(text), block):
        piece = text[i : i + block]
        good += len(by_good(piece))
        bad += len(by_bad(piece))
    return (bad - good) / (bad + good)


def _dictionaries(good: list[bytes], bad: list[bytes], settings: Settings) -> tuple[bytes, bytes] | None:
    """Two dictionaries of the kind that the settings name; none where the trainer has too little text."""
    size = settings.dict_bytes
    if settings.dictionaries == "content":
        return tuple((b"\n".join(x) or b" " * 8)[-size:].rjust(8) for x in (good, bad))
    if settings.dictionaries != "trained":
        raise ValueError(f"{settings.dictionaries} is no kind of dictionary: trained or content")
    try:
        return tuple(zstandard.train_dictionary(size, x).as_bytes() for x in (good, bad))
    except zstandard.ZstdError as refused:
        warnings.warn(f"too little labelled text to train dictionaries ({refused}): all scores are the share of good labels", stacklevel=2)
        return None


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of one feature by Newton's method with a small ridge."""
    a, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - np.array([0, 1e-3]) * beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``labels`` (doc_id, quality) and the texts of ``docs`` they name."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for q in (0, 1):
        one = labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
        chosen = one if chosen is None else chosen.unionAll(one)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # 2 * sample ids at most
    # repeated ids may bring more rows than ids: the sample's bound holds for the rows of each class
    good, bad = ([r["text"].encode() for r in rows.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(settings.sample).toLocalIterator()] for q in (1, 0))
    found = _dictionaries(good[::2], bad[::2], settings) if good and bad else None
    if found is None:
        share = len(good) / (len(good) + len(bad)) if good or bad else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b" " * 8, b" " * 8, True, float(np.log(share / (1 - share))), 0.0, settings)
    (a, b), raw = found, settings.dictionaries == "content"
    model = Model(a, b, raw, 0.0, 0.0, settings)
    by = model.compressors()
    seen = [(difference(t, by, settings.block), q, len(x)) for q, x in ((1, good[1::2] or good), (0, bad[1::2] or bad)) for t in x]
    x, y = np.array([s[0] for s in seen]), np.array([s[1] for s in seen], float)
    weight = np.array([counts[s[1]] / s[2] for s in seen])  # classes count as often as they are labelled
    intercept, slope = _logistic(x, y, weight / weight.mean())
    return Model(a, b, raw, intercept, slope, settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, difference, score, predicted for every row of ``docs``."""
    small_batches(docs.sparkSession)
    block, threshold = model.settings.block, model.settings.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = model.compressors()
        for batch in batches:
            d = [difference((t.as_py() or "").encode(), by, block) for t in batch.column(1)]
            p = [model.probability(x) for x in d]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(d, pa.float64()), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32())],
                ["doc_id", "difference", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, difference double, score double, predicted int")


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is predicted good."""
    small_batches(docs.sparkSession)
    block, threshold, text = model.settings.block, model.settings.threshold, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = model.compressors()
        for batch in batches:
            kept = [model.probability(difference((t.as_py() or "").encode(), by, block)) >= threshold for t in batch.column(text)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

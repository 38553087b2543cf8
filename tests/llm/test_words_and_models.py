import math
import pickle
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from wayfold.llm import _words, brown_lm, quality_classifier
from wayfold.llm._shared import remainder


def test_words_and_shingles():
    texts = [b"", b" A b\tB\x0bc ", "Ünder_score no break".encode(), b"one", b"a b c d e f", b"a b c d e g", b" \n "]
    w = _words.words(texts)
    lower = [t.lower().split() for t in texts]
    assert [[bytes(w.data[s:e]) for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == lower
    by_word = {}
    for word, h in zip([x for t in lower for x in t], w.hash.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    h, owner = _words.shingles(w, 5)
    assert Counter(owner.tolist()) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2}
    sets = {t: set(h[owner == t].tolist()) for t in (4, 5)}
    assert len(sets[4] & sets[5]) == 1


def corpus(n, seed=1):
    rng = random.Random(seed)
    lexicon = [[f"{lang}{i}" for i in range(40)] for lang in "ab"]
    return [" ".join(rng.choices(lexicon[i % 2], k=rng.randint(3, 60))) for i in range(n)]


SMALL = brown_lm.Settings(classes=4, types=30, endings=16, lexicon=50, ranges=4)


@pytest.fixture(scope="module")
def scored(spark):
    texts = [*corpus(60), "", None, "unseen words", "A0 a0 A0", corpus(1)[0], "a1 b2 unseen " * 60_000]
    df = spark.createDataFrame([(i, t, i % 3 == 0, 1.0) for i, t in enumerate(texts)] + [(None, "a1", False, 1.0)], "doc_id long, text string, held boolean, score double").repartition(3)
    model = brown_lm.train(df.where("NOT held"), SMALL)
    return df, model, brown_lm.score(df, model, F.col("held")).collect()


@pytest.mark.parametrize("held", [[], [0], [2**64 - 1], [0, 1, 2, 3, 2**63, 2**63 + 1, 2**64 - 2, 2**64 - 1], list(range(5, 4000, 3)), [x * 0x9E3779B97F4A7C15 % 2**64 for x in range(3000)]])
def test_words_are_found_by_leading_bits(held):
    held = np.array(sorted(held), np.uint64)
    lexicon = brown_lm.Lexicon(held, np.ones(len(held), np.int64), np.full(len(held), -1))
    asked = np.concatenate([held, held + np.uint64(1), held - np.uint64(1), np.array([0, 7, 2**63, 2**64 - 1], np.uint64)])
    at, there = lexicon.find(asked)
    assert there.tolist() == [x in set(held.tolist()) for x in asked.tolist()]
    assert (held[at[there]] == asked[there]).all()
    assert pickle.loads(pickle.dumps(lexicon)).lookup is None  # tasks make their own


def test_order_by_part_and_key():
    rng = np.random.default_rng(1)
    for parts in (1, 7, 70_000):
        part, key = rng.integers(0, parts, 5000), rng.permutation(5000)
        for k in (key, None):
            order, bounds = brown_lm._by_part(part, parts, k)
            assert order.tolist() == np.lexsort((np.arange(5000) if k is None else k, part)).tolist()
            assert bounds.tolist() == np.searchsorted(np.sort(part), np.arange(parts + 1)).tolist()


def test_counts_do_not_depend_on_how_many_words_are_gathered(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in corpus(40)], "text string").coalesce(1)
    rows = lambda: sorted(tuple(r) for r in brown_lm.word_counts(df, SMALL).collect())
    whole = rows()
    monkeypatch.setattr(_words, "portions", lambda texts: ((i, [(t or "").encode()]) for i, t in enumerate(texts)))
    monkeypatch.setattr(brown_lm, "GATHERED", 10)
    assert rows() == whole
    assert sum(n for *_, n in whole) == sum(len(t.split()) for t in corpus(40))


def test_base_scores_and_counts(scored):
    df, model, rows = scored
    texts = {r.doc_id: r.text for r in df.collect()}
    seen = Counter()
    for r in df.where("NOT held").collect():
        seen.update([*(r.text or "").encode().lower().split(), None])
    total, distinct = sum(seen.values()), len(seen)
    assert len(rows) == len(texts)
    for r in rows:
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(seen[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((seen[t] + 1) / (total + distinct + 1)) for t in tokens))
        assert r.score < 0


@pytest.mark.parametrize(("long_text", "classes"), [(False, 4), (True, 6)])
def test_classes_predict_better_than_words_alone(spark, long_text, classes):
    """Two languages are found; a long text of three words in turn, most of all tokens, needs three classes more for these words."""
    texts = [*corpus(60), "", None, "unseen words", "A0 a0 A0", corpus(1)[0], *(["a1 b2 unseen " * 60_000] if long_text else [])]
    df = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "doc_id long, text string, held boolean").repartition(3)
    model = brown_lm.train(df.where("NOT held"), replace(SMALL, classes=classes))
    held = brown_lm.score(df.where("held"), model).collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_exchange(texts, classes):
    """The best log likelihood of exchange, one word at a time, from several starts."""
    pairs = Counter((a, b) for t in texts for a, b in zip([None, *t.split()], [*t.split(), None], strict=True))
    words = sorted({w for p in pairs for w in p if w is not None})

    def value(of):
        table = np.zeros((classes, classes))
        for (a, b), n in pairs.items():
            table[of[a], of[b]] += n
        return brown_lm.likelihood(table)

    best = -math.inf
    for seed in range(2):
        rng = random.Random(seed)
        of = {None: 0} | {w: rng.randint(1, classes - 1) for w in words}
        now, before = value(of), -math.inf
        while now > before + 1e-9:
            before = now
            for w in words:
                own = max(range(1, classes), key=lambda c: value(of | {w: c}))  # noqa: B023
                if value(of | {w: own}) > now + 1e-9:
                    of[w] = own
                    now = value(of)
        best = max(best, now)
    return best


def test_exchange_against_one_word_at_a_time(spark):
    rng = random.Random(9)
    follow = {c: rng.sample("pqrst", 2) for c in "pqrst"}  # five kinds of six words each

    def text():
        kind, out = rng.choice("pqrst"), []
        for _ in range(rng.randint(4, 12)):
            out.append(f"{kind}{rng.randint(0, 5)}")
            kind = rng.choice(follow[kind])
        return " ".join(out)

    texts = [text() for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    settings = brown_lm.Settings(classes=6, types=40, endings=8, lexicon=50, ranges=16, gain=1e-4)
    counts = brown_lm.word_counts(df, settings)
    lexicon = brown_lm._lexicon(counts, settings)
    table = brown_lm.bigrams(df, lexicon, settings)
    found = brown_lm.exchange(table, lexicon, settings)
    assert brown_lm.likelihood(brown_lm._class_table(table, found, settings)) >= 0.9 * plain_exchange(texts, 6)
    # what a step changes in the class table is what a new count of all bigrams says
    other = found.copy()
    moving = np.arange(len(found)) % settings.ranges_ % 4 == 1
    other[moving] = 1 + (other[moving] + 1) % 5
    other[0] = 0
    change = brown_lm._changed(table, found, other, settings, 1, 4)
    assert (brown_lm._class_table(table, found, settings) + change == brown_lm._class_table(table, other, settings)).all()


def test_probabilities_sum_to_one(scored):
    _, model, _ = scored
    assert np.allclose((10**model.transition).sum(1), 1)
    # the words of a class and one unknown word share its probability
    counts = {r.h: r.n for r in model.counts.collect()}
    known = {h: t for h, t in zip(model.lexicon.hash.view(np.int64).tolist(), model.lexicon.type.tolist(), strict=True)}
    of_class = Counter()
    for h, n in counts.items():
        if known.get(h, -1) >= 0:
            of_class[model.of_type[known[h]]] += n + 1
    assert all(total <= model.size[c] for c, total in of_class.items())


def test_words_beyond_the_types_have_classes_by_their_neighbours(spark):
    rng = random.Random(6)
    # two languages of four frequent words each, and rare words of one ending among them
    word = lambda x, y: f"{y}{rng.randint(0, 40)}xend" if rng.random() < 0.25 else f"{x}{rng.randint(0, 3)}"
    texts = [" ".join(word(*("ar" if i % 2 else "bs")) for _ in range(24)) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    models = {}
    for lexicon in (8, 1000):  # the classes come from the table, or from the arrays
        model = brown_lm.train(df, brown_lm.Settings(classes=5, types=8, endings=16, lexicon=lexicon, ranges=4))
        own = {r.h: r["class"] for r in model.counts.collect()}
        of = lambda word: own[int(_words.words([word.encode()]).hash.view(np.int64)[0])]
        seen = sorted({w for t in texts for w in t.split()})
        # with four classes for two languages one of them may have two: what counts is that the languages' words are apart
        in_r, in_s = (Counter(of(w) for w in seen if w[0] == first) for first in "rs")
        n_r, n_s = sum(n for c, n in in_r.items() if n > in_s[c]), sum(n for c, n in in_s.items() if n > in_r[c])
        assert len(own) == len(seen) and min(n_r, n_s) >= 36  # of 41 each
        scores = {r.doc_id: r for r in brown_lm.score(df, model).collect()}
        # scores and sizes against plain sums over the classes
        tokens, uses = Counter(), Counter(w for t in texts for w in t.split())
        for w in seen:
            tokens[of(w)] += uses[w] + 1
        tokens[0] = len(texts) + 1
        assert [tokens[c] + 1 for c in range(5)] == model.size.tolist()
        for i, t in enumerate(texts):
            c = [0, *(of(w) for w in t.split()), 0]
            want = sum(model.transition[a, b] - math.log10(model.size[b]) for a, b in zip(c[:-1], c[1:], strict=True)) + sum(math.log10(uses[w] + 1) for w in t.split()) + math.log10(len(texts) + 1)
            assert scores[i].score == pytest.approx(want) and scores[i].n_known == len(c) - 1
        models[lexicon] = model.transition
    assert np.allclose(models[8], models[1000])


def test_threshold_of_very_frequent_words(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([90_000, 80_000, 70_000, 70_000, 5, 1])], "h long, n long")
    assert [brown_lm._threshold(counts, most) for most in (0, 1, 2, 3, 4, 5, 6)] == [1 << 62, 90_000, 80_000, 80_000, 70_000, 5, 1]


def test_untrained_and_empty(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = brown_lm.train(df.limit(0), SMALL)
    rows = brown_lm.score(df, model).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in rows] == [(0, 0, 0.0)] * 2 and all(math.isfinite(r.score) for r in rows)
    assert brown_lm.score(df.limit(0), model).count() == 0


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the quiet river", "walks along", "a green valley", "in spring", "and people talk"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "click%%%", "NOW!!"]) for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good(), i) for i in range(160)] + [(1000, None, 0), (1001, "", 0), (None, good(), 0), (1002, good() * 200, 0), (1, good(), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(160)] + [(1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    found = quality_classifier.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.predicted == (r.doc_id % 4 != 0) for r in found if r.doc_id is not None and r.doc_id < 160)
    kept = quality_classifier.good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id < 160 AND doc_id % 4 = 0").count() == 0
    one = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality_classifier.score(docs, one).collect()} == {1}
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}


def test_quality_against_a_plain_version(spark):
    rng = random.Random(9)
    words = ["river", "walks", "valley", "spring", "people", "stone", "winter", "paper", "light", "garden"]
    text = lambda bad: " ".join(rng.choice(words[5 * (rng.random() < (0.75 if bad else 0.25)) :][:5]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(40, 300)))
    rows = [(i, text(i % 3 == 0), 7) for i in range(240)] + [(300, "é" * 700, 7), (301, "", 7), (302, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")  # a column of the labels' name
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(240)], "doc_id long, quality int")
    settings = quality_classifier.Settings(dict_bytes=4096)
    model = quality_classifier.fit(docs, labels, settings)
    found = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}

    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    of = dict((i, (t or "").encode()) for i, t, _ in rows)
    sides = [[of[i] for i in order if (i % 3 != 0) == good] for good in (True, False)]
    made = [zstandard.train_dictionary(4096, x[::2]).as_bytes() for x in sides]

    def size(t, dictionary):
        one = zstandard.ZstdCompressionDict(dictionary)
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=one, write_content_size=False, write_dict_id=False).compress(t[i : i + 256])) for i in range(0, len(t), 256))

    plain = {i: (size(t, made[1]) - size(t, made[0])) / (size(t, made[1]) + size(t, made[0])) if t else 0.0 for i, t in of.items()}
    assert all(abs(found[i].difference - x) < 1e-12 for i, x in plain.items())
    # the fit: no neighbour has a greater likelihood of the rows that the dictionaries have not seen
    seen = [(next(plain[i] for i in of if of[i] == t), y, n / len(x[1::2])) for x, y, n in ((sides[0], 1, 160), (sides[1], 0, 80)) for t in x[1::2]]
    total = sum(w for *_, w in seen) / len(seen)
    likely = lambda a, b: sum(w / total * -math.log1p(math.exp(-(a + b * x) if y else a + b * x)) for x, y, w in seen) - 0.5e-3 * b * b
    best = likely(model.intercept, model.slope)
    assert model.slope > 1 and all(likely(model.intercept + i, model.slope + j) < best + 1e-9 for i, j in ((0.05, 0), (-0.05, 0), (0, 0.5), (0, -0.5), (0.05, 0.5), (-0.05, -0.5), (0.05, -0.5)))
    assert all(abs(found[i].score - 1 / (1 + math.exp(-model.intercept - model.slope * x))) < 1e-12 for i, x in plain.items())


def test_quality_sample_by_class_and_too_little_text(spark):
    # one id of class 0 comes a thousand times; class 1 keeps its rows
    docs = spark.createDataFrame([(1, f"bad {i}") for i in range(1000)] + [(i, f"a good text of its own {i}") for i in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)] + [(i, 1) for i in range(2, 12)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="too little labelled text"):
        model = quality_classifier.fit(docs, labels, quality_classifier.Settings(sample=10))
    assert {round(r.score, 9) for r in quality_classifier.score(docs, model).collect()} == {0.5}  # ten rows of each
    asked = quality_classifier.fit(docs, labels, quality_classifier.Settings(sample=10, dictionaries="content"))
    assert asked.raw and asked.good.startswith(b"a good text") and asked.bad.startswith(b"bad")
    with pytest.raises(ValueError, match="no kind of dictionary"):
        quality_classifier.fit(docs, labels, quality_classifier.Settings(dictionaries="other"))

import re
from collections import Counter

import pytest

from wayfold.llm import source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ROWS = [
    ("the cat sat, The DOG ran", "en", "a"), ("the cat's dog the", "en", "b"), ("cat dog the bird", "en", "a"), ("bird bird bird the", "en", "c"), ("bird 1234 !!", "en", "c"),
    (None, "en", "empty"), ("", "en", None), ("été ÉTÉ été_x", "fr", "a"), ("été x", "fr", "b"), ("x été\x00x", "fr", "b"), ("one", "de", "a"), ("two", "de", "b"), ("two two", None, "a"), ("two", None, None), ("two", None, "a"),
    ("same", "en", "a"), ("same", "en", "a"), ("same", "en", "d"), ("rare once", "en", "d"), ("z" * 5000 + " the" * 5000, "en", "b"), ("日本 the", "en", "\U0001f642"), ("日本", "en", "é"), ("日本", "en", "zz"),
]


def plainly(rows, least=3, top=200):
    docs = [(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        held = Counter(t for d in own for t in set(d[0]))
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: Counter(t for d in own if d[2] == s for t in d[0] if t in kept) for s in {d[2] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s in count:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s]
            over = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(sorted(found)[:most], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value long, term string").repartition(3)


def result(df, **more):
    rows = [tuple(r) for r in source_divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_all_terms_of_all_pairs(spark):
    assert result(frame(spark, ROWS)) == plainly(ROWS)
    assert result(frame(spark, ROWS), least=1, top=2) == plainly(ROWS, 1, 2)


def test_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "LISTS", 2)
    monkeypatch.setattr(source_divergence, "HELD", 3)
    monkeypatch.setattr(source_divergence, "PAIRS", 4)
    assert result(frame(spark, ROWS)) == plainly(ROWS)


def test_no_kept_terms_and_no_rows(spark):
    rows = [("one", "de", "a"), ("two", "de", "b"), (None, "de", "c")]
    assert result(frame(spark, rows)) == plainly(rows) == {("de", s, "pair", o, 0, i) for s, rest in (("a", "bc"), ("b", "ac"), ("c", "ab")) for i, o in enumerate(rest, 1)}
    assert result(frame(spark, rows).limit(0)) == set()


@pytest.mark.parametrize("c", [0, 7, 10**10])
def test_shares_are_exact(spark, c):
    from pyspark.sql import functions as F

    row = spark.range(1).select(source_divergence.share(F.lit(c).cast("long"), F.lit(3 * 10**10 + 1)).alias("p")).first()
    assert row.p == 1 + 10**9 * (c + 1) // (3 * 10**10 + 1)

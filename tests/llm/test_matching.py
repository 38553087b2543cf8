import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import decontamination, fingerprints, jaccard_join, sharding, url_filters
from wayfold.llm.components import components


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_texts(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 9))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 12, 40, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    passage = " ".join(word() for _ in range(30))
    out += [" ".join([word() for _ in range(9)] + [passage] + [word() for _ in range(rng.randint(0, 9))]) for _ in range(12)]
    return [*out, out[0], out[0].upper(), "", None, " \t", "one two", "one two", "One  two"]


def test_join_against_all_pairs(spark):
    texts = near_texts()
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[5], 0), (None, texts[0], 0), (None, "alone here", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(4)
    found = jaccard_join.join(df, jaccard_join.Settings(postings=200, block=5, heads=6, marks=7)).collect()
    sets = [shingle_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    want = sorted((str(doc), len(sets[i]), str(least.get(find(i)))) for i, (doc, _, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want
    groups = {}
    for i, (doc, text, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc is None, doc or 0, text, i))
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    left = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    alone = [i for i, x in enumerate(sets) if not x]
    assert len(left) == len([g for g in groups.values() if sets[g[0][3]]]) + len(alone)
    for g in groups.values():
        if sets[g[0][3]]:
            least = min(x[:2] for x in g)
            assert any((str(x[1]) if not x[0] else "None", str(x[2])) in left for x in g if x[:2] == least)


def test_one_of_each_by_rows(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "alpha beta gamma delta epsilon zeta")
    rows = [(2, a, 1), (5, a, 2), (5, b, 3), (None, b, 4), (None, c, 5), (None, c, 5), (7, None, 6), (7, None, 6), (None, "", 7), (9, c.upper(), 8), (9, c.upper(), 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int").withColumns({"key": F.lit(1), "node": F.lit("x"), "row": F.lit(2), "at": F.lit(3), "twins": F.lit(4)}).repartition(3)
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    found = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert found == sorted([("2", a), ("5", b), ("9", c.upper()), ("7", "None"), ("7", "None"), ("None", "")])
    only = spark.createDataFrame([(None, c, 1), (None, c, 2)], "doc_id long, text string, n int")
    assert jaccard_join.one_of_each(only).count() == 1
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0 and jaccard_join.join(df.limit(0)).count() == 0


def test_join_of_very_long_texts(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120_000)]
    near = [w if i % 100 else "other" for i, w in enumerate(base)]  # a twentieth of the shingles differ
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:91_000])), (4, " ".join(base[:50_000]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_bitmaps_never_rule_out_similar_sets():
    rng = np.random.default_rng(1)
    read = lambda raw: (int.from_bytes(raw[:8], "little"), 8 * (len(raw) - 8), int.from_bytes(raw[8:], "little"))
    for _ in range(300):
        s = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        t = np.unique(np.append(s[rng.random(len(s)) > rng.random() * 0.3], rng.integers(0, 1 << 63, rng.integers(0, len(s) // 4 + 1), dtype=np.uint64)))
        if len(t) and jaccard_join.similar(s, t, 75):
            assert jaccard_join.may_be_similar(read(jaccard_join.bitmap(s)), read(jaccard_join.bitmap(t)), 75)
    a, b = (np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in "ab")
    assert not jaccard_join.may_be_similar(read(jaccard_join.bitmap(a)), read(jaccard_join.bitmap(b)), 75)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7), (50, 40)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {i: 0 for i in range(21)} | {40: 40, 45: 40, 50: 40}
    assert components(links.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = near_texts(9)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(4)
    found = {r.doc_id: r for r in fingerprints.edited_pairs(df).collect()}
    assert len(found) == len(rows)
    import hashlib

    for i in found:
        own, nxt = texts[i] or "", texts[i - 1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert found[i].n_chars == len(own) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingle_set(own), shingle_set(edited), shingle_set(nxt)
        exact = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
        assert abs(found[i].near_edited - exact(a, b)) < 0.3 and abs(found[i].near_next - exact(a, c)) < 0.3
    prints = {}
    for i, t in enumerate(texts):
        assert prints.setdefault(t or "", found[i].fingerprint) == found[i].fingerprint
    errors = [found[i].near_edited - len(shingle_set(texts[i]) & shingle_set((texts[i])[: len(texts[i]) - len(texts[i]) // 2] + (texts[i - 1] or "")[: len(texts[i]) // 2])) / max(1, len(shingle_set(texts[i]) | shingle_set((texts[i])[: len(texts[i]) - len(texts[i]) // 2] + (texts[i - 1] or "")[: len(texts[i]) // 2]))) for i in range(40) if texts[i]]
    assert abs(sum(errors) / len(errors)) < 0.05
    assert fingerprints.edited_pairs(df.limit(0)).count() == 0
    one = fingerprints.edited_pairs(df.where("doc_id = 0")).first()
    assert one.near_next == 1.0


def plain_fingerprint(text):
    """Bins, densification and low bits one by one. Spark's xxhash64 is XXH64 with seed 42, and a further column's seed is the hash so far."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda v, seed=42: xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in re.split("[ \t-\r]+", (text or "").lower()) if x]
    if not w:
        return None
    hashes = []
    for group in [w] if len(w) < 5 else [w[i : i + 5] for i in range(len(w) - 4)]:
        h = 42
        for x in group:
            h = long(x, h)
        hashes.append(signed(h))
    least = {}
    for h in hashes:
        least[h >> 57] = min(h, least.get(h >> 57, h))
    out = []
    for b in range(-64, 64):
        if b in least:
            out.append(least[b] & 255)
        else:  # the bin that is not empty and has the least hash of both numbers; its low byte
            out.append(min((signed(long(e, long(b))) & -256) | (least[e] & 255) for e in least) & 255)
    return out


def plain_likeness(a, b):
    if a is None or b is None:
        return float(a is b)
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_against_a_plain_version(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randint(0, 99999)}" for _ in range(60_000))
    same = [f"{x} words of an id that is repeated" for x in ("some", "other", "more")]
    rows = [(i * 7 % 50, t) for i, t in enumerate(near_texts(5)[:50])] + [(200, long), (201, long + " end"), (None, "no id"), (None, None), (None, "no id"), (300, None)] + [(400, t) for t in [*same, same[0]]] + [(None, f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"print": F.lit(1), "next_text": F.lit("x"), "_hash": F.lit(3)}).repartition(4)
    found = fingerprints.edited_pairs(df).collect()
    assert len(found) == len(rows)
    import xxhash

    hashed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42)) % (1 << 64) >> 1
    order = sorted([(d, t or "") for d, t in rows], key=lambda x: (x[0] is None, -(x[0] or 0), hashed(x[1]), x[1]))
    want = []
    for (doc, own), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        a, b, c = map(plain_fingerprint, (own, edited, nxt))
        text = lambda p: bytes(p).hex() if p else "0" * 256
        want.append((str(doc), len(own), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got) == sorted(want)


def test_decontamination_against_a_plain_alignment(spark):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randint(0, 3000))
    items = [" ".join(word() for _ in range(rng.randint(15, 50))) for _ in range(12)]
    filler = lambda n: " ".join(word() for _ in range(n))

    def changed(text, share):
        return " ".join(word() if rng.random() < share else w for w in text.split() if rng.random() > share / 3)

    docs = [f"{filler(80)} {items[0]} {filler(30)}", items[1].upper(), f"{changed(items[2], 0.15)} {filler(50)}", f"{filler(500)} {changed(items[3], 0.1)}", filler(900), "", None, "few words", f"{items[4]} {filler(100)} {items[5]}"]
    table = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate([*docs, docs[0]])], "doc_id long, text string, score double")
    bench = spark.createDataFrame([(i, t, 2.0) for i, t in enumerate(items)] + [(90, None, 0.0), (91, "too short", 0.0), (None, items[0], 0.0), (92, items[1], 0.0)], "item_id long, text string, score double")
    found = decontamination.matches(table, bench, decontamination.Settings(block=900)).collect()

    def plain(a, b):
        last, best = [0] * (len(b) + 1), 0
        for x in a:
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(max(0, last[j - 1] + (2 if x == y else -1), last[j] - 1, row[-1] - 1))
            last, best = row, max(best, *row)
        return best

    want = {}
    for i, d in enumerate([*docs, docs[0]]):
        for k, t in [*enumerate(items), (92, items[1])]:
            a, b = t.lower().split(), (d or "").lower().split()
            share = plain(a, b) / (2 * len(a)) if b else 0
            if share >= 0.5:
                want[i, k] = share
    assert {(r.doc_id, r.item_id): pytest.approx(r.score) for r in found} == want
    whole = next(r for r in found if (r.doc_id, r.item_id) == (0, 0))
    assert (whole.first_word, whole.last_word) == (80, 80 + len(items[0].split()) - 1)
    assert sorted(r.doc_id for r in decontamination.clean(table, bench).collect()) == [4, 5, 6, 7]
    assert decontamination.matches(table.limit(0), bench).count() == 0 and decontamination.matches(table, bench.limit(0)).count() == 0


def test_decontamination_of_edited_copies(spark):
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randint(0, 400))
    items = [" ".join(word() for _ in range(n)) for n in (3, 8, 20, 21, 33, 48)]

    def changed(text, share):
        return " ".join(w if rng.random() > share else rng.choice(["", word(), f"{w} {word()}"]) for w in text.split())

    every = lambda text, k, put: " ".join(put(w) if i % k == k - 1 else w for i, w in enumerate(text.split()))
    filler = lambda n: " ".join(word() for _ in range(n))
    copies = [(k, every(t, 3, lambda _: "zz")) for k, t in enumerate(items)]  # no three words in a row are left
    copies += [(k, every(t, 2, lambda w: f"{w} {word()}")) for k, t in enumerate(items)] + [(k, every(t, 1, lambda w: f"{w} {word()}")) for k, t in enumerate(items)]
    copies += [(k, changed(items[k], share)) for share in (0.2, 0.25, 0.4) for k in (3, 4, 5) for _ in range(2)]
    copies += [(2, changed(items[2], 0.25)) for _ in range(60)]  # many copies with their own counts
    texts = [f"{filler(rng.randint(0, 40))} {t} {filler(rng.randint(0, 40))}" for _, t in copies] + [filler(200) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def plain(a, b):
        last, best = [0] * (len(b) + 1), 0
        for x in a:
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(max(0, last[j - 1] + (2 if x == y else -1), last[j] - 1, row[-1] - 1))
            last, best = row, max(best, *row)
        return best / (2 * len(a))

    scores = {(i, k): plain(t.split(), d.split()) for i, d in enumerate(texts) for k, t in enumerate(items)}
    want = {key: pytest.approx(s) for key, s in scores.items() if s >= 0.5}
    assert sum(0.5 <= scores[i, k] < 0.7 for i, (k, _) in enumerate(copies)) > 20
    assert {(r.doc_id, r.item_id): r.score for r in decontamination.matches(docs, bench, decontamination.Settings(block=500)).collect()} == want
    i = next(i for i, (k, _) in enumerate(copies) if (i, k) in want)  # a single copy in a small table
    one = decontamination.matches(docs.where(F.col("doc_id") == i), bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in one} == {key: s for key, s in want.items() if key[0] == i}
    assert decontamination.matches(docs, bench.select("item_id", F.lit("two words").alias("text"))).count() == 0


def test_clean_by_rows(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join("f" + str(rng.randint(0, 500)) for _ in range(n))
    item = " ".join(f"i{k}" for k in range(20))
    rows = [(1, f"{filler(9)} {item}", 1), (1, "a clean text", 2), (None, item, 3), (None, "clean", 4), (2, None, 5), (2, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long").withColumns({"row": F.lit(1), "best": F.lit(2), "item_id": F.lit(3)}).repartition(2)
    bench = spark.createDataFrame([(1, item), (1, "other words of an item with the same number"), (2, item)], "item_id long, text string")
    for block in (30, 1 << 20):
        left = decontamination.clean(df, bench, decontamination.Settings(block=block))
        assert left.columns == df.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("1", "a clean text"), ("2", "None"), ("2", "None"), ("None", "clean")]
        found = decontamination.matches(df, bench, decontamination.Settings(block=block)).collect()
        assert sorted((str(r.doc_id), r.item_id, r.score) for r in found) == [("1", 1, 1.0), ("1", 2, 1.0), ("None", 1, 1.0), ("None", 2, 1.0)]


def test_alignment_in_very_long_passages(spark):
    rng = np.random.default_rng(4)
    item = np.arange(1, 21, dtype=np.uint64)
    text = rng.integers(100, 1 << 40, 1_053_576, dtype=np.uint64)
    text[-20:] = item
    score, start, end = decontamination.align([item], [text])
    assert (score.tolist(), start.tolist(), end.tolist()) == ([40], [1_053_556], [1_053_575])
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 300_000))
    words = " ".join(f"q{x}" for x in range(30))
    df = spark.createDataFrame([(1, f"{long} {words}"), (2, f"{words} {long}"), (3, long), (4, f"{words} " * 3000)], "doc_id long, text string")
    found = decontamination.matches(df, spark.createDataFrame([(7, words)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.score, r.first_word, r.last_word) for r in found) == [(1, 1.0, 300_000, 300_029), (2, 1.0, 0, 29), (4, 1.0, 0, 29)]


def test_sharding(spark):
    rows = [(i, "x" * (i * 37 % 90)) for i in range(400)] + [(None, "y"), (5, None), (6, "z" * 5000), (8, "long " * 400_000)] + [(77, "same row")] * 100
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), limit=300).collect()
    assert sorted((str(r.key), r.bytes) for r in found) == sorted((str(k), len(t or "")) for k, t in rows)
    size, depth = {}, {}
    for r in found:
        size[r.shard] = size.get(r.shard, 0) + r.bytes
        depth[r.shard] = r.depth
    assert all(n <= 300 or n in (5000, 2_000_000) for n in size.values())
    plain = [s for s in size if "-" not in s]
    for s in plain:  # prefixes are disjoint, and none could be shorter
        assert not any(o != s and o.startswith(s) for o in plain)
        assert not s or sum(n for o, n in size.items() if o.startswith(s[:-1])) > 300
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert {r.shard for r in sharding.shard(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()} == {""}


def test_url_filters(spark):
    rng = random.Random(5)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.net"]
    names = [*(f"host:{h}" for h in hosts), *(f"domain:{h}" for h in hosts), "url:http://b.org/page"]
    entries = [(rng.choice(["spam", "adult"]), rng.choice(names), rng.choice(["add", "remove"]), rng.randrange(0, 2000, 10)) for _ in range(120)]
    captures = [(i, f"http://{rng.choice(hosts).upper()}/{rng.choice(['', 'page', 'q#f'])}", rng.randrange(-50, 2100)) for i in range(150)]
    captures += [(500, None, 5), (501, "no url", 5), (502, "http://a.com", None), (503, "http://u:p@x.a.com:80/", 900), captures[0], captures[0], (504, "http://x.a.com/" + "long/" * 20_000, 700), (505, "http://a.com", 10**15), (506, "http://b.org/page", -(10**15))]
    e = spark.createDataFrame([*entries, (None, "host:a.com", "add", 0), ("spam", "host:a.com", "perhaps", 0)], "list string, pattern string, action string, at long")
    c = spark.createDataFrame([(*x, "z") for x in captures], "capture_id long, url string, fetched_at long, host string").repartition(3)
    found = url_filters.evaluate(c, e, width=300, share=7).collect()

    def active(pattern, which, t):
        state = [(at, a == "add") for n, p, a, at in entries if (n, p) == (which, pattern) and at <= t]
        return bool(state) and any(on for at, on in state if at == max(s[0] for s in state))

    def wanted(i, url, t):
        if url is None or t is None:
            return (i, 0, "")
        host = url.split("//")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if "//" in url else None
        keys = ["url:" + url.split("#")[0].lower()]
        if host:
            parts = host.split(".")
            keys += [f"host:{host}", *("domain:" + ".".join(parts[k:]) for k in range(len(parts)))]
        hits = [n for n in ("spam", "adult") for k in keys if active(k, n, t)]
        return (i, len(hits), ",".join(sorted(set(hits))))

    assert sorted((r.capture_id, r.n_entries, r.lists) for r in found) == sorted(wanted(*x) for x in captures)
    assert all(r.blocked == (r.n_entries > 0) for r in found)
    assert url_filters.evaluate(c.limit(0), e).count() == 0 and url_filters.evaluate(c, e.limit(0)).where("blocked").count() == 0
    assert c.where(F.lit(True)).count() == len(captures)

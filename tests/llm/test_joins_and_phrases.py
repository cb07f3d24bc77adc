"""Jaccard join, importance resampling and collocations against brute-force versions, at small bounds and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from passagelake.llm import collocations, importance, jaccard
from passagelake.llm.perfecthash import PerfectHash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, label string, key string"
ODD = [
    (1, None, None, None, None, 1, 0.0, "x", "y"),
    (2, "", "en", "a", 0, 1, 0.0, "x", "y"),
    (3, " \t\n", "en", "a", 3, 1, 0.0, "x", "y"),
    (4, "one", "en", "a", 3, 1, 0.0, "x", "y"),
    (4, "one", "en", "a", 3, 1, 0.0, "x", "y"),
    (5, "One", "fr", "a", 3, 1, 0.0, "x", "y"),
    (None, "one two three four five six", None, "a", 3, 1, 0.0, "x", "y"),
    (None, "one two three four five six", None, "a", 3, 1, 0.0, "x", "y"),
    (7, "ONE two three four five six", "en", "b", 3, 1, 0.0, "x", "y"),
    (8, "日本 語 é ß", "ja", "b", 3, 1, 0.0, "x", "y"),
    (9, " ".join(f"w{i % 700}" for i in range(40_000)), "en", "b", 3, 1, 0.0, "x", "y"),
]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def texts(seed, n=160):
    """Texts with copies, near copies, shared passages and shared openings."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    shared = [[r.choice(words) for _ in range(r.randrange(5, 60))] for _ in range(4)]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.5 and out:
            w = list(r.choice(out))
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(r.randrange(1, 90))]
            if kind > 0.8:
                w = r.choice(shared) + w
        out.append(w)
    return [" ".join(w) for w in out]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("light, part, percent", [(None, 1024, 80), (0, 2, 80), (15, 4, 60)])
def test_jaccard_components(spark, light, part, percent):
    rows = [(i, t) for i, t in enumerate(texts(3))] + [(None, "w1 w2"), (900, "w1 w2"), (901, ""), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(docs, percent=percent, light=light, part=part)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(components(rows, percent), key=key)


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == Counter(components([(r[0], r[1]) for r in ODD]))
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_signatures_share_enough():
    r = np.random.default_rng(1)
    counts = r.integers(0, 50, jaccard.SLOTS).astype(np.uint32)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(4, 80)).astype(np.uint64))
        keep = r.random(len(a)) < 0.93
        b = np.unique(np.concatenate([a[keep], r.integers(0, 1 << 63, 2).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            for k in (1, 2):
                assert len(np.intersect1d(jaccard.signature(a, counts, 80, k), jaccard.signature(b, counts, 80, k))) >= min(k, both)
            x, y = (np.frombuffer(jaccard.sketch(s), np.uint64) for s in (a, b))
            differ = int(np.bitwise_count(x ^ y).sum())
            assert differ <= len(a) + len(b) - 2 * both and jaccard.may_link(len(a), len(b), differ, 80)


def test_boundary_weighs_both_ways():
    assert jaccard.boundary([(12, 1000), (40, 1000)], 1e9) >= jaccard.largest(40)  # lists too long to read
    assert jaccard.boundary([(12, 1000), (40, 1000)], 0.0) < jaccard.largest(40)  # subsets too many to write
    assert jaccard.boundary([], 1.0) == 1


def brute_importance(rows, target, buckets, gram, least, percent, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, gram + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for d, x in rows:
        n, f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    some = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(some[: percent * len(some) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("buckets, gram, percent", [(10_000, 1, 10), (37, 3, 55), (1 << 16, 2, 100)])
def test_importance(spark, buckets, gram, percent):
    rows = [(i, t) for i, t in enumerate(texts(5))] + [(900, ""), (901, None), (902, "Été 42 x-y")]
    target = texts(6, 9) + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(docs, wanted, buckets=buckets, gram=gram, least_words=5, percent=percent)
    assert Counter(tuple(r) for r in got.collect()) == brute_importance(rows, target, buckets, gram, 5, percent, 2024)


def test_importance_odd_rows(spark):
    docs, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], "text string")
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in importance.resampled(docs, none, least_words=0, percent=50).collect())
    want = brute_importance([(r[0], r[1]) for r in ODD], [], 10_000, 1, 0, 50, 2024)
    assert got == want
    assert importance.resampled(docs.limit(0), none).count() == 0


def test_run_lengths():
    values, many = importance.run_lengths(np.array([5, 1, 5, 65535, 1, 5], np.uint16))
    assert values.tolist() == [1, 5, 65535] and many.tolist() == [2, 3, 1]
    assert [len(x) for x in importance.run_lengths(np.zeros(0, np.uint16))] == [0, 0]


def test_perfect_hash():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 63, 50_000).astype(np.uint64))
    h = PerfectHash(np.concatenate([keys, keys[:10]]))
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys))) and (h.keys[h.slots(keys)] == keys).all()
    assert (h.slots(np.setdiff1d(r.integers(0, 1 << 63, 50_000).astype(np.uint64), keys)) == -1).all()
    assert PerfectHash(np.zeros(0, np.uint64)).slots(keys[:3]).tolist() == [-1] * 3


def brute_collocations(rows, longest, least, inside, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        gone = {q[i : i + m] for q, b in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= inside * found[q[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, inside, top, block, longest, slots", [(3, 100, 2000, 1 << 20, 5, 1 << 22), (2, 80, 40, 2000, 4, 1 << 16), (4, 100, 2000, 60, 3, 1 << 14)])
def test_collocations(spark, least, inside, top, block, longest, slots):
    r = random.Random(4)
    rows = [(re.sub(" w[1-5] ", lambda _: r.choice([", ", ".\n", "\t ", "  "]), t), r.choice(["en", "fr", None])) for t in texts(7, 90)] + [(None, "en"), ("", None), ("A b c d e f, a B c d e f", "xx")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = collocations.collocations(docs, least=least, inside=inside, top=top, block=block, longest=longest, slots=slots)
    assert sorted(tuple(x) for x in got.collect()) == brute_collocations(rows, longest, least, inside, top)


def test_collocations_by_counters_that_no_task_holds(spark, monkeypatch):
    """Beyond DENSE counters tasks hand on the places that windows met: the same phrases, whatever is held at once."""
    monkeypatch.setattr(collocations, "DENSE", 0)
    rows = [(t, "en") for t in texts(8, 90)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.collocations(docs, least=3, longest=3, slots=1 << 14)
    assert sorted(tuple(x) for x in got.collect()) == brute_collocations(rows, 3, 3, 100, 2000)


def test_collocation_counters_never_fill():
    """The mean of a counter stays below two fifths of the least count, however many windows there are."""
    for windows in (0, 10**6, 10**8, 10**9, 10**10):
        slots = collocations.counters(windows, 100, collocations.SLOTS)
        assert slots >= collocations.SLOTS and slots & (slots - 1) == 0 and windows <= 40 * slots
    assert collocations.counters(10**6, 100, collocations.SLOTS) == collocations.SLOTS


def test_collocation_streams_are_stored_in_short_rows(spark):
    """Spark reads thousands of rows of a stored table at once: a row holds ROW words or so, also of one very long text."""
    long = " ".join(f"w{i % 50}" + ("," if i % 7 == 0 else "") for i in range(40_000))
    docs = spark.createDataFrame([(long, "en")] + [("w1 w2 w3 w4.", "en")] * 400, "text string, lang string").coalesce(1)
    vocabulary = collocations.word_counts(docs).filter("n >= 3")
    key = spark.createDataFrame([(r.lang, bytes(r.word), r.n, int(np.uint64(collocations.word_key(r.lang, bytes(r.word))).view(np.int64))) for r in vocabulary.collect()], "lang string, word binary, n long, key long")
    for block in (1 << 20, 30):
        _, streams = collocations.encoded(docs, key, "text", "lang", block)
        sizes = [len(r.words) // 4 for r in streams.collect()]
        assert len(sizes) > 40 and max(sizes) <= 2 * collocations.ROW


def test_collocations_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, least=2).collect())
    assert got == brute_collocations([(r[1], r[2]) for r in ODD], 5, 2, 100, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_jaccard_entries_alone_in_their_bucket_go():
    """Packed entries over several batches: a bucket's rows come together with its least node, single ones and repeated ones go."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    key, node = r.integers(0, 400, 900), r.integers(0, 30, 900)
    rows = [(s, key[(key % 4 == s) & at], node[(key % 4 == s) & at]) for s in range(4) for at in (np.arange(900) % 2 == 0, np.arange(900) % 2 == 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in some], pa.int32()), pa.array([k.tobytes() for _, k, _ in some], pa.binary()), pa.array([n.tobytes() for _, _, n in some], pa.binary())], ["share", "keys", "nodes"]) for some in (rows[:3], rows[3:])]
    got = sorted(x for b in jaccard._shared(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns)))
    held = defaultdict(list)
    for k, n in zip(key.tolist(), node.tolist()):
        held[k].append(n)
    assert got == sorted((k, n, min(ns)) for k, ns in held.items() if len(set(ns)) > 1 for n in ns)
    assert list(jaccard._shared(iter([]))) == []


def test_jaccard_words_are_hashed_by_bytes():
    """Equal words have equal hashes wherever they stand, A-Z as a-z; others, of any length, have others."""
    r = np.random.default_rng(5)
    texts = [bytes(r.choice(list(b"abAB\xe6\x00\x1c  \t\n"), n).tolist()) for n in (0, 1, 7, 3000, 100_000)]
    texts += [None, b"x" * 200_000, b"A" * 70_000 + b" b " + b"c" * jaccard.SPAN + b" d" + b" " * 200_000 + b"e F g", b" " * 70_000]
    words = [w.translate(bytes.maketrans(b"AB", b"ab")).replace(b"F", b"f") for t in texts for w in (t or b"").split()]
    start, hashed = jaccard.word_hashes(np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8))
    assert len(start) == len(words) and len(set(words)) == len(set(hashed.tolist())) == len(set(zip(words, hashed.tolist())))
    assert [len(s) for s in jaccard.shingle_sets([b"a b c d e f", b"A b", b"", None, b"a b c d e a b c d e"])] == [2, 1, 0, 0, 5]


def test_jaccard_boundary_stays_as_the_corpus_grows():
    """Counters that more elements share don't make light sets of large ones: their subsets grow with the square of the size."""
    r = np.random.default_rng(6)
    for load in (1, 24, 113, 1400):
        assert jaccard.boundary([(c, 1000) for c in range(80)], jaccard.list_length(r.poisson(load, 1 << 20)), 80) <= 20
    assert jaccard.counters(0) == jaccard.SLOTS < jaccard.counters(1 << 30) < jaccard.counters(1 << 50) == jaccard.MOST


def test_jaccard_pairs_rows_of_sizes_that_may_link():
    r = np.random.default_rng(7)
    group, size = np.repeat(np.arange(5), [1, 300, 0, 40, 700]), r.integers(1, 2000, 1041)
    group, size = group[order := np.lexsort((size, group))], size[order]
    left, same = r.random(1041) < 0.5, group != 3
    met = [p for i, j in jaccard._crossed(group, left, same, size, 80) for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for i in range(1041) for j in range(i + 1, 1041) if group[i] == group[j] and 100 * size[i] >= 80 * size[j] and (same[i] or left[i] != left[j])}
    assert len(met) == len(want) and set(met) == want

"""Collocations, clusters and repeated passages against plain versions, over awkward tables and at any bound."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from letterlake.llm import centroids, collocations, passages


# --- collocations ------------------------------------------------------------------------------


def brute_collocations(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            own.update(" ".join(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        some = [p for p in f if f[p] >= least and " " in p]
        found = []
        for p in some:
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and f[q] >= f[p] for q in some):
                continue
            score, k = min((1000 * f[p] * totals[lang] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            found.append((-score, -f[p], p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out += [(lang, n, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return set(out)


def prose_of(rng, n):
    words = ["The", "of", "é", "ab\x00c", "über", "x" * 70, "new", "york", "日本", "#"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("table_words", [1_000_000, 3, 0])
def test_collocations_against_counting(spark, table_words):
    rng = random.Random(4)
    rows = [(prose_of(rng, rng.randint(0, 60)), rng.choice(["en", "und", None, "a b", ""])) for _ in range(120)] + [("new york city of the world " * 12, "en"), (None, "en"), ("", None), (" \t.", "zz"), ("alone", "one")]
    df = spark.createDataFrame([(t, lang, 7) for t, lang in rows], "text string, lang string, rank int")
    got = {tuple(r) for r in collocations.collocations(df, least=6, top=25, table_words=table_words).collect()}
    # an empty language is a language of its own
    assert got == brute_collocations(rows, 6, 25)


def test_no_rows_and_no_frequent_phrase(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).count() == 0


def test_a_phrase_over_several_ranges_and_a_very_long_text(spark, monkeypatch):
    # every suffix begins with the same two words, so that ranges must cut it
    monkeypatch.setattr(collocations, "EVERY", 3)
    rng = random.Random(6)
    text = " ".join(f"hot pair {rng.choice('abcdefghij')} {rng.choice('abcdefghij')}" for _ in range(3_000))
    df = spark.createDataFrame([(text, "en")] * 2, "text string, lang string")
    got = {tuple(r) for r in collocations.collocations(df, least=50).collect()}
    assert got == brute_collocations([(text, "en")] * 2, 50, 2_000)


# --- clusters ------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    now = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(now)) for _, v in kept]
        if n < rounds:
            for j in range(len(now)):
                mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
                if mine:
                    now[j] = [sum(x) // len(mine) for x in zip(*mine)]
    total = Counter()
    for d, j in own:
        total[j] += d
    return sorted((str(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own))


@pytest.mark.parametrize("seed", range(3))
def test_clusters_against_comparing_all(spark, seed):
    rng = random.Random(seed)
    # few different whole values make many ties; repeated rows and ids, odd vectors
    rows = [(rng.randrange(150), [rng.choice([-2.0, -0.5, 0.0, 0.25, 1.0, 3.0]) for _ in range(4)]) for _ in range(200)]
    rows += rows[:20] + [(500, None), (501, [1.0] * 3), (502, [None, 1.0, 1.0, 1.0]), (503, [float("nan")] * 4), (504, [float("inf")] * 4), (None, [1.0] * 4), (505, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    got = sorted((str(r[0]), *r[1:]) for r in centroids.clustered(df, components=4, clusters=5, rounds=6).collect())
    assert got == brute_clusters(rows, 5, 6, 4)


def test_few_vectors_none_and_too_large_ones(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert centroids.clustered(frame([])).count() == 0
    assert [(r.cluster, r.distance) for r in centroids.clustered(frame([(1, [0.5, 2.0]), (2, [0.5, 2.0])]), components=2).collect()] == [(0, 0), (0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        centroids.clustered(frame([(1, [1e9, 0.0])]), components=2).collect()


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-50, 50, (500, 8)) + 10_000 * np.eye(8, dtype=int)[k] for k in range(4)])
    now = [v[0].tolist(), v[600].tolist(), v[1100].tolist(), v[1700].tolist()]
    own, upper, lower = np.zeros(len(v), int), np.full(len(v), np.inf), np.zeros((len(v), 4))
    first = centroids.Centroids(now, None).assigned(v, own, upper, lower)
    moved = [[x + 1 for x in c] for c in now]
    again = centroids.Centroids(moved, now).assigned(v, own, upper, lower)
    assert len(v) <= first < 4 * len(v) and again == 0 and (own == np.repeat(range(4), 500)).all()


# --- passages ------------------------------------------------------------------------------------


def brute_passages(rows, window):
    texts = [(i, re.findall("[^ \t-\r]+", t or "")) for i, t in rows]
    home = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            if i is not None:
                home[tuple(w[k : k + window])] = min(i, home.get(tuple(w[k : k + window]), i))
    out = []
    for i, w in texts:
        gone = {j for k in range(len(w) - window + 1) if i is not None and home[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed,window,shard_words", [(1, 6, 200_000), (2, 6, 5), (3, 9, 40), (4, 2, 10)])
def test_passages_against_comparing_windows(spark, seed, window, shard_words, monkeypatch):
    monkeypatch.setattr(passages.repeated_spans, "__defaults__", (window, shard_words))
    rng = random.Random(seed)
    words = lambda n, kinds=40: [rng.choice(["W", "w", "é", "日"]) + str(rng.randrange(kinds)) for _ in range(n)]
    shared = [words(rng.randint(window, 4 * window)) for _ in range(8)]
    rows = []
    for k in range(60):
        w = words(rng.randint(0, 30))
        for p in rng.sample(shared, rng.randint(0, 3)):
            lo = rng.randint(0, len(p) // 3)
            w += p[lo : len(p) - rng.randint(0, len(p) // 3)] + words(rng.randint(0, 9), 3)
        rows.append((rng.randrange(50), rng.choice([" ", "\n", " \t"]).join(w)))
    # copies, repeated rows, repeats within a text, one word again and again, nulls
    rows += [(k, rows[3][1]) for k in (70, 2, 71)] + [rows[5], rows[5], (None, rows[3][1]), (80, None), (81, ""), (82, " \n "), (83, "a " * 200), (84, "a " * 90), (85, " ".join(shared[0] * 3))]
    df = spark.createDataFrame([(i, t, "own", 1.5) for i, t in rows], "doc_id long, text string, kept string, starts double").repartition(3)
    got = passages.deduplicated(df, window=window)
    assert got.columns == ["doc_id", "text", "starts", "n_words", "n_removed", "kept", "removed"]
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == brute_passages(rows, window)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in found)


def test_no_documents_and_a_very_long_one(spark):
    assert passages.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(60_000))
    part = " ".join(long.split(" ")[30_000:30_080])
    rows = [(1, long), (2, f"before {part} after"), (3, "a" * 3_000_000), (4, "b " * 300_000)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in passages.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()}
    assert got[2] == (82, 80, "before after") and got[1][1:] == (0, long) and got[3][:2] == (1, 0) and got[4][1] == 0


def test_marks_depend_on_the_window_alone():
    rng = random.Random(3)
    w = [rng.choice("abcdef") for _ in range(400)]
    whole = passages.marks(passages.Words(pa.array([" ".join(w)])), 10)[0]
    for k in range(0, 390, 7):
        own = passages.marks(passages.Words(pa.array([" ".join(w[k : k + 10])])), 10)[0]
        assert len(own) == 1 and own[0] + k in whole

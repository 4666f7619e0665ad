"""Cases that small tables do not reach: long inputs, rare languages and words, lone secrets, repeated notices."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from letterlake.llm import common, decontaminate, langid, licenses, lines, pii, secrets
from tests.llm.test_operators import edits, prose

BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


@pytest.mark.parametrize("most", [1, 2, 3])
def test_distance_by_runs(most):
    rng = random.Random(most)
    points = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, most + 2)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        assert lines.within_long(points(a), points(b), most) == (edits(a, b) <= most)


def test_lines_of_megabytes():
    x = "abcdefgh" * 600_000
    points, at = lines.code_points(pa.array([x, "z" + x[:-1] + "q"]))
    assert lines.within(points, at[:1], np.diff(at)[:1], at[1:2], np.diff(at)[1:], 1).tolist() == [False]
    assert lines.within(points, at[:1], np.diff(at)[:1], at[1:2], np.diff(at)[1:], 2).tolist() == [True]


def test_many_benchmark_windows():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(2000)]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(112))) for k in range(1000)]
    search = decontaminate.Search(items + items[:1], 13, 3)
    table, starts, own = search.tables[0]
    assert len(table.at) == 100_000 and starts[-1] == len(own) == 100_000
    found = common.Words(pa.array([items[7][1], "w1 w2"]))
    _, _, rows, which = search.rows(found)
    assert set(rows.tolist()) == {0} and {search.names[i] for i in which} == {"7"} and len(which) == 100


def test_words_of_any_length_are_learned_from():
    names = ["▁", "a", "b", "ab", "aba"]
    chance = np.random.default_rng(1).random((len(names), 2)) / 2
    model = langid.Model(["x", "y"], langid.Vocabulary(names), chance)
    long, short = "ab" * 250, "ab" * 10
    out, shares = model.forward([long, short], True)
    tables = [dict(zip(names, chance[:, k])) for k in range(2)]
    assert out[0, 0] == pytest.approx(langid.log_probability(long, tables[0])) and out[1, 1] == pytest.approx(langid.log_probability(short, tables[1]))
    covered = np.zeros(2)
    for word, piece, share in shares:
        np.add.at(covered, word, share[:, 0] * np.array([len(names[p]) for p in piece]))
    assert covered == pytest.approx([501, 21], rel=1e-3)
    assert np.isfinite(model.forward(["a" * 50_000], True)[0]).all()


def test_a_rare_language_is_learned(spark):
    rng = random.Random(8)
    tongues = {"de": "der die und nicht ein haus strasse gehen wir".split(), "en": "the and not house a street going over this".split(), "fi": "ja talo katu ei yksi menen me kala vesi".split()}
    data = [(" ".join(rng.choice(tongues[t]) for _ in range(20)), t) for t in ["de"] * 150 + ["en"] * 150 + ["fi"] * 3]
    model = langid.learned(spark.createDataFrame(data, "text string, lang string"), most_docs=5)
    assert model.languages == ["de", "en", "fi"]
    found = langid.predicted(spark.createDataFrame([("talo ja katu", 1)], "text string, doc_id int"), model).first()
    assert found.lang_pred == "fi"


def test_one_secret_among_ordinary_names(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    name = lambda: rng.choice("-_").join(rng.choice(words) for _ in range(4))[: rng.randint(18, 44)] + str(rng.randint(1, 99))
    data = [(k, prose(20, rng) + " " + " ".join(name() for _ in range(5))) for k in range(300)]
    key = "".join(rng.choice(BASE62) for _ in range(40))
    df = spark.createDataFrame([*data, (5000, f"x {prose(20, rng)} KEY={key} end")], "doc_id long, text string")
    found = [s.match for r in secrets.scanned(df, keep_text=False).collect() for s in r.spans if s.kind == "random"]
    assert found == [key]


def test_places_of_licence_matches_against_scanning():
    rng = random.Random(2)
    templates = {"t": "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(6, 14))) for _ in range(6))}
    found = licenses.automaton(templates, {})
    names, each = found.vocabulary.to_pylist(), [x.split() for x in templates["t"].split("\n")]
    text = [rng.choice("abcz") for _ in range(300)]
    state, length = found.walk(np.array([names.index(w) if w in names else -1 for w in text]), np.array([0, 300]))
    for k in np.flatnonzero(length >= 3):
        run = text[k + 1 - length[k] : k + 1]
        got = {(int(found.place_template[p]), int(found.place_end[p])) for p in range(found.place_from[state[k]], found.place_to[state[k]])}
        assert got == {(i, j + len(run)) for i, t in enumerate(each) for j in range(len(t)) if t[j : j + len(run)] == run}


def test_best_chain_against_all_subsets():
    for seed in range(150):
        rng, some = random.Random(seed), []
        for _ in range(rng.randint(1, 7)):
            n, x, y = rng.randint(1, 5), rng.randint(0, 25), rng.randint(0, 20)
            some.append([x, x + n, y, y + n])
        some.sort(key=lambda m: (m[1], m[3]))
        best = 0
        for chain in itertools.chain.from_iterable(itertools.combinations(some, r) for r in range(1, len(some) + 1)):
            steps = list(zip(chain, chain[1:]))
            if all(all(p[i] < q[i] for i in range(4)) and q[0] - p[1] <= licenses.GAP for p, q in steps):
                best = max(best, chain[0][3] - chain[0][2] + sum(min(q[3] - max(q[2], p[3]), q[1] - max(q[0], p[1])) for p, q in steps))
        assert licenses.chains(some)[0][0] == best


def test_a_notice_that_stands_twice_gives_two_spans(spark):
    notice = licenses.TEMPLATES["mpl-2.0"]
    row = licenses.scanned(spark.createDataFrame([(f"{notice} {'and so on ' * 30} {notice}",)], "text string")).first()
    assert [(s.label, s.covered) for s in row.spans if s.covered == 1] == [("mpl-2.0", 1.0)] * 2


def test_words_that_disclose_against_counting(spark):
    rng = random.Random(6)
    data = []
    for k in range(200):
        text = prose(15, rng).replace("\n", " ")
        if k % 20 == 0:
            text += f" owner{'abcdefghij'[k // 20]}x writes to p{k}@one.example"
        if k % 25 == 0:
            text += f" Quorl far away {'pad ' * 40} team@two.example"
        data.append((k, text))
    words = lambda t: {w for w in __import__("re").findall(r"[^\W\d_]{2,}", " ".join(x for x in t.lower().split() if "@" not in x))}
    entities = lambda t: {x for x in t.split() if "@" in x}
    n = len(data)
    count = lambda f: sum(f(t) for _, t in data)
    expected = {}
    for k, t in data:
        for e in entities(t):
            holding = count(lambda x: e in entities(x))
            for w in words(t):
                both, total = count(lambda x: e in entities(x) and w in words(x)), count(lambda x: w in words(x))
                if total <= both * (n / holding) ** (1 - pii.DISCLOSED):
                    expected.setdefault(k, {})[w] = "term" if both > 1 or expected.get(k, {}).get(w) == "term" else "rare"
    got = {r.doc_id: {s.match.lower(): s.kind for s in r.spans if s.kind in ("term", "rare")} for r in pii.sanitised(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: expected.get(k, {}) for k, _ in data}
    # a word far from the entity, and one that stands with it once
    assert got[25]["quorl"] == "term" and got[20]["ownerbx"] == "rare"


def test_heavy_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = common.spread_join(rows, table, ["k"], "n", 500).collect()
    assert sorted((r.id, r.top) for r in got) == [(k, 399 if k < 400 else k) for k in range(500)]

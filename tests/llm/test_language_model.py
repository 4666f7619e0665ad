"""Language identification against plain sums over all cuts, from learning to prediction, and with many languages."""

import itertools
import math
import random

import pytest

from letterlake.llm import langid

PIECES = ["a", "b", "ab", "ba", "c", "▁", "▁a", "bc", "abc"]


def cuts(word):
    """Every way to cut the marked word into pieces and single characters that no piece is taken for: [(pieces, foreign characters)]."""
    full = "▁" + word
    for marks in itertools.product([False, True], repeat=len(full) - 1):
        parts, start = [], 0
        for k, mark in enumerate(marks, 1):
            if mark:
                parts.append(full[start:k])
                start = k
        parts.append(full[start:])
        # a single character may also be foreign
        for choice in itertools.product(*([True, False] if len(p) == 1 and p in PIECES else [p in PIECES] for p in parts)):
            if all(own or len(p) == 1 for own, p in zip(choice, parts)):
                yield [p for own, p in zip(choice, parts) if own], sum(not own for own in choice)


def plain_model(docs, rounds):
    """Piece chances of each language by expectation maximisation, word by word and cut by cut."""
    languages = sorted({lang for _, lang in docs})
    chance = {lang: dict.fromkeys(PIECES, 1 / len(PIECES)) for lang in languages}
    for _ in range(rounds):
        for lang in languages:
            table = dict.fromkeys(PIECES, langid.SMOOTHING)
            for text, own in docs:
                for word in text.split() if own == lang else ():
                    weights = [(used, math.prod(chance[lang][p] for p in used) * langid.FOREIGN**foreign) for used, foreign in cuts(word)]
                    total = sum(w for _, w in weights)
                    for used, w in weights:
                        for p in used:
                            table[p] += w / total
            chance[lang] = {p: x / sum(table.values()) for p, x in table.items()}
    return chance


def log_of(text, chance):
    return sum(math.log(sum(math.prod(chance[p] for p in used) * langid.FOREIGN**foreign for used, foreign in cuts(w))) for w in text.split())


def test_learning_and_prediction_against_all_cuts(spark):
    rng = random.Random(7)
    words = {"x": ["ab", "abc", "a", "zab"], "y": ["ba", "bab", "c", "bc"], "z": ["cc", "acb", "b"]}
    docs = [(" ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 6))), lang) for lang in words for _ in range(12)]
    model = langid.learned(spark.createDataFrame(docs, "text string, lang string"), names=sorted(PIECES))
    expected = plain_model(docs, langid.ROUNDS)
    for k, lang in enumerate(model.languages):
        for j, piece in enumerate(model.vocabulary.names):
            assert model.chance[j, k] == pytest.approx(expected[lang][piece], rel=1e-4)
    texts = ["ab ba", "cc", "zz q", "abc abc c", "b", "bab"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        logs = {lang: log_of(text, expected[lang]) for lang in sorted(expected)}
        best = max(logs, key=lambda x: logs[x])
        assert got[k][0] == best and got[k][1] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)


def test_two_thousand_languages_and_one_more(spark):
    rows = [(f"ab c{'ab' * (k % 3)}", f"l{k:04}") for k in range(langid.MOST_LANGUAGES)] * 2
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    model = langid.learned(df, names=PIECES, rounds=1, most_docs=1)
    assert len(model.languages) == langid.MOST_LANGUAGES
    with pytest.raises(ValueError, match="2000 languages"):
        langid.learned(df.union(spark.createDataFrame([("ab", "more")], "text string, lang string")), names=PIECES)

"""N-gram sets are made where their texts lie, one for each set."""

from letterlake.llm import jaccard


def test_sets_are_not_shuffled_to_be_made(spark, monkeypatch):
    seen = {}
    whole = jaccard.materialise

    def told(df, tag):
        seen.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, tag)

    monkeypatch.setattr(jaccard, "materialise", told)
    words = [f"w{k}" for k in range(60)]
    text = lambda *other: " ".join(other[words.index(w) % len(other)] if other and k == 30 else w for k, w in enumerate(words))
    rows = [(1, text()), (2, text()), (3, text("near")), (4, text("far")), (5, "some other words that stand alone here"), (None, text("near"))]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda df: sorted(map(tuple, jaccard.near_classes(df, keep_text=False).collect()), key=str)
    assert got(plain) == sorted([(1, 1, 4, 2), (2, 1, 4, 2), (3, 1, 4, 2), (None, 1, 4, 2), (4, 1, 4, 1), (5, 5, 0, 1)], key=str)
    # before, all sets were shuffled by their text's digest
    assert len(seen["jaccard-grams"]) == 1 and "hashpartitioning" not in seen["jaccard-grams"][0]
    # rows with the same id and text (null ids too) make one set
    seen.clear()
    twice = got(plain.union(spark.createDataFrame([(1, text()), (None, text("near"))], "doc_id long, text string")))
    assert set(twice) == {(1, 1, 6, 3), (2, 1, 6, 3), (3, 1, 6, 3), (None, 1, 6, 3), (4, 1, 6, 1), (5, 5, 0, 1)}

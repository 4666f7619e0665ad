"""N-gram sets meet the set of their component's smallest member in the one shuffle that they make."""

from letterlake.llm import common, jaccard


def test_sets_are_shuffled_once_and_rows_not_at_all(spark, monkeypatch):
    seen = {}
    whole = jaccard.materialise

    def told(df, tag):
        seen.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, tag)

    monkeypatch.setattr(jaccard, "materialise", told)
    words = [f"w{k}" for k in range(400)]
    # 300 documents that differ in one word, more than meet in one task, their copies, and 50 that stand alone
    rows = [(k, " ".join("x%d" % k if w == "w200" else w for w in words)) for k in range(300)]
    rows += [(1000 + k, text) for k, text in rows[:20]] + [(2000 + k, f"alone {k} with words of its own {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(k, 0, 319, 1 + (k < 20)) for k in range(300)] + [(1000 + k, 0, 319, 2) for k in range(20)] + [(2000 + k, 2000 + k, 0, 1) for k in range(50)])
    got = lambda: sorted(map(tuple, jaccard.near_classes(docs, keep_text=False).collect()))
    assert got() == want
    # before, the sets of smallest members were gathered and joined with the others: two more shuffles of sets
    assert "jaccard-base" not in seen and seen["jaccard-coded"][0].count("Exchange hashpartitioning(root") == 1
    # before, all rows were shuffled to meet their sets where a table has more rows than may be broadcast
    monkeypatch.setattr(common, "BROADCAST_ROWS", 350)
    found = jaccard.near_classes(docs, keep_text=False)
    assert "Join" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(key" not in plan
    assert sorted(map(tuple, found.collect())) == want
    # nothing may be broadcast
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert got() == want

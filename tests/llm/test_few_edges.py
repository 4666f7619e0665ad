"""Few edges are joined in few tasks, whatever the number of shuffle partitions."""

from letterlake.llm import components


def test_few_edges_take_few_tasks(spark, monkeypatch):
    wide, whole = [], components.materialise

    def told(df, tag):
        out = whole(df, tag)
        wide.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "materialise", told)
    edges = spark.createDataFrame([(k, k + 1) for k in range(200) if k % 20 != 19], "u long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = {r.node: r.root for r in components.components(edges).distinct().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: k // 20 * 20 for k in range(200)}
    # before, a round wrote as many files as there were partitions with rows
    assert len(wide) > 2 and set(wide[1:]) == {1}

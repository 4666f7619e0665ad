"""What a search finds is put in order by tasks of a bounded number of messages."""

import pytest
from pyspark.sql import functions as F

from letterlake.operators import search
from letterlake.plans import adapters

GIVEN = {
    "days": {"since": "1995", "until": "1995-06-30"},
    "limit": {"subject": "-", "limit": 1_200},
    "subject": {"subject": "urgent"},
    "wildcards": {"subject": "%u"},
    "recipient": {"recipient": "S7@"},
    "sender": {"sender": "CUSTOMER#00000001"},
    "mailbox": {"mailbox": "build"},
}


@pytest.mark.parametrize("name", GIVEN)
def test_a_task_orders_a_bounded_number_of_messages(spark, monkeypatch, name):
    frames = adapters.order_mail(spark, "/root/testdata/sf0.01")
    frames["message"] = frames["message"].withColumn("subject", F.replace("subject", F.lit("-"), F.lit("%"))) if name == "wildcards" else frames["message"]
    whole = search.search(frames, **GIVEN[name]).collect()
    monkeypatch.setattr(search, "TASK_MESSAGES", 500)
    found = search.search(frames, **GIVEN[name])
    # 15,000 messages, or 1,200 asked for: before, they were put in order by as many tasks as Spark has partitions, 4 here
    expected = 3 if name == "limit" else 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [f", {expected})" in line for line in plan.splitlines() if "rangepartitioning(" in line] == [True]
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 2 * 500
    assert found.collect() == whole


def test_undated_and_equal_dates(spark, monkeypatch):
    rows = [(f"{i:04}", None if i % 3 == 0 else f"200{i % 2}", "x") for i in range(400)]
    frames = {
        "message": spark.createDataFrame(rows, "store_id string, date string, subject string"),
        "sender": spark.createDataFrame([], "store_id string, address string"),
        "location": spark.createDataFrame([], "store_id string, mailbox string, folder string"),
    }
    monkeypatch.setattr(search, "TASK_MESSAGES", 30)
    expected = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))]
    assert [r.store_id for r in search.search(frames).collect()] == expected
    assert [r.store_id for r in search.search(frames, limit=70).collect()] == expected[:70]
    assert search.search(frames, limit=0).collect() == []


def test_items_are_dealt_to_partitions_written_as_they_come(spark):
    # 360 times the items of sf0.1: before, 432 partitions, for which Spark sorts a task's rows in memory
    assert adapters.dealt(spark.range(10), "id", 216_000_000).rdd.getNumPartitions() <= 200

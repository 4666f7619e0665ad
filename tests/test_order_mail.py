"""The frames of orders as mail, dealt out by rows."""

import pytest

from letterlake.plans import adapters


@pytest.mark.parametrize("frame", ["recipient", "location"])
def test_a_task_has_a_bounded_number_of_rows(spark, monkeypatch, frame):
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(adapters, "TASK_ROWS", 10**9)
    whole = adapters.order_mail(spark, sf)[frame]
    # 60,000 items: before, their number did not decide over the partitions, of which there are 4 here
    monkeypatch.setattr(adapters, "TASK_ROWS", 2_000)
    dealt = adapters.order_mail(spark, sf)[frame]
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 30 and max(sizes) <= 2 * 2_000
    assert dealt.exceptAll(whole).isEmpty() and whole.exceptAll(dealt).isEmpty()

"""Shuffle files go with the step that wrote them."""

import glob
import time

from pyspark.sql import functions as F

from letterlake.llm import common


def test_shuffle_files_go_with_their_table(spark):
    files = lambda: {f for top in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{top}/*/shuffle*")}
    before = files()
    common.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(common.SHUFFLES_GO, None) is None

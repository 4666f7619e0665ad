"""Incremental refresh of a projection from a stream of log files.

The file stream reads each path once, so a file that is repaired in place is not seen again; the
batch refresh of ``Projection`` does see it and is the default.  Old files must not be ignored,
hence ``maxFileAge``.  A batch may come twice: its number is written with the version it made, in one
step, so a batch that was folded in is not looked at again, and one that was not is folded in whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from letterlake import schema
from letterlake.functions.text import is_hash
from letterlake.plans.projection import Projection

_FILES = schema.of("path string, modificationTime timestamp, length long, content binary")


def log_stream(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the log files below ``root``: path and content."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).option("maxFileAge", "36500d").load(root)


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log files, observations) of a frame with path and content."""
    lines = F.split(F.decode("content", "UTF-8"), "\n", -1)
    df = files.select(F.regexp_extract("path", r"([^/]+)\.jsonl\z", 1).alias("hash"), F.sha2("content", 384).alias("own"), lines.alias("lines"), F.from_json(F.get(lines, F.lit(0)), schema.LOG_HEADER).alias("h"), "path")
    readable = F.coalesce(F.col("h.version").isin(1, 2), F.lit(False))
    listed = df.select("hash", F.col("h.version").alias("version"), "h.mailbox", "h.folder", "h.date", F.col("h.messages").alias("declared"), "h.prev", readable.alias("readable"), (F.col("own") == F.col("hash")).alias("intact"), "path")
    rows = df.where(readable).select(F.col("hash").alias("log_hash"), "h.mailbox", "h.folder", F.col("h.date").alias("log_date"), F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line_no", "line"))
    found = rows.withColumn("store_id", F.lower(F.from_json("line", schema.LOG_LINE)["store_id"])).where(is_hash(F.col("store_id")))
    return listed, found.select(*schema.OBSERVATION.names)


def refresh_stream(spark: SparkSession, root: str, projection: Projection, store: DataFrame, heads: DataFrame, checkpoint: str) -> StreamingQuery:
    """Fold all log files that are there into ``projection`` and stop."""

    def fold(batch: DataFrame, number: int) -> None:
        projection.refresh(store, *parsed(batch), heads, batch=(checkpoint, number))

    return log_stream(spark, root).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

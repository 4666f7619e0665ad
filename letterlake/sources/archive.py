"""Reading an archive's directories: messages, log files, heads, and older layouts.

All of it goes through Spark's own file readers, so a path may be in any store that Spark reads.
"""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterlake import schema
from letterlake.functions import mail
from letterlake.functions.text import entry_hash, is_hash, usable_resume

LOG_VERSIONS = (1, 2)
#: What follows the name of an entry in quarantine.
QUARANTINED = r"\.corrupt(\.\d+)?\z"


def files(spark: SparkSession, root: str, pattern: str | None = None, content: bool = True) -> DataFrame:
    """path, name, modified, length and, if asked for, content of the files below ``root``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(root)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))


def stored(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """The stored messages: those files whose names are a hash and a suffix, compressed or not."""
    found = files(spark, root, content=content).withColumn("store_id", entry_hash(F.col("name"))).where("store_id IS NOT NULL")
    codec = F.when(F.endswith("name", F.lit(".zst")), "zstd").otherwise("none")
    body = mail.unpacked("content") if content else F.lit(None).cast("binary")
    return found.select("store_id", body.alias("content"), F.col("length").alias("stored_bytes"), codec.alias("codec"), "path", "modified")


def external_messages(spark: SparkSession, root: str) -> DataFrame:
    """path and content of the messages in a plain directory tree."""
    found = files(spark, root).where(F.col("name").rlike(r"\.eml(\.zst)?\z"))
    return found.select("path", mail.unpacked("content").alias("content"), F.col("length").alias("stored_bytes"))


def largest_per_directory(found: DataFrame) -> DataFrame:
    """Of each directory the largest uncompressed message (then the first by path)."""
    own = found.where(F.endswith("path", F.lit(".eml"))).withColumn("directory", F.regexp_replace("path", r"/[^/]*\z", ""))
    return own.groupBy("directory").agg(F.min(F.struct((-F.col("stored_bytes")).alias("size"), "path")).alias("best")).select("directory", F.col("best.path").alias("path"), (-F.col("best.size")).alias("stored_bytes"))


def logs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(log files, observations) of the JSON-lines files below ``root``.

    A file with an unknown version or unreadable header is not readable and has no observations;
    a bad line costs only that line; a file whose content does not match its name is read and
    marked as not intact.  Lines end at newlines only, and ids are lower-cased.
    """
    text = F.decode("content", "UTF-8")
    raw = files(spark, root, "*.jsonl").withColumn("lines", F.split(text, "\n", -1))
    head = F.from_json(F.get("lines", F.lit(0)), schema.LOG_HEADER)
    df = raw.select("path", F.regexp_replace("name", r"\.jsonl\z", "").alias("hash"), head.alias("h"), F.sha2("content", 384).alias("own"), "lines")
    readable = F.coalesce(F.col("h.version").isin(*LOG_VERSIONS), F.lit(False))
    listed = df.select("hash", F.col("h.version").alias("version"), "h.mailbox", "h.folder", "h.date", F.col("h.messages").alias("declared"), "h.prev", readable.alias("readable"), (F.col("own") == F.col("hash")).alias("intact"), "path")
    rows = df.where(readable).select(F.col("hash").alias("log_hash"), "h.mailbox", "h.folder", F.col("h.date").alias("log_date"), F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line_no", "line"))
    found = rows.withColumn("store_id", F.lower(F.from_json("line", schema.LOG_LINE)["store_id"])).where(is_hash(F.col("store_id")))
    return listed, found.select(*schema.OBSERVATION.names)


def heads(spark: SparkSession, root: str) -> DataFrame:
    """The heads of places: files named like ``name.1234abcd``; unusable resume points are null."""
    found = files(spark, root).where(F.col("name").rlike(r"^.+\.[0-9a-f]{8}\z"))
    body = F.decode("content", "UTF-8")
    df = found.select(body.alias("body"), F.from_json(body, schema.HEAD_JSON).alias("h"), F.get_json_object(body, "$.resume").alias("resume"))
    df = df.where("h.version IS NOT NULL AND (h.job IS NOT NULL OR h.folder IS NOT NULL)")
    return df.select(F.col("h.job").alias("mailbox"), "h.folder", "h.last_run", F.when(usable_resume(F.col("resume")), F.col("resume")).alias("resume"), "h.log")


def legacy_state(spark: SparkSession, path: str) -> DataFrame:
    """mailbox, folder, last_run and resume of an old state file; a plain text is a last run only."""
    body = spark.read.text(path, wholetext=True)
    boxes = body.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("mailbox", "folders"))
    each = boxes.select("mailbox", F.explode("folders").alias("folder", "value"))
    last = F.coalesce(F.get_json_object("value", "$.last_run"), F.when(~F.startswith("value", F.lit("{")), F.col("value")))
    resume = F.get_json_object("value", "$.resume")
    df = each.select("mailbox", "folder", F.when(F.try_to_timestamp(last).isNotNull(), last).alias("last_run"), F.when(usable_resume(resume), resume).alias("resume"))
    return df.where("last_run IS NOT NULL OR resume IS NOT NULL")


#: Rows of an old database that one task reads.
LEGACY_ROWS = 200_000
_LEGACY = {
    "message": ("message", "SELECT t.message_id, t.store_id FROM message t", "message_id long, store_id string"),
    "mailbox": ("message_mailbox", "SELECT t.message_id, name FROM message_mailbox t JOIN mailbox USING (mailbox_id)", "message_id long, mailbox string"),
    "folder": ("message_label", "SELECT t.message_id, name FROM message_label t JOIN label USING (label_id)", "message_id long, folder string"),
    "snapshot": ("snapshot", "SELECT m.name, l.name, t.date FROM snapshot t JOIN mailbox m USING (mailbox_id) JOIN label l USING (label_id)", "mailbox string, folder string, date string"),
}


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def legacy_database(spark: SparkSession, path: str, rows: int = LEGACY_ROWS) -> dict[str, DataFrame]:
    """The tables of an old SQLite file, joined to names; no snapshots where the table is missing.

    The file must lie in a folder that driver and executors share.  The driver asks for the row
    numbers that a table has; tasks read ranges of ``rows`` of them.
    """
    out = {}
    with contextlib.closing(_opened(path)) as con:
        there = {r[0] for r in con.execute("SELECT name FROM sqlite_master")}
        for name, (table, asked, ddl) in _LEGACY.items():
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone() if table in there or name != "snapshot" else (None, None)
            if low is None:
                out[name] = spark.createDataFrame([], ddl)
                continue
            starts = spark.range(low, high + 1, rows, numPartitions=-(-(high + 1 - low) // rows))
            out[name] = starts.mapInPandas(_rows_of(path, f"{asked} WHERE t.rowid BETWEEN ? AND ?", ddl, rows), ddl)
    return out


def _rows_of(path: str, asked: str, ddl: str, rows: int):
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in batch["id"]:
                with contextlib.closing(_opened(path)) as con:
                    found = con.execute(asked, (int(low), int(low) + rows - 1))
                    while part := found.fetchmany(10_000):
                        yield pd.DataFrame(part, columns=names, dtype=object)

    return run


def classified(listing: DataFrame, now, min_age_hours: int = 24) -> DataFrame:
    """``listing`` (name, modified, ...) with ``kind``: entry, stale or live leftover, quarantined or foreign."""
    own = entry_hash(F.regexp_replace("name", r"\.[^.]+\.tmp\z", ""))
    leftover = F.col("name").rlike(r"\.[^.]+\.tmp\z") & own.isNotNull()
    aside = F.col("name").rlike(QUARANTINED) & entry_hash(F.regexp_replace("name", QUARANTINED, "")).isNotNull()
    old = F.col("modified") <= now - F.expr(f"INTERVAL {min_age_hours} HOURS")
    kind = F.when(entry_hash(F.col("name")).isNotNull(), "entry").when(leftover & old, "stale").when(leftover, "live").when(aside, "quarantined").otherwise("foreign")
    return listing.withColumn("kind", kind)

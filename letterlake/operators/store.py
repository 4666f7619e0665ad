"""The content-addressed store: adding, probing, importing, statistics, conversion and export."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterlake.functions import mail


def addressed(messages: DataFrame, content: str = "content", bits: int = 384) -> DataFrame:
    """``messages`` with ``store_id``, the hash of their content."""
    return messages.withColumn("store_id", F.sha2(F.col(content), bits))


def outcomes(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """``incoming`` (store_id, ...) with ``status``: NEW or EXISTS; all rows of a new id are NEW."""
    there = store.select("store_id", F.lit(True).alias("__there")).distinct()
    return incoming.join(there, "store_id", "left").withColumn("status", F.when(F.col("__there"), "EXISTS").otherwise("NEW")).drop("__there")


def added(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """What an append must write: each id that is not stored yet, once."""
    return incoming.join(store.select("store_id"), "store_id", "left_anti").dropDuplicates(["store_id"])


def import_counts(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """stored (new ids), present (rows that need no write) and failed (unreadable rows): one row.

    Of repeated new rows, the first counts as stored and the others as present.
    """
    known = outcomes(incoming, store)
    return known.agg(
        F.count_distinct(F.when(F.col("status") == "NEW", F.col("store_id"))).alias("stored"),
        (F.count("store_id") - F.count_distinct(F.when(F.col("status") == "NEW", F.col("store_id")))).alias("present"),
        F.count_if(F.col("store_id").isNull()).alias("failed"),
    )


def statistics(store: DataFrame) -> DataFrame:
    """messages and stored_bytes: one row."""
    return store.agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("stored_bytes"))


def converted(store: DataFrame, compress: bool = True) -> DataFrame:
    """path, content in the other form, and ``outcome``: converted, skipped (already so) or failed."""
    if compress:
        df = mail.packed(store)
        outcome = F.when(F.col("codec") == "zstd", "skipped").when(F.col("packed").isNull(), "failed").otherwise("converted")
        return df.select("store_id", "path", F.col("packed").alias("content"), outcome.alias("outcome"))
    df = store.withColumn("plain", mail.unpacked("content"))
    outcome = F.when(F.col("codec") != "zstd", "skipped").when(F.col("plain").isNull(), "failed").otherwise("converted")
    return df.select("store_id", "path", F.col("plain").alias("content"), outcome.alias("outcome"))


def exported(store: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """Write the wanted messages as ``aa/bb/hash.eml`` below ``root`` (a folder all executors share),
    each through a temporary name; returns store_id and path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                path = f"{root}/{r.store_id[:2]}/{r.store_id[2:4]}/{r.store_id}.eml"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(tmp := f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
                    f.write(r.content)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(tmp, path)
                rows.append((r.store_id, path))
            yield pd.DataFrame(rows, columns=["store_id", "path"])

    return store.join(wanted.select("store_id").distinct(), "store_id", "left_semi").select("store_id", "content").mapInPandas(run, "store_id string, path string")


def deletable(listing: DataFrame, stored: DataFrame, recorded: DataFrame) -> DataFrame:
    """The gate before a server may drop a message: it is stored and its place is in a sealed log."""
    here = listing.join(stored.select("store_id", F.lit(True).alias("s")).distinct(), "store_id", "left")
    seen = recorded.select(F.col("store_id").alias("r_id"), F.col("mailbox").alias("r_m"), F.col("folder").alias("r_f"), F.lit(True).alias("r")).distinct()
    same = (F.col("store_id") == F.col("r_id")) & F.col("mailbox").eqNullSafe(F.col("r_m")) & F.col("folder").eqNullSafe(F.col("r_f"))
    return here.join(seen, same, "left").withColumn("deletable", F.coalesce(F.col("s") & F.col("r"), F.lit(False))).drop("s", "r", "r_id", "r_m", "r_f")

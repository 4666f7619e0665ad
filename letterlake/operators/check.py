"""Checking an archive: what is stored against what the log says, contents against names, log chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Doublings of a chain walk: chains of up to 2 ** MOST_ROUNDS files.
MOST_ROUNDS = 40


def missing(observation: DataFrame, store: DataFrame) -> DataFrame:
    """Observed ids that are not stored, with the first place (by file, then line) that names each."""
    first = observation.groupBy("store_id").agg(F.min_by(F.struct("mailbox", "folder"), F.struct("log_hash", "line_no")).alias("place"))
    return first.join(store.select("store_id"), "store_id", "left_anti").select("store_id", "place.mailbox", "place.folder")


def orphans(store: DataFrame, observation: DataFrame) -> DataFrame:
    """Stored ids that no log names."""
    return store.select("store_id").distinct().join(observation.select("store_id"), "store_id", "left_anti")


def damaged(store: DataFrame, bits: int = 384) -> DataFrame:
    """Stored messages whose content does not have the hash in their name, or cannot be read."""
    return store.where(F.col("content").isNull() | (F.sha2("content", bits) != F.col("store_id"))).select("store_id", "path")


def reached(heads: DataFrame, log_file: DataFrame, cut=None) -> DataFrame:
    """hash and place of every log that a chain reaches from a head, by doubling joins: the walk of
    a chain of n files takes log2(n) rounds, and cycles in damaged chains end like others.

    ``cut`` materialises a round's frame (by default a reliable checkpoint, or an eager cache-free
    copy where no checkpoint folder is set).
    """
    cut = cut or _cut
    own = log_file.select("hash", "prev").distinct()
    jump = cut(own.where("prev IS NOT NULL").select(F.col("hash").alias("at"), F.col("prev").alias("to")))
    found = cut(heads.where("log IS NOT NULL").groupBy(F.col("log").alias("hash")).agg(F.min(F.struct("mailbox", "folder")).alias("place")))
    for _ in range(MOST_ROUNDS):
        before = found.count()
        more = found.join(jump, found["hash"] == jump["at"]).select(F.col("to").alias("hash"), "place")
        found = cut(found.union(more).groupBy("hash").agg(F.min("place").alias("place")))
        if found.count() == before:
            break
        further = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.at"))
        jump = cut(further.select(F.col("a.at").alias("at"), F.col("b.to").alias("to")).distinct())
    return found.select("hash", "place.mailbox", "place.folder")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set a local session (in tests) has one in the warehouse."""
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_letterlake_checkpoints")
    return spark.sparkContext.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """``df`` out of a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def broken_chains(heads: DataFrame, log_file: DataFrame, cut=None, chain: DataFrame | None = None) -> DataFrame:
    """Hashes that a chain leads to but no log file has, with a place whose chain does (``chain``: what ``reached`` gave)."""
    return (reached(heads, log_file, cut) if chain is None else chain).join(log_file.select("hash"), "hash", "left_anti")


def unchained(heads: DataFrame, log_file: DataFrame, cut=None, chain: DataFrame | None = None) -> DataFrame:
    """Log files that no chain reaches; none where there are no heads at all."""
    chain = reached(heads, log_file, cut) if chain is None else chain
    some = heads.limit(1).select(F.lit(1).alias("k"))
    rest = log_file.select("hash").join(chain.select("hash"), "hash", "left_anti")
    return rest.withColumn("k", F.lit(1)).join(some, "k").drop("k")


def short_logs(log_file: DataFrame, observation: DataFrame) -> DataFrame:
    """Readable log files with another number of entries than their first line declares: hash, declared, entries."""
    found = observation.groupBy(F.col("log_hash").alias("hash")).agg(F.count(F.lit(1)).alias("entries"))
    both = log_file.where("readable AND declared IS NOT NULL").select("hash", "declared").join(found, "hash", "left")
    return both.select("hash", "declared", F.coalesce("entries", F.lit(0)).alias("entries")).where("declared <> entries")


def counters(store: DataFrame, observation: DataFrame, log_file: DataFrame) -> DataFrame:
    """entries, observations, referenced (distinct ids), places, log_files, unreadable and damaged_logs: one row."""
    k = F.lit(1).alias("k")
    parts = [
        store.agg(F.count_distinct("store_id").alias("entries")),
        observation.agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("store_id").alias("referenced")),
        observation.select("mailbox", "folder").distinct().agg(F.count(F.lit(1)).alias("places")),
        log_file.agg(F.count(F.lit(1)).alias("log_files"), F.count_if(~F.col("readable")).alias("unreadable_logs"), F.count_if(F.col("readable") & ~F.col("intact")).alias("damaged_logs")),
    ]
    out = parts[0].select("*", k)
    for part in parts[1:]:
        out = out.join(part.select("*", k), "k")
    return out.drop("k")


def verdict(store: DataFrame, observation: DataFrame, log_file: DataFrame, heads: DataFrame, bits: int = 384, cut=None) -> DataFrame:
    """Counters plus missing, orphans, damaged, broken_chains, unchained, findings and sound: one row.

    Orphans and files outside all chains are reported but are no findings.
    """
    k = F.lit(1).alias("k")
    chain = reached(heads, log_file, cut)
    out = counters(store, observation, log_file).select("*", k)
    # one look at each id tells what is missing and what is an orphan
    ids = store.select("store_id", F.lit(1).alias("s"), F.lit(0).alias("o")).union(observation.select("store_id", F.lit(0), F.lit(1))).groupBy("store_id").agg(F.max("s").alias("s"), F.max("o").alias("o"))
    out = out.join(ids.agg(F.count_if(F.col("s") == 0).alias("missing"), F.count_if(F.col("o") == 0).alias("orphans")).select("*", k), "k")
    for name, df in (("damaged", damaged(store, bits)), ("broken_chains", broken_chains(heads, log_file, cut, chain)), ("unchained", unchained(heads, log_file, cut, chain))):
        out = out.join(df.agg(F.count(F.lit(1)).alias(name)).select("*", k), "k")
    findings = F.col("missing") + F.col("damaged") + F.col("broken_chains") + F.col("unreadable_logs") + F.col("damaged_logs")
    return out.drop("k").withColumn("findings", findings).withColumn("sound", findings == 0)

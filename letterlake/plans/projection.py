"""The searchable projection of an archive: what the log says, for messages that are there.

Frames: ``message`` (store_id, email_id, date, subject), ``sender`` and ``recipient`` (store_id,
address), ``location`` (store_id, mailbox, folder).  Ids are natural keys, so no surrogate numbers
are joined through, and Parquet's dictionaries do the interning.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from letterlake import schema
from letterlake.functions.mail import with_headers

#: Folders that a table may be spread over before it is written anew in one.
MOST_PARTS = 32
TABLES = {"message": schema.MESSAGE, "sender": schema.ADDRESS, "recipient": schema.ADDRESS, "location": schema.LOCATION}


def placed(observation: DataFrame) -> DataFrame:
    """Observations that name at least half a place."""
    return observation.where("mailbox IS NOT NULL OR folder IS NOT NULL")


def build(store: DataFrame, observation: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The frames for all observed messages that are stored; with ``known`` (messages already
    projected) only headers of new ones are read, each once."""
    seen = placed(observation)
    ids = seen.select("store_id").distinct()
    if known is not None:
        ids = ids.join(known, "store_id", "left_anti")
    parsed = with_headers(store.join(ids, "store_id", "left_semi").dropDuplicates(["store_id"]).select("store_id", "content")).drop("content")
    location = seen.join(store.select("store_id"), "store_id", "left_semi").select("store_id", "mailbox", "folder").distinct()
    each = lambda column: parsed.select("store_id", F.explode(column).alias("address")).distinct()
    return {"message": parsed.select("store_id", "email_id", "date", "subject"), "sender": each("senders"), "recipient": each("recipients"), "location": location}


def replay_counts(store: DataFrame, observation: DataFrame) -> DataFrame:
    """entries, unknown (entries whose message is gone) and messages (distinct ones that are there)."""
    there = store.select("store_id", F.lit(1).alias("here")).distinct()
    df = placed(observation).join(there, "store_id", "left")
    return df.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("here").isNull()).alias("unknown"), F.count_distinct(F.when(F.col("here").isNotNull(), F.col("store_id"))).alias("messages"))


def v_messages(frames: dict[str, DataFrame]) -> DataFrame:
    """Messages with every combination of sender, recipient and location; each may be missing."""
    df = frames["message"]
    for name in ("sender", "recipient"):
        df = df.join(frames[name].select("store_id", F.col("address").alias(name)), "store_id", "left")
    return df.join(frames["location"], "store_id", "left").select("store_id", "email_id", "date", "subject", "sender", "recipient", "mailbox", "folder")


def v_duplicates(message: DataFrame, strict: bool = False) -> DataFrame:
    """Messages that share Message-ID and date text with another; ``strict`` leaves empty Message-IDs out."""
    same = W.partitionBy("email_id", "date")
    some = message.where("email_id IS NOT NULL AND date IS NOT NULL" + (" AND email_id <> ''" if strict else ""))
    return some.withColumn("n", F.count(F.lit(1)).over(same)).where("n > 1").drop("n")


def unapplied(log_file: DataFrame, applied: DataFrame) -> DataFrame:
    """Readable log files of a known place that the projection has not folded in yet."""
    return log_file.where("readable AND (mailbox IS NOT NULL OR folder IS NOT NULL)").join(applied.select("hash"), "hash", "left_anti")


def behind(heads: DataFrame, recorded: DataFrame) -> DataFrame:
    """Heads whose log is not the one recorded for their place, or that were never recorded."""
    r = recorded.select(F.col("mailbox").alias("m"), F.col("folder").alias("f"), F.col("log").alias("recorded"), F.lit(1).alias("known"))
    same = F.col("mailbox").eqNullSafe(F.col("m")) & F.col("folder").eqNullSafe(F.col("f"))
    return heads.join(r, same, "left").where(F.col("known").isNull() | ~F.col("log").eqNullSafe(F.col("recorded"))).select("mailbox", "folder", "log", "recorded")


class Projection:
    """A projection kept as Parquet folders below ``root``; a pointer file names those that are current.

    A version is a list of folders for each table.  A refresh writes a folder with its new rows and
    then replaces the pointer in one step, so readers see the old version or the new one; tables in
    ``MOST_PARTS`` folders are written anew in one.  Folders that neither the last two versions
    name are deleted.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> dict | None:
        fs = self._path("_current")
        return json.loads(fs[0].open(fs[1]).readAllBytes().decode()) if fs[0].exists(fs[1]) else None

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        return self._pointer() is not None

    def frames(self) -> dict[str, DataFrame]:
        at = self._pointer()
        if at is None:
            raise FileNotFoundError(f"no projection in {self.root}")
        if at["schema_version"] != schema.SCHEMA_VERSION:
            raise ValueError(f"projection of shape {at['schema_version']}; rebuild it")
        kinds = TABLES | {"applied": "hash string", "recorded": "mailbox string, folder string, log string"}
        return {n: self.spark.read.schema(s).parquet(*(f"{self.root}/{part}/{n}" for part in self._parts(at)[n])) for n, s in kinds.items()}

    @staticmethod
    def _parts(pointer: dict) -> dict[str, list[str]]:
        """The folders of each table; a pointer without any stands for one folder."""
        return pointer.get("parts") or {n: [pointer["version"]] for n in (*TABLES, "applied", "recorded")}

    def folded(self, stream: str) -> int:
        """The last batch of a stream that was folded in; -1 where there is none."""
        return (self._pointer() or {}).get("batches", {}).get(stream, -1)

    def _commit(self, frames: dict[str, DataFrame], batch: tuple[str, int] | None = None, kept: dict[str, list[str]] | None = None) -> None:
        """A version of ``frames`` and of the folders ``kept`` of each table."""
        version = f"v-{uuid.uuid4().hex}"
        batches = (self._pointer() or {}).get("batches", {}) | (dict([batch]) if batch else {})
        parts = {name: [*(kept or {}).get(name, []), version] for name in frames}
        for name, df in frames.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        fs, path = self._path("_current")
        with_tmp = self._path(f"_current-{version}")[1]
        out = fs.create(with_tmp)
        out.write(bytearray(json.dumps({"version": version, "schema_version": schema.SCHEMA_VERSION, "parts": parts, "batches": batches}).encode()))
        out.close()
        # one step: a reader finds the old pointer or the new one
        jvm = self.spark.sparkContext._jvm
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        before = self._pointer()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(with_tmp, path, overwrite)
        # readers of the version before may still be at work; older ones go
        keep = {part for own in (parts, self._parts(before) if before else {}) for folders in own.values() for part in folders}
        for status in fs.listStatus(self._path("")[1]):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in keep:
                fs.delete(status.getPath(), True)

    def create(self, store: DataFrame, log_file: DataFrame, observation: DataFrame, heads: DataFrame, force: bool = False, batch: tuple[str, int] | None = None) -> None:
        """Build from scratch; refuses to replace an existing projection unless forced."""
        if self.exists() and not force:
            raise FileExistsError(self.root)
        todo = unapplied(log_file, self.spark.createDataFrame([], "hash string"))
        own = observation.join(todo.select(F.col("hash").alias("log_hash")), "log_hash", "left_semi")
        self._commit({**build(store, own), "applied": todo.select("hash").distinct(), "recorded": heads.select("mailbox", "folder", "log")}, batch)

    def refresh(self, store: DataFrame, log_file: DataFrame, observation: DataFrame, heads: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Fold in the log files that are new, and return how many; never changes or deletes messages.

        ``batch`` (stream, number) goes into the ledger that the pointer holds, in the same step as
        the new version; a batch that is there is not folded in again.
        """
        if batch and self.folded(batch[0]) >= batch[1]:
            return 0
        if not self.exists():
            self.create(store, log_file, observation, heads, batch=batch)
            return self.frames()["applied"].count()
        old = self.frames()
        todo = unapplied(log_file, old["applied"])
        n = todo.count()
        if n:
            own = observation.join(todo.select(F.col("hash").alias("log_hash")), "log_hash", "left_semi")
            new = build(store, own, old["message"].select("store_id"))
            # places are told from those that are there by what they are, null halves too
            same = F.xxhash64("store_id", "mailbox", F.col("mailbox").isNull(), "folder", F.col("folder").isNull())
            there = old["location"].join(new["location"].select("store_id").distinct(), "store_id", "left_semi").withColumn("k", same)
            met = new["location"].withColumn("k", same).alias("a").join(there.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.store_id") == F.col("b.store_id")) & F.col("a.mailbox").eqNullSafe(F.col("b.mailbox")) & F.col("a.folder").eqNullSafe(F.col("b.folder")), "left_anti")
            new = {**new, "location": met.drop("k"), "applied": todo.select("hash").distinct(), "recorded": heads.select("mailbox", "folder", "log")}
            new = {name: df.select(*old[name].columns) for name, df in new.items()}
            kept = {name: folders for name, folders in self._parts(self._pointer()).items() if name != "recorded"}
            if max(map(len, kept.values())) >= MOST_PARTS:
                new, kept = {name: old[name].union(df) if name != "recorded" else df for name, df in new.items()}, None
            self._commit(new, batch, kept)
        return n

    def drop(self) -> bool:
        fs, path = self._path("")
        return fs.exists(path) and fs.delete(path, True)

"""The log by place: summaries, compaction, adoption, and writing log files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(observation: DataFrame) -> DataFrame:
    """mailbox, folder, messages (distinct) and last_seen (largest date text) of each place; unknown mailboxes last."""
    per = observation.groupBy("mailbox", "folder").agg(F.count_distinct("store_id").alias("messages"), F.max("log_date").alias("last_seen"))
    return per.orderBy(F.col("mailbox").isNull(), F.coalesce("mailbox", F.lit("")), F.coalesce("folder", F.lit("")))


def totals(observation: DataFrame) -> DataFrame:
    """Distinct messages and places over all; at most the sum of the places' counts."""
    places = observation.select("mailbox", "folder").distinct().agg(F.count(F.lit(1)).alias("places"))
    ids = observation.agg(F.count_distinct("store_id").alias("messages"), F.count(F.lit(1)).alias("observations"))
    return ids.withColumn("k", F.lit(1)).join(places.withColumn("k", F.lit(1)), "k").drop("k")


def _entries(ids: DataFrame, per_place: DataFrame) -> DataFrame:
    """``ids`` (mailbox, folder, store_id), each once, with the columns of their place and how many it has (``messages``)."""
    ids = ids.select("mailbox", "folder", "store_id").distinct()
    counts = ids.groupBy("mailbox", "folder").agg(F.count(F.lit(1)).alias("messages"))
    both = per_place.withColumnsRenamed({"mailbox": "__m", "folder": "__f"}).join(counts.withColumnsRenamed({"mailbox": "__a", "folder": "__b"}), F.col("__m").eqNullSafe(F.col("__a")) & F.col("__f").eqNullSafe(F.col("__b"))).drop("__a", "__b")
    return ids.join(both, F.col("mailbox").eqNullSafe(F.col("__m")) & F.col("folder").eqNullSafe(F.col("__f"))).drop("__m", "__f")


def compacted(observation: DataFrame) -> DataFrame:
    """The entries of one log file per place, a row each: its distinct ids with the newest date and the number of ids."""
    newest = observation.groupBy("mailbox", "folder").agg(F.max("log_date").alias("date"), F.lit(None).cast("string").alias("prev"))
    return _entries(observation, newest)


def compaction_counts(observation: DataFrame) -> DataFrame:
    """Files and entries before and after a compaction."""
    after = observation.groupBy("mailbox", "folder").agg(F.count_distinct("store_id").alias("n"))
    before = observation.agg(F.count_distinct("log_hash").alias("files_before"), F.count(F.lit(1)).alias("entries_before"))
    done = after.agg(F.count(F.lit(1)).alias("files_after"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries_after"))
    return before.withColumn("k", F.lit(1)).join(done.withColumn("k", F.lit(1)), "k").drop("k")


def adopted(store: DataFrame, observation: DataFrame, name: str) -> DataFrame:
    """Observations (at the mailbox-less place ``name``) for stored messages that no log names."""
    orphans = store.select("store_id").distinct().join(observation.select("store_id"), "store_id", "left_anti")
    return orphans.select(F.lit(None).cast("string").alias("mailbox"), F.lit(name).alias("folder"), "store_id")


def adoption_counts(store: DataFrame, observation: DataFrame, name: str) -> DataFrame:
    """found (orphans) and held (distinct messages that the place has already)."""
    found = adopted(store, observation, name).agg(F.count(F.lit(1)).alias("found"))
    held = observation.where(F.col("mailbox").isNull() & (F.col("folder") == name)).agg(F.count_distinct("store_id").alias("held"))
    return found.withColumn("k", F.lit(1)).join(held.withColumn("k", F.lit(1)), "k").drop("k")


def serialised_head(mailbox, folder, date, messages: int, prev) -> bytes:
    head = {"version": 2, "mailbox": mailbox, "folder": folder, "date": date, "messages": messages, "prev": prev}
    return (json.dumps(head, ensure_ascii=False) + "\n").encode()


def serialised(mailbox, folder, date, ids: list[str], prev) -> bytes:
    """The bytes of a log file; the same place and ids always give the same bytes."""
    return serialised_head(mailbox, folder, date, len(ids), prev) + "".join(f'{{"store_id": "{i}"}}\n' for i in ids).encode()


class _File:
    """A log file being written below ``root`` (or only hashed): by a temporary name until its hash is known."""

    def __init__(self, root: str | None, algorithm: str, head: bytes):
        self.root, self.hash, self.messages = root, hashlib.new(algorithm), 0
        self.tmp = f"{root}/writing.{uuid.uuid4().hex}.tmp" if root else None
        self.out = open(self.tmp, "wb") if root else None  # noqa: SIM115
        self.put(head)

    def put(self, data: bytes) -> None:
        self.hash.update(data)
        if self.out:
            self.out.write(data)

    def done(self) -> tuple[str, str | None]:
        name = self.hash.hexdigest()
        if not self.out:
            return name, None
        self.out.flush()
        os.fsync(self.out.fileno())
        self.out.close()
        path = f"{self.root}/{name[:2]}/{name}.jsonl"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        # the same content has the same name, so a task that runs again changes nothing
        os.replace(self.tmp, path)
        return name, path

    def given_up(self) -> None:
        if self.out:
            self.out.close()
            os.unlink(self.tmp)


def log_files(entries: DataFrame, root: str | None = None, algorithm: str = "sha384") -> DataFrame:
    """hash, mailbox, folder, messages and path of the log file of each place, written below ``root`` if one is given.

    ``entries`` has mailbox, folder, store_id, messages, date and prev.  They are sorted by place and
    id and streamed into their file and its hash, so a place may have any number of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = file = None

        def closed() -> pa.RecordBatch:
            name, path = file.done()
            return pa.RecordBatch.from_pydict({"hash": [name], "mailbox": [place[0]], "folder": [place[1]], "messages": [file.messages], "path": [path]}, schema=pa.schema([("hash", pa.string()), ("mailbox", pa.string()), ("folder", pa.string()), ("messages", pa.int64()), ("path", pa.string())]))

        try:
            for batch in batches:
                rows = batch.to_pydict()
                names = list(zip(rows["mailbox"], rows["folder"]))
                starts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
                for lo, hi in zip(starts, [*starts[1:], len(names)]):
                    if names[lo] != place or file is None:
                        if file is not None:
                            yield closed()
                        place = names[lo]
                        file = _File(root, algorithm, serialised_head(*place, rows["date"][lo], rows["messages"][lo], rows["prev"][lo]))
                    file.put("".join(f'{{"store_id": "{i}"}}\n' for i in rows["store_id"][lo:hi]).encode())
                    file.messages += hi - lo
            if file is not None:
                yield closed()
                file = None
        except BaseException:
            if file is not None:
                file.given_up()
            raise

    columns = ["mailbox", "folder", "store_id", "messages", "date", "prev"]
    ordered = entries.select(*columns).repartition("mailbox", "folder").sortWithinPartitions("mailbox", "folder", "store_id")
    return ordered.mapInArrow(run, "hash string, mailbox string, folder string, messages long, path string")


def appended(new: DataFrame, heads: DataFrame, date: str) -> DataFrame:
    """The entries of new log files: the distinct ids of each place, with the log that its head points to; ready for ``log_files``."""
    own = new.select("mailbox", "folder").distinct()
    h = heads.select(F.col("mailbox").alias("m"), F.col("folder").alias("f"), F.col("log").alias("prev"))
    same = F.col("mailbox").eqNullSafe(F.col("m")) & F.col("folder").eqNullSafe(F.col("f"))
    return _entries(new, own.join(h, same, "left").select("mailbox", "folder", F.lit(date).alias("date"), "prev"))


def moved_heads(heads: DataFrame, written: DataFrame) -> DataFrame:
    """``heads`` after a write: each written place points to its new file, other fields stay."""
    w = written.select(F.col("mailbox").alias("m"), F.col("folder").alias("f"), F.col("hash"))
    same = F.col("mailbox").eqNullSafe(F.col("m")) & F.col("folder").eqNullSafe(F.col("f"))
    both = heads.join(w, same, "full")
    own = lambda half, other: F.when(F.col("hash").isNotNull(), F.col(other)).otherwise(F.col(half)).alias(half)
    return both.select(own("mailbox", "m"), own("folder", "f"), "last_run", "resume", F.coalesce("hash", "log").alias("log"))


# Fixed values of the format: they decide the file names that other readers look for.
HEAD_EMPTY, HEAD_JOIN, HEAD_LENGTH, HEAD_PERSON = "_", "-", 80, b"jobless-place"


def head_name(mailbox: str | None, folder: str | None) -> str:
    """The file name of a place's head: a readable part and eight hex digits that tell places apart."""
    parts = ["_".join(re.findall(r"[A-Za-z0-9]+", x)) or HEAD_EMPTY for x in (mailbox, folder) if x is not None] or [HEAD_EMPTY]
    readable = HEAD_JOIN.join(parts)
    if len(readable) > HEAD_LENGTH:
        readable = readable[:HEAD_LENGTH].rstrip("_-") or HEAD_EMPTY
    raw = (mailbox or "") + "\0" + ("\0" if folder is None else folder)
    mark = hashlib.blake2b(raw.encode(), digest_size=4, person=HEAD_PERSON if mailbox is None else b"")
    return f"{readable}.{mark.hexdigest()}"

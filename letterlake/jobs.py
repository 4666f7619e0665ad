"""Whole tasks over an archive directory: what the operators are for, under their usual names.

An archive has ``mail`` (messages), ``meta`` (log files), ``heads`` and a marker file; the folder
must be one that driver and executors share.
"""

from __future__ import annotations

import functools
import json
import shutil
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterlake import schema
from letterlake.functions import mail
from letterlake.functions.text import entry_hash
from letterlake.operators import attribution, backup as backing, check as checking, places, reconcile, search as searching, store as storing
from letterlake.plans.projection import Projection, behind
from letterlake.sources import archive, mailbox as servers

MARKER, GENERATION = "FORMAT", 2
_EMPTY_HEADS = "mailbox string, folder string, last_run string, resume string, log string"


class Archive:
    """An archive and its projection."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.projection = Projection(spark, f"{root}/view")

    def init(self) -> None:
        """Make the directories, marker last; a directory with other things in it is refused."""
        if self.root.exists() and any(self.root.iterdir()) and not (self.root / MARKER).exists():
            raise FileExistsError(f"{self.root} is not empty")
        for name in ("mail", "meta", "heads"):
            (self.root / name).mkdir(parents=True, exist_ok=True)
        (self.root / MARKER).write_text(f"{GENERATION}\n")

    def require(self) -> None:
        """Refuse what is no archive, or one of a generation not known here."""
        try:
            generation = int((self.root / MARKER).read_text())
        except (OSError, ValueError) as e:
            raise ValueError(f"{self.root} is no archive") from e
        if generation > GENERATION:
            raise ValueError(f"{self.root} is of generation {generation}")

    def _has(self, folder: str, pattern: str) -> bool:
        return next((self.root / folder).rglob(pattern), None) is not None

    def store(self, content: bool = True) -> DataFrame:
        if not self._has("mail", "*.eml*"):
            return self.spark.createDataFrame([], schema.STORE)
        return archive.stored(self.spark, str(self.root / "mail"), content)

    def log(self) -> tuple[DataFrame, DataFrame]:
        if not self._has("meta", "*.jsonl"):
            return self.spark.createDataFrame([], schema.LOG_FILE), self.spark.createDataFrame([], schema.OBSERVATION)
        return archive.logs(self.spark, str(self.root / "meta"))

    def heads(self) -> DataFrame:
        if not self._has("heads", "*"):
            return self.spark.createDataFrame([], schema.of(_EMPTY_HEADS))
        return archive.heads(self.spark, str(self.root / "heads"))

    def _write_head(self, h) -> None:
        body = {"version": 1, "job": h.mailbox, "folder": h.folder, "last_run": h.last_run, "resume": json.loads(h.resume) if h.resume else None, "log": h.log}
        path = self.root / "heads" / places.head_name(h.mailbox, h.folder)
        tmp = path.with_name(f".{path.name}.tmp")
        tmp.write_text(json.dumps(body, indent=2, sort_keys=True) + "\n")
        tmp.replace(path)

    def record(self, observed: DataFrame, date: str | None = None) -> int:
        """Write log files for observations (mailbox, folder, store_id) and move the heads after them; returns the files."""
        if observed.where(F.trim(F.coalesce("folder", "mailbox", F.lit(""))) == "").limit(1).count():
            raise ValueError("an observation names no place")
        date = date or datetime.now(timezone.utc).isoformat()
        heads = self.heads()
        written = places.log_files(places.appended(observed, heads, date), str(self.root / "meta")).cache()
        n = written.count()
        # one small file per place, after its log file is there
        for h in places.moved_heads(heads, written).toLocalIterator():
            self._write_head(h)
        written.unpersist()
        return n

    def add(self, messages: DataFrame, mailbox: str | None, folder: str | None, dry_run: bool = False) -> dict[str, int]:
        """Store new messages (``content``) once each and record all of them at a place."""
        incoming = storing.addressed(messages)
        counts = storing.import_counts(incoming, self.store(False)).first().asDict()
        if not dry_run:
            new = storing.added(incoming.where("store_id IS NOT NULL"), self.store(False))
            _written(new.select(F.col("store_id").alias("hash"), "content", F.lit(None).cast("string").alias("mailbox"), F.lit(None).cast("string").alias("folder")), str(self.root / "mail"), "eml", 2).count()
            self.record(incoming.where("store_id IS NOT NULL").select(F.lit(mailbox).cast("string").alias("mailbox"), F.lit(folder).cast("string").alias("folder"), "store_id"))
        return counts

    def import_directory(self, source: str, name: str, largest_only: bool = False, dry_run: bool = False) -> dict[str, int]:
        """Messages of a plain directory tree, at the mailbox-less place ``name``; the archive itself is refused."""
        a, b = Path(source).resolve(), self.root.resolve()
        if a == b or a in b.parents or b in a.parents:
            raise ValueError("source and archive overlap")
        found = archive.external_messages(self.spark, source)
        if largest_only:
            found = found.join(archive.largest_per_directory(found).select("path"), "path", "left_semi")
        return self.add(found.select("content"), None, name, dry_run)

    def adopt(self, name: str, dry_run: bool = False) -> dict[str, int]:
        """Record the stored messages that no log names."""
        _, observation = self.log()
        counts = places.adoption_counts(self.store(False), observation, name).first().asDict()
        if not dry_run and counts["found"]:
            self.record(places.adopted(self.store(False), observation, name))
        return counts

    def compact(self) -> dict[str, int]:
        """One log file per place; the old ones go when all new ones are there and the heads point to them."""
        log_file, observation = self.log()
        counts = places.compaction_counts(observation).first().asDict()
        old = [r.path for r in log_file.where("readable").select("path").toLocalIterator()]
        written = places.log_files(places.compacted(observation), str(self.root / "meta")).cache()
        new = {r.path for r in written.select("path").toLocalIterator()}
        for h in places.moved_heads(self.heads(), written).toLocalIterator():
            self._write_head(h)
        # nothing goes before every new file has been read back, whole, with all entries
        there, entries = archive.logs(self.spark, str(self.root / "meta"))
        sound = there.where("intact").join(written.select("hash"), "hash", "left_semi")
        kept = entries.join(written.select(F.col("hash").alias("log_hash")), "log_hash", "left_semi").count()
        if sound.count() != len(new) or kept != counts["entries_after"]:
            raise OSError("the compacted log did not read back whole; the old files stay")
        for path in old:
            if (path := path.removeprefix("file:").replace("///", "/")) not in new:
                Path(path).unlink(missing_ok=True)
        return counts

    def check(self) -> dict:
        log_file, observation = self.log()
        return checking.verdict(self.store(), observation, log_file, self.heads()).first().asDict()

    def short_logs(self) -> DataFrame:
        """Log files that have another number of entries than they declare."""
        return checking.short_logs(*self.log())

    def quarantine(self) -> int:
        """Take damaged entries' names from them, keeping every byte, so that they count as missing and are fetched again."""
        return _renamed(checking.damaged(self.store()).select("path")).count()

    def quarantined(self) -> DataFrame:
        """Ids that stand in the archive in quarantine only."""
        if not self._has("mail", "*.corrupt*"):
            return self.spark.createDataFrame([], "store_id string")
        aside = archive.files(self.spark, str(self.root / "mail"), "*.corrupt*", content=False).select(entry_hash(F.regexp_replace("name", archive.QUARANTINED, "")).alias("store_id"))
        return aside.where("store_id IS NOT NULL").distinct().join(self.store(False).select("store_id"), "store_id", "left_anti")

    def prune(self, min_age_hours: int = 24) -> int:
        """Delete what writers have left unfinished, if it is old enough that none of them can still be at work."""
        total = 0
        for name in ("mail", "meta", "heads"):
            if self._has(name, "*.tmp"):
                old = archive.files(self.spark, str(self.root / name), "*.tmp", content=False).where(F.col("modified") <= F.current_timestamp() - F.expr(f"INTERVAL {int(min_age_hours)} HOURS"))
                total += _deleted(old.select("path")).count()
        return total

    def places(self) -> DataFrame:
        return places.summary(self.log()[1])

    def statistics(self) -> dict[str, int]:
        return storing.statistics(self.store(False)).first().asDict()

    def create_db(self, force: bool = False) -> None:
        log_file, observation = self.log()
        self.projection.create(self.store(), log_file, observation, self.heads(), force)

    def refresh_db(self) -> int:
        log_file, observation = self.log()
        return self.projection.refresh(self.store(), log_file, observation, self.heads())

    def drop_db(self) -> bool:
        return self.projection.drop()

    def freshness(self) -> DataFrame:
        """Places whose newest log file the projection does not have."""
        return behind(self.heads(), self.projection.frames()["recorded"])

    def search(self, **given) -> DataFrame:
        """Hits in the projection, but for messages that are in quarantine."""
        frames = self.projection.frames()
        return searching.search(frames | {"message": frames["message"].join(self.quarantined(), "store_id", "left_anti")}, **given)

    def _listing(self, mailbox: str, options: dict[str, str], points: dict[str, tuple[int, int]] | None = None) -> DataFrame:
        """mailbox, folder, validity, ord and mid of a server's messages, read once; validities are asked before the listing.

        Of folders with a point (validity, uid) that the server still honours only later messages are asked for.
        """
        servers.register(self.spark)
        server = servers.client(options)
        asked = servers.budget(server, options)
        folders = {f: int(asked.ask(lambda f=f: server.validity(f))) for f in asked.ask(server.folders)}
        told = self.spark.createDataFrame(list(folders.items()), "of string, validity long")
        after = {f: uid for f, (validity, uid) in (points or {}).items() if folders.get(f) == validity}
        parts = [servers.loaded(self.spark, options, [f], uid) for f, uid in sorted(after.items())]
        rest = [f for f in folders if f not in after]
        parts += [servers.loaded(self.spark, options, rest)] if rest or not parts else []
        listed = functools.reduce(DataFrame.unionByName, parts).join(F.broadcast(told), F.col("folder") == F.col("of"))
        mid = mail.message_id_key("message_id").alias("mid")
        return checking._cut(listed.select(F.lit(mailbox).alias("mailbox"), "folder", "validity", "ord", mid))

    def message_ids(self, wanted: DataFrame) -> DataFrame:
        """store_id and mid (normalised Message-ID) of the stored messages among ``wanted`` (store_id).

        They are kept in a table beside the store; only messages that it lacks are read.
        """
        at = str(self.root / "index" / "mids")
        if Path(at).exists():
            known = self.spark.read.schema("store_id string, mid string").parquet(at)
        else:
            known = self.spark.createDataFrame([], "store_id string, mid string")
        new = checking._cut(wanted.select("store_id").distinct().join(known, "store_id", "left_anti").join(self.store(False).select("store_id"), "store_id", "left_semi"))
        if not new.isEmpty():
            named = mail.with_headers(self.store().join(new, "store_id", "left_semi"))
            named.select("store_id", mail.message_id_key("email_id").alias("mid")).write.mode("append").parquet(at)
            known = self.spark.read.schema("store_id string, mid string").parquet(at)
        # a message may have been read by two runs at once
        there = known.groupBy("store_id").agg(F.min("mid").alias("mid"))
        return there.join(wanted.select("store_id"), "store_id", "left_semi").join(self.store(False).select("store_id"), "store_id", "left_semi")

    def _archived(self, mailbox: str) -> DataFrame:
        """Copies of each Message-ID at the places of ``mailbox``."""
        observed = self.log()[1].where(F.col("mailbox") == mailbox)
        return reconcile.archived_counts(observed, self.message_ids(observed))

    def _fetch(self, wanted: DataFrame, options: dict[str, str]) -> tuple[DataFrame, Path]:
        """Fetch messages into the store, in tasks; mailbox, folder, ord and store_id (null where that failed) wait below ``pending``."""
        waiting = self.root / "pending" / uuid.uuid4().hex
        _fetched(wanted.repartition("folder", "ord"), options, str(self.root / "mail")).write.parquet(str(waiting))
        return self.spark.read.parquet(str(waiting)), waiting

    def _seal(self, outcome: DataFrame, waiting: Path) -> None:
        """Record fetched messages; they stay below ``pending`` until their log files and heads are there."""
        self.record(outcome.where("store_id IS NOT NULL").select("mailbox", "folder", "store_id"))
        shutil.rmtree(waiting)

    def _seal_pending(self) -> None:
        """Record what stopped runs have stored.  Unfinished batches have no success marker: their messages are fetched again."""
        for waiting in (self.root / "pending").glob("*"):
            if (waiting / "_SUCCESS").exists():
                self._seal(self.spark.read.parquet(str(waiting)), waiting)
            else:
                shutil.rmtree(waiting)

    def backup(self, mailbox: str, options: dict[str, str]) -> dict[str, int]:
        """Fetch what is new on a server, record it, then move the resume points of the folders without failures."""
        self._seal_pending()
        heads = self.heads().where(F.col("mailbox") == mailbox)
        # one small row per folder
        points = {r.folder: (r.uidvalidity, r.uid) for r in backing.points(heads).toLocalIterator()}
        listing = self._listing(mailbox, options, points)
        scan = checking._cut(backing.scanned(listing, heads))
        if scan.where(F.col("scan") == backing.LOST).isEmpty():
            wanted = scan.where(F.col("scan") != backing.BELOW)
        else:
            wanted = backing.wanted(scan, self._archived(mailbox))
        outcome, waiting = self._fetch(checking._cut(wanted), options)
        counts = outcome.agg(F.count(F.lit(1)).alias("wanted"), F.count("store_id").alias("stored"), F.count_if(F.col("store_id").isNull()).alias("failed")).first().asDict()
        moved = checking._cut(backing.advanced(listing, outcome))
        self._seal(outcome, waiting)
        # one small file per place, after its log
        heads = checking._cut(self.heads().where(F.col("mailbox") == mailbox).drop("resume"))
        for h in heads.join(moved, ["mailbox", "folder"]).toLocalIterator():
            self._write_head(h)
        return {"listed": listing.count(), **counts}

    def verify(self, mailbox: str, options: dict[str, str], repair: bool = False) -> DataFrame:
        """Per folder of a server: listed, missing and extra copies; or, after fetching those, what ``reconcile.repairs`` counts."""
        self._seal_pending()
        claimed = checking._cut(reconcile.claims(self._listing(mailbox, options), self._archived(mailbox)))
        if not repair:
            return reconcile.verdicts(claimed)
        before = checking._cut(self.store(False).select("store_id"))
        outcome, waiting = self._fetch(claimed.where(F.col("claim") != reconcile.TAKEN), options)
        repaired = checking._cut(reconcile.repairs(claimed, outcome, before))
        self._seal(outcome, waiting)
        return repaired

    def convert(self, compress: bool = True) -> dict[str, int]:
        """Bring all stored messages into compressed or plain form; a file goes only when its other form has been read back."""
        if not self._has("mail", "*.eml*"):
            return {"converted": 0, "skipped": 0, "failed": 0}
        raw = archive.files(self.spark, str(self.root / "mail")).withColumn("store_id", entry_hash(F.col("name"))).where("store_id IS NOT NULL")
        raw = raw.withColumn("codec", F.when(F.endswith("name", F.lit(".zst")), "zstd").otherwise("none"))
        done = _replaced(storing.converted(raw, compress), compress)
        kinds = ("converted", "skipped", "failed")
        return done.agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in kinds)).first().asDict()

    def export(self, wanted: DataFrame, target: str) -> DataFrame:
        return storing.exported(self.store(), wanted, target)

    def migrate(self, database: str) -> dict[str, int]:
        """Record the places of an old SQLite file, as far as they can be told."""
        old = archive.legacy_database(self.spark, database)
        owner = attribution.owners(old["mailbox"], old["folder"], old["snapshot"], checking._cut)
        counts = attribution.attribution_counts(old["message"], old["mailbox"], old["folder"], owner).first().asDict()
        self.record(attribution.attributed(old["message"], old["mailbox"], old["folder"], owner).select("mailbox", "folder", "store_id"))
        return counts


def _put(path: str, content: bytes) -> None:
    """Write a file by a temporary name; one that is there stays."""
    import os

    if os.path.exists(path):
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(tmp := f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def _renamed(damaged: DataFrame) -> DataFrame:
    """Give each damaged file (path) the first free name of a quarantined one; those that could be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for batch in batches:
            done = []
            for path in (p.removeprefix("file:") for p in batch["path"]):
                names = [path + ".corrupt" + (f".{k}" if k else "") for k in range(1000)]
                free = next((n for n in names if not os.path.exists(n)), None)
                if free and os.path.exists(path):
                    os.rename(path, free)
                    done.append(free)
            yield pd.DataFrame({"path": done}, dtype=object)

    return checking._cut(damaged.mapInPandas(run, "path string"))


def _deleted(files: DataFrame) -> DataFrame:
    """Delete files (path); those that went."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pathlib import Path as File

        for batch in batches:
            gone = [p for p in batch["path"] if File(p.removeprefix("file:")).exists()]
            for p in gone:
                File(p.removeprefix("file:")).unlink(missing_ok=True)
            yield pd.DataFrame({"path": gone}, dtype=object)

    return checking._cut(files.mapInPandas(run, "path string"))


def _fetched(wanted: DataFrame, options: dict[str, str], root: str) -> DataFrame:
    """mailbox, folder, ord and store_id of wanted messages, each fetched and stored below ``root``; one connection a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        server = asked = None
        for batch in batches:
            ids = []
            for r in batch.itertuples(index=False):
                if server is None:
                    server = servers.client(options)
                    asked = servers.budget(server, options)
                try:
                    body = asked.ask(lambda r=r: server.fetch(r.folder, str(r.ord)))
                except (OSError, LookupError, servers.Busy, servers.Refused):
                    ids.append(None)
                    continue
                ids.append(hashlib.sha384(body).hexdigest())
                _put("/".join([root, ids[-1][:2], ids[-1][2:4], f"{ids[-1]}.eml"]), body)
            yield batch.assign(store_id=pd.Series(ids, batch.index, dtype=object))

    return wanted.select("mailbox", "folder", "ord").mapInPandas(run, "mailbox string, folder string, ord long, store_id string")


def _replaced(converted: DataFrame, compress: bool) -> DataFrame:
    """Write converted contents (path, content, outcome) beside the old files, read them back, and delete those; outcome."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pathlib import Path as File

        for batch in batches:
            outcomes = []
            for r in batch.itertuples(index=False):
                outcomes.append(r.outcome)
                if r.outcome == "converted":
                    old = File(r.path.removeprefix("file:"))
                    new = old.with_name(f"{old.name}.zst" if compress else old.name.removesuffix(".zst"))
                    _put(str(new), r.content)
                    if new.read_bytes() == r.content:
                        old.unlink(missing_ok=True)
                    else:
                        outcomes[-1] = "failed"
            yield pd.DataFrame({"outcome": outcomes})

    return converted.select("path", "content", "outcome").mapInPandas(run, "outcome string")


def _written(files: DataFrame, root: str, suffix: str, depth: int) -> DataFrame:
    """Write hash and content as files below ``root``, each by a temporary name; hash, mailbox, folder and path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = []
            for r in batch.itertuples(index=False):
                paths.append("/".join([root, *(r.hash[2 * k : 2 * k + 2] for k in range(depth)), f"{r.hash}.{suffix}"]))
                _put(paths[-1], r.content)
            yield pd.DataFrame({"hash": batch["hash"], "mailbox": batch["mailbox"], "folder": batch["folder"], "path": paths})

    return files.select("hash", "mailbox", "folder", "content").mapInPandas(run, "hash string, mailbox string, folder string, path string")

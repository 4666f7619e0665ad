"""Mailboxes on servers as Python data sources, for batches and for Structured Streaming.

A server is reached through a client that the option ``client`` names (``module:function``, called
with the other options).  A client has ``folders()``, ``validity(folder)``, ``top(folder)`` (the
highest uid given so far), ``listing(folder, low, high)`` (uid, message_id, date) and
``fetch(folder, msg_id)``; one with change links has ``delta(folder, link)`` instead of the uids.
A client that can name the first uid there is has ``following(folder, low, high)`` (none where
there is none), which spares requests over uids that were never given or are gone.

Offsets are the resume points: for ``mail_uid`` each folder's validity and highest uid, for
``mail_delta`` the link that the last round ended with.  The driver asks for these numbers only;
messages are listed ``CHUNK`` at a time and fetched in tasks, in ranges of uids that stay the same
when a batch is repeated.  A resume point the server no longer honours raises ``ResumeLost``:
nothing is read, and the caller reconciles by listing or starts with a new checkpoint.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

COLUMNS = "folder string, msg_id string, ord long, message_id string, date string, content binary"
#: Messages that one request lists, and ranges into which a folder is cut at most.
CHUNK, MOST_RANGES = 500, 1_000

# Fixed values of the protocol: what may be asked again, what says that a change link is void, and waits in seconds.
BUSY_STATUS = (408, 429, 500, 502, 503, 504)
LOST_STATUS = 410
LOST_CODES = ("syncstatenotfound", "resyncrequired", "resyncchangesapplydifferences", "resyncchangesuploaddifferences")
FIRST_WAIT, LONGEST_WAIT = 2.0, 60.0


class ResumeLost(RuntimeError):
    """The server has forgotten the position that an offset stands for."""


class Refused(RuntimeError):
    """The server will give the same answer however often it is asked."""


class Expired(RuntimeError):
    """The client's permission has to be renewed before it asks again."""


class Busy(RuntimeError):
    """The server asks to come back, after ``seconds`` if it says so."""

    def __init__(self, seconds: float | None = None):
        super().__init__("busy" if seconds is None else f"retry after {seconds} s")
        self.seconds = seconds


def refusal(status: int, code: str = "", retry_after: str | None = None) -> Exception | None:
    """The error that an answer stands for; none where it is no error."""
    if status < 400:
        return None
    if status == LOST_STATUS or code.lower() in LOST_CODES:
        return ResumeLost(code or str(status))
    if status == 401:
        return Expired()
    if status in BUSY_STATUS:
        try:
            return Busy(None if retry_after is None else float(retry_after))
        except ValueError:
            # a date: the usual waits do
            return Busy()
    return Refused(f"{status} {code}".strip())


class Budget:
    """The repeated requests of one partition: ``tries`` in all, so that a failing server is not asked forever.

    ``Busy`` and broken connections are asked again, after the time the server names or waits that
    double, up to ``LONGEST_WAIT``; an ``Expired`` permission is renewed once a request and costs
    nothing.  All other errors are final.
    """

    def __init__(self, tries: int = 5, sleep: Callable[[float], None] = time.sleep, renew: Callable[[], None] | None = None):
        self.left, self.sleep, self.renew = tries, sleep, renew

    def ask(self, request: Callable):
        attempt, renewed = 0, False
        while True:
            try:
                return request()
            except Expired:
                if renewed or self.renew is None:
                    raise
                renewed = True
                self.renew()
            except (Busy, ConnectionError, TimeoutError) as e:
                if self.left <= 0:
                    raise
                self.left -= 1
                named = getattr(e, "seconds", None)
                self.sleep(min(max(named, 0.0) if named is not None else FIRST_WAIT * 2**attempt, LONGEST_WAIT))
                attempt += 1


def client(options: dict[str, str]):
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


def budget(server, options: dict[str, str]) -> Budget:
    return Budget(int(options.get("tries", 5)), renew=getattr(server, "renew", None))


def folder_paths(children: Callable[[str | None], list[tuple[str, str]]], parent: str | None = None, prefix: str = "") -> dict[str, str]:
    """path -> id of a tree of folders; ``children(id)`` gives (id, name) pairs."""
    out = {}
    for number, name in children(parent):
        out[prefix + name] = number
        out |= folder_paths(children, number, f"{prefix}{name}/")
    return out


@dataclass
class Uids(InputPartition):
    """The messages of a folder from one uid to another, under a validity."""

    folder: str
    validity: int
    low: int
    high: int


def ranges(folder: str, validity: int, above: int, top: int, chunk: int) -> list[Uids]:
    """The uids after ``above`` up to ``top`` in even ranges of whole chunks, at most ``MOST_RANGES``."""
    size = chunk * max(1, -(-(top - above) // (chunk * MOST_RANGES)))
    return [Uids(folder, validity, low, min(low + size - 1, top)) for low in range(above + 1, top + 1, size)]


def _listed(server, asked: Budget, part: Uids, chunk: int) -> Iterator[tuple]:
    if asked.ask(lambda: server.validity(part.folder)) != part.validity:
        raise ResumeLost(f"{part.folder}: uids were renumbered")
    following, low = getattr(server, "following", None), part.low
    while low <= part.high:
        if following is not None:
            low = asked.ask(lambda: following(part.folder, low, part.high))  # noqa: B023
            if low is None:
                return
        high = min(low + chunk - 1, part.high)
        # servers may answer with the last message even where its uid is not asked for
        yield from (m for m in asked.ask(lambda: server.listing(part.folder, low, high)) if low <= m[0] <= high)  # noqa: B023
        low = high + 1


class _UidStream(DataSourceStreamReader):
    """Offsets: validity and highest uid of each folder.  Uids only grow under a validity, so a batch can be read again as it was."""

    def __init__(self, options: dict[str, str]):
        self.options, self.chunk = options, int(options.get("chunk", CHUNK))

    def initialOffset(self) -> dict:
        return {"kind": "imap-uid", "folders": {}}

    def latestOffset(self) -> dict:
        server = client(self.options)
        asked = budget(server, self.options)
        names = self.options["folder"].split("\n") if "folder" in self.options else asked.ask(server.folders)
        return {"kind": "imap-uid", "folders": {f: {"uidvalidity": asked.ask(lambda: server.validity(f)), "uid": asked.ask(lambda: server.top(f))} for f in names}}  # noqa: B023

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for folder, point in end["folders"].items():
            before = start["folders"].get(folder, {"uidvalidity": point["uidvalidity"], "uid": 0})
            if before["uidvalidity"] != point["uidvalidity"]:
                raise ResumeLost(f"{folder}: uids were renumbered")
            out += ranges(folder, point["uidvalidity"], before["uid"], point["uid"], self.chunk)
        return out

    def read(self, partition: Uids) -> Iterator[tuple]:
        server = client(self.options)
        asked = budget(server, self.options)
        for uid, message_id, date in _listed(server, asked, partition, self.chunk):
            try:
                body = asked.ask(lambda: server.fetch(partition.folder, str(uid)))  # noqa: B023
            except LookupError:
                # gone since it was listed
                continue
            yield partition.folder, str(uid), uid, message_id, date, body

    def commit(self, end: dict) -> None:
        pass


class _DeltaReader(SimpleDataSourceStreamReader):
    """Change links follow one another, so the driver walks them; it sees ids only.  ``with_content`` fetches in tasks."""

    def __init__(self, options: dict[str, str]):
        self.options, self.folder = options, options["folder"]

    def initialOffset(self) -> dict:
        return {"kind": "graph-delta", "delta_link": None, "issued": None}

    def _round(self, link: str | None) -> tuple[list[tuple], str]:
        server, rows = client(self.options), []
        asked = budget(server, self.options)
        while True:
            page, following, done = asked.ask(lambda: server.delta(self.folder, link))  # noqa: B023
            rows += [(self.folder, row[0], None, row[1], row[2], None) for row in page if row is not None]
            if done is not None:
                return rows, done
            link = following

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, link = self._round(start["delta_link"])
        if start["delta_link"] is None and not rows:
            # an empty first round proves nothing about the folder, so its link is not kept
            return iter([]), start
        issued = datetime.now(timezone.utc).isoformat() if link != start["delta_link"] else start["issued"]
        return iter(rows), {"kind": "graph-delta", "delta_link": link, "issued": issued}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._round(start["delta_link"])[0])


class _ListingReader(DataSourceReader):
    """What folders hold, without contents.  Folders and bounds of uids that are filtered for are all that the server is asked for.

    Spark keeps one reader for all scans of one ``load()``, so reads with different filters within a
    plan each need a ``load()`` of their own (``loaded``).
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.chunk = options, int(options.get("chunk", CHUNK))
        self.only: set[str] | None = None
        self.above, self.upto = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            path = getattr(f, "attribute", None)
            if path == ("folder",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            elif path == ("ord",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.above = max(self.above, f.value - isinstance(f, GreaterThanOrEqual))
            elif path == ("ord",) and isinstance(f, (LessThan, LessThanOrEqual)):
                last = f.value - isinstance(f, LessThan)
                self.upto = last if self.upto is None else min(self.upto, last)
            # Spark looks at the rows again, in case a server answers with more
            yield f

    def partitions(self) -> list[InputPartition]:
        server = client(self.options)
        asked = budget(server, self.options)
        names = self.options["folder"].split("\n") if "folder" in self.options else asked.ask(server.folders)
        out = []
        for f in names:
            if self.only is None or f in self.only:
                top = asked.ask(lambda: server.top(f))  # noqa: B023
                out += ranges(f, asked.ask(lambda: server.validity(f)), self.above, top if self.upto is None else min(top, self.upto), self.chunk)  # noqa: B023
        # a source without partitions would be read as one that has none of its own
        return out or [Uids("", 0, 1, 0)]

    def read(self, partition: Uids) -> Iterator[tuple]:
        if partition.low > partition.high:
            return
        server = client(self.options)
        for uid, message_id, date in _listed(server, budget(server, self.options), partition, self.chunk):
            yield partition.folder, str(uid), uid, message_id, date, None


def loaded(spark: SparkSession, options: dict[str, str], folders: list[str], above: int | None = None) -> DataFrame:
    """The listing of some folders (of uids beyond ``above``), asked for as such."""
    found = spark.read.format("mail_uid").options(**options).load().where(F.col("folder").isin(folders))
    return found if above is None else found.where(F.col("ord") > above)


def with_content(messages: DataFrame, options: dict[str, str]) -> DataFrame:
    """``messages`` of a source with their contents, fetched in tasks; one connection and one budget a partition.  What is gone has null."""
    schema = messages.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server = asked = None
        for batch in batches:
            bodies = []
            for r in batch.itertuples(index=False):
                if server is None:
                    server = client(options)
                    asked = budget(server, options)
                try:
                    bodies.append(asked.ask(lambda: server.fetch(r.folder, r.msg_id)))  # noqa: B023
                except LookupError:
                    bodies.append(None)
            yield batch.assign(content=pd.Series(bodies, batch.index, dtype=object))

    return messages.mapInPandas(run, schema)


class UidMailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail_uid"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _UidStream(dict(self.options))


class DeltaMailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail_delta"

    def schema(self) -> str:
        return COLUMNS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _DeltaReader(dict(self.options))


def register(spark) -> None:
    """Make ``spark.read`` and ``spark.readStream`` know the formats, and hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(UidMailbox)
    spark.dataSource.register(DeltaMailbox)

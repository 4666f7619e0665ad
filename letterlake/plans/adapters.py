"""The benchmark's tables as mail: the frames that the registered queries run over."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a task sorts and joins.  Not fewer: a step of more than 200 partitions makes the tasks before it hold their rows.
TASK_ROWS = 1_100_000
#: Events of a file and bytes of a row group of the server's table, and uids that the server reads ahead.
SERVED_ROWS, SERVED_BYTES = 1_000_000, 1 << 20
LEAST_AHEAD, MOST_AHEAD = 20_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt out by ``key`` for a step over ``rows`` rows, so that a task has about ``TASK_ROWS`` of them; few rows are left to Spark.

    Spark deals by bytes as they are written, and columns of keys and flags grow to many times that when they are sorted.
    """
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), key)


def order_mail(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as messages: customers write, suppliers of the items receive, segments are mailboxes."""
    orders, items, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    n_orders, n_items = orders.count(), items.count()
    key = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("store_id")
    date = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    message = orders.select(key("o_orderkey"), F.concat(F.lit("<"), F.col("o_custkey").cast("string"), F.lit("@mail>")).alias("email_id"), date.alias("date"), F.col("o_orderpriority").alias("subject"))
    owned = dealt(orders.select("o_orderkey", "o_custkey"), "o_custkey", n_orders).join(dealt(customers, "c_custkey", n_orders), F.col("o_custkey") == F.col("c_custkey"))
    sender = owned.select(key("o_orderkey"), F.lower("c_name").alias("address"))
    received = items.select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("@supply")).alias("address"))
    recipient = dealt(received, "l_orderkey", n_items).distinct().select(key("l_orderkey"), "address")
    lines = dealt(items.select("l_orderkey", "l_returnflag", "l_linestatus"), "l_orderkey", max(n_items, n_orders))
    # a task has few orders, which need no sorting
    placed = lines.join(dealt(owned.select("o_orderkey", "c_mktsegment"), "o_orderkey", max(n_items, n_orders)).hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    location = placed.select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("c_mktsegment")).alias("mailbox"), F.col("l_linestatus").alias("folder")).distinct()
    return {"message": message, "sender": sender, "recipient": recipient, "location": location.select(key("l_orderkey"), "mailbox", "folder")}


def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored messages; equal texts are one entry."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    each = docs.select(F.sha2("text", 256).alias("store_id"), F.encode("text", "UTF-8").alias("content"), F.octet_length("text").cast("long").alias("stored_bytes"))
    return each.dropDuplicates(["store_id"]).select("*", F.lit("none").alias("codec"), F.concat(F.substring("store_id", 1, 2), F.lit("/"), "store_id", F.lit(".eml")).alias("path"))


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as observations at (source, lang), written by five passes a place; toxic ones are gone from the store."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").join(table(spark, sf_dir, "labels"), "doc_id")
    log = F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), (F.col("doc_id") % 5).cast("string"))
    gone = F.when(F.col("toxic") == 1, F.sha2(F.concat(F.lit("gone"), F.col("text")), 256)).otherwise(F.sha2("text", 256))
    date = F.concat(F.lit("2026-0"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("-01T00:00:00+00:00"))
    return docs.select(F.sha2(log, 256).alias("log_hash"), F.col("source").alias("mailbox"), F.col("lang").alias("folder"), date.alias("log_date"), gone.alias("store_id"), F.col("doc_id").alias("line_no"))


def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a server's listing: type and user are the place, values the Message-IDs."""
    mid = F.when(F.col("value") < 5, "").otherwise(F.floor(F.col("value") / 10).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("mailbox"), (F.col("user_id") % 20).cast("string").alias("folder"), F.col("event_id").alias("ord"), mid.alias("mid"))


def event_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each Message-ID that the archive has: of every event whose id is not a multiple of three."""
    return event_listing(spark, sf_dir).where("ord % 3 <> 0 AND mid <> ''").groupBy("mailbox", "folder", "mid").agg(F.count(F.lit(1)).alias("n"))


def event_scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The listing with validities by type, and heads of its places but folder 3: points up to the events whose id is a multiple of seven."""
    listing = event_listing(spark, sf_dir)
    point = F.to_json(F.struct(F.lit("imap-uid").alias("kind"), F.lit(1).alias("uidvalidity"), F.max("ord").alias("uid")))
    heads = listing.where("ord % 7 = 0 AND folder <> '3'").groupBy("mailbox", "folder").agg(point.alias("resume"), F.lit("log").alias("log"))
    return listing.withColumn("validity", (1 + F.length("mailbox") % 2).cast("long")), heads


def served(events: DataFrame, root: str) -> str:
    """The events as a server keeps its mail, by folder and uid in small row groups, so that a page is read without the others; a new folder below ``root``."""
    path = f"{root}/served-{uuid.uuid4().hex}"
    kept = events.where("event_type IS NOT NULL AND event_id IS NOT NULL").select("event_type", "event_id", "user_id", "ts", "props")
    files = max(1, -(-kept.count() // SERVED_ROWS))
    kept.repartitionByRange(files, "event_type", "event_id").sortWithinPartitions("event_type", "event_id").write.option("parquet.block.size", SERVED_BYTES).parquet(path)
    return path


class EventServer:
    """The events as a mail server: types are folders, ``event_id + 1`` is the uid, properties are the contents.

    ``path`` is their table, best as ``served`` writes it.  Messages are read some thousand uids
    ahead, and requests that follow one another are answered from what is held.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.width, self.held = LEAST_AHEAD, None

    def folders(self) -> list[str]:
        return sorted({kind for kind, _ in _tops(self.path)})

    def validity(self, folder: str) -> int:
        return 1

    def top(self, folder: str) -> int:
        return max((uid for kind, uid in _tops(self.path) if kind == folder), default=0)

    def _hold(self, folder: str, low: int, high: int) -> None:
        """Have a folder's messages from ``low`` to ``high`` at hand, and some beyond: more where uids are sparse."""
        if self.held is not None and self.held[0] == folder and self.held[1] <= low and high < self.held[2]:
            return
        import pyarrow.compute as pc

        end = max(high + 1, low + self.width)
        asked = (pc.field("event_type") == folder) & (pc.field("event_id") >= low - 1) & (pc.field("event_id") < end - 1)
        rows = _events(self.path).to_table(columns=["event_id", "user_id", "ts", "props"], filter=asked, use_threads=False).sort_by("event_id")
        self.held = folder, low, end
        self.uids = rows["event_id"].to_numpy() + 1
        self.rows, self.bodies = rows.select(["event_id", "user_id", "ts"]), rows["props"].combine_chunks()
        if len(rows) < LEAST_AHEAD // 4:
            self.width = min(self.width * 2, MOST_AHEAD)
        elif len(rows) > LEAST_AHEAD:
            self.width = max(self.width // 2, LEAST_AHEAD)

    def following(self, folder: str, low: int, high: int) -> int | None:
        """The first uid from ``low`` to ``high`` that there is."""
        while low <= high:
            self._hold(folder, low, low)
            at = self.uids.searchsorted(low)
            if at < len(self.uids):
                return int(self.uids[at]) if self.uids[at] <= high else None
            low = self.held[2]
        return None

    def listing(self, folder: str, low: int, high: int) -> list[tuple[int, str, str]]:
        self._hold(folder, low, high)
        a, b = self.uids.searchsorted([low, high + 1])
        return [(r["event_id"] + 1, f"<{r['event_id']}@{r['user_id']}>", str(r["ts"])) for r in self.rows.slice(a, b - a).to_pylist()]

    def fetch(self, folder: str, msg_id: str) -> bytes:
        uid = int(msg_id)
        self._hold(folder, uid, uid)
        at = self.uids.searchsorted(uid)
        if at == len(self.uids) or self.uids[at] != uid:
            raise LookupError(msg_id)
        return (self.bodies[int(at)].as_py() or "").encode()


@functools.lru_cache(8)
def _events(path: str):
    """The table as a dataset, which keeps the footers that it has read."""
    import pyarrow.dataset as ds

    return ds.dataset(path, format="parquet")


@functools.lru_cache(8)
def _tops(path: str) -> tuple[tuple[str, int], ...]:
    """Folders and their highest uids, from the statistics of row groups with one folder; others are read, one at a time."""
    tops: dict[str, int] = {}
    for file in _events(path).get_fragments():
        place = {file.metadata.schema.column(k).path: k for k in range(file.metadata.num_columns)}
        for number in range(file.metadata.num_row_groups):
            kinds, ids = (file.metadata.row_group(number).column(place[c]).statistics for c in ("event_type", "event_id"))
            if kinds and ids and kinds.has_min_max and ids.has_min_max and kinds.min == kinds.max:
                found = [(kinds.max, ids.max)]
            else:
                own = file.subset(row_group_ids=[number]).to_table(columns=["event_type", "event_id"]).group_by("event_type").aggregate([("event_id", "max")])
                found = zip(own["event_type"].to_pylist(), own["event_id_max"].to_pylist())
            for kind, top in found:
                if kind is not None and top is not None:
                    tops[kind] = max(tops.get(kind, 0), top + 1)
    return tuple(tops.items())

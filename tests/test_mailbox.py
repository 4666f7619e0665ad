"""Mailbox sources: partitions, pushdown, replays, lost positions, and what is asked again."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from letterlake.queries import QUERIES
from letterlake.sources import mailbox


class Server:
    """root/folder.json: {"validity": n, "messages": {uid: text}}; every call is a line in root/calls."""

    def __init__(self, options):
        self.root = Path(options["root"])

    def _told(self, *call):
        with (self.root / "calls").open("a") as f:
            f.write(json.dumps(call) + "\n")

    def _folder(self, folder):
        return json.loads((self.root / f"{folder}.json").read_text())

    def folders(self):
        return sorted(p.stem for p in self.root.glob("*.json"))

    def validity(self, folder):
        return self._folder(folder)["validity"]

    def top(self, folder):
        return max(map(int, self._folder(folder)["messages"]), default=0)

    def listing(self, folder, low, high):
        self._told("listing", folder, low, high)
        uids = sorted(map(int, self._folder(folder)["messages"]))
        # as servers do: the last message even where its uid is smaller
        return [(u, f"<{u}@{folder}>", None) for u in uids if low <= u <= high or u == uids[-1]]

    def fetch(self, folder, msg_id):
        import os

        self._told("fetch", folder, int(msg_id), os.getpid())
        body = self._folder(folder)["messages"][msg_id]
        if body is None:
            raise LookupError(msg_id)
        return body.encode()

    def delta(self, folder, link):
        pages = {None: ([("1", "<1>", None), None], "page2", None), "page2": ([("2", "<2>", None)], None, "end"), "end": ([], None, "end")}
        return pages[link]


def put(root, folder, validity, messages):
    (root / f"{folder}.json").write_text(json.dumps({"validity": validity, "messages": messages}))


def calls(root, kind):
    lines = (root / "calls").read_text().splitlines() if (root / "calls").exists() else []
    return [tuple(c[1:]) for c in map(json.loads, lines) if c[0] == kind]


def options_of(root, **more):
    return {"client": f"{__name__}:Server", "root": str(root), **more}


def test_filters_reach_the_server_in_pages(spark, tmp_path):
    put(tmp_path, "INBOX", 1, {u: "x" for u in range(1, 26)})
    put(tmp_path, "Sent", 1, {u: "x" for u in range(1, 26)})
    mailbox.register(spark)
    found = spark.read.format("mail_uid").options(**options_of(tmp_path, chunk="4")).load()
    rows = found.where((F.col("folder") == "INBOX") & (F.col("ord") > 12) & (F.col("ord") <= 22)).select("folder", "ord").collect()
    assert sorted(rows) == [("INBOX", u) for u in range(13, 23)]
    assert sorted(calls(tmp_path, "listing")) == [("INBOX", 13, 16), ("INBOX", 17, 20), ("INBOX", 21, 22)] and not calls(tmp_path, "fetch")
    assert found.where(F.col("folder") == "none").count() == 0
    # a filter that the source cannot use is still applied
    assert sorted(r.ord for r in found.where((F.col("ord") >= 24) & F.col("message_id").endswith("@Sent>")).collect()) == [24, 25]


def test_ranges_stay_few():
    parts = mailbox.ranges("f", 1, 0, 10_000_000, 500)
    assert len(parts) <= mailbox.MOST_RANGES and parts[0].low == 1 and parts[-1].high == 10_000_000
    assert all(b.low == a.high + 1 for a, b in zip(parts, parts[1:])) and mailbox.ranges("f", 1, 7, 7, 500) == []


def run_stream(spark, root, options):
    mailbox.register(spark)
    messages = spark.readStream.format("mail_uid").options(**options).load()
    messages.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.folder, r.ord, bytes(r.content).decode()) for r in spark.read.schema(messages.schema).parquet(f"{root}/out").collect())


def test_stream_reads_in_tasks_and_goes_on_where_it_stopped(spark, tmp_path):
    import os

    server = tmp_path / "server"
    server.mkdir()
    put(server, "INBOX", 1, {1: "a", 3: "b", 9: None, 10: "c"})
    put(server, "Sent", 1, {})
    options = options_of(server, chunk="3")
    assert run_stream(spark, tmp_path, options) == [("INBOX", 1, "a"), ("INBOX", 3, "b"), ("INBOX", 10, "c")]
    assert all(pid != os.getpid() for *_, pid in calls(server, "fetch")) and ("INBOX", 10, 10) in calls(server, "listing")
    put(server, "INBOX", 1, {10: "c", 11: "d"})
    put(server, "Sent", 4, {5: "e"})
    put(server, "New", 1, {1: "f"})
    with pytest.raises(Exception, match="renumbered"):
        # a folder that had a validity has another one now
        run_stream(spark, tmp_path, options)
    put(server, "Sent", 1, {5: "e"})
    (server / "calls").unlink()


def test_a_batch_can_be_read_again_as_it_was(tmp_path):
    put(tmp_path, "INBOX", 1, {u: str(u) for u in range(1, 8)})
    reader = mailbox._UidStream(options_of(tmp_path, chunk="2"))
    start, end = reader.initialOffset(), json.loads(json.dumps(reader.latestOffset()))
    parts = reader.partitions(start, end)
    assert len(parts) == 4
    first = [r for p in parts for r in reader.read(p)]
    put(tmp_path, "INBOX", 1, {u: str(u) for u in range(1, 20)})
    assert [r for p in mailbox._UidStream(options_of(tmp_path, chunk="2")).partitions(start, end) for r in reader.read(p)] == first
    assert [r[2] for r in first] == list(range(1, 8)) and reader.partitions(end, end) == []
    put(tmp_path, "INBOX", 2, {1: "x"})
    with pytest.raises(mailbox.ResumeLost):
        reader.partitions(end, reader.latestOffset())
    with pytest.raises(mailbox.ResumeLost):
        list(reader.read(parts[0]))


def test_delta_sees_ids_only_and_contents_come_in_tasks(spark, tmp_path):
    put(tmp_path, "INBOX", 1, {"1": "a", "2": "b"})
    reader = mailbox._DeltaReader(options_of(tmp_path, folder="INBOX"))
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert [(r[1], r[5]) for r in rows] == [("1", None), ("2", None)] and end["delta_link"] == "end"
    again, same = reader.read(end)
    assert list(again) == [] and same == end and list(reader.readBetweenOffsets(reader.initialOffset(), end)) == rows
    df = mailbox.with_content(spark.createDataFrame(rows + [("INBOX", "7", None, "<7>", None, None)], mailbox.COLUMNS), options_of(tmp_path))
    assert {r.msg_id: r.content and bytes(r.content) for r in df.collect()} == {"1": b"a", "2": b"b", "7": None}


ANSWERS = [
    (200, "", None, None), (204, "", None, None), (401, "", None, mailbox.Expired), (400, "", None, mailbox.Refused), (403, "", None, mailbox.Refused), (404, "", None, mailbox.Refused),
    (408, "", None, mailbox.Busy), (429, "", "7", mailbox.Busy), (500, "", None, mailbox.Busy), (502, "", None, mailbox.Busy), (503, "", "soon", mailbox.Busy), (504, "", None, mailbox.Busy),
    (410, "", None, mailbox.ResumeLost), (400, "SyncStateNotFound", None, mailbox.ResumeLost), (404, "resyncRequired", None, mailbox.ResumeLost), (501, "", None, mailbox.Refused),
]


@pytest.mark.parametrize("status,code,after,kind", ANSWERS)
def test_what_an_answer_means(status, code, after, kind):
    got = mailbox.refusal(status, code, after)
    assert (got is None and kind is None) or type(got) is kind
    if after is not None:
        assert got.seconds == (7.0 if after == "7" else None)


def failing(*errors):
    left = list(errors)

    def request():
        if left:
            raise left.pop(0)
        return "done"

    return request


ERRORS = {
    "busy waits double": ((mailbox.Busy(), mailbox.Busy(), mailbox.Busy()), [2.0, 4.0, 8.0], "done"),
    "the server names the time": ((mailbox.Busy(3.5), mailbox.Busy(1e9), mailbox.Busy(-1)), [3.5, 60.0, 0.0], "done"),
    "connections break": ((ConnectionError(), TimeoutError()), [2.0, 4.0], "done"),
    "the last refusal is told": ((mailbox.Busy(),) * 6, [2.0, 4.0, 8.0, 16.0, 32.0], mailbox.Busy),
    "a lost position is final": ((mailbox.ResumeLost(),), [], mailbox.ResumeLost),
    "a refusal is final": ((mailbox.Refused(),), [], mailbox.Refused),
    "a missing message is final": ((LookupError(),), [], LookupError),
    "an expired permission is renewed once": ((mailbox.Expired(),), [], "done"),
    "and no more": ((mailbox.Expired(), mailbox.Expired()), [], mailbox.Expired),
}


@pytest.mark.parametrize("case", ERRORS)
def test_what_is_asked_again(case):
    errors, expected, outcome = ERRORS[case]
    waits = []
    asked = mailbox.Budget(5, waits.append, renew=lambda: None)
    if isinstance(outcome, str):
        assert asked.ask(failing(*errors)) == outcome
    else:
        with pytest.raises(outcome):
            asked.ask(failing(*errors))
    assert waits == expected


def test_requests_share_a_budget():
    asked = mailbox.Budget(3, lambda _: None)
    assert asked.ask(failing(mailbox.Busy(), mailbox.Busy())) == "done"
    with pytest.raises(mailbox.Busy):
        asked.ask(failing(mailbox.Busy(), mailbox.Busy()))


def test_the_events_in_several_partitions(spark):
    sf = "/root/testdata/sf0.001"
    assert spark.read.format("mail_uid").options(client="letterlake.plans.adapters:EventServer", path=f"{sf}/events.parquet", chunk="100").load().rdd.getNumPartitions() > 5
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert sum(r.messages for r in QUERIES["mailbox_stream"](spark, sf).collect()) == total


def test_the_server_of_events_reads_on_and_skips_gaps(spark, tmp_path, monkeypatch):
    from letterlake.plans import adapters

    # two runs of uids far apart, in falling order and with rows that are no messages
    ids = [*range(999, -1, -1), *range(3_000_000_499, 3_000_000_000 - 1, -1)]
    rows = [(i, i % 7, "a" if i % 3 else "b/ö", f"p{i}") for i in ids] + [(None, 1, "a", "x"), (5_000, 1, None, "x")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    path = adapters.served(events, f"file://{tmp_path}")
    told = {"asked": 0, "read": 0}

    class Counted(adapters.EventServer):
        def listing(self, folder, low, high):
            told["asked"] += 1
            return super().listing(folder, low, high)

        def _hold(self, *asked):
            before = self.held
            super()._hold(*asked)
            told["read"] += self.held is not before

    monkeypatch.setattr(adapters, "EventServer", Counted)
    options = {"client": "letterlake.plans.adapters:EventServer", "path": path, "chunk": "50"}
    reader = mailbox._UidStream(options)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [r for p in parts for r in reader.read(p)]
    assert sorted((r[0], r[2], r[3], r[5]) for r in got) == sorted((kind, i + 1, f"<{i}@{user}>", body.encode()) for i, user, kind, body in rows if i is not None and kind is not None)
    # before, every 50 uids were a request (120 million here), and each request read the table
    assert told["asked"] <= 100 and told["read"] <= 20_000 and reader.latestOffset()["folders"]["a"]["uid"] == 3_000_000_500
    with pytest.raises(LookupError):
        adapters.EventServer(options).fetch("a", "7777")

"""Quarantine, pruning, declared counts, and the table of Message-IDs."""

import os
import time

from letterlake.jobs import Archive
from tests.test_archive import message
from tests.test_backup import Post, put  # noqa: F401


def archive_of(spark, tmp_path, n=4):
    a = Archive(spark, str(tmp_path / "archive"))
    a.init()
    a.add(spark.createDataFrame([(message(k),) for k in range(n)], "content binary"), "me", "INBOX")
    return a


def test_a_damaged_entry_loses_its_name(spark, tmp_path):
    a = archive_of(spark, tmp_path)
    a.create_db()
    path = sorted((tmp_path / "archive" / "mail").rglob("*.eml"))[0]
    sid, body = path.stem, path.read_bytes()
    assert a.quarantine() == 0 and a.search().count() == 4
    for nth in range(2):
        path.write_bytes(body + b"!")
        assert a.check()["damaged"] == 1 and a.quarantine() == 1
        assert not path.exists() and len(list(path.parent.glob("*.corrupt*"))) == nth + 1
        found = a.check()
        # it is missing now, so that it is fetched again, and no search or count shows it
        assert (found["damaged"], found["missing"]) == (0, 1) and a.statistics()["messages"] == 3
        assert [r.store_id for r in a.quarantined().collect()] == [sid] and sid not in {r.store_id for r in a.search().collect()} and a.search().count() == 3
        path.write_bytes(body)
        assert a.quarantined().count() == 0 and a.search().count() == 4 and a.check()["sound"]


def test_only_old_leftovers_go(spark, tmp_path):
    a = archive_of(spark, tmp_path, 1)
    entry = next((tmp_path / "archive" / "mail").rglob("*.eml"))
    old, new = entry.with_name(entry.name + ".1.tmp"), tmp_path / "archive" / "meta" / "writing.2.tmp"
    for p in (old, new):
        p.write_text("x")
    os.utime(old, (time.time() - 90_000,) * 2)
    assert a.prune() == 1 and not old.exists() and new.exists() and a.check()["sound"]
    os.utime(new, (time.time() - 90_000,) * 2)
    assert a.prune() == 1 and a.prune() == 0 and entry.exists()


def test_logs_that_declare_another_number(spark, tmp_path):
    a = archive_of(spark, tmp_path)
    assert a.short_logs().count() == 0
    path = next((tmp_path / "archive" / "meta").rglob("*.jsonl"))
    path.write_text("".join(path.read_text().splitlines(True)[:-1]))
    assert [(r.hash, r.declared, r.entries) for r in a.short_logs().collect()] == [(path.stem, 4, 3)]


def test_no_message_is_read_twice_for_its_id(spark, tmp_path):
    server = tmp_path / "server"
    options = {"client": "tests.test_backup:Post", "root": str(server)}
    put(server, "INBOX", 1, {1: message(1), 2: message(2)})
    a = Archive(spark, str(tmp_path / "archive"))
    a.init()
    a.backup("me", options)
    first = [tuple(r) for r in a.verify("me", options).collect()]
    # contents that can no longer tell their ids
    for path in (tmp_path / "archive" / "mail").rglob("*.eml"):
        path.write_bytes(b"x")
    assert [tuple(r) for r in a.verify("me", options).collect()] == first == [("me", "INBOX", 2, 0, 0)]
    (tmp_path / "archive" / "mail").rename(tmp_path / "elsewhere")
    (tmp_path / "archive" / "mail").mkdir()
    # nor does the table stand for messages that are gone
    assert [r.missing for r in a.verify("me", options).collect()] == [2]


def test_an_old_database_in_ranges(spark, tmp_path):
    import sqlite3

    from letterlake.sources import archive

    path = tmp_path / "old.db"
    with sqlite3.connect(path) as con:
        con.executescript("CREATE TABLE mailbox (mailbox_id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE label (label_id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE message (message_id INTEGER PRIMARY KEY, store_id TEXT); CREATE TABLE message_mailbox (message_id INTEGER, mailbox_id INTEGER); CREATE TABLE message_label (message_id INTEGER, label_id INTEGER);")
        con.executemany("INSERT INTO mailbox VALUES (?, ?)", [(1, "a"), (2, "b")])
        con.executemany("INSERT INTO label VALUES (?, ?)", [(1, "in"), (2, "out")])
        con.executemany("INSERT INTO message VALUES (?, ?)", [(k * 3, f"s{k}") for k in range(-2, 23)])
        con.executemany("INSERT INTO message_mailbox VALUES (?, ?)", [(k * 3, 1 + k % 2) for k in range(-2, 23)])
    for rows in (4, 1_000):
        found = archive.legacy_database(spark, str(path), rows)
        assert sorted(tuple(r) for r in found["message"].collect()) == [(k * 3, f"s{k}") for k in range(-2, 23)]
        assert sorted(tuple(r) for r in found["mailbox"].collect()) == [(k * 3, "ab"[k % 2]) for k in range(-2, 23)]
        assert found["folder"].count() == 0 and found["snapshot"].count() == 0
    assert archive.legacy_database(spark, str(path), 4)["message"].rdd.getNumPartitions() == 19


def test_a_batch_counts_once_and_a_crash_changes_nothing(spark, tmp_path, monkeypatch):
    import pytest

    from letterlake.plans.projection import Projection

    a = archive_of(spark, tmp_path, 2)
    log_file, observation = a.log()
    view = Projection(spark, str(tmp_path / "view"))
    given = a.store(), log_file, observation, a.heads()
    assert view.refresh(*given, batch=("s", 0)) == 1 and view.folded("s") == 0 and view.folded("other") == -1
    a.add(spark.createDataFrame([(message(7),)], "content binary"), "me", "Sent")
    log_file, observation = a.log()
    given = a.store(), log_file, observation, a.heads()
    before = view._pointer()
    # the tables are written, and then the pointer cannot be moved
    with monkeypatch.context() as m:
        m.setattr(Projection, "exists", lambda self: True)
        real = Projection._path

        def broken(self, name):
            if name.startswith("_current-"):
                raise OSError("stopped")
            return real(self, name)

        m.setattr(Projection, "_path", broken)
        with pytest.raises(OSError, match="stopped"):
            view.refresh(*given, batch=("s", 1))
    assert view._pointer() == before and view.frames()["message"].count() == 2
    assert view.refresh(*given, batch=("s", 1)) == 1 and view.frames()["message"].count() == 3
    # the same batch again, and an older one: neither is looked at
    for number in (1, 0):
        assert view.refresh(*given, batch=("s", number)) == 0
    assert view.folded("s") == 1 and view.refresh(*given) == 0 and view.folded("s") == 1


def test_a_refresh_writes_new_rows_only(spark, tmp_path, monkeypatch):
    from letterlake.plans import projection

    monkeypatch.setattr(projection, "MOST_PARTS", 3)
    a = archive_of(spark, tmp_path, 3)
    a.create_db()
    root, sizes = tmp_path / "archive" / "view", []
    for k in range(5, 9):
        a.add(spark.createDataFrame([(message(k),), (message(0),)], "content binary"), "me", "Sent" if k % 2 else None)
        before = {p.name for p in root.iterdir()}
        assert a.refresh_db() == 1 and a.refresh_db() == 0
        fresh = [p for p in root.iterdir() if p.name not in before and p.name.startswith("v-")]
        sizes.append(spark.read.parquet(str(fresh[0] / "message")).count())
        frames = a.projection.frames()
        assert frames["message"].count() == 3 + k - 4 == frames["message"].select("store_id").distinct().count()
        assert frames["location"].count() == frames["location"].distinct().count() == 3 + (k - 4) + (1 if k == 5 else 2)
        assert a.freshness().count() == 0 and a.search(limit=-1).count() == 3 + k - 4
    # every third folder is the whole table
    assert sizes == [1, 1, 6, 1]
    assert len([p for p in root.iterdir() if p.name.startswith("v-")]) <= 4

"""Whole tasks over a directory, and settings."""

import sqlite3

import pytest

from letterlake import conf
from letterlake.__main__ import main
from letterlake.jobs import Archive
from tests.test_archive import message


def test_archive_life(spark, tmp_path, capsys):
    a = Archive(spark, str(tmp_path / "archive"))
    with pytest.raises(ValueError):
        a.require()
    a.init()
    a.require()
    mail = tmp_path / "old" / "x"
    mail.mkdir(parents=True)
    for n in range(3):
        (mail / f"{n}.eml").write_bytes(message(n) + b"!" * n)
    (mail / "note.txt").write_text("x")
    assert a.import_directory(str(tmp_path / "old"), "import", dry_run=True)["stored"] == 3 and a.statistics()["messages"] == 0
    assert a.import_directory(str(tmp_path / "old"), "import", largest_only=True)["stored"] == 1
    assert a.import_directory(str(tmp_path / "old"), "import") == {"stored": 2, "present": 1, "failed": 0}
    with pytest.raises(ValueError):
        a.import_directory(str(tmp_path), "import")
    found = a.check()
    assert found["sound"] and found["entries"] == 3 and found["log_files"] == 2 and found["unchained"] == 0
    a.create_db()
    assert a.freshness().count() == 0 and a.search(sender="a2@").count() == 1
    assert a.compact() == {"files_before": 2, "entries_before": 4, "files_after": 1, "entries_after": 3}
    assert a.check()["log_files"] == 1 and a.check()["sound"]
    assert a.compact()["files_before"] == 1 and a.check()["log_files"] == 1
    stray = next((tmp_path / "archive" / "meta").rglob("*.jsonl"))
    stray.unlink()
    assert a.check()["orphans"] == 3 and a.check()["broken_chains"] == 1
    assert a.adopt("found", dry_run=True) == {"found": 3, "held": 0} and a.adopt("found")["found"] == 3 and a.adopt("found") == {"found": 0, "held": 3}
    assert main([str(tmp_path / "archive"), "check"]) == 1
    assert main([str(tmp_path / "archive"), "update"]) == 0
    assert main([str(tmp_path / "archive"), "search", "--sender", "a1@", "--format", "ids"]) == 0
    assert len(capsys.readouterr().out.split()[-1]) == 96


def test_migration(spark, tmp_path):
    path = tmp_path / "store.db"
    with sqlite3.connect(path) as con:
        con.executescript("""CREATE TABLE mailbox(mailbox_id, name); CREATE TABLE label(label_id, name); CREATE TABLE message(message_id, store_id);
            CREATE TABLE message_mailbox(message_id, mailbox_id); CREATE TABLE message_label(message_id, label_id);
            INSERT INTO mailbox VALUES (1, 'a'), (2, 'b'); INSERT INTO label VALUES (1, 'INBOX'), (2, 'Chat');
            INSERT INTO message VALUES (1, 'aa'), (2, 'bb'), (3, 'cc'); INSERT INTO message_mailbox VALUES (1, 1), (1, 2), (2, 1);
            INSERT INTO message_label VALUES (1, 1), (1, 2), (2, 1);""")
    a = Archive(spark, str(tmp_path / "archive"))
    a.init()
    assert a.migrate(str(path)) == {"messages": 3, "placeless": 1, "undecidable": 0}
    assert {(r.mailbox, r.folder, r.messages) for r in a.places().collect()} == {("a", "INBOX", 2), ("b", "Chat", 1)}


def test_settings(monkeypatch):
    monkeypatch.setenv("WORD", "pass")
    text = '[job.one]\nserver = "${HOST:-mail.example.org}"\npassword = "${WORD}"\nexclude = ["Trash"]\n'
    (job,) = conf.jobs(text)
    assert (job.server, job.password, job.port) == ("mail.example.org", "pass", 993)
    assert conf.wanted_folders(["INBOX", "Trash/2019", "My Trash"], job) == ["INBOX", "My Trash"]
    assert conf.jobs('[job.x]\nserver = "s"\npassword_cmd = "echo hi"\n', allow_exec=True)[0].password == "hi"
    for bad in ('[job.x]\nserver = "s"\nport = true\n', '[job.x]\nserver = "${NO_SUCH_NAME}"\n', '[job.x]\nserver = "s"\nwhat = 1\n', "[job.x]\n", '[job.x]\nserver = "s"\npassword_cmd = "x"\n', "= 1", '[job.x]\nserver = "s"\nexclude = ["("]\n'):
        with pytest.raises(conf.ConfigError):
            conf.jobs(bad)

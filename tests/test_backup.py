"""Backup and verification against a stand-in server whose folders are directories."""

import json
import shutil
from pathlib import Path

from letterlake.__main__ import main
from letterlake.jobs import Archive
from tests.test_archive import message


class Post:
    """root/folder/uid.eml; ``validity`` beside the messages; an empty file cannot be fetched."""

    def __init__(self, options):
        self.root = Path(options["root"])

    def folders(self):
        return sorted(p.name for p in self.root.iterdir())

    def validity(self, folder):
        return int((self.root / folder / "validity").read_text())

    def top(self, folder):
        return max((int(p.stem) for p in (self.root / folder).glob("*.eml")), default=0)

    def listing(self, folder, low, high):
        with self.root.with_name("asked").open("a") as f:
            f.write(f"{folder} {low} {high}\n")
        for p in sorted((self.root / folder).glob("*.eml"), key=lambda p: int(p.stem)):
            head = p.read_bytes().split(b"Message-Id: ")
            yield int(p.stem), head[1].split(b"\r\n")[0].decode() if len(head) > 1 else "", None

    def fetch(self, folder, msg_id):
        body = (self.root / folder / f"{msg_id}.eml").read_bytes()
        if not body:
            raise OSError("no such message")
        return body


def put(root, folder, validity, messages):
    shutil.rmtree(root / folder, ignore_errors=True)
    (root / folder).mkdir(parents=True)
    (root / folder / "validity").write_text(str(validity))
    for uid, body in messages.items():
        (root / folder / f"{uid}.eml").write_bytes(body)


def points(archive):
    return {r.folder: json.loads(r.resume)["uid"] if r.resume else None for r in archive.heads().collect()}


def test_backup_and_verification(spark, tmp_path):
    server = tmp_path / "server"
    options = {"client": f"{__name__}:Post", "root": str(server)}
    put(server, "INBOX", 1, {1: message(1), 2: message(2), 3: message(2)})
    put(server, "Sent", 1, {5: message(5), 6: b""})
    put(server, "Empty", 1, {})
    a = Archive(spark, str(tmp_path / "archive"))
    a.init()
    assert a.backup("me", options) == {"listed": 5, "wanted": 5, "stored": 4, "failed": 1}
    # a copy is stored once; a folder with a failure keeps no point, and is told by its listing next time
    assert a.statistics()["messages"] == 3 and points(a) == {"INBOX": 3, "Sent": None}
    assert a.check()["sound"]
    put(server, "INBOX", 1, {2: message(2), 3: message(2), 4: message(4)})
    put(server, "Sent", 1, {5: message(5), 6: message(6)})
    (tmp_path / "asked").unlink()
    assert a.backup("me", options) == {"listed": 3, "wanted": 2, "stored": 2, "failed": 0}
    # of a folder with a point only later messages are asked for, of the others all
    assert set((tmp_path / "asked").read_text().splitlines()) == {"INBOX 4 4", "Sent 1 6"}
    assert points(a) == {"INBOX": 4, "Sent": 6}
    assert a.backup("me", options)["wanted"] == 0 and points(a) == {"INBOX": 4, "Sent": 6}
    # renumbered: only what the archive lacks is fetched
    put(server, "INBOX", 2, {1: message(4), 2: message(7), 3: message(1)})
    assert a.backup("me", options) == {"listed": 3, "wanted": 1, "stored": 1, "failed": 0} and points(a)["INBOX"] == 3

    put(server, "INBOX", 2, {1: message(4), 2: message(7), 3: message(1), 4: message(8), 5: message(1)})
    found = {r.folder: (r.listed, r.missing, r.extra_copies) for r in a.verify("me", options).collect()}
    assert found == {"INBOX": (5, 1, 1), "Sent": (2, 0, 0)}
    repaired = {r.folder: (r.restored, r.recovered, r.known, r.failed) for r in a.verify("me", options, repair=True).collect()}
    assert repaired == {"INBOX": (1, 0, 1, 0)} and a.check()["sound"]
    assert {(r.folder, r.messages) for r in a.places().collect()} == {("INBOX", 5), ("Sent", 2)}


def test_what_a_stopped_backup_left_is_recorded_by_the_next(spark, tmp_path, monkeypatch):
    server = tmp_path / "server"
    options = {"client": f"{__name__}:Post", "root": str(server)}
    put(server, "INBOX", 1, {1: message(1)})
    a = Archive(spark, str(tmp_path / "archive"))
    a.init()

    def stopped(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(a, "record", stopped)
        try:
            a.backup("me", options)
        except OSError:
            pass
    assert a.log()[1].count() == 0 and points(a) == {}
    put(server, "INBOX", 1, {})
    assert a.backup("me", options)["listed"] == 0
    assert [r.folder for r in a.log()[1].collect()] == ["INBOX"] and a.check()["sound"]
    assert not list((tmp_path / "archive" / "pending").iterdir())


def test_conversion_and_commands(spark, tmp_path, capsys):
    server, root = tmp_path / "server", str(tmp_path / "archive")
    put(server, "INBOX", 1, {1: message(1), 2: message(2)})
    a = Archive(spark, root)
    a.init()
    mailbox = ["me", "--client", f"{__name__}:Post", "--option", f"root={server}"]
    assert main([root, "folders", *mailbox]) == 0 and capsys.readouterr().out.split() == ["INBOX"]
    assert main([root, "backup", *mailbox]) == 0 and main([root, "verify", *mailbox]) == 0
    ids = sorted(r.store_id for r in a.store().collect())
    assert a.convert(True) == {"converted": 2, "skipped": 0, "failed": 0}
    assert a.convert(True) == {"converted": 0, "skipped": 2, "failed": 0} and a.check()["sound"]
    assert main([root, "decompress"]) == 0 and sorted(r.store_id for r in a.store().collect()) == ids
    assert {r.codec for r in a.store().collect()} == {"none"} and a.check()["sound"]
    assert main([root, "export", ids[0], "--to", str(tmp_path / "out")]) == 0
    assert [p.stem for p in (tmp_path / "out").rglob("*.eml")] == ids[:1]
    a.create_db()
    capsys.readouterr()
    assert main([root, "search", "--format", "csv"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == '"store_id","date","sender","subject","places"'
    put(server, "INBOX", 1, {1: message(1), 3: message(3)})
    assert main([root, "verify", *mailbox]) == 1

"""The archive operators on small literal frames and real files."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from letterlake import schema
from letterlake.functions import mail, text
from letterlake.operators import attribution, check, places, reconcile, search, store
from letterlake.plans import projection
from letterlake.sources import archive, mailbox

A, B, C = "a" * 96, "b" * 96, "c" * 96


def frame(spark, rows, fields):
    return spark.createDataFrame(rows, schema.of(fields))


#: Made of parts, so that filters hit some of them: folders and mailboxes, names, domains, words of subjects.
_FOLDERS, _NAMES, _WORDS = ["Inbox", "in_box", "Trash 2020", "100%"], ["ann", "BO", "c_d", "ümit"], ["Invoice", "invoice 5%", "Re: tea", "tea_time", "", "ÄRGER"]


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(20)
    tables = {"message": [], "sender": [], "recipient": [], "location": []}
    for k in range(60):
        sid = hashlib.sha384(str(k).encode()).hexdigest()
        day = f"{rng.choice([1969, 2001, 2020, 2021])}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        date = rng.choice([None, f"{day}T{rng.randrange(24):02}:30:00{rng.choice(['', '+02:00', '-11:00'])}"])
        tables["message"].append((sid, f"<{k}@x>", date, rng.choice(_WORDS)))
        for kind in ("sender", "recipient"):
            tables[kind] += [(sid, f"{n}@{rng.choice(['mail.test', 'post.test'])}") for n in rng.sample(_NAMES, rng.randint(0, 2))]
        tables["location"] += [(sid, m, f) for m, f in {(rng.choice([None, "home", "Work"]), rng.choice(_FOLDERS)) for _ in range(rng.randint(0, 3))}]
    kinds = {"message": schema.MESSAGE, "sender": schema.ADDRESS, "recipient": schema.ADDRESS, "location": schema.LOCATION}
    return {name: spark.createDataFrame(rows, kinds[name]) for name, rows in tables.items()} | {"rows": tables}


def model_search(tables, sender=None, recipient=None, subject=None, mailbox=None, folder=None, since=None, until=None, limit=None):
    """Store ids by plain loops: oldest first, undated ones last, then by id."""
    low = lambda x: "".join(c.lower() if c < "\x80" else c for c in x or "")
    within = lambda part, whole: whole is not None and low(part) in low(whole)
    out = []
    for sid, _, date, title in tables["message"]:
        hits = [not sender or any(s == sid and within(sender, a) for s, a in tables["sender"]), not recipient or any(s == sid and within(recipient, a) for s, a in tables["recipient"])]
        hits.append(not subject or within(subject, title))
        places_ = [(m, f) for s, m, f in tables["location"] if s == sid]
        # the two halves may hit different places
        hits += [not mailbox or any(within(mailbox, m) for m, _ in places_), not folder or any(within(folder, f) for _, f in places_)]
        hits.append(not since or (date is not None and date[:10] >= since))
        hits.append(not until or (date is not None and date[:10] <= until))
        if all(hits):
            out.append((date is None, date or "", sid))
    out = [sid for *_, sid in sorted(out)]
    return out if limit is None or limit < 0 else out[:limit]


ASKED = [
    {}, {"sender": "MAIL.t"}, {"sender": "bo@"}, {"recipient": "c_d"}, {"recipient": "Ümit"}, {"recipient": "ümit"}, {"subject": "%"}, {"subject": "_"}, {"subject": "invoice"}, {"subject": "ärger"}, {"subject": ""},
    {"mailbox": "o"}, {"folder": "IN"}, {"folder": "n_b"}, {"folder": "%"}, {"mailbox": "work", "folder": "trash"}, {"sender": "ann", "folder": "2020"}, {"sender": "nobody"},
    {"since": "2001-06-01"}, {"until": "2020-12-31"}, {"since": "2020-01-01", "until": "2020-12-31"}, {"limit": 7}, {"limit": 0}, {"limit": -3}, {"subject": "tea", "limit": 2},
]


@pytest.mark.parametrize("given", ASKED, ids=str)
def test_search_against_loops(frames, given):
    tables = {k: v for k, v in frames.items() if k != "rows"}
    got = [(r.date, r.store_id) for r in search.search(tables, **given).collect()]
    expected = model_search(frames["rows"], **given)
    assert [s for _, s in got] == expected


def test_an_unknown_filter_is_refused(frames):
    with pytest.raises(TypeError):
        search.search({k: v for k, v in frames.items() if k != "rows"}, colour="red")


def test_one_row_whatever_a_message_joins_with(frames):
    tables = {k: v for k, v in frames.items() if k != "rows"}
    hits = search.search(tables).collect()
    assert len(hits) == len({r.store_id for r in hits}) == 60
    count = lambda kind, sid: max(1, sum(r[0] == sid for r in frames["rows"][kind]))
    expected = sum(count("sender", m[0]) * count("recipient", m[0]) * count("location", m[0]) for m in frames["rows"]["message"])
    assert projection.v_messages(tables).count() == expected


def test_only_ascii_case_is_folded(spark):
    df = spark.createDataFrame([("ÄB",), ("äb",)], schema.of("x string"))
    assert [r.x for r in df.where(text.contains_ci(F.col("x"), "äB")).collect()] == ["äb"]


def test_duplicates_compare_text(spark):
    rows = [("1", "<x>", "d"), ("2", "<x>", "d"), ("3", "<x>", "e"), ("4", "", "d"), ("5", "", "d"), ("6", "<y>", None), ("7", "<y>", None)]
    df = spark.createDataFrame([(*r, "") for r in rows], schema.MESSAGE)
    assert {r.store_id for r in projection.v_duplicates(df).collect()} == {"1", "2", "4", "5"}
    assert {r.store_id for r in projection.v_duplicates(df, strict=True).collect()} == {"1", "2"}


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Wed, 20 Feb 2026 12:00:00 -0500", "2026-02-20T12:00:00-05:00"), ("yesterday afternoon", None), ("Tue, 04 Apr 00 06:41:03EST", "2000-04-04T06:41:03-05:00"),
        ("Thur, 11 Dec 1997", "1997-12-11T00:00:00"), ("Thur, 26 June 1997", "1997-06-26T00:00:00"), ("Sa, 14 Dez 2002 00:49:11 +0100", "2002-12-14T00:49:11+01:00"),
        ("Do, 5 März 2003 08:15:00 +0100", "2003-03-05T08:15:00+01:00"), ("27.11.2002 12:03:27", "2002-11-27T12:03:27"), ("05.03.2002 12:03:27", None),
        ("Wed, 17 Sep   GMT Daylight Time", None),
        ("=?iso-8859-1?Q?Thu=2C_18_Dec_1997_22=3A03=3A34_+0100_=28=28ME?= =?iso-8859-1?Q?Z=29_Mitteleurop=E4ische_Zeit=29?=", "1997-12-18T22:03:34+01:00"),
        (None, None), ("", None),
    ],
)
def test_dates(raw, expected):
    found = mail.read_date(raw)
    assert (found and found[:16]) == (expected and expected[:16])


def test_dates_beyond_any_timestamp_and_without_time():
    assert mail.read_date("Fri, 8 Aug 7048 10:02:45 +9752").startswith("7048-08-08T10:02:45")
    assert mail.read_date("Mon, 11 Mar 2002 PST").startswith("2002-03-11T00:00:00")


def test_headers(spark):
    raw = b"From: A <A@Example.com>\r\nTo: Team: b@example.com, c@example.com;\r\nCC: d@example.com\r\nReceived: from x by y for <e@example.com>; now\r\nSubject: Hi\r\nMessage-ID: <m@x>\r\nDate: Wed, 20 Feb 2026 12:00:00 +0100\r\n\r\nTo: no@body.example\r\n"
    odd = b"From: a@example.com\r\nTo: Undisclosed recipients:;\r\n\r\n"
    rows = mail.with_headers(spark.createDataFrame([(raw,), (odd,), (None,)], schema.of("content binary"))).collect()
    assert rows[0].senders == ["a@example.com"] and rows[0].recipients == ["b@example.com", "c@example.com", "d@example.com", "e@example.com"]
    assert (rows[0].email_id, rows[0].subject, rows[0].date) == ("<m@x>", "Hi", "2026-02-20T12:00:00+01:00")
    assert rows[1].recipients == [] and rows[1].email_id == "" and rows[1].date is None
    assert rows[2].senders == []


def test_message_ids(spark):
    given = ["<ABC@Example.com>", "abc@example.com", "<abc\r\n @example.com>", "<>", "", None, "  "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], schema.of("x string")).select(mail.message_id_key("x")).collect()]
    assert got[0] == got[1] == "abc@example.com" and got[3:] == ["", "", "", ""]


def test_journal():
    inner = b"From: x@y\r\nSubject: inner\r\n\r\nbody\r\n"
    part = lambda x: b"--B\r\nContent-Type: message/rfc822\r\n\r\n" + x + b"\r\n"
    cover = b'From: j@y\r\nContent-Type: multipart/mixed; boundary="B"\r\n\r\n'
    assert b"Subject: inner" in mail.journal_item(cover + part(inner) + b"--B--\r\n")
    bounced = cover + part(b"Content-Type: text/plain\r\n\r\nstatus") + part(inner) + b"--B--\r\n"
    assert b"Subject: inner" in mail.journal_item(bounced)
    assert mail.journal_item(inner) is None and mail.journal_item(None) is None


def model_claims(listing, archived):
    left, out = dict(archived), []
    for mid in listing:
        names = [mid] if mid in left else [m for m in sorted(archived) if len(m) > reconcile.LONG and m.startswith(mid)] if len(mid) > reconcile.LONG else []
        hit = next((m for m in names if left[m]), None)
        if hit:
            left[hit] -= 1
        out.append("TAKEN" if hit else "EXHAUSTED" if names else "ABSENT")
    return out


def test_claims_against_a_model(spark):
    rng = random.Random(4)
    listing, archived, expected = [], [], {}
    for place in range(12):
        box, folder = (None if place == 3 else f"m{place}"), f"f{place}"
        ids = ["", "a", "b", "x" * 250 + "1", "x" * 250 + "2", "y" * 140]
        counts = {m: rng.randint(1, 2) for m in rng.sample(ids[1:], 3)}
        asked = [rng.choice([*ids, "x" * 250, "x" * 128, "y" * 139]) for _ in range(15)]
        listing += [(box, folder, k, m) for k, m in enumerate(asked)]
        archived += [(box, folder, m, n) for m, n in counts.items()]
        ordered = [(box, folder, k) for k in range(15)]
        expected |= dict(zip(ordered, model_claims(asked, counts)))
    got = reconcile.claims(frame(spark, listing, "mailbox string, folder string, ord long, mid string"), frame(spark, archived, "mailbox string, folder string, mid string, n long"))
    found = {(r.mailbox, r.folder, r.ord): r.claim for r in got.collect()}
    # which of two long ids a prefix takes is the archive's order; whether one is free is not
    assert found == expected


def test_chains_longer_than_any_recursion_limit(spark):
    n = 300
    logs = [(f"{k:04d}", f"{k - 1:04d}" if k else "lost") for k in range(n)] + [("loop1", "loop2"), ("loop2", "loop1"), ("alone", None)]
    log_file = frame(spark, logs, "hash string, prev string")
    heads = frame(spark, [("m", "f", f"{n - 1:04d}"), ("m", "g", "loop1"), (None, "h", None)], "mailbox string, folder string, log string")
    broken = check.broken_chains(heads, log_file).collect()
    assert [(r.hash, r.mailbox, r.folder) for r in broken] == [("lost", "m", "f")]
    assert [r.hash for r in check.unchained(heads, log_file).collect()] == ["alone"]
    assert check.unchained(heads.limit(0), log_file).count() == 0


def cut(df):
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else check._cut(df)


def test_attribution_by_elimination(spark):
    mail_rows = [(k, m) for k in (0, 1) for m in ("gmail", "other")] + [(2, "gmail"), (3, "a"), (3, "b"), (4, None)]
    folders = [(k, f) for k in (0, 1) for f in ("Archiv/Chat", "Chat")] + [(1, "Important"), (2, "Important"), (3, "INBOX")]
    mailbox = frame(spark, [r for r in mail_rows if r[1]], "message_id long, mailbox string")
    folder = frame(spark, folders, "message_id long, folder string")
    snapshot = frame(spark, [("Archiv/Chat", "other"), ("INBOX", "a"), ("INBOX", "b")], "folder string, mailbox string")
    message = frame(spark, [(k, f"id{k}") for k in range(5)], "message_id long, store_id string")
    owner = attribution.owners(mailbox, folder, snapshot, cut)
    got = {(r.store_id, r.mailbox, r.folder) for r in attribution.attributed(message, mailbox, folder, owner).collect()}
    assert ("id0", "gmail", "Chat") in got and ("id0", "other", "Archiv/Chat") in got and ("id3", "a", None) in got and ("id3", "b", None) in got
    counts = attribution.attribution_counts(message, mailbox, folder, owner).first()
    assert (counts.messages, counts.placeless, counts.undecidable) == (5, 3, 1)


def write_log(root, mailbox, folder, ids, prev=None, date="2026-08-01T18:02:21+00:00"):
    body = places.serialised(mailbox, folder, date, ids, prev)
    name = hashlib.sha384(body).hexdigest()
    path = root / name[:2] / f"{name}.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    return name, path


def message(n):
    return f"From: a{n}@example.com\r\nTo: b@example.com\r\nMessage-Id: <{n}@example.com>\r\nDate: Wed, 20 Feb 2026 12:00:0{n} +0100\r\n\r\nbody {n}".encode()


def test_archive_end_to_end(spark, tmp_path):
    import zstandard

    ids = []
    for n in range(4):
        body = message(n)
        ids.append(hashlib.sha384(body).hexdigest())
        path = tmp_path / "mail" / ids[n][:2] / ids[n][2:4]
        path.mkdir(parents=True, exist_ok=True)
        (path / (ids[n] + (".eml.zst" if n == 1 else ".eml"))).write_bytes(zstandard.compress(body) if n == 1 else body)
    (tmp_path / "mail" / "note.txt").write_text("x")
    first, _ = write_log(tmp_path / "meta", "job", "INBOX", sorted(ids[:2]))
    second, _ = write_log(tmp_path / "meta", "job", "INBOX", [ids[2].upper(), "f" * 96], first)
    bad = tmp_path / "meta" / "zz" / "broken.jsonl"
    bad.parent.mkdir()
    bad.write_text('{"version": 9}\n')
    (tmp_path / "meta" / "zz" / "torn.jsonl").write_text(json.dumps({"version": 1, "mailbox": None, "folder": "a b", "date": None, "messages": 2}) + f'\n{{"store_id": "{ids[0]}"}}\n{{"store')
    stored = archive.stored(spark, str(tmp_path / "mail"))
    assert {r.store_id for r in stored.collect()} == set(ids)
    log_file, observation = archive.logs(spark, str(tmp_path / "meta"))
    files = {r.hash: r for r in log_file.collect()}
    assert files[first].intact and files[second].prev == first and not files["broken"].readable and not files["torn"].intact
    assert observation.where("folder = 'a b'").count() == 1
    verdict = check.verdict(stored, observation, log_file, frame(spark, [("job", "INBOX", second)], "mailbox string, folder string, log string")).first()
    assert (verdict.entries, verdict.missing, verdict.orphans, verdict.damaged, verdict.broken_chains, verdict.unchained) == (4, 1, 1, 0, 0, 2)
    heads = frame(spark, [("job", "INBOX", None, None, second)], "mailbox string, folder string, last_run string, resume string, log string")
    view = projection.Projection(spark, str(tmp_path / "view"))
    assert not view.exists()
    view.create(stored, log_file.where(F.col("hash") == first), observation, heads)
    assert view.frames()["message"].count() == 2
    assert view.refresh(stored, log_file, observation, heads) == 2
    assert view.refresh(stored, log_file, observation, heads) == 0
    frames = view.frames()
    assert frames["message"].count() == 3 and frames["location"].count() == 4
    assert [r.sender for r in search.search(frames, sender="A2@").collect()] == ["a2@example.com"]
    assert projection.behind(heads, frames["recorded"]).count() == 0
    with pytest.raises(FileExistsError):
        view.create(stored, log_file, observation, heads)
    out = store.converted(stored, compress=True).collect()
    assert sorted(r.outcome for r in out) == ["converted", "converted", "converted", "skipped"]
    done = store.exported(stored, stored.select("store_id"), str(tmp_path / "out")).collect()
    assert all(hashlib.sha384(open(r.path, "rb").read()).hexdigest() == r.store_id for r in done) and len(done) == 4
    assert view.drop() and not view.exists()


def test_written_logs_read_back_and_compact_idempotently(spark, tmp_path):
    new = frame(spark, [("job", "INBOX", A), ("job", "INBOX", A), ("job", "INBOX", B), (None, "x", C)], "mailbox string, folder string, store_id string")
    heads = frame(spark, [("job", "INBOX", "2026", None, "old")], "mailbox string, folder string, last_run string, resume string, log string")
    (tmp_path / "meta").mkdir()
    files = places.log_files(places.appended(new, heads, "2026-01-01"), str(tmp_path / "meta")).collect()
    assert {(f.mailbox, f.folder, f.messages) for f in files} == {("job", "INBOX", 2), (None, "x", 1)}
    body = {f.folder: open(f.path, "rb").read() for f in files}
    assert body["INBOX"] == places.serialised("job", "INBOX", "2026-01-01", [A, B], "old") and body["x"] == places.serialised(None, "x", "2026-01-01", [C], None)
    assert all(f.hash == hashlib.sha384(body[f.folder]).hexdigest() for f in files)
    moved = places.moved_heads(heads, spark.createDataFrame([(f.hash, f.mailbox, f.folder) for f in files], schema.of("hash string, mailbox string, folder string"))).collect()
    assert len(moved) == 2 and all(r.log != "old" for r in moved)
    again = places.log_files(places.appended(new, heads, "2026-01-01"), str(tmp_path / "meta")).collect()
    assert {f.hash for f in files} == {f.hash for f in again} and len(list((tmp_path / "meta").rglob("*"))) == 2 * len(files)
    log_file, observation = archive.logs(spark, str(tmp_path / "meta"))
    assert log_file.where("intact").count() == 2 and check.short_logs(log_file, observation).count() == 0
    compacted = places.log_files(places.compacted(observation)).collect()
    assert {(f.folder, f.messages, f.path) for f in compacted} == {("INBOX", 2, None), ("x", 1, None)}


def test_a_place_of_very_many_ids(spark):
    entries = spark.range(300_000, numPartitions=3).select(F.lit("job").alias("mailbox"), F.lit(None).cast("string").alias("folder"), F.lpad(F.col("id").cast("string"), 96, "0").alias("store_id"), F.lit("d").alias("log_date"))
    got = places.log_files(places.compacted(entries)).collect()
    body = places.serialised("job", None, "d", [f"{k:096}" for k in range(300_000)], None)
    assert [(f.messages, f.hash) for f in got] == [(300_000, hashlib.sha384(body).hexdigest())]


def test_head_names_tell_places_apart():
    names = [places.head_name(*p) for p in [("a", "INBOX/Sent"), ("a", "INBOX.Sent"), ("a", None), (None, "a"), ("", "a"), ("a", "")]]
    assert len(set(names)) == 6 and all(text_ok(n) for n in names)


def text_ok(name):
    return len(name.rsplit(".", 1)[1]) == 8


def test_classification(spark):
    from datetime import datetime, timedelta

    now = datetime(2026, 1, 10)
    rows = [(f"{A}.eml", now), (f"{A}.eml.zst", now), (f"{A}.eml.x1.tmp", now - timedelta(hours=30)), (f"{A}.eml.x1.tmp", now), (f"{A}.eml.corrupt", now), (f"{A}.eml.corrupt.2", now), ("state.json.x.tmp", now), ("note.txt", now)]
    got = [r.kind for r in archive.classified(spark.createDataFrame(rows, schema.of("name string, modified timestamp")), F.lit(now)).collect()]
    assert got == ["entry", "entry", "stale", "live", "quarantined", "quarantined", "foreign", "foreign"]


def test_legacy_state(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"box": {"INBOX": "2024-01-01T00:00:00+00:00", "Sent": {"last_run": "2024-02-01T00:00:00", "resume": {"kind": "imap-uid", "uid": 3}}, "Bad": "never", "NoKind": {"resume": {"uid": 1}}}}))
    got = {r.folder: (r.last_run, r.resume is not None) for r in archive.legacy_state(spark, str(path)).collect()}
    assert got == {"INBOX": ("2024-01-01T00:00:00+00:00", False), "Sent": ("2024-02-01T00:00:00", True)}


def test_folder_tree():
    tree = {None: [("1", "INBOX"), ("2", "Archiv")], "2": [("3", "2019")], "3": [("4", "Q1")]}
    assert mailbox.folder_paths(lambda n: tree.get(n, [])) == {"INBOX": "1", "Archiv": "2", "Archiv/2019": "3", "Archiv/2019/Q1": "4"}


def test_streaming_refresh(spark, tmp_path):
    from letterlake.streaming.refresh import refresh_stream

    body = message(1)
    sid = hashlib.sha384(body).hexdigest()
    write_log(tmp_path / "meta", "job", "INBOX", [sid])
    stored = frame(spark, [(sid, body)], "store_id string, content binary")
    heads = frame(spark, [], "mailbox string, folder string, log string")
    view = projection.Projection(spark, str(tmp_path / "view"))
    for _ in range(2):
        refresh_stream(spark, str(tmp_path / "meta"), view, stored, heads, str(tmp_path / "cp")).awaitTermination()
        assert view.frames()["message"].count() == 1

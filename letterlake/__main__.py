"""python -m letterlake ARCHIVE COMMAND ...: exit code 0 if all is well, 1 if something was found, 2 for wrong use,
130 after an interrupt, 141 where nobody reads the output any more."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from letterlake.jobs import Archive


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="letterlake")
    p.add_argument("archive")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "stats", "check", "places", "compact", "quarantine", "prune", "compress", "decompress", "create", "update", "drop"):
        sub.add_parser(name)
    for name in ("import", "adopt", "migrate"):
        s = sub.add_parser(name)
        s.add_argument("what", help="directory, place name or old database")
        s.add_argument("--place", default="import")
        s.add_argument("--largest-only", action="store_true")
        s.add_argument("--dry-run", action="store_true")
    for name in ("folders", "backup", "verify"):
        s = sub.add_parser(name)
        s.add_argument("mailbox")
        s.add_argument("--client", required=True, help="module:function that gives a server's client")
        s.add_argument("--option", action="append", default=[], metavar="NAME=VALUE")
        s.add_argument("--repair", action="store_true")
    s = sub.add_parser("export")
    s.add_argument("ids", nargs="+")
    s.add_argument("--to", required=True)
    s = sub.add_parser("search")
    for name in ("sender", "recipient", "subject", "mailbox", "folder", "since", "until"):
        s.add_argument(f"--{name}")
    s.add_argument("--limit", type=int)
    s.add_argument("--format", choices=["table", "ids", "csv", "json"], default="table")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    a = Archive(SparkSession.builder.getOrCreate(), args.archive)
    if args.command == "init":
        a.init()
        return 0
    a.require()
    if args.command == "check":
        found = a.check()
        print(json.dumps(found))
        return 0 if found["sound"] else 1
    if args.command in ("folders", "backup", "verify"):
        return _with_server(a, args)
    if args.command == "export":
        wanted = a.spark.createDataFrame([(i.lower(),) for i in args.ids], "store_id string")
        written = a.export(wanted, args.to).count()
        print(json.dumps({"exported": written}))
        return 0 if written == len({i.lower() for i in args.ids}) else 1
    if args.command in ("compress", "decompress"):
        counts = a.convert(args.command == "compress")
        print(json.dumps(counts))
        return 1 if counts["failed"] else 0
    if args.command == "places":
        _table(a.places())
    elif args.command == "search":
        hits = a.search(**{k: getattr(args, k) for k in ("sender", "recipient", "subject", "mailbox", "folder", "since", "until", "limit")})
        from letterlake.operators import search

        if args.format == "table":
            _table(search.preview(hits))
        else:
            shaped = {"ids": hits.select("store_id"), "csv": search.as_csv(hits), "json": hits}[args.format]
            if args.format == "csv":
                print(",".join(f'"{c}"' for c in shaped.columns))
            for row in shaped.toLocalIterator():
                print(row[0] if args.format == "ids" else json.dumps(row.asDict(), ensure_ascii=False) if args.format == "json" else ",".join('"' + str(v).replace('"', '""') + '"' for v in row))
    else:
        run = {
            "stats": a.statistics, "compact": a.compact, "quarantine": a.quarantine, "prune": a.prune, "create": lambda: a.create_db(True), "update": a.refresh_db, "drop": a.drop_db,
            "import": lambda: a.import_directory(args.what, args.place, args.largest_only, args.dry_run), "adopt": lambda: a.adopt(args.what, args.dry_run), "migrate": lambda: a.migrate(args.what),
        }[args.command]
        print(json.dumps(run()))
    return 0


def _table(rows: DataFrame) -> None:
    """All rows, tab-separated under their names, as they come."""
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else " ".join(map(str, v)) if isinstance(v, list) else str(v) for v in row))


def _with_server(a: Archive, args: argparse.Namespace) -> int:
    options = {"client": args.client, **dict(o.split("=", 1) for o in args.option)}
    if args.command == "folders":
        from letterlake.sources.mailbox import client

        print("\n".join(sorted(client(options).folders())))
        return 0
    if args.command == "backup":
        counts = a.backup(args.mailbox, options)
        print(json.dumps(counts))
        return 1 if counts["failed"] else 0
    # one row per folder
    found = [r.asDict() for r in a.verify(args.mailbox, options, args.repair).toLocalIterator()]
    print("\n".join(json.dumps(f, ensure_ascii=False) for f in found))
    return 1 if any(f.get("failed") or f.get("missing") or f.get("extra_copies") for f in found) else 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except KeyboardInterrupt:
        sys.exit(130)
    except BrokenPipeError:
        # nothing more can be written, not even at exit
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        sys.exit(141)

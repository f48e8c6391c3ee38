"""Command line over a folder of tables; prints one JSON object.

    python -m shelfmark.cli list
    python -m shelfmark.cli run NAME TABLES [--out FOLDER] [--limit N]
    python -m shelfmark.cli search TABLES QUERY [--kind KIND] [--limit N]
    python -m shelfmark.cli read TABLES VERSION [--page N | --brief CARD | --source | --asset ADDRESS] [--historical]
    python -m shelfmark.cli spans TABLES VERSION
    python -m shelfmark.cli history TABLES DOCUMENT
    python -m shelfmark.cli audit TABLES [--limit N]
    python -m shelfmark.cli status | map | health TABLES
    python -m shelfmark.cli export TABLES FOLDER
    python -m shelfmark.cli verify-bundle FOLDER
    python -m shelfmark.cli audit-inventory SNAPSHOT

Exit code 0, or 2 with {"ok": false, "error": {...}}. run prints up to --limit rows (default 1000) and says whether there are more; --out
writes all of them.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

#: Commands that are one named query: its name.
_NAMED = {"status": "status_counts", "map": "kind_map", "health": "source_health"}


def _session() -> SparkSession:
    return SparkSession.builder.appName("shelfmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="shelfmark")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **options) -> None:
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x)
        for o, kind in options.items():
            p.add_argument(f"--{o}", action="store_true") if kind is bool else p.add_argument(f"--{o}", type=kind)

    command("list")
    command("run", "name", "tables", out=str, limit=int)
    command("search", "tables", "query", kind=str, limit=int)
    command("read", "tables", "version", page=int, brief=str, source=bool, asset=str, historical=bool)
    command("spans", "tables", "version")
    command("history", "tables", "document")
    command("audit", "tables", limit=int)
    for name in _NAMED:
        command(name, "tables")
    command("export", "tables", "folder")
    command("verify-bundle", "folder")
    command("audit-inventory", "snapshot")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        result = _run(args)
    except Exception as e:
        code = str(e) if str(e).isupper() else "IO_OR_SCHEMA_ERROR"
        print(json.dumps({"ok": False, "error": {"code": code, "message": type(e).__name__}}))
        return 2
    print(json.dumps({"ok": True, "result": result}, ensure_ascii=False, default=str))
    return 0


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _run(args: argparse.Namespace):
    from shelfmark.operators import inventory, reading, search, versions
    from shelfmark.plans.registry import all_queries
    from shelfmark.session import table
    from shelfmark.sources import bundle, files

    queries = all_queries()
    if args.command == "list":
        return sorted(queries)
    spark = _session()
    if args.command == "verify-bundle":
        return _rows(bundle.verify_bundle(spark, args.folder))
    if args.command == "audit-inventory":
        return _rows(inventory.snapshot_problems(files.inventory_snapshot(spark, args.snapshot)))
    t = lambda *names: [table(spark, args.tables, n) for n in names]
    if args.command in _NAMED:
        return _rows(queries[_NAMED[args.command]](spark, args.tables))
    if args.command == "run":
        if args.name not in queries:
            raise ValueError("INVALID_COMMAND")
        df = queries[args.name](spark, args.tables)
        if args.out:
            df.write.parquet(args.out)
            return {"out": args.out}
        most = 1000 if args.limit is None else args.limit
        rows = _rows(df.limit(most + 1))
        return {"rows": rows[:most], "truncated": len(rows) > most}
    if args.command == "search":
        found = search.results(*t("versions", "documents", "pages"), query=args.query, kind=args.kind, allow_stale=True)
        return _rows(search.first_results(found, 20 if args.limit is None else args.limit))
    if args.command == "read":
        return _rows(reading.read(*t("versions", "documents", "pages", "extractions"), args.version, args.page, args.brief, args.source, args.asset, args.historical))
    if args.command == "spans":
        own = t("pages")[0]
        return _rows(reading.spans(own.filter(own.version_id == args.version)).orderBy("number"))
    if args.command == "history":
        return _rows(versions.history(t("versions")[0], args.document))
    if args.command == "audit":
        return _rows(versions.audit_tail(t("events")[0], 100 if args.limit is None else args.limit))
    bundle.write_bundle(bundle.bundle_files(*t("versions", "documents", "pages")), args.folder)
    return {"folder": args.folder}


if __name__ == "__main__":
    sys.exit(main())

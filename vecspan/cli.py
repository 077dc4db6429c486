"""Command line: create, insert, search, info, flush, compact, backup, serve."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from .api import Database
from .errors import VecspanError
from .sources.files import json_lines
from .types import METRICS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecspan", description="Vector collections on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args, **kw: _arguments(sub.add_parser(name, **kw), args)
    c = add("create", "db", "collection", help="create a collection")
    c.add_argument("--dim", type=int, required=True)
    c.add_argument("--metric", choices=METRICS, default="cosine")
    add("insert", "db", "collection", help="insert JSON lines from standard input")
    s = add("search", "db", "collection", help="find the nearest records")
    s.add_argument("--vector", required=True, help="a JSON array")
    s.add_argument("--k", type=int, default=10)
    s.add_argument("--ef", type=int)
    s.add_argument("--filter", help="a JSON filter")
    s.add_argument("--pretty", action="store_true")
    for name in ("info", "flush", "compact"):
        add(name, "db")
    add("backup", "db", "dest")
    v = add("serve", "db", help="serve over HTTP")
    v.add_argument("--port", type=int, default=8080)
    v.add_argument("--api-key")
    v.add_argument("--follow", action="store_true", help="read-only, following the primary at the same path")
    return p


def _arguments(p: argparse.ArgumentParser, names: tuple[str, ...]) -> argparse.ArgumentParser:
    for n in names:
        p.add_argument(n)
    return p


def details(db: Database, name: str) -> dict:
    c = db.collection(name)
    segs = [{"seg_id": s["seg_id"], "rows": s["record_count"], "tombstones": s["tombstone_count"], "hnsw": s["has_hnsw"]} for s in c.segment_stats()]
    return {"name": name, "dim": c.dim, "metric": c.metric, "len": len(c), "segments": segs}


def run(args: argparse.Namespace, spark: SparkSession, lines: Iterable[str] = (), out: Callable[[str], None] = print) -> None:
    if args.command == "serve":
        from .server import serve

        serve(Database(spark, args.db, replica=args.follow), args.port, args.api_key)
        return
    with Database(spark, args.db) as db:
        pretty = None
        if args.command == "create":
            db.create_collection(args.collection, args.dim, args.metric)
            said = {"created": args.collection, "dim": args.dim}
        elif args.command == "insert":
            c, n = db.collection(args.collection), 0
            for batch in json_lines(lines):
                c.upsert_records(batch)
                n += len(batch)
            said = {"inserted": n}
        elif args.command == "search":
            s = db.collection(args.collection).search(json.loads(args.vector)).k(args.k)
            if args.ef:
                s = s.ef(args.ef)
            if args.filter:
                s = s.filter(json.loads(args.filter))
            said, pretty = {"hits": [h.as_json() for h in s.run()]}, 2 if args.pretty else None
        elif args.command == "info":
            said = {"collections": [details(db, n) for n in db.collection_names()]}
        elif args.command == "flush":
            db.flush()
            said = {"flushed": True}
        elif args.command == "compact":
            db.flush()
            db.compact()
            said = {"compacted": True}
        else:
            db.backup(args.dest)
            said = {"backup": args.dest}
        out(json.dumps(said, indent=pretty))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("vecspan").config("spark.ui.enabled", "false").getOrCreate()
    try:
        run(args, spark, sys.stdin if args.command == "insert" else ())
    except (VecspanError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

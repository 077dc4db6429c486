"""The database over HTTP, with the standard library's server."""

from __future__ import annotations

import hmac
import json
import re
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from .api import Database
from .cli import details
from .errors import CollectionExists, CollectionNotFound, DimensionMismatch, InvalidConfig, InvalidVector, ReadOnlyReplica
from .sources.files import record_of
from .types import path_id

_SEGMENT_FILE = re.compile(r"[\w.=-]+(/[\w.=-]+)?")


class NotFound(Exception):
    pass


def status_of(e: Exception) -> int:
    if isinstance(e, CollectionNotFound | NotFound):
        return 404
    if isinstance(e, CollectionExists | ReadOnlyReplica):
        return 409
    if isinstance(e, DimensionMismatch | InvalidConfig | InvalidVector | ValueError | KeyError | TypeError):
        return 400
    return 500


class Api:
    """Routes to answers, without the network: ``handle`` takes a method, a path, headers and a body."""

    def __init__(self, db: Database, api_key: str | None = None):
        self.db, self.api_key = db, api_key
        # one request at a time changes the database or plans a search; searches run, and files are read, side by side
        self.lock = threading.RLock()
        name = r"/collections/([^/]+)"
        self.routes: list[tuple[str, re.Pattern, Callable[..., Any]]] = [
            (m, re.compile(p + r"\Z"), f)
            for m, p, f in (
                ("GET", r"/collections", self.names), ("PUT", name, self.create), ("DELETE", name, self.drop), ("GET", name, self.info),
                ("POST", name + r"/records", self.upsert), ("GET", name + r"/records/([^/]+)", self.get), ("DELETE", name + r"/records/([^/]+)", self.delete),
                ("POST", name + r"/search", self.search), ("POST", r"/admin/flush", self.flush), ("POST", r"/admin/compact", self.compact),
                ("GET", r"/replication/state", self.state), ("GET", r"/replication/manifest/(\d+)", self.manifest),
                ("GET", r"/replication/files/(\d+)/(\d+)", self.files),
                ("GET", r"/replication/segment/(\d+)/(\d+)/(.+)", self.segment), ("GET", r"/replication/wal/(\d+)", self.log),
            )
        ]

        self.unlocked = (self.search, self.manifest, self.files, self.segment, self.log)

    def allowed(self, headers: dict[str, str]) -> bool:
        if self.api_key is None:
            return True
        given = headers.get("x-api-key") or headers.get("authorization", "").removeprefix("Bearer ")
        return hmac.compare_digest(given.encode(), self.api_key.encode())

    def handle(self, method: str, target: str, headers: dict[str, str], body: bytes = b"") -> tuple[int, Any]:
        url = urlsplit(target)
        if method == "GET" and url.path == "/health":
            return 200, {"status": "ok", "role": "replica" if self.db.is_replica else "primary", "manifest_gen": self.db.generation}
        if not self.allowed({k.lower(): v for k, v in headers.items()}):
            return 401, {"error": "a valid key is needed"}
        known = False
        for m, pattern, f in self.routes:
            if found := pattern.match(url.path):
                known = True
                if m == method:
                    try:
                        args = [unquote(g) for g in found.groups()]
                        extra = {"body": json.loads(body or b"null")} if method in ("PUT", "POST") else {"query": parse_qs(url.query)}
                        if f in self.unlocked:
                            return 200, f(*args, **extra)
                        with self.lock:
                            return 200, f(*args, **extra)
                    except Exception as e:  # noqa: BLE001
                        return status_of(e), {"error": str(e)}
        return (405, {"error": "no such method here"}) if known else (404, {"error": "no such path"})

    def names(self, query: dict) -> dict:
        return {"collections": self.db.collection_names()}

    def create(self, name: str, body: dict) -> dict:
        self.db.create_collection(name, int(body["dim"]), body.get("metric", "cosine"))
        return {"created": name}

    def drop(self, name: str, query: dict) -> dict:
        self.db.drop_collection(name)
        return {"dropped": name}

    def info(self, name: str, query: dict) -> dict:
        return details(self.db, name)

    def upsert(self, name: str, body: Any) -> dict:
        records = [record_of(r) for r in (body if isinstance(body, list) else [body])]
        self.db.collection(name).upsert_records(records)
        return {"upserted": len(records)}

    def get(self, name: str, key: str, query: dict) -> dict:
        r = self.db.collection(name).get(path_id(key))
        if r is None:
            raise NotFound(f"no record {key}")
        return {"id": key, "vector": r.vector, "meta": r.meta}

    def delete(self, name: str, key: str, query: dict) -> dict:
        return {"deleted": self.db.collection(name).delete(path_id(key))}

    def search(self, name: str, body: dict) -> dict:
        with self.lock:
            s = self.db.collection(name).search(body["vector"]).k(int(body.get("k", 10)))
            if body.get("ef") is not None:
                s = s.ef(int(body["ef"]))
            if body.get("filter") is not None:
                s = s.filter(body["filter"])
            planned = s.planned()
        return {"hits": [h.as_json() for h in s.hits(planned)]}

    def flush(self, body: Any) -> dict:
        self.db.flush()
        return {"flushed": True}

    def compact(self, body: Any) -> dict:
        self.db.flush()
        self.db.compact()
        return {"compacted": True}

    # for followers that don't share a file system

    def _base(self):
        if self.db.store.base is None:
            raise InvalidConfig("a database in memory can't be followed")
        return self.db.store.base

    def state(self, query: dict) -> dict:
        self._base()
        s = self.db.store
        return {"manifest_gen": s.manifest.generation, "flushed_seq": s.manifest.flushed_seq, "logs": [{"seq": int(p.stem), "bytes": p.stat().st_size} for p in s.logs]}

    def _file(self, *parts: str) -> bytes:
        p = self._base().joinpath(*parts)
        if not p.is_file():
            raise NotFound("no such file")
        return p.read_bytes()

    def manifest(self, generation: str, query: dict) -> bytes:
        return self._file(self.db.store._manifest_name(int(generation)))

    def files(self, cid: str, seg: str, query: dict) -> dict:
        folder = self._base() / "segments" / cid / seg
        if not folder.is_dir():
            raise NotFound("no such segment")
        return {"files": [{"name": str(p.relative_to(folder)), "bytes": p.stat().st_size} for p in sorted(folder.rglob("*")) if p.is_file() and not p.name.startswith(".")]}

    def segment(self, cid: str, seg: str, name: str, query: dict) -> bytes:
        if not _SEGMENT_FILE.fullmatch(name) or ".." in name:
            raise NotFound("no such file")
        return self._file("segments", cid, seg, name)

    def log(self, seq: str, query: dict) -> bytes:
        offset = int(query.get("offset", ["0"])[0])
        p = self._base() / "oplog" / f"{int(seq):020d}.parquet"
        if not p.is_file():
            raise NotFound("no such file")
        with open(p, "rb") as f:
            f.seek(offset)
            return f.read()


def server(db: Database, port: int = 8080, api_key: str | None = None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    api = Api(db, api_key)

    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, said = api.handle(self.command, self.path, dict(self.headers.items()), body)
            data = said if isinstance(said, bytes) else json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/octet-stream" if isinstance(said, bytes) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_PUT = do_POST = do_DELETE = _run

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(db: Database, port: int, api_key: str | None = None) -> None:
    """Serves until interrupted; the primary flushes on the way out. A follower polls once a second beside."""
    import signal

    s = server(db, port, api_key)
    signal.signal(signal.SIGTERM, lambda *_: threading.Thread(target=s.shutdown).start())
    stop = threading.Event()
    if db.is_replica:
        from .streaming.follower import Follower

        threading.Thread(target=Follower(db).run, kwargs={"until": stop.is_set}, daemon=True).start()
    try:
        s.serve_forever()
    finally:
        stop.set()
        if not db.is_replica:
            db.flush()
        db.close()

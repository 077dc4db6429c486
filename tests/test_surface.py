"""Sources, streaming, command line and HTTP."""

import json
import struct
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from vecspan import cli, errors
from vecspan.api import Database
from vecspan.server import Api, server
from vecspan.sources import files
from vecspan.streaming.follower import Follower, LatestState, follow


def test_vecs(spark, tmp_path):
    files.register(spark)
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    p = tmp_path / "a.fvecs"
    p.write_bytes(b"".join(struct.pack("<i3f", 3, *row) for row in x.tolist()))
    rows = spark.read.format("fvecs").option("rowsPerPartition", 3).load(str(p)).orderBy("id").collect()
    assert [r.vector for r in rows] == x.tolist() and [r.id for r in rows] == [0, 1, 2, 3]
    assert spark.read.format("fvecs").option("limit", 2).load(str(p)).count() == 2
    q = tmp_path / "a.ivecs"
    q.write_bytes(struct.pack("<i2i", 2, 7, 8))
    assert spark.read.format("ivecs").load(str(q)).first().vector == [7, 8]
    with pytest.raises(errors.Corrupted):
        files.VecsReader({"path": str(_write(tmp_path / "bad", b"\3\0\0\0abc"))}, "fvecs").partitions()


def _write(p, data):
    p.write_bytes(data)
    return p


def test_json_lines(spark, tmp_path):
    lines = ['{"id": 1, "vector": [1, 0.5], "meta": {"lang": "ja", "n": 3, "x": 2.5, "ok": true, "t": "7"}}', "", '{"id": "a", "vector": [0, 1]}']
    (batch,) = files.json_lines(lines)
    assert batch[0].meta == {"lang": "ja", "n": 3, "x": 2.5, "ok": True, "t": "7"} and batch[1].id == "a"
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(lines))
    rows = {r.key: r for r in files.read_json_lines(spark, str(p)).collect()}
    assert rows["1"].numeric and not rows["a"].numeric and rows["1"].vector == [1.0, 0.5]
    kinds = {k: v.asDict() for k, v in rows["1"].meta.items()}
    assert kinds["lang"]["s"] == "ja" and kinds["n"]["i"] == 3 and kinds["x"]["f"] == 2.5 and kinds["ok"]["b"] is True and kinds["t"]["s"] == "7" and kinds["t"]["i"] is None
    odd = [r'{"id": 1, "vector": [1], "meta": {"id": "x", "a(b": "\"q\"", "big": 18446744073709551616, "e": 1e3, "n": -0.5, "k": "id\": 5", "none": null}}', r'{"meta": {"id": 7}, "vector": [2.5], "id": "1"}']
    p.write_text("\n".join(odd))
    rows = files.read_json_lines(spark, str(p)).collect()
    assert [(r.key, r.numeric, r.vector) for r in rows] == [("1", True, [1.0]), ("1", False, [2.5])]
    got = {k: next((x for x in (v.s, v.i, v.f, v.b) if x is not None), None) for k, v in rows[0].meta.items()}
    assert got == {"id": "x", "a(b": '"q"', "big": 18446744073709551616.0, "e": 1000.0, "n": -0.5, "k": 'id": 5', "none": None} and rows[1].meta["id"].i == 7
    p.write_text('{"vector": [1]}')
    with pytest.raises(Exception, match="without an id"):
        files.read_json_lines(spark, str(p)).collect()
    for bad in ("{", "[]", '{"id": 1}', '{"id": -1, "vector": []}', '{"id": 1, "vector": ["a"]}', '{"id": 1, "vector": [1], "meta": {"a": []}}'):
        with pytest.raises(errors.InvalidConfig):
            list(files.json_lines([bad]))


def test_streaming(spark, tmp_path):
    base = tmp_path / "db"
    state = LatestState(spark, str(tmp_path / "state"))
    with Database(spark, base) as db:
        c = db.create_collection("c", 1, "l2")
        c.upsert(1, [1.0])
        c.upsert(2, [2.0])
        follow(spark, str(base), state, str(tmp_path / "ck")).awaitTermination()
        assert sorted(r.id for r in state.live(1).collect()) == [1, 2]
        follower = Follower.open(spark, str(base))
        assert len(follower.database.collection("c")) == 2 and follower.database.is_replica
        with pytest.raises(errors.ReadOnlyReplica):
            follower.database.collection("c").upsert(3, [3.0])
        c.delete(1)
        c.upsert(2, [5.0])
        follow(spark, str(base), state, str(tmp_path / "ck")).awaitTermination()
        assert [(r.id, r.vector) for r in state.live(1).collect()] == [(2, [5.0])]
        assert follower.sync_once() and len(follower.database.collection("c")) == 1 and not follower.sync_once()
        db.flush()
        db.vacuum()
        assert follower.sync_once() and follower.database.collection("c").get(2).vector == [5.0]
        said, rounds = [], iter([False, False, True])
        follower.database.store.base = tmp_path / "nowhere"
        (tmp_path / "nowhere").mkdir()
        (tmp_path / "nowhere" / "CURRENT").write_text("MANIFEST-x.json")
        follower.run(0.01, lambda: next(rounds), said.append)
        assert len(said) == 1


def test_streaming_takes_up_frames_and_flushed_files(spark, tmp_path):
    """Rows that never were in the log, and log files that are gone before they are read."""
    base = tmp_path / "db"
    state = LatestState(spark, str(tmp_path / "state"), most=2)
    with Database(spark, base) as db:
        c = db.create_collection("c", 1, "l2")
        c.upsert(1, [1.0])
        c.upsert_frame(files.from_arrays(spark, [5, 6], [[5.0], [6.0]]))
        c.upsert(9, [9.0])
        db.flush()
        db.vacuum()
        for k in range(3):
            c.upsert(20 + k, [k])
            follow(spark, str(base), state, str(tmp_path / "ck")).awaitTermination()
        c.delete_frame(spark.createDataFrame([(5,), (7,)], "id long"))
        c.upsert(6, [60.0])
        follow(spark, str(base), state, str(tmp_path / "ck")).awaitTermination()
        want = {r.id: r.vector for r in c.frame().collect()}
        assert sorted(want) == [1, 6, 9, 20, 21, 22] and {r.id: r.vector for r in state.live(1).collect()} == want
        assert len(state._folders()) < 6


def test_remote_follower(spark, tmp_path):
    """Tail, flush, deletes, a log file that came in part, restart, an unreachable primary, and promotion."""
    from vecspan.streaming.remote import RemoteFollower

    with Database(spark, tmp_path / "db") as db:
        s = server(db, 0, "secret")
        threading.Thread(target=s.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{s.server_port}"
        c = db.create_collection("docs", 2, "l2")
        c.upsert_batch([1, 2, "a"], [[1, 0], [2, 0], [3, 0]], [{"lang": "ja"}, {}, {}])
        f = RemoteFollower(spark, url, tmp_path / "copy", "secret")
        read = lambda f: {r.id: r.vector[0] for r in f.database.collection("docs").frame().collect()}
        assert f.sync_once() and sorted(read(f).values()) == [1, 2, 3] and not f.sync_once()
        assert f.database.collection("docs").search([1, 0]).k(1).run()[0].meta == {"lang": "ja"}
        with pytest.raises(errors.ReadOnlyReplica):
            f.database.collection("docs").upsert(3, [3.0, 0])
        db.flush()
        c.delete(2)
        c.upsert(1, [9, 0])
        last = sorted((tmp_path / "db" / "oplog").glob("*.parquet"))[-1]
        (tmp_path / "copy" / "oplog" / f"{last.stem}.part").write_bytes(last.read_bytes()[:50])
        assert f.sync_once() and sorted(read(f).values()) == [3, 9] and not list((tmp_path / "copy" / "oplog").glob("*.part"))
        f.database.close()
        c.upsert_frame(files.from_arrays(spark, [7], [[7.0, 0.0]]))
        f = RemoteFollower(spark, url, tmp_path / "copy", "secret")
        assert f.sync_once() and sorted(read(f).values()) == [3, 7, 9] and read(f) == {r.id: r.vector[0] for r in c.frame().collect()}
        with pytest.raises(errors.Unreachable):
            RemoteFollower(spark, url, tmp_path / "other", "wrong").sync_once()
        s.shutdown()
        s.server_close()
        with pytest.raises(errors.Unreachable):
            f.sync_once()
        assert sorted(read(f).values()) == [3, 7, 9]
        f.database.close()
    with Database(spark, tmp_path / "copy") as db:
        db.collection("docs").upsert("a", [4, 0])
        assert sorted(r.vector[0] for r in db.collection("docs").frame().collect()) == [4, 7, 9]


def test_command_line(spark, tmp_path):
    out = []

    def call(*args, lines=()):
        cli.run(cli.parser().parse_args(list(args)), spark, lines, out.append)
        return json.loads(out[-1])

    db = str(tmp_path / "db")
    assert call("create", db, "docs", "--dim", "2", "--metric", "l2") == {"created": "docs", "dim": 2}
    rows = [json.dumps({"id": i, "vector": [i, 0], "meta": {"even": i % 2 == 0}}) for i in range(5)]
    assert call("insert", db, "docs", lines=rows) == {"inserted": 5}
    hits = call("search", db, "docs", "--vector", "[0, 0]", "--k", "2", "--filter", '{"eq": ["even", true]}')["hits"]
    assert [(h["id"], h["score"], h["meta"]) for h in hits] == [(0, 0.0, {"even": True}), (2, 2.0, {"even": True})]
    assert call("flush", db) == {"flushed": True}
    assert call("info", db)["collections"][0]["len"] == 5
    assert call("compact", db) == {"compacted": True} and call("backup", db, str(tmp_path / "b"))["backup"]


def test_http(spark, tmp_path):
    with Database(spark, tmp_path / "db") as db:
        s = server(db, 0, "secret")
        threading.Thread(target=s.serve_forever, daemon=True).start()

        def call(method, path, body=None, key="secret"):
            r = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", method=method, data=None if body is None else json.dumps(body).encode(), headers={"X-Api-Key": key} if key else {})
            try:
                with urllib.request.urlopen(r) as a:
                    return a.status, json.loads(a.read())
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read())

        assert call("GET", "/health", key=None) == (200, {"status": "ok", "role": "primary", "manifest_gen": 0})
        assert call("GET", "/collections", key="no")[0] == 401
        assert call("PUT", "/collections/d", {"dim": 3, "metric": "l2"}) == (200, {"created": "d"})
        assert call("PUT", "/collections/d", {"dim": 3})[0] == 409 and call("PUT", "/collections/e", {"dim": 3, "metric": "x"})[0] == 400
        assert call("POST", "/collections/d/records", [{"id": 1, "vector": [1, 0, 0], "meta": {"lang": "ja"}}, {"id": "doc-x", "vector": [0, 1, 0]}]) == (200, {"upserted": 2})
        assert call("GET", "/collections/d/records/doc-x")[1]["vector"] == [0, 1, 0]
        assert call("POST", "/collections/d/search", {"vector": [1, 0, 0], "k": 1})[1]["hits"][0]["id"] == 1
        assert call("POST", "/collections/d/search", {"vector": [1, 0], "k": 1})[0] == 400 and call("POST", "/collections/x/search", {"vector": [1]})[0] == 404
        assert call("POST", "/collections/d/search", {"vector": [1, 0, 0], "filter": {"no": 1}})[0] == 400
        assert call("DELETE", "/collections/d/records/1") == (200, {"deleted": True}) and call("GET", "/collections/d/records/1")[0] == 404
        assert call("POST", "/admin/flush", {}) == (200, {"flushed": True}) and call("POST", "/admin/compact", {})[1] == {"compacted": True}
        assert call("GET", "/collections/d")[1]["len"] == 1
        assert call("GET", "/nowhere")[0] == 404 and call("DELETE", "/collections")[0] == 405
        s.shutdown()
        api = Api(db)
        gen = api.handle("GET", "/replication/state", {})[1]["manifest_gen"]
        assert api.handle("GET", f"/replication/manifest/{gen}", {})[1] == (tmp_path / "db" / f"MANIFEST-{gen:020d}.json").read_bytes()
        assert api.handle("GET", "/replication/segment/1/1/../../../CURRENT", {})[0] == 404
        assert api.handle("DELETE", "/collections/d", {})[1] == {"dropped": "d"}

"""Databases: life cycle, newest-wins, compaction, recovery, and random operations against a dictionary."""

import json
import math
import random

import pytest

from vecspan import errors
from vecspan.api import Database
from vecspan.operators import filters as f
from vecspan.types import Options


def ids(c, q, k=10, flt=None):
    s = c.search(q).k(k)
    return [h.id for h in (s.filter(flt) if flt else s).run()]


def test_life_cycle(spark, tmp_path):
    with Database(spark, tmp_path / "db") as db:
        c = db.create_collection("docs", 3, "cosine")
        c.upsert_batch([1, 2, 3], [[1, 0, 0], [0, 1, 0], [0.9, 0.1, 0]], [{"lang": "ja"}, {"lang": "en"}, {"lang": "ja"}])
        assert ids(c, [2, 0, 0], 2) == [1, 3] and len(c) == 3 and not c.is_empty()
        assert ids(c, [0, 1, 0], 2, f.eq("lang", "ja")) == [3, 1]
        c.upsert("doc-a", [0, 0, 5], {"y": 2026, "ok": True, "x": 0.5})
        r = c.get("doc-a")
        assert r.vector == [0, 0, 1] and r.meta == {"_ext_id": "doc-a", "ok": True, "x": 0.5, "y": 2026}
        hit = c.search([0, 0, 1]).k(1).run()[0]
        assert hit.id == 1 << 63 and hit.ext_id == "doc-a"
        c.upsert("doc-a", [0, 1, 1])
        assert len(c) == 4 and c.get("doc-b") is None and c.delete("doc-b") is False
        with pytest.raises(errors.CollectionExists):
            db.create_collection("docs", 2)
        with pytest.raises(errors.Locked):
            Database(spark, tmp_path / "db")
        db.flush()
        assert c.segment_stats() == [{"seg_id": 1, "record_count": 4, "tombstone_count": 0, "has_hnsw": False}]
        assert c.delete("doc-a") is True and c.delete(2) is True and c.delete(99) is False
        assert len(c) == 2 and c.get(2) is None
        c.upsert("doc-a", [1, 1, 1])
    with Database(spark, tmp_path / "db") as db:
        c = db.collection("docs")
        assert len(c) == 3 and c.get("doc-a") is not None and db.collection_names() == ["docs"]
        db.flush()
        assert [s["tombstone_count"] for s in c.segment_stats()] == [0, 3]
        db.compact()
        assert [(s["record_count"], s["tombstone_count"]) for s in c.segment_stats()] == [(3, 0)]
        db.verify()
        db.backup(tmp_path / "copy")
        with pytest.raises(errors.InvalidConfig):
            db.backup(tmp_path / "copy")
        db.drop_collection("docs")
        with pytest.raises(KeyError):
            db.collection("docs")
        again = db.create_collection("docs", 3, "l2")
        db.flush()
        assert len(again) == 0
        db.vacuum()
    with Database(spark, tmp_path / "copy") as db:
        assert len(db.collection("docs")) == 3


def test_checks(spark, tmp_path):
    with Database(spark) as db:
        c = db.create_collection("c", 2, "cosine")
        for bad, kind in (([1], errors.DimensionMismatch), ([1, math.nan], errors.InvalidVector), ([math.inf, 0], errors.InvalidVector), ([0, 0], errors.InvalidVector)):
            with pytest.raises(kind):
                c.upsert_batch([1, 2], [[1, 0], bad])
            with pytest.raises(kind):
                c.search(bad).k(0).run()
        assert len(c) == 0
        c.upsert_batch([1, 1], [[1, 0], [0, 1]])
        assert c.get(1).vector == [0, 1] and c.search([1, 0]).k(0).run() == [] and ids(c, [1, 0], 5) == [1]
        db.flush()
        db.compact()
        with pytest.raises(errors.InvalidConfig):
            db.backup(tmp_path / "x")
        with pytest.raises(errors.InvalidConfig):
            c.upsert(-1, [1, 0])
        with pytest.raises(errors.InvalidConfig):
            db.create_collection("d", 0)
        with pytest.raises(errors.InvalidConfig):
            db.create_collection("d", 2, "l3")
    for bad in ({"flush_threshold_bytes": 0}, {"compaction_threshold": 1}, {"sync": ("every", 0)}):
        with pytest.raises(errors.InvalidConfig):
            Options(**bad)


def test_merge_of_sources(spark, tmp_path):
    with Database(spark, tmp_path / "db") as db:
        c = db.create_collection("c", 1, "l2")
        c.upsert_batch(list(range(5)), [[i] for i in range(5)])
        db.flush()
        c.upsert(2, [100])
        c.delete(3)
        db.flush()
        c.upsert(4, [200])
        c.upsert(9, [9])
        assert ids(c, [0], 3) == [0, 1, 9] and len(c) == 5
        assert ids(c, [2], 1) != [2]


def test_auto_flush_and_partial_compaction(spark, tmp_path):
    options = Options(flush_threshold_bytes=64, compaction_threshold=3)
    with Database(spark, tmp_path / "db", options) as db:
        c = db.create_collection("c", 4, "l2")
        big = db.create_collection("big", 1, "l2")
        big.upsert_batch(list(range(1000)), [[i] for i in range(1000)])
        for k in range(4):
            c.upsert_batch(list(range(5)), [[k] * 4] * 5)
        assert len(c.segment_stats()) < 4 and len(c) == 5 and c.get(0).vector == [3.0] * 4
        big.delete(7)
        for k in range(4):
            big.upsert_batch(range(2000 + 20 * k, 2020 + 20 * k), [[k]] * 20)
        stats = big.segment_stats()
        assert stats[0]["record_count"] == 1000 and len(stats) <= 4 and len(big) == 1079
        assert sum(s["tombstone_count"] for s in stats) >= 1 and big.get(7) is None


def test_recovery(spark, tmp_path):
    base = tmp_path / "db"
    with Database(spark, base) as db:
        c = db.create_collection("c", 1, "l2")
        for i in range(4):
            c.upsert(i, [i])
    last = sorted((base / "oplog").glob("*.parquet"))[-1]
    last.write_bytes(last.read_bytes()[:-7])  # torn
    (base / "segments" / "1" / "5.tmp").mkdir(parents=True)
    (base / "segments" / "1" / "9").mkdir()
    (base / "CURRENT.x.tmp").write_text("?")
    with Database(spark, base) as db:
        c = db.collection("c")
        assert len(c) == 3
        assert last.with_suffix(".damaged").exists() and not last.exists()
        assert not list(base.rglob("*.tmp")) and not (base / "segments" / "1" / "9").exists()
        c.upsert(7, [7])
        db.flush()
        assert len(c) == 4
    m = next(base.glob("MANIFEST-*.json"))
    text = json.loads(m.read_text())
    text["body"]["generation"] += 1
    m.write_text(json.dumps(text))
    with pytest.raises(errors.Corrupted):
        Database(spark, base)


def test_every_cut_of_the_log_keeps_what_came_before(spark, tmp_path):
    base = tmp_path / "db"
    with Database(spark, base) as db:
        c = db.create_collection("c", 1, "l2")
        for i in range(3):
            c.upsert(i, [i])
    last = sorted((base / "oplog").glob("*.parquet"))[-1]
    whole = last.read_bytes()
    for cut in (0, 1, len(whole) // 2, len(whole) - 1):
        last.write_bytes(whole[:cut])
        with Database(spark, base) as db:
            assert sorted(r["id"] for r in db.collection("c").frame().collect()) == [0, 1]


def test_opening_counts_rows_and_bytes(spark, tmp_path):
    """Operations that are replayed count towards the next flush; a segment that lost rows is found on opening."""
    base = tmp_path / "db"
    with Database(spark, base, Options(flush_threshold_bytes=100)) as db:
        c = db.create_collection("c", 4, "l2")
        for i in range(5):
            c.upsert(i, [i] * 4)
        assert not c.segment_stats()
    with Database(spark, base, Options(flush_threshold_bytes=100)) as db:
        c = db.collection("c")
        c.upsert(9, [9] * 4)
        c.upsert(10, [9] * 4)
        assert [s["record_count"] for s in c.segment_stats()] == [7] and len(c) == 7
    rows = base / "segments" / "1" / "1" / "rows"
    spark.read.parquet(str(rows)).where("id < 3").coalesce(1).write.parquet(str(tmp_path / "fewer"))
    for p in rows.glob("*.parquet"):
        p.unlink()
    next((tmp_path / "fewer").glob("*.parquet")).rename(rows / "part-0.parquet")
    with pytest.raises(errors.Corrupted, match="rows"):
        Database(spark, base)


def test_checksums_by_tasks(spark, tmp_path, monkeypatch):
    from vecspan.sources import store

    with Database(spark, tmp_path / "db") as db:
        c = db.create_collection("c", 1, "l2")
        c.upsert_batch(list(range(20)), [[i] for i in range(20)])
        db.flush()
        monkeypatch.setattr(store, "CHECKED_HERE", 0)
        db.verify()
        p = next((tmp_path / "db" / "segments").rglob("*.parquet"))
        p.write_bytes(p.read_bytes() + b"x")
        with pytest.raises(errors.Corrupted):
            db.verify()


def test_frames_with_names(spark, tmp_path):
    """Text ids in a frame meet those of single upserts; new ones are numbered after them."""
    meta = "map<string,struct<s:string,i:bigint,f:double,b:boolean>>"
    with Database(spark, tmp_path / "db") as db:
        c = db.create_collection("c", 1, "l2")
        c.upsert("b", [1.0])
        c.upsert("z", [2.0], {"k": 1})
        frame = spark.createDataFrame([("a", [5.0], None), ("b", [6.0], {"x": ("y", None, None, None)}), ("c", [7.0], {}), ("a", [4.0], None)], f"id string, vector array<double>, meta {meta}")
        c.upsert_frame(frame)
        c.upsert("d", [8.0])
        c.upsert("a", [9.0])
    with Database(spark, tmp_path / "db") as db:
        c = db.collection("c")
        assert len(c) == 5 and [c.get(x).vector[0] for x in "abczd"] == [9.0, 6.0, 7.0, 2.0, 8.0]
        assert c.get("b").meta == {"_ext_id": "b", "x": "y"} and len({r["id"] for r in c.frame().collect()}) == 5


def test_background_maintenance(spark, tmp_path, monkeypatch):
    """Writes go on during a flush and are behind it; nothing is lost whenever the database is closed; a write waits where
    the log has grown too long."""
    import threading
    import time

    from vecspan.sources import store

    with Database(spark, tmp_path / "db", Options(flush_threshold_bytes=64, compaction_threshold=3, background=True)) as db:
        c = db.create_collection("c", 2, "l2")
        begun, go = threading.Event(), threading.Event()
        write = db.store._write_segment

        def slow(*args):
            begun.set()
            go.wait(30)
            return write(*args)

        monkeypatch.setattr(db.store, "_write_segment", slow)
        for i in range(9):
            c.upsert(i, [i, 0])
        assert begun.wait(30)
        c.upsert(3, [33, 0])
        c.delete(4)
        assert not c.segment_stats() and len(c) == 8 and c.get(3).vector[0] == 33
        go.set()
        until = time.time() + 60
        while not c.segment_stats() and time.time() < until:
            time.sleep(0.05)
        assert c.segment_stats() and len(c) == 8 and c.get(3).vector[0] == 33 and c.get(4) is None
        for k in range(6):
            c.upsert_batch(list(range(100, 109)), [[k, k]] * 9)
        assert len(c) == 17
    with Database(spark, tmp_path / "db") as db:
        c = db.collection("c")
        assert len(c) == 17 and c.get(100).vector == [5, 5] and c.get(3).vector[0] == 33 and c.get(4) is None
        db.verify()
    # single writes, frames, flushes and searches from several threads
    with Database(spark, tmp_path / "many", Options(flush_threshold_bytes=100, compaction_threshold=3, background=True)) as db:
        c = db.create_collection("c", 1, "l2")

        def work(k):
            for i in range(4):
                c.upsert(10 * k + i, [k])
                if k == 1 and i % 2:
                    c.upsert_frame(spark.createDataFrame([(1000 + i, [5.0])], "id long, vector array<float>").selectExpr("id", "vector", "cast(null as map<string,struct<s:string,i:bigint,f:double,b:boolean>>) meta"))
                elif k == 2:
                    db.flush()
                elif k == 3:
                    c.search([1.0]).k(2).run()

        threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join(120)
        assert not any(t.is_alive() for t in threads)
        assert sorted(r["id"] for r in c.frame().collect()) == sorted([10 * k + i for k in range(4) for i in range(4)] + [1001, 1003])
    monkeypatch.setattr(store, "STALL", 1)
    with Database(spark, tmp_path / "other", Options(flush_threshold_bytes=64, background=True)) as db:
        c = db.create_collection("c", 4, "l2")
        c.upsert_batch(list(range(8)), [[1] * 4] * 8)  # more than a flush: this write waits for it
        assert [s["record_count"] for s in c.segment_stats()] == [8] and not db.store.logs


def test_filters_are_planned_by_segment(spark, tmp_path):
    """A filter that few rows of one segment pass and all of another: the one is compared exactly, the other by its graph,
    with and without codes, and what stands is found in both."""
    import numpy as np

    r = np.random.default_rng(2)
    x = r.uniform(-1, 1, (600, 6)).round(3)
    for sq in (False, True):
        with Database(spark, tmp_path / f"db{sq}", Options(hnsw_min_rows=100, sq8=sq, compaction_threshold=9)) as db:
            c = db.create_collection("c", 6, "l2")
            for lo, hi, kind in ((0, 300, lambda i: i == 5), (300, 600, lambda i: True)):
                c.upsert_batch(range(lo, hi), x[lo:hi], [{"in": bool(kind(i))} for i in range(lo, hi)])
                db.flush()
            c.upsert(301, [9.0] * 6, {"in": True})
            s = c.search(x[302]).k(8).filter(f.eq("in", True))
            assert [p.strategy for p in s.plans().values()] == ["exact", "index"] and [p.strategy for p in c.search(x[0]).plans().values()] == ["index"] * 2
            allowed = [i for i in [5, *range(300, 600)] if i != 301]
            truth = sorted(allowed, key=lambda i: (((x[i] - x[302]) ** 2).sum(), i))[:8]
            assert len(set(ids(c, x[302], 8, f.eq("in", True))) & set(truth)) >= 7
            assert ids(c, x[5], 1, f.eq("in", True)) == [5]


def test_damage_in_the_middle_of_the_log(spark, tmp_path):
    base = tmp_path / "db"
    with Database(spark, base) as db:
        c = db.create_collection("c", 1, "l2")
        c.upsert(1, [1])
        c.upsert(2, [2])
    first = sorted((base / "oplog").glob("*.parquet"))[1]
    first.write_bytes(b"junk")
    with pytest.raises(errors.Corrupted):
        Database(spark, base)


def test_frames_and_index(spark, tmp_path):
    import numpy as np

    from vecspan.sources.files import from_arrays

    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (600, 8)).astype(np.float32)
    for sq in (False, True):
        with Database(spark, tmp_path / f"db{sq}", Options(hnsw_min_rows=100, sq8=sq)) as db:
            c = db.create_collection("c", 8, "l2")
            c.upsert_frame(from_arrays(spark, list(range(600)), x))
            assert c.segment_stats()[0]["has_hnsw"] and len(c) == 600
            hits = 0
            for q in x[:5] + np.float32(0.05):
                truth = np.argsort(((x.astype(float) - q) ** 2).sum(axis=1))[:10].tolist()
                hits += len(set(truth) & set(ids(c, q, 10)))
            assert hits >= 47
            if not sq:
                c.upsert(5, [9.0] * 8)
                c.delete(6)
                c.upsert(1000, x[5].tolist())
                found = ids(c, x[5], 5)
                assert found[0] == 1000 and 5 not in found and 6 not in ids(c, x[6], 10)
                c.upsert_batch(list(range(100, 160)), x[100:160], [{"even": i % 2 == 0} for i in range(60)])
                assert set(ids(c, x[100], 5, f.eq("even", True))) <= set(range(100, 160, 2))
            with pytest.raises(errors.InvalidVector):
                c.upsert_frame(from_arrays(spark, [1], [[math.nan] * 8]))


@pytest.mark.parametrize("seed", range(4))
def test_random_operations(spark, tmp_path, seed):
    r = random.Random(seed)
    base = tmp_path / "db"
    options = Options(compaction_threshold=3)
    db = Database(spark, base, options)
    c = db.create_collection("c", 1, "l2")
    want: dict[int, tuple[float, bool]] = {}
    for _ in range(14):
        op = r.choices(["upsert", "delete", "flush", "compact", "reopen"], [5, 2, 1, 1, 1])[0]
        if op == "upsert":
            i, v, even = r.randrange(8), float(r.randrange(-8, 8)), r.random() < 0.5
            c.upsert(i, [v], {"even": even})
            want[i] = (v, even)
        elif op == "delete":
            i = r.randrange(8)
            assert c.delete(i) == (i in want)
            want.pop(i, None)
        elif op == "reopen":
            db.close()
            db = Database(spark, base, options)
            c = db.collection("c")
        else:
            getattr(db, op)()
        got = {row["id"]: (row["vector"][0], row["meta"]["even"]["b"]) for row in c.frame().collect()}
        assert got == want
    assert len(c) == len(want)
    for q in (-5.0, 0.0, 5.0):
        order = sorted(want, key=lambda i: ((want[i][0] - q) ** 2, i))
        assert ids(c, [q], 3) == order[:3]
        assert ids(c, [q], 10, f.eq("even", True)) == [i for i in order if want[i][1]]
    db.close()

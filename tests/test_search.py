"""Distances, batch search, quantisation, and the graph index."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.errors import Corrupted, InvalidConfig
from vecspan.functions import metrics, sq8
from vecspan.operators import hnsw, search
from vecspan.plans import catalogue, planner
from vecspan.sources.files import from_arrays
from vecspan.types import HnswParams


def test_metrics(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 1.0])], "a array<float>, b array<float>")
    r = df.select(metrics.dot(F.col("a"), F.col("b")), metrics.l2_squared(F.col("a"), F.col("b")), metrics.norm(F.col("a")), metrics.normalise(F.col("a"))).first()
    assert (r[0], r[1], r[2]) == (4.0, 18.0, 5.0) and np.allclose(r[3], [0.6, 0.8])
    assert spark.range(1).select(metrics.normalise(F.array(F.lit(0.0)))).first()[0] is None
    assert metrics.prepared([3, 4], 2, "cosine") == pytest.approx([0.6, 0.8])


def test_unsigned_order_and_ties(spark):
    rows = spark.createDataFrame([(-(1 << 63), [1.0]), (1, [1.0]), (2, [5.0])], "id long, vector array<float>")
    assert [r.id for r in search.nearest(rows, [1.0], 5, "l2").orderBy("rank").collect()] == [1, -(1 << 63), 2]


def test_dot_prefers_larger(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [10.0, 0.0]), (3, [-5.0, 0.0])], "id long, vector array<float>")
    assert [r.id for r in search.nearest(rows, [1.0, 0.0], 2, "dot").orderBy("rank").collect()] == [2, 1]


def test_topk_plan(spark):
    rows = spark.range(100).select("id", F.array(F.col("id").cast("float")).alias("vector"))
    assert "TakeOrderedAndProject" in search.nearest(rows, [1.0], 5, "l2")._jdf.queryExecution().toString()


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_batch(spark, metric, monkeypatch):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 5)).astype(np.float32)
    base = from_arrays(spark, list(range(300)), x).repartition(5)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 60)
    got = search.nearest_of_each(base.where("id < 30").withColumnRenamed("id", "qid"), base, 4, metric).collect()
    found = {}
    for g in got:
        found.setdefault(g.qid, {})[g["rank"]] = g.id
    y = x.astype(float)
    for q in range(30):
        key = ((y - y[q]) ** 2).sum(axis=1) if metric == "l2" else -(y @ y[q])
        assert [found[q][k] for k in range(1, 5)] == np.argsort(key, kind="stable")[:4].tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    assert search.nearest(none, [1.0], 3, "l2").count() == 0
    assert search.nearest_of_each(none.withColumnRenamed("id", "qid"), none, 3, "l2").count() == 0
    assert sq8.fit(none) == sq8.Range(0.0, 1.0)


def test_sample_takes_every_nth(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2 == 0).alias("hit")).repartition(4)
    assert planner.sample(df, F.col("hit"), 2000).first()[0] == 1.0
    assert planner.sample(df.where("id < 1999"), F.col("hit"), 1999).first()[0] == pytest.approx(1000 / 1999)
    assert planner.choose(0.04, 64).strategy == "exact" and planner.choose(0.1, 64).ef == 256 and planner.choose(1.0, 64).ef == 64


def test_sample_of_many_partitions(spark):
    """Every (n // 1000)th row, in unsigned order of ids, where a sort has several partitions."""
    df = spark.range(0, 400_000, 1, 8).select("id", (F.col("id") % 400 == 0).alias("hit"))
    # negative ids come last, in their order: -400, ..., -1 take places 399,600 to 399,999
    moved = df.withColumn("id", F.when(F.col("id") >= 399_600, F.col("id") - 400_000).otherwise(F.col("id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert planner.sample(df, F.col("hit"), 400_000).first()[0] == 1.0
        assert planner.sample(moved, F.col("hit"), 400_000).first()[0] == 1.0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_constant_vectors_quantise(spark):
    r = sq8.Range(2.0, 2.0)
    assert r.scale == 1 and sq8.codes([2.0, 2.4, 2.5, 900.0, -5.0], r) == [0, 0, 1, 255, 0]


def by_inserts(x, metric, p):
    return hnsw.Builder(x, metric, p).graph


def _recall(x, q, metric, ef, p=HnswParams(), build=by_inserts):  # noqa: B008
    g = hnsw.Graph.from_bytes(build(x, metric, p).to_bytes())
    hits = 0
    for v in q:
        key = ((x - v) ** 2).sum(axis=1) if metric == "l2" else -(x @ v)
        truth = set(np.argsort(key)[:10].tolist())
        hits += len(truth & {n for _, n in hnsw.search(g, lambda rows: hnsw.keys_to(x, v, rows, metric), 10, ef)})  # noqa: B023
    return hits / (10 * len(q)), g


def test_graph_recall():
    r = np.random.default_rng(5)
    fast = HnswParams(ef_construction=80)
    x = r.uniform(-1, 1, (1200, 16))
    found, g = _recall(x, r.uniform(-1, 1, (30, 16)), "l2", 64, fast)
    assert found >= 0.95 and max(map(len, g.links[0].values())) <= 32 and all(len(v) <= 16 for level in g.links[1:] for v in level.values())
    assert _recall(x[:300], r.uniform(-1, 1, (10, 16)), "l2", 300, fast)[0] == 1.0
    centres = r.uniform(-5, 5, (20, 32))
    y = centres[r.integers(20, size=1200)] + 0.5 * r.standard_normal((1200, 32))
    assert _recall(y, y[:30] + 0.1, "l2", 64, fast)[0] >= 0.95
    z = y / np.linalg.norm(y, axis=1, keepdims=True)
    assert _recall(z, z[:30], "dot", 64, fast)[0] >= 0.95


def test_bulk_graphs():
    """As many true neighbours as by single inserts, exact with a full beam whatever the shape of the data: clusters far
    apart, rows that come many times, few rows."""
    r = np.random.default_rng(5)
    x = r.uniform(-1, 1, (3000, 24))
    found, g = _recall(x, r.uniform(-1, 1, (40, 24)), "l2", 64, build=hnsw.bulk)
    assert found >= 0.95 and max(map(len, g.links[0].values())) <= 40
    centres = 1000 * r.uniform(-5, 5, (20, 32))
    y = centres[r.integers(20, size=2000)] + 0.5 * r.standard_normal((2000, 32))
    assert _recall(y, y[:30] + 0.1, "l2", 64, build=hnsw.bulk)[0] >= 0.95
    z = r.standard_normal((2000, 32))
    assert _recall(z, z[:30], "dot", 128, build=hnsw.bulk)[0] >= 0.85
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert _recall(z, r.standard_normal((30, 32)), "dot", 64, build=hnsw.bulk)[0] >= 0.95
    for rows in (y[:900], np.repeat(r.standard_normal((30, 4)), 25, axis=0), x[:1], x[:2], x[:40], np.zeros((50, 3))):
        g = hnsw.bulk(rows, "l2", HnswParams(seed=2))
        for v in rows[:: max(1, len(rows) // 5)]:
            key = ((rows - v) ** 2).sum(axis=1)
            got = hnsw.search(g, lambda k: hnsw.keys_to(rows, v, k, "l2"), 10, len(rows))  # noqa: B023
            assert [d for d, _ in got] == pytest.approx(np.sort(key)[:10].tolist())
    assert hnsw.bulk(x[:500], "l2", HnswParams(seed=4)).to_bytes() == hnsw.bulk(x[:500], "l2", HnswParams(seed=4)).to_bytes()
    assert hnsw.bulk(x[:0], "l2").n == 0


def test_graph_mask_and_bytes():
    r = np.random.default_rng(6)
    x = r.uniform(-1, 1, (200, 4))
    a, b = hnsw.Builder(x, "l2", HnswParams(seed=3)).graph, hnsw.Builder(x, "l2", HnswParams(seed=3)).graph
    data = a.to_bytes()
    assert data == b.to_bytes()
    mask = np.arange(200) % 3 == 0
    found = hnsw.search(a, lambda rows: hnsw.keys_to(x, x[0], rows, "l2"), 5, 200, mask)
    want = [i for i in np.argsort(((x - x[0]) ** 2).sum(axis=1), kind="stable").tolist() if mask[i]][:5]
    assert [n for _, n in found] == want
    for bad in (data[:-4], data[:10], b"\0" * 64, data + b"\0\0\0\0"):
        with pytest.raises(Corrupted):
            hnsw.Graph.from_bytes(bad)
    empty = hnsw.Builder(np.zeros((0, 4)), "l2").graph
    assert hnsw.search(hnsw.Graph.from_bytes(empty.to_bytes()), lambda rows: rows, 3, 10) == []
    with pytest.raises(InvalidConfig):
        HnswParams(m=1)


def test_index_in_spark(spark):
    r = np.random.default_rng(7)
    x = r.uniform(-1, 1, (400, 8)).astype(np.float32)
    df = from_arrays(spark, list(range(400)), x)
    one = hnsw.build_index(df, "l2", HnswParams(ef_construction=60), 3, by_inserts=True).where("n > 0")
    assert hnsw.nearest(one, x[3].tolist(), 5, "l2", 400).count() == 5
    index = hnsw.build_index(df, "l2", HnswParams(ef_construction=60), 3).cache()
    want = np.argsort(((x.astype(float) - x[3]) ** 2).sum(axis=1))[:5].tolist()
    assert [h.id for h in hnsw.nearest(index, x[3].tolist(), 5, "l2", 400).orderBy("rank").collect()] == want
    odd = df.where("id % 2 = 1").select("id")
    got = hnsw.nearest(index, x[3].tolist(), 5, "l2", 400, odd).orderBy("rank").collect()
    assert [h.id for h in got] == [i for i in np.argsort(((x.astype(float) - x[3]) ** 2).sum(axis=1)).tolist() if i % 2][:5]
    assert math.isclose(got[0].score, 0.0)


def test_plan_choice_of_many_partitions(spark, tmp_path):
    """The plan of a table of which every sampled row matches, whatever the others do."""
    lang = F.when(F.col("id") % 400 == 0, "en").otherwise("de")
    spark.range(0, 400_000, 1, 8).select(F.col("id").alias("doc_id"), lang.alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert catalogue.QUERIES["plan_choice"](spark, str(tmp_path)).first() == ("index", 64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("case", ["negative", "null", "empty"])
def test_plan_choice_in_the_order_of_its_sql(spark, tmp_path, case):
    """Negative ids come first and a null last, over many partitions; a table without rows has a plan, too."""
    place = F.col("id")
    id_ = {"negative": place - 199_900, "null": F.when(place < 399_999, place), "empty": place}[case]
    rows = spark.range(0, 0 if case == "empty" else 400_000, 1, 8).select(id_.alias("doc_id"), F.when(place % 400 == 0, "en").otherwise("de").alias("lang"))
    rows.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalogue.QUERIES["plan_choice"](spark, str(tmp_path)).first()
        assert got == con.execute(catalogue.ORACLES["plan_choice"]).fetchone() == ("index", 64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_index_of_copies(spark):
    """Rows of equal vectors don't crowd each other out of the graph, and of equal ones the smallest ids are found."""
    r = np.random.default_rng(21)
    x = np.tile(r.standard_normal((150, 16)).astype(np.float32), (30, 1))
    df = from_arrays(spark, list(range(len(x))), x)
    index = hnsw.build_index(df, "l2", HnswParams(), 2)
    found = hnsw.search_index(index, [(k, x[k].tolist()) for k in range(40)], 10, 64, "l2").orderBy("key", "id").collect()
    for k in range(40):
        assert [f.id for f in found if f.qid == k][:10] == list(range(k, len(x), 150))[:10]


@pytest.mark.parametrize("coded", [False, True])
def test_index_widens_its_beam(spark, coded):
    """Vectors without any structure: the given beam is too narrow for a shard, and the index has measured that."""
    r = np.random.default_rng(22)
    x = (r.standard_normal((6000, 48)) * r.integers(1, 11, 6000)[:, None]).astype(np.float32)
    df = from_arrays(spark, list(range(len(x))), x)
    rng = sq8.fit(df) if coded else None
    index = hnsw.build_index(df, "l2", HnswParams(ef_search=10), 1, coded=rng)
    q = r.standard_normal((100, 48)) * r.integers(1, 11, 100)[:, None]
    found = hnsw.search_index(index, [(k, v.tolist()) for k, v in enumerate(q)], 10, 10, "l2", coded=rng).collect()
    hits = sum(len({f.id for f in found if f.qid == k} & set(np.argsort(((x - v) ** 2).sum(axis=1))[:10].tolist())) for k, v in enumerate(q))
    assert hits >= 900


def test_filtered_walks_are_bounded(spark):
    """All that a filter lets through lies beyond all that it keeps out: a walk doesn't go through the latter."""
    r = np.random.default_rng(23)
    x = r.standard_normal((3000, 16))
    x *= (np.where(np.arange(3000) % 2, 9.0, 1.0) / np.sqrt((x * x).sum(axis=1)))[:, None]
    graph, mask, looked = hnsw.bulk(x, "l2"), np.arange(3000) % 2 == 1, []
    distance = lambda rows, nodes: (looked.extend(nodes.tolist()), ((x[nodes] - x[0]) ** 2).sum(axis=1))[1]
    hnsw.Walker(graph).search(distance, 1, 32, mask)
    # of what is kept out, the way down the upper levels alone
    assert all(graph.levels[n] > 0 for n in looked if not mask[n]) and len(looked) < 1500
    df = from_arrays(spark, list(range(3000)), x.astype(np.float32))
    odd = df.where("id % 2 = 1").select("id")
    found = hnsw.search_index(hnsw.build_index(df, "l2", HnswParams(), 2), [(k, x[k].tolist()) for k in range(0, 60, 2)], 10, 64, "l2", odd).collect()
    far = np.flatnonzero(mask)
    hits = sum(len({f.id for f in found if f.qid == k} & set(far[np.argsort(((x[far] - x[k]) ** 2).sum(axis=1))[:10]].tolist())) for k in range(0, 60, 2))
    assert hits >= 270

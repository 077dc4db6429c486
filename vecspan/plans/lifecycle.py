"""Registered queries that go through a database: writes, flushes, compaction, recovery, followers, sources and indexes.

Each opens a database of its own in the shared folder, writes whole test tables to it, and returns what is read back.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Collection, Database
from ..errors import InvalidConfig
from ..functions import metrics, sq8
from ..operators import filters, hnsw, search
from ..operators.filters import ColumnSource
from ..server import Api
from ..sources import files
from ..sources.store import SHARD_ROWS
from ..streaming.follower import Follower, LatestState, follow
from ..types import EXT_ID, META, HnswParams, Options

QUERIES: dict = {}
ORACLES: dict = {}
K = 10


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


def place(spark: SparkSession) -> Path:
    """A new folder that driver and executors share. Only a session in one process may do without a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise InvalidConfig("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vecspan-")
    if "://" in base and not base.startswith("file:"):
        raise InvalidConfig("a database lies on a file system with paths")
    path = Path("/" + base.removeprefix("file:").lstrip("/")) / "vecspan-db" / uuid.uuid4().hex
    path.mkdir(parents=True)
    return path


@contextmanager
def opened(spark: SparkSession, path: Path | None = None, **options) -> Iterator[Database]:
    with Database(spark, path or place(spark) / "db", Options(**options)) as db:
        yield db


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _value(kind: str, c: Column) -> Column:
    """A tagged metadata value."""
    none = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}
    return F.struct(*[(c if k == kind else F.lit(None)).cast(t).alias(k) for k, t in none.items()])


_NO_META = lambda: F.create_map().cast(META)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "customer")
    meta = F.create_map(F.lit("segment"), _value("s", F.col("c_mktsegment")), F.lit("nation"), _value("i", F.col("c_nationkey")))
    return t.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal").cast("float")).alias("vector"), meta.alias("meta"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))


def _numbers(c: Collection) -> DataFrame:
    return c.frame().select("id", F.get("vector", F.lit(0)).cast("double").alias("value"))


_BALANCE = "CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE)"
_LEFT = f"SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 0.5::DOUBLE ELSE {_BALANCE} END AS value FROM customer WHERE c_mktsegment <> 'BUILDING'"


def _written(db: Database, spark: SparkSession, d: str) -> Collection:
    """All customers; then a nation's get another value; then a market segment's are deleted: three segments."""
    t = _customers(spark, d)
    c = db.create_collection("customers", 1, "l2")
    c.upsert_frame(t)
    c.upsert_frame(t.where("nation = 3").withColumn("vector", F.array(F.lit(0.5).cast("float"))))
    c.delete_frame(t.where("segment = 'BUILDING'"))
    return c


@query("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS first, len(embedding) AS n FROM embeddings")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        c = db.create_collection("e", 64, "l2")
        c.upsert_frame(_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), _NO_META().alias("meta")))
        return c.frame().select("id", F.get("vector", F.lit(0)).cast("double").alias("first"), F.size("vector").cast("long").alias("n"))


@query(_LEFT)
def store_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        return _numbers(_written(db, spark, d))


@query(f"SELECT count(*) AS len FROM ({_LEFT})")
def store_len(spark: SparkSession, d: str) -> DataFrame:
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        return spark.createDataFrame([(len(_written(db, spark, d)),)], "len long")


@query(f"SELECT * FROM ({_LEFT}) WHERE id = 7")
def store_get(spark: SparkSession, d: str) -> DataFrame:
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        r = _written(db, spark, d).get(7)
        return spark.createDataFrame([] if r is None else [(r.id, r.vector[0])], "id long, value double")


_STATS = """SELECT 1::BIGINT AS seg_id, (SELECT count(*) FROM customer) AS record_count, 0::BIGINT AS tombstone_count, false AS has_hnsw
    UNION ALL SELECT 2, (SELECT count(*) FROM customer WHERE c_nationkey = 3), 0, false
    UNION ALL SELECT 3, 0, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'), false"""


def _stats(c: Collection, spark: SparkSession) -> DataFrame:
    rows = [tuple(s[k] for k in ("seg_id", "record_count", "tombstone_count", "has_hnsw")) for s in c.segment_stats()]
    return spark.createDataFrame(rows, "seg_id long, record_count long, tombstone_count long, has_hnsw boolean")


@query(_STATS)
def store_segments(spark: SparkSession, d: str) -> DataFrame:
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        return _stats(_written(db, spark, d), spark)


@query(f"SELECT 4::BIGINT AS seg_id, count(*) AS record_count, 0::BIGINT AS tombstone_count, false AS has_hnsw FROM ({_LEFT})")
def store_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Full compaction: one segment without tombstones, verified by its checksum."""
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        c = _written(db, spark, d)
        db.compact()
        db.verify()
        return _stats(c, spark)


@query("SELECT (SELECT count(*) FROM customer) AS record_count UNION ALL SELECT count(*) FROM customer WHERE c_nationkey IN (0, 1, 2, 3)")
def store_compaction_run(spark: SparkSession, d: str) -> DataFrame:
    """Small segments over a large one: those of like size are merged, and the large one stays."""
    t = _customers(spark, d)
    with opened(spark, hnsw_min_rows=1 << 40, compaction_threshold=4) as db:
        c = db.create_collection("c", 1, "l2")
        c.upsert_frame(t)
        for k in range(4):
            c.upsert_frame(t.where(F.col("nation") == k))
        return spark.createDataFrame([(s["record_count"],) for s in c.segment_stats()], "record_count long")


_NATIONS = "SELECT n_nationkey::BIGINT AS id, CAST(n_regionkey AS DOUBLE) AS value, n_name AS name FROM nation WHERE n_nationkey <> 4"


def _nations(db: Database, spark: SparkSession, d: str) -> Collection:
    """Records one batch after another, through the log, and a delete."""
    rows = _table(spark, d, "nation").orderBy("n_nationkey").collect()
    c = db.create_collection("nations", 1, "l2")
    for k in range(0, len(rows), 10):
        part = rows[k : k + 10]
        c.upsert_batch([r["n_nationkey"] for r in part], [[r["n_regionkey"]] for r in part], [{"name": r["n_name"]} for r in part])
    c.delete(4)
    return c


def _named(c: Collection) -> DataFrame:
    return c.frame().select("id", F.get("vector", F.lit(0)).cast("double").alias("value"), F.try_element_at("meta", F.lit("name"))["s"].alias("name"))


@query(_NATIONS)
def store_log(spark: SparkSession, d: str) -> DataFrame:
    with opened(spark) as db:
        return _named(_nations(db, spark, d))


@query(_NATIONS)
def store_in_memory(spark: SparkSession, d: str) -> DataFrame:
    with Database(spark) as db:
        return _named(_nations(db, spark, d))


@query(_NATIONS)
def store_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Nothing was flushed when the database was closed, and a temporary file was left behind."""
    base = place(spark) / "db"
    with opened(spark, base) as db:
        _nations(db, spark, d)
    (base / "segments" / "9.tmp").mkdir(parents=True)
    with opened(spark, base) as db:
        db.flush()
        return _named(db.collection("nations"))


@query("SELECT n_nationkey::BIGINT AS id, CAST(n_regionkey AS DOUBLE) AS value, n_name AS name FROM nation WHERE n_nationkey < 10")
def store_cut_log(spark: SparkSession, d: str) -> DataFrame:
    """The newest log files are damaged one after the other: what came before the first of them stands."""
    base = place(spark) / "db"
    with opened(spark, base) as db:
        _nations(db, spark, d)
    for p in sorted((base / "oplog").glob("*.parquet"))[-1:1:-1]:
        p.write_bytes(p.read_bytes()[:-9])
        with opened(spark, base) as db:
            found = _named(db.collection("nations"))
    return found


@query(f"{_NATIONS} UNION ALL SELECT 100, 9.0, 'none'")
def store_follower(spark: SparkSession, d: str) -> DataFrame:
    """A follower that opened before the flush and takes up the new generation and log."""
    base = place(spark) / "db"
    with opened(spark, base) as db:
        c = _nations(db, spark, d)
        f = Follower.open(spark, str(base))
        db.flush()
        c.upsert(100, [9.0], {"name": "none"})
        f.sync_once()
        return _named(f.database.collection("nations"))


@query(_LEFT)
def store_backup(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark)
    with opened(spark, at / "db", hnsw_min_rows=1 << 40) as db:
        _written(db, spark, d)
        db.backup(at / "copy")
    with opened(spark, at / "copy") as db:
        return _numbers(db.collection("customers"))


@query(f"{_NATIONS.replace('n_name AS name', 'NULL::VARCHAR AS name')} UNION ALL SELECT c_custkey + 1000, {_BALANCE}, NULL FROM customer")
def store_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Structured Streaming over the log, beside rows that went into segments without it."""
    at = place(spark)
    with opened(spark, at / "db", hnsw_min_rows=1 << 40) as db:
        c = _nations(db, spark, d)
        state = LatestState(spark, str(at / "state"))
        follow(spark, str(at / "db"), state, str(at / "checkpoint")).awaitTermination()
        c.upsert_frame(_customers(spark, d).withColumn("id", F.col("id") + 1000))
        follow(spark, str(at / "db"), state, str(at / "checkpoint")).awaitTermination()
        return state.live(1).select("id", F.get("vector", F.lit(0)).cast("double").alias("value"), F.lit(None).cast("string").alias("name"))


@query("""SELECT user_id AS id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
    WHERE n = 1 AND event_type <> 'error'""")
def events_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of operations on users, merged into the latest state batch by batch."""
    at = place(spark)
    state = LatestState(spark, str(at / "state"))
    raw = spark.readStream.schema(_table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    ops = raw.select(F.lit(1).alias("collection_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), F.array(F.col("value").cast("float")).alias("vector"), _NO_META().alias("meta"))
    ops.writeStream.foreachBatch(state.merge).option("checkpointLocation", str(at / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return state.live(1).select("id", F.get("vector", F.lit(0)).cast("double").alias("value"))


@query("""SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS collection_id, r_name AS name, CAST(r_regionkey + 1 AS INTEGER) AS dim, 'l2' AS metric
    FROM region QUALIFY r_regionkey <> 2""")
def catalog(spark: SparkSession, d: str) -> DataFrame:
    """A collection for each region, one of them dropped, after closing and opening again."""
    base = place(spark) / "db"
    with opened(spark, base) as db:
        for r in _table(spark, d, "region").orderBy("r_regionkey").collect():
            db.create_collection(r["r_name"], r["r_regionkey"] + 1, "l2")
            if r["r_regionkey"] == 2:
                db.drop_collection(r["r_name"])
        db.flush()
    with opened(spark, base) as db:
        return db.store.catalog()


@query("""SELECT url AS ext_id, CAST(CAST(-9223372036854775808 AS HUGEINT) + row_number() OVER (ORDER BY url) - 1 AS BIGINT) AS id, CAST(max(page_id) AS DOUBLE) AS value
    FROM pages WHERE url IS NOT NULL GROUP BY url""")
def store_string_ids(spark: SparkSession, d: str) -> DataFrame:
    """Pages by URL, twice: the second time the ids are known."""
    t = _table(spark, d, "pages").where("url is not null").select(F.col("url").alias("id"), F.array(F.col("page_id").cast("float")).alias("vector"), _NO_META().alias("meta"), "page_id")
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        c = db.create_collection("pages", 1, "l2")
        for _ in range(2):
            c.upsert_frame(t, order="page_id")
        return c.frame().select(F.try_element_at("meta", F.lit(EXT_ID))["s"].alias("ext_id"), "id", F.get("vector", F.lit(0)).cast("double").alias("value"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS key, true AS numeric, {_BALANCE} AS value, c_name AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance, c_acctbal > 0 AS positive FROM customer")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers as JSON lines, and read again with the kinds of their values."""
    at = str(place(spark) / "lines")
    meta = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("positive"))
    t = _table(spark, d, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("vector"), meta.alias("meta"))).alias("value"))
    t.write.text(at)
    of = lambda k, kind: F.try_element_at("meta", F.lit(k))[kind]
    balance = F.coalesce(of("balance", "f"), of("balance", "i").cast("double"))
    return files.read_json_lines(spark, at).select("key", "numeric", F.get("vector", F.lit(0)).cast("double").alias("value"), of("name", "s").alias("name"), of("nation", "i").alias("nation"), balance.alias("balance"), of("positive", "b").alias("positive"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def vector_files(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as .fvecs files, and read again."""
    files.register(spark)
    at = place(spark) / "vectors"
    files.write_vecs(_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), str(at))
    return spark.read.format("fvecs").option("rowsPerPartition", 500).load(str(at)).select("id", F.get("vector", F.lit(0)).cast("double").alias("first"), F.get("vector", F.lit(63)).cast("double").alias("last"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, c_nationkey::INTEGER AS first FROM customer")
def integer_files(spark: SparkSession, d: str) -> DataFrame:
    files.register(spark)
    at = place(spark) / "vectors"
    files.write_vecs(_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array("c_nationkey").alias("vector")), str(at), "ivecs")
    return spark.read.format("ivecs").load(str(at)).select("id", F.get("vector", F.lit(0)).alias("first"))


_L2 = "list_sum(list_transform(list_zip(v, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_E = "e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(CAST(x * (1.0 + label) AS FLOAT) AS DOUBLE)) AS v FROM embeddings)"


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "embeddings")
    v = F.transform(metrics.doubles(F.col("embedding")), lambda x: (x * (F.lit(1.0) + F.col("label"))).cast("float"))
    return t.select(F.col("vec_id").alias("id"), v.alias("vector"), F.create_map(F.lit("label"), _value("i", F.col("label"))).alias("meta"), "label")


@query(f"""WITH {_E}, q AS (SELECT v AS qv FROM e WHERE id = 0), k AS (SELECT id, label, {_L2} AS key FROM e, q WHERE label >= 5)
    SELECT CAST(row_number() OVER (ORDER BY key, id) AS INTEGER) AS rank, id, sqrt(key) AS score FROM k ORDER BY key, id LIMIT {K}""")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The search builder over several segments and a tail, without an index."""
    t = _embedded(spark, d)
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        c = db.create_collection("e", 64, "l2")
        c.upsert_frame(t.where("id % 2 = 0"))
        c.upsert_frame(t.where("id % 2 = 1"))
        q = c.get(0)
        c.upsert(0, q.vector, q.meta)
        return c.search(q.vector).k(K).filter(filters.gte("label", 5)).frame()


@query(f"""WITH {_E}, q AS (SELECT id AS qid, v AS qv FROM e WHERE id % 50 = 0), k AS (SELECT qid, id, {_L2} AS key, row_number() OVER (PARTITION BY qid ORDER BY {_L2}, id) AS rank FROM e, q)
    SELECT qid, CAST(rank AS INTEGER) AS rank, id, sqrt(key) AS score FROM k WHERE rank <= {K}""")
def search_many(spark: SparkSession, d: str) -> DataFrame:
    t = _embedded(spark, d)
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        c = db.create_collection("e", 64, "l2")
        c.upsert_frame(t)
        return c.search_many(t.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), K)


@query(f"""WITH {_E}, q AS (SELECT v AS qv FROM e WHERE id = 0), k AS (SELECT id, label, {_L2} AS key FROM e, q)
    SELECT CAST(row_number() OVER (ORDER BY key, id) AS INTEGER) AS rank, id, sqrt(key) AS score, label::BIGINT AS label FROM k ORDER BY key, id LIMIT {K}""")
def http_search(spark: SparkSession, d: str) -> DataFrame:
    """The HTTP interface's answer, hits with their metadata."""
    with opened(spark, hnsw_min_rows=1 << 40) as db:
        c = db.create_collection("e", 64, "l2")
        c.upsert_frame(_embedded(spark, d))
        status, said = Api(db).handle("POST", "/collections/e/search", {}, f'{{"vector": {c.get(0).vector}, "k": {K}}}'.encode())
        if status != 200:
            raise InvalidConfig(str(said))
        return spark.createDataFrame([(k, h["id"], h["score"], h["meta"]["label"]) for k, h in enumerate(said["hits"], 1)], "rank int, id long, score double, label long")


_RECALLED = "SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, true AS at_least_0_9 FROM embeddings"


def _recalled(spark: SparkSession, d: str, ef: int, coded: bool, label: int | None = None) -> DataFrame:
    """Every vector whose id is divisible by 50 is searched for in an index of the store's own shard size: whether at
    least nine tenths of the true neighbours are found."""
    t = _embedded(spark, d)
    r = sq8.fit(t) if coded else None
    index = hnsw.build_index(t, "l2", HnswParams(), math.ceil(t.count() / SHARD_ROWS), coded=r)
    index.write.parquet(at := str(place(spark) / "index"))
    queries = t.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    # a fiftieth of the table's vectors, as the index search takes them in one list
    some = [(x["qid"], x["vector"]) for x in queries.collect()]
    allowed = None if label is None else t.where(filters.gte("label", label).where(ColumnSource(t)))
    found = hnsw.search_index(spark.read.parquet(at), some, K, ef, "l2", None if allowed is None else allowed.select("id"), r)
    truth = search.nearest_of_each(queries, t if allowed is None else allowed, K, "l2")
    share = search.recall(found, truth, K)
    return share.select(F.lit(len(some)).cast("long").alias("queries"), (F.col("recall") >= 0.9).alias("at_least_0_9"))


@query(_RECALLED)
def hnsw_topk(spark: SparkSession, d: str) -> DataFrame:
    return _recalled(spark, d, 64, False)


@query(_RECALLED)
def hnsw_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _recalled(spark, d, 128, False, 5)


@query(_RECALLED)
def hnsw_coded(spark: SparkSession, d: str) -> DataFrame:
    """The graph is walked by 8-bit codes; the best 4 k are compared exactly."""
    return _recalled(spark, d, 64, True)


@query("SELECT count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p99_9, max(value) AS max FROM events")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(_table(spark, d, "events"), "value")

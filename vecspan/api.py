"""Databases, collections and searches."""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidConfig
from .functions import metrics, sq8
from .operators import hnsw, search
from .operators.filters import Filter, MapSource, parse
from .operators.live import live
from .plans import planner
from .sources.store import Info, Segment, Store
from .types import Hit, Options, Record, Scalar, floats, plain_meta, record_id, unsigned


class Database:
    """A database at a path, or in memory without one."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike | None = None, options: Options = Options(), replica: bool = False):  # noqa: B008
        if replica and path is None:
            raise InvalidConfig("a follower needs a path")
        self.spark, self.store = spark, Store(spark, path, options, follower=replica)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    @property
    def path(self) -> str | None:
        return None if self.store.base is None else str(self.store.base)

    @property
    def options(self) -> Options:
        return self.store.options

    @property
    def is_replica(self) -> bool:
        return self.store.follower

    @property
    def generation(self) -> int:
        return self.store.manifest.generation

    def create_collection(self, name: str, dim: int, metric: str = "cosine") -> Collection:
        return Collection(self.store, self.store.create(name, dim, metric))

    def collection(self, name: str) -> Collection:
        return Collection(self.store, self.store.info(name))

    def collection_names(self) -> list[str]:
        return self.store.names()

    def drop_collection(self, name: str) -> None:
        self.store.drop(name)

    def flush(self) -> None:
        self.store.flush()

    def compact(self) -> None:
        self.store.compact()

    def backup(self, dest: str | os.PathLike) -> None:
        self.store.backup(dest)

    def vacuum(self) -> None:
        self.store.vacuum()

    def verify(self) -> None:
        self.store.verify()

    def refresh(self) -> bool:
        return self.store.refresh()

    def close(self) -> None:
        self.store.close()


class Collection:
    """Records with vectors of one length under one metric."""

    def __init__(self, store: Store, info: Info):
        self.store, self.info = store, info

    @property
    def name(self) -> str:
        return self.info.name

    @property
    def dim(self) -> int:
        return self.info.dim

    @property
    def metric(self) -> str:
        return self.info.metric

    def frame(self) -> DataFrame:
        """The records that stand, as a DataFrame: id, vector, meta."""
        return self.store.live(self.info)

    def __len__(self) -> int:
        return self.store.count(self.info)

    def is_empty(self) -> bool:
        return len(self) == 0

    def upsert(self, id: int | str, vector: Sequence[float], meta: dict[str, Scalar] | None = None) -> None:
        self.upsert_batch([id], [vector], [meta or {}])

    def upsert_batch(self, ids: Sequence[int | str], vectors: Any, metas: Sequence[dict[str, Scalar] | None] | None = None) -> None:
        rows = [floats(v) for v in vectors]
        if len(rows) != len(ids) or metas is not None and len(metas) != len(ids):
            raise InvalidConfig("ids, vectors and metas have different lengths")
        self.upsert_records([Record(i, v, m or {}) for i, v, m in zip(ids, rows, metas or [None] * len(rows), strict=True)])

    def upsert_records(self, records: list[Record]) -> None:
        self.store.upsert(self.info, records)

    def upsert_frame(self, df: DataFrame, order: str | None = None) -> None:
        self.store.upsert_frame(self.info, df, order)

    def delete_frame(self, df: DataFrame) -> None:
        self.store.delete_frame(self.info, df)

    def delete(self, id: int | str) -> bool:
        return self.store.delete(self.info, id)

    def get(self, id: int | str) -> Record | None:
        rid = record_id(id)
        if isinstance(rid, str):
            rid = self.store._string_ids(self.info, [rid]).get(rid)
        row = None if rid is None else self.frame().where(F.col("id") == rid).first()
        return None if row is None else Record(id, list(row["vector"]), plain_meta(row["meta"]))

    def segment_stats(self) -> list[dict]:
        return self.store.stats(self.info)

    def search(self, query: Sequence[float]) -> Search:
        return Search(self, floats(query))

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Exact neighbours of every query (qid, vector): qid, rank, id, score."""
        v = metrics.doubles(F.col("vector"))
        q = queries.select("qid", (metrics.normalise(v) if metrics.needs_normalising(self.metric) else v).alias("vector"))
        return search.nearest_of_each(q, self.frame(), k, self.metric)


class Search:
    """A search in the making: ``collection.search(q).k(5).filter(f).ef(100).run()``."""

    def __init__(self, collection: Collection, query: list[float]):
        self.collection, self.query = collection, query
        self._k, self._filter, self._ef = 10, None, None

    def k(self, k: int) -> Search:
        if k < 0:
            raise InvalidConfig("k is at least 0")
        self._k = k
        return self

    def filter(self, f: Filter | dict) -> Search:
        self._filter = f if isinstance(f, Filter) else parse(f)
        return self

    def ef(self, ef: int) -> Search:
        if ef < 1:
            raise InvalidConfig("ef is at least 1")
        self._ef = ef
        return self

    def plans(self) -> dict[int, planner.FilterPlan]:
        """By segment with an index, how it is searched. A filter's share of a segment's rows decides for that segment."""
        c = self.collection
        ef = self._ef or c.store.options.hnsw.ef_search
        out = {}
        for s in c.store.segments(c.info):
            if s.has_hnsw and self._filter is None:
                out[s.seg_id] = planner.FilterPlan("index", 1.0, ef)
            elif s.has_hnsw:
                rows = c.store.segment_rows(c.info, [s])
                share = planner.sample_segment(rows, self._filter.compile(MapSource()), s.record_count + s.tombstone_count).first()["selectivity"]
                out[s.seg_id] = planner.choose(share, ef)
        return out

    def frame(self) -> DataFrame:
        """rank, id, score. A segment without an index, or whose filter lets few rows through, is compared exactly; of an
        index each shard gives its nearest rows, by codes first where the segment has them."""
        c = self.collection
        q = metrics.prepared(self.query, c.dim, c.metric)
        plans = {k: p for k, p in self.plans().items() if p.strategy == "index"}
        if not plans:
            return search.nearest(c.frame(), q, self._k, c.metric, self._filter)
        return self._indexed(c.frame(), [s for s in c.store.segments(c.info) if s.seg_id in plans], plans, q)

    def _indexed(self, rows: DataFrame, indexed: list[Segment], plans: dict[int, planner.FilterPlan], q: list[float]) -> DataFrame:
        c, k = self.collection, self._k
        segs = c.store.segments(c.info)
        wanted = rows if self._filter is None else rows.where(self._filter.where(MapSource()))
        # ids that stand where each index has them; with a filter also those that pass it
        placed = None
        if len(segs) > 1 or c.store.logs or self._filter is not None:
            marked = [c.store.segment_rows(c.info, [s]).select("id", "seq", F.lit(s.seg_id).alias("seg"), "op") for s in segs]
            marked.append(c.store.tail(c.info).select("id", "seq", F.lit(-1).alias("seg"), "op"))
            every = marked[0]
            for m in marked[1:]:
                every = every.unionByName(m)
            placed = live(every).select("id", "seg")
            if self._filter is not None:
                placed = placed.join(wanted.select("id"), "id", "left_semi")
        parts = []
        for s in indexed:
            allowed = None if placed is None else placed.where(F.col("seg") == s.seg_id).select("id")
            coded = sq8.Range(s.low, s.high) if s.coded else None
            parts.append(hnsw.search_index(c.store.index(c.info, s), [(0, q)], k, plans[s.seg_id].ef, c.metric, allowed, coded, s.shards).select("id", "key"))
        if placed is not None:
            others = placed.where(~F.col("seg").isin([s.seg_id for s in indexed])).select("id")
            exact = wanted.join(others, "id", "left_semi").select("id", metrics.key(c.metric, F.col("vector"), metrics.literal(q)).alias("key"))
            parts.append(exact.orderBy("key", *metrics.id_order("id")).limit(k))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        top = out.orderBy("key", *metrics.id_order("id")).limit(k)
        return search.ranked(top).select("rank", "id", metrics.score(c.metric, F.col("key")).alias("score"))

    def planned(self) -> DataFrame | None:
        """The hits with their metadata, not yet computed; None where none are wanted."""
        c = self.collection
        if self._k == 0:
            metrics.prepared(self.query, c.dim, c.metric)
            return None
        return search.with_rows(self.frame(), c.frame(), ["meta"])

    def run(self) -> list[Hit]:
        """The hits with their metadata, nearest first."""
        return self.hits(self.planned())

    @staticmethod
    def hits(planned: DataFrame | None) -> list[Hit]:
        hits = [] if planned is None else planned.collect()
        return [Hit(unsigned(r["id"]), r["score"], plain_meta(r["meta"])) for r in sorted(hits, key=lambda r: r["rank"])]

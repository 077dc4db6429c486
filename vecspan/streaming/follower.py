"""Following operations: the log as a stream, newest-wins state, and a follower that polls."""

from __future__ import annotations

import shutil
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Database
from ..operators.live import newest
from ..sources.store import Store
from ..types import OPLOG


def log_stream(spark: SparkSession, base: str, files_a_trigger: int = 100) -> DataFrame:
    """The operations of a database's log as a streaming DataFrame. Spark's checkpoint keeps the place in it; files
    appear whole, so a micro-batch never sees a part of a write."""
    return spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{base}/oplog")


class LatestState:
    """The newest operation of every (collection, id), kept in Parquet folders below a path.

    Every micro-batch adds a folder with its own newest operations, named by the batch's number; a batch that is replayed
    writes its folder again and changes nothing. Reads take the newest over all folders. After ``most`` folders they are
    merged into one, so a batch costs its own size and now and then a merge.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 16):
        self.spark, self.path, self.most = spark, Path(path), most
        self.path.mkdir(parents=True, exist_ok=True)

    def _folders(self) -> list[Path]:
        """Folders that are whole: a merged one (``to-<number>``) stands for all numbers up to its own."""
        whole = [p for p in self.path.iterdir() if (p / "_SUCCESS").exists()]
        merged = sorted((p for p in whole if p.name.startswith("to-")), key=lambda p: int(p.name[3:]))[-1:]
        upto = int(merged[0].name[3:]) if merged else -1
        return merged + sorted((p for p in whole if p.name.isdigit() and int(p.name) > upto), key=lambda p: int(p.name)) + [p for p in whole if p.name.startswith("segment-")]

    def ops(self) -> DataFrame:
        found = [str(p) for p in self._folders()]
        return newest(self.spark.read.schema(OPLOG).parquet(*found), ("collection_id", "id")) if found else self.spark.createDataFrame([], OPLOG)

    def live(self, collection_id: int) -> DataFrame:
        return self.ops().where((F.col("collection_id") == collection_id) & (F.col("op") == "upsert")).select("id", "vector", "meta")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(str(self.path / name))

    def merge(self, batch: DataFrame, number: int) -> None:
        own = batch.where(F.col("op").isin("upsert", "delete")).select(*OPLOG.fieldNames())
        self._write(newest(own, ("collection_id", "id")), str(number))
        old = self._folders()
        if len(old) > self.most:
            self._write(self.ops(), f"to-{number}")
            for p in old:
                # that a segment has been taken up is remembered by its empty folder
                shutil.rmtree(p, ignore_errors=True)
                if p.name.startswith("segment-"):
                    p.mkdir()

    def take_segments(self, base: str) -> None:
        """Takes up the segments of a database's generation in force: rows that went into one without the log, and log
        files that were flushed and removed before they were read. Each segment is taken once."""
        store = Store(self.spark, base, follower=True)
        for info in store.collections.values():
            for s in store.segments(info):
                name = f"segment-{info.collection_id}-{s.seg_id}"
                if not (self.path / name).exists():
                    self._write(store.segment_rows(info, [s]), name)


def follow(spark: SparkSession, base: str, state: LatestState, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merges a database's operations into state; once over what is there, or again and again. What the log doesn't hold
    any more, or never did, comes from the segments."""

    def merge(batch: DataFrame, number: int) -> None:
        state.merge(batch, number)
        state.take_segments(base)

    state.take_segments(base)
    writer = log_stream(spark, base).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Follower:
    """A read-only database that takes up the primary's generations and log when told to, or by polling."""

    def __init__(self, database: Database):
        self.database = database
        self.said: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Follower:
        return cls(Database(spark, path, replica=True))

    def sync_once(self) -> bool:
        return self.database.refresh()

    def run(self, interval: float = 1.0, until: Callable[[], bool] = lambda: False, say: Callable[[str], None] = print) -> None:
        """Polls until told to stop. An error is told once, not again while it stays the same."""
        while not until():
            try:
                self.sync_once()
                self.said = None
            except Exception as e:  # noqa: BLE001
                if str(e) != self.said:
                    say(f"can't follow: {e}")
                self.said = str(e)
            time.sleep(interval)

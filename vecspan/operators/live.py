"""Newest-wins reads over an operation log, string ids, and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..types import FIRST_STRING_ID, signed


def newest(ops: DataFrame, by: tuple[str, ...] = ("id",), order: str = "seq") -> DataFrame:
    """The last operation of every id, deletes included. Spark drops older ones before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return ops.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def live(ops: DataFrame, by: tuple[str, ...] = ("id",), order: str = "seq") -> DataFrame:
    """The records that stand: last operations that aren't deletes."""
    return newest(ops, by, order).where("op = 'upsert'")


def overlaid(base: DataFrame, tail: DataFrame, tail_rows: int, most: int = 100_000) -> DataFrame:
    """live over a base whose ids are unique and a newer tail: the base without the tail's ids, and the tail's records.
    A tail of up to ``most`` rows is sent to all tasks and the base isn't shuffled; a longer one is joined."""
    last = newest(tail)
    ids = last.select("id")
    ids = F.broadcast(ids) if tail_rows <= most else ids
    return base.where("op = 'upsert'").join(ids, "id", "left_anti").unionByName(last.where("op = 'upsert'"))


def stacked(sources: list[tuple[DataFrame, int]], most: int = 100_000) -> DataFrame:
    """live over sources with unique ids, the newest first, each with its number of rows: of every source what no newer
    one has. Only ids of newer sources meet a source's rows: up to ``most`` of them are sent to all tasks, so a large
    old source under small new ones isn't shuffled; more are joined."""
    out, ids, n = None, None, 0
    for rows, size in sources:
        own = rows.where("op = 'upsert'")
        if ids is not None:
            own = own.join(F.broadcast(ids) if n <= most else ids, "id", "left_anti")
        out = own if out is None else out.unionByName(own)
        ids = rows.select("id") if ids is None else ids.unionByName(rows.select("id"))
        n += size
    return out


def deleted(ops: DataFrame) -> DataFrame:
    return newest(ops).where("op = 'delete'")


def live_count(ops: DataFrame) -> DataFrame:
    return live(ops).agg(F.count(F.lit(1)).alias("len"))


def string_ids(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The dictionary of string ids: names in order of first appearance, numbered from 2**63 on (as signed longs).

    Numbers come from offsets of sorted partitions, not from one task: names are counted in each partition of a range
    sort, and the counts' running sum is joined back.
    """
    first = rows.groupBy(name).agg(F.min(order).alias("_first"))
    dealt = first.orderBy("_first", name).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_low"))
    # one row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_low", "_before")
    place = F.col("_before") + F.col("_m") - F.col("_low")
    return dealt.join(F.broadcast(before), "_p").select(F.col(name), (F.lit(signed(FIRST_STRING_ID)) + place).alias("id"))


def memory_bytes(ops: DataFrame, vector: str = "vector", meta: str = "meta") -> DataFrame:
    """Bytes that records take in memory: 4 for each number of a vector, keys and text by their length, 8 for other
    values."""
    each = F.aggregate(
        F.map_entries(meta), F.lit(0).cast("long"), lambda s, e: s + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]["s"]), F.lit(8))
    )
    return ops.agg(F.coalesce(F.sum(F.size(vector) * 4 + F.coalesce(each, F.lit(0))), F.lit(0)).cast("long").alias("bytes"))


def segment_stats(rows: DataFrame) -> DataFrame:
    """Records and tombstones of every segment."""
    return rows.groupBy("seg_id").agg(F.sum(F.when(F.col("op") == "upsert", 1).otherwise(0)).cast("long").alias("record_count"), F.sum(F.when(F.col("op") == "delete", 1).otherwise(0)).cast("long").alias("tombstone_count"))


def merge_run(rows: DataFrame, older_remain: bool) -> DataFrame:
    """A run of segments as one: the last operation of every id; tombstones stay only while older segments remain."""
    last = newest(rows)
    return last if older_remain else last.where("op = 'upsert'")

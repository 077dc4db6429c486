"""Exact nearest neighbours: one query, many queries, and recall."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics
from ..types import check_metric
from .filters import Filter, MapSource, Source

#: Numbers in one block of queries that is sent to all tasks, and in one matrix of a task's distances.
BLOCK_NUMBERS = 4_000_000


def ranked(df: DataFrame, key: str = "key", id_col: str = "id") -> DataFrame:
    """A column rank, from 1, over at most k rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(key, *metrics.id_order(id_col))))


def nearest(df: DataFrame, query: Sequence[float] | Column, k: int, metric: str, filter: Filter | None = None, source: Source | None = None, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """The k rows nearest to query: rank, id and score. Vectors and query must have length 1 for cosine.

    Only ids, keys and what the filter needs are read; Spark keeps k rows of each partition and merges those.
    """
    q = query if isinstance(query, Column) else metrics.literal(query)
    rows = df if filter is None else df.where(filter.where(source or MapSource()))
    rows = rows.select(F.col(id_col).alias("id"), metrics.key(metric, F.col(vector), q).alias("key"))
    top = rows.orderBy("key", *metrics.id_order("id")).limit(k)
    return ranked(top).select("rank", "id", metrics.score(metric, F.col("key")).alias("score"))


def with_rows(hits: DataFrame, df: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Columns of the hit rows, fetched after the search."""
    rows = df.select(F.col(id_col).alias("id"), *columns)
    # hits holds at most k rows
    return rows.join(F.broadcast(hits), "id").select(*hits.columns, *columns)


def nearest_of_each(queries: DataFrame, base: DataFrame, k: int, metric: str, query_id: str = "qid", id_col: str = "id", vector: str = "vector") -> DataFrame:
    """For every query its k nearest rows: qid, rank, id, score.

    Queries go to all tasks in blocks of a bounded size; each task multiplies its rows by a block and keeps what may be
    among the k nearest there, with keys computed once more in the order of the array; Spark ranks those.
    """
    check_metric(metric)
    q = queries.select(F.col(query_id).alias("qid"), metrics.doubles(F.col(vector)).alias("v"))
    out = None
    for ids, matrix in _blocks(q):
        part = _block_nearest(base, ids, matrix, k, metric, id_col, vector)
        out = part if out is None else out.unionByName(part)
    if out is None:
        spark = base.sparkSession
        return spark.createDataFrame([], T.StructType([T.StructField("qid", queries.schema[query_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField("id", base.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
    w = Window.partitionBy("qid").orderBy("key", *metrics.id_order("id"))
    best = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("qid", "rank", "id", metrics.score(metric, F.col("key")).alias("score"))


def _blocks(q: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows, held = [], [], 0
    for r in q.toLocalIterator():
        ids.append(r["qid"])
        rows.append(r["v"])
        held += len(r["v"])
        if held >= BLOCK_NUMBERS:
            yield np.array(ids), np.array(rows, float)
            ids, rows, held = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, float)


def exact_keys(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Keys of row pairs, summed in the order of the array."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        if metric == "l2":
            t = x[:, d] - q[:, d]
            total = total + t * t
        else:
            total = total + x[:, d] * q[:, d]
    return total if metric == "l2" else -total


def _block_nearest(base: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, metric: str, id_col: str, vector: str) -> DataFrame:
    squares = (matrix * matrix).sum(axis=1)
    schema = "qid long, id long, key double"
    together = max(1, BLOCK_NUMBERS // max(len(matrix), matrix.shape[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not k:
                continue
            for at in range(0, len(b), together):
                own = b["id"].to_numpy(np.int64)[at : at + together]
                x = np.stack(b["v"].to_numpy()[at : at + together]).astype(float)
                near = -(x @ matrix.T)
                if metric == "l2":
                    near = squares + (x * x).sum(axis=1)[:, None] + 2 * near
                n = min(k, len(x))
                edge = np.partition(near, n - 1, axis=0)[n - 1]
                # products in another order may differ in the last digits: keep a margin
                margin = 1e-9 * (1 + squares + (x * x).sum(axis=1).max())
                r, c = np.nonzero(near <= edge + margin)
                yield pd.DataFrame({"qid": ids[c], "id": own[r], "key": exact_keys(x[r], matrix[c], metric)})

    rows = base.select(F.col(id_col).cast("long").alias("id"), metrics.doubles(F.col(vector)).alias("v"))
    return rows.mapInPandas(run, schema)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the share of true neighbours (qid, id) that were found."""
    marked = found.select("qid", "id").distinct().withColumn("_hit", F.lit(1))
    both = truth.select("qid", "id").join(marked, ["qid", "id"], "left")
    return both.agg((F.count("_hit") / (F.count_distinct("qid") * F.lit(k))).alias("recall"))

"""8-bit scalar quantisation with one range for a whole table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import check_metric
from .metrics import doubles


@dataclass(frozen=True)
class Range:
    low: float = 0.0
    high: float = 1.0

    @property
    def scale(self) -> float:
        s = (self.high - self.low) / 255.0
        return s if s > 0 else 1.0


def fit(df: DataFrame, vector: str = "vector") -> Range:
    """The smallest and largest number of all vectors; (0, 1) for an empty table."""
    v = doubles(F.col(vector))
    r = df.agg(F.min(F.array_min(v)).alias("low"), F.max(F.array_max(v)).alias("high")).first()
    return Range() if r is None or r["low"] is None else Range(float(r["low"]), float(r["high"]))


def fit_columns(df: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: low, high and scale."""
    v = doubles(F.col(vector))
    out = df.agg(F.coalesce(F.min(F.array_min(v)), F.lit(0.0)).alias("low"), F.coalesce(F.max(F.array_max(v)), F.lit(1.0)).alias("high"))
    width = (F.col("high") - F.col("low")) / 255.0
    return out.withColumn("scale", F.when(width > 0, width).otherwise(F.lit(1.0)))


def quantise(v: Column, r: Range) -> Column:
    """Codes 0 to 255."""
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x - F.lit(r.low)) / F.lit(r.scale)).cast("int"))))


def codes(v: list[float], r: Range) -> list[int]:
    """The same for one vector on the driver; halves are rounded away from zero."""
    import math

    return [max(0, min(255, math.floor(abs(t) + 0.5) * (1 if t >= 0 else -1))) for t in ((x - r.low) / r.scale for x in v)]


def code_matrix(x: np.ndarray, r: Range) -> np.ndarray:
    """Codes of a matrix of vectors."""
    t = (x - r.low) / r.scale
    return np.clip(np.copysign(np.floor(np.abs(t) + 0.5), t), 0, 255).astype(np.uint8)


def keys_of_codes(codes: np.ndarray, q: np.ndarray, r: Range, metric: str) -> np.ndarray:
    """Ranking keys of rows of codes against one row of codes, from sums of whole numbers."""
    c, own = codes.astype(np.int64), q.astype(np.int64)
    if check_metric(metric) == "l2":
        d = c - own
        return r.scale * r.scale * np.einsum("ij,ij->i", d, d)
    return -(c.shape[1] * r.low * r.low + r.low * r.scale * (c.sum(axis=1) + own.sum()) + r.scale * r.scale * (c @ own))


def keys_of_pairs(codes: np.ndarray, q: np.ndarray, r: Range, metric: str) -> np.ndarray:
    """Ranking keys of rows of codes against the rows of codes beside them; doubles hold the sums exactly."""
    c, own = codes.astype(float), q.astype(float)
    if check_metric(metric) == "l2":
        d = c - own
        return r.scale * r.scale * np.einsum("ij,ij->i", d, d)
    return -(c.shape[1] * r.low * r.low + r.low * r.scale * (c.sum(axis=1) + own.sum(axis=1)) + r.scale * r.scale * np.einsum("ij,ij->i", c, own))


def _whole(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)


def l2_sum(a: Column, b: Column) -> Column:
    return _whole(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")))


def dot_sum(a: Column, b: Column) -> Column:
    return _whole(F.zip_with(a, b, lambda x, y: (x * y).cast("long")))


def code_sum(a: Column) -> Column:
    return _whole(F.transform(a, lambda x: x.cast("long")))


def key(metric: str, a: Column, b: Column, r: Range, dim: int) -> Column:
    """The ranking key that two code vectors stand for."""
    s, low = F.lit(r.scale), F.lit(r.low)
    if check_metric(metric) == "l2":
        return s * s * l2_sum(a, b).cast("double")
    return -(F.lit(float(dim)) * low * low + low * s * (code_sum(a) + code_sum(b)).cast("double") + s * s * dot_sum(a, b).cast("double"))

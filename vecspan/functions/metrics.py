"""Distances and scores as Spark columns.

Sums run over doubles in the order of the array, so results are the same on any cluster. A *key* is smaller for nearer
vectors whatever the metric; a *score* is what users see: the Euclidean distance, or a similarity.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidVector
from ..types import check_metric


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v: Sequence[float]) -> Column:
    """A query vector as an array literal."""
    return F.array(*[F.lit(float(x)) for x in v]) if len(v) else F.array().cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """v at length 1; null where it has no direction."""
    n = norm(v)
    usable = (n > 0) & ~F.isnan(n) & (n != F.lit(math.inf))
    return F.when(usable, F.transform(doubles(v), lambda x: x * (F.lit(1.0) / n)))


def needs_normalising(metric: str) -> bool:
    return check_metric(metric) == "cosine"


def key(metric: str, a: Column, b: Column) -> Column:
    """Ranking key. For cosine both sides must have length 1."""
    return l2_squared(a, b) if check_metric(metric) == "l2" else -dot(a, b)


def score(metric: str, key: Column) -> Column:
    return F.sqrt(key) if check_metric(metric) == "l2" else -key


def key_of_score(metric: str, score: Column) -> Column:
    return score * score if check_metric(metric) == "l2" else -score


def finite(v: Column) -> Column:
    return ~F.exists(doubles(v), lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == F.lit(math.inf)))


def valid(v: Column, dim: int, metric: str) -> Column:
    """Whether a vector can be stored: its length, all numbers finite, and a direction for cosine."""
    ok = F.coalesce((F.size(v) == dim) & finite(v), F.lit(False))
    return ok & F.coalesce(norm(v) > 0, F.lit(False)) if needs_normalising(metric) else ok


def prepared(v: Sequence[float], dim: int, metric: str) -> list[float]:
    """A checked query or record vector, at length 1 for cosine."""
    v = [float(x) for x in v]
    if len(v) != dim:
        raise DimensionMismatch(dim, len(v))
    if not all(map(math.isfinite, v)):
        raise InvalidVector("numbers must be finite")
    if not needs_normalising(metric):
        return v
    total = 0.0
    for x in v:
        total += x * x
    if not total > 0 or not math.isfinite(total):
        raise InvalidVector("a zero vector has no direction")
    inverse = 1.0 / math.sqrt(total)
    return [x * inverse for x in v]


def percentiles(df, column: str, shares: Sequence[float] = (0.5, 0.99, 0.999)):
    """One row: the number of values, their nearest-rank percentiles (p50, p99, p99_9, ...) and the largest.

    Values are counted first, so the sort is of distinct values; a rank is found by running counts of ranges of them.
    """
    name = lambda s: "p" + f"{100 * s:g}".replace(".", "_")
    exact = [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY `{column}`)").alias(name(s)) for s in shares]
    return df.agg(F.count(column).alias("n"), *exact, F.max(column).alias("max"))


def id_order(c: str | Column) -> list[Column]:
    """Sort columns for ids in unsigned order."""
    c = F.col(c) if isinstance(c, str) else c
    return [c < 0, c]

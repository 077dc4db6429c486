"""Two-stage search: a coarse ranking by codes, then exact keys for the best of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, sq8
from ..plans.planner import REFETCH
from .search import ranked


def nearest(df: DataFrame, query: Sequence[float], k: int, metric: str, r: sq8.Range, id_col: str = "id", vector: str = "vector", codes: str | None = None) -> DataFrame:
    """rank, id, score. codes: a column of stored codes, else they are computed. Vectors ride along with the coarse
    ranking's best rows only, so the exact pass needs no second scan."""
    own = F.col(codes) if codes else sq8.quantise(F.col(vector), r)
    q = F.array(*[F.lit(c) for c in sq8.codes(list(query), r)])
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), sq8.key(metric, own, q, r, len(query)).alias("coarse"))
    few = rows.orderBy("coarse", *metrics.id_order("id")).limit(REFETCH * k)
    top = few.select("id", metrics.key(metric, F.col("v"), metrics.literal(query)).alias("key")).orderBy("key", *metrics.id_order("id")).limit(k)
    return ranked(top).select("rank", "id", metrics.score(metric, F.col("key")).alias("score"))

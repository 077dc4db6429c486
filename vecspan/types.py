"""Schemas, record identifiers, metadata values and options."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from .errors import InvalidConfig

#: Internal ids of string-keyed records start here, above every numeric id.
FIRST_STRING_ID = 1 << 63
#: The reserved metadata key that holds a record's string id.
EXT_ID = "_ext_id"

META_VALUE = T.StructType([T.StructField("s", T.StringType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("b", T.BooleanType())])
META = T.MapType(T.StringType(), META_VALUE)
VECTOR = T.ArrayType(T.FloatType())
RECORDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", VECTOR), T.StructField("meta", META)])
OPLOG = T.StructType(
    [
        T.StructField("collection_id", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", T.LongType()),
        T.StructField("vector", VECTOR), T.StructField("meta", META),
    ]
)
METRICS = ("l2", "cosine", "dot")

Scalar = str | int | float | bool


def signed(unsigned: int) -> int:
    """An unsigned 64-bit id as Spark's signed long."""
    return unsigned - (1 << 64) if unsigned >= 1 << 63 else unsigned


def unsigned(stored: int) -> int:
    return stored & 0xFFFFFFFFFFFFFFFF


def meta_value(v: Any) -> dict:
    """A scalar as the tagged struct; whole numbers beyond 64 bits become floating ones."""
    out: dict[str, Any] = {"s": None, "i": None, "f": None, "b": None}
    if isinstance(v, bool):
        out["b"] = v
    elif isinstance(v, str):
        out["s"] = v
    elif isinstance(v, int):
        if -(1 << 63) <= v < 1 << 63:
            out["i"] = v
        else:
            out["f"] = float(v)
    elif isinstance(v, float):
        out["f"] = v
    else:
        raise InvalidConfig(f"metadata holds text, numbers and booleans, not {type(v).__name__}")
    return out


def plain_value(tagged: Any) -> Scalar:
    """The scalar in a tagged struct (a Row or dict)."""
    for k in ("s", "i", "f", "b"):
        if tagged[k] is not None:
            return tagged[k]
    raise InvalidConfig("an empty metadata value")


def meta_struct(meta: Mapping[str, Any] | None) -> dict[str, dict]:
    return {str(k): meta_value(v) for k, v in sorted((meta or {}).items())}


def plain_meta(meta: Mapping[str, Any] | None) -> dict[str, Scalar]:
    return {k: plain_value(v) for k, v in sorted((meta or {}).items())}


def record_id(x: Any) -> int | str:
    """A numeric id below 2**63, or a string."""
    if isinstance(x, bool) or not isinstance(x, int | str):
        raise InvalidConfig("an id is a whole number or text")
    if isinstance(x, int) and not 0 <= x < 1 << 63:
        raise InvalidConfig("numeric ids lie between 0 and 2**63")
    return x


def path_id(text: str) -> int | str:
    """An id in a path: a number where it reads as an unsigned 64-bit one."""
    return int(text) if text.isascii() and text.isdigit() and int(text) < 1 << 64 else text


@dataclass(frozen=True)
class Record:
    id: int | str
    vector: list[float]
    meta: dict[str, Scalar] = field(default_factory=dict)


@dataclass(frozen=True)
class Hit:
    id: int
    score: float
    meta: dict[str, Scalar]

    @property
    def ext_id(self) -> str | None:
        v = self.meta.get(EXT_ID)
        return v if isinstance(v, str) else None

    def as_json(self) -> dict:
        return {"id": self.id, "ext_id": self.ext_id, "score": self.score, "meta": {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in self.meta.items()}}


@dataclass(frozen=True)
class HnswParams:
    m: int = 16
    m0: int = 32
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 0
    extend_candidates: bool = True

    def __post_init__(self):
        if self.m < 2 or self.m0 < 1:
            raise InvalidConfig("m is at least 2 and m0 at least 1")
        if self.ef_construction < 1 or self.ef_search < 1:
            raise InvalidConfig("ef_construction and ef_search are at least 1")


@dataclass(frozen=True)
class Options:
    """Runtime options; they are never stored with the data. sync: "always", ("every", n) or "batch"; all three mean
    that a write is visible, whole, once its file has been renamed into place. background: flushes and compactions run in
    a thread beside the writes."""

    sync: str | tuple[str, int] = "always"
    flush_threshold_bytes: int = 64 << 20
    hnsw: HnswParams = HnswParams()
    hnsw_min_rows: int = 1024
    compaction_threshold: int = 4
    sq8: bool = False
    background: bool = False

    def __post_init__(self):
        if self.flush_threshold_bytes <= 0:
            raise InvalidConfig("flush_threshold_bytes is above 0")
        if self.compaction_threshold < 2:
            raise InvalidConfig("compaction_threshold is at least 2")
        if self.sync not in ("always", "batch") and not (isinstance(self.sync, tuple) and len(self.sync) == 2 and self.sync[0] == "every" and self.sync[1] > 0):
            raise InvalidConfig('sync is "always", "batch" or ("every", n) with n above 0')


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise InvalidConfig(f"unknown metric: {metric}")
    return metric


def floats(v: Iterable[Any]) -> list[float]:
    """A vector from a list, tuple or numpy array."""
    return [float(x) for x in (v.tolist() if hasattr(v, "tolist") else v)]

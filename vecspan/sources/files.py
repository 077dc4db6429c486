"""Readers and writers for records: JSON lines, ``.fvecs``/``.ivecs`` and arrays."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import Corrupted, InvalidConfig
from ..types import META, Record, floats, meta_struct, record_id


def record_of(data: Any) -> Record:
    """A record from its JSON form: {"id": 1 or "a", "vector": [...], "meta": {...}}."""
    if not isinstance(data, dict) or "id" not in data or not isinstance(data.get("vector"), list):
        raise InvalidConfig('a record is an object with "id" and "vector"')
    meta = data.get("meta") or {}
    if not isinstance(meta, dict):
        raise InvalidConfig("meta is an object")
    meta_struct(meta)
    if not all(isinstance(x, int | float) and not isinstance(x, bool) for x in data["vector"]):
        raise InvalidConfig("a vector is a list of numbers")
    return Record(record_id(data["id"]), floats(data["vector"]), meta)


def json_lines(lines: Iterable[str], batch: int = 1000) -> Iterator[list[Record]]:
    """Batches of records; blank lines are passed over."""
    held: list[Record] = []
    for line in lines:
        if not line.strip():
            continue
        try:
            held.append(record_of(json.loads(line)))
        except json.JSONDecodeError as e:
            raise InvalidConfig(f"not JSON: {e}") from e
        if len(held) >= batch:
            yield held
            held = []
    if held:
        yield held


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """key (string), numeric (whether the id is a number), vector, meta. Lines become variants, in which every value keeps
    its kind; whole numbers beyond 64 bits become floating ones. A blank line is passed over, a line that isn't JSON or
    has no id fails the read."""
    whole = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"), "value")
    kind = F.schema_of_variant(F.variant_get("v", "$.id", "variant"))
    fields = F.from_json(F.get_json_object("value", "$.meta"), "map<string,variant>")

    def tagged(_, v):
        is_a = F.schema_of_variant(v)
        number = v.cast("double")
        return F.struct(
            F.when(is_a == "STRING", v.cast("string")).alias("s"), F.when(is_a == "BIGINT", v.cast("bigint")).alias("i"),
            F.when((is_a == "DOUBLE") | is_a.startswith("DECIMAL"), number).alias("f"), F.when(is_a == "BOOLEAN", v.cast("boolean")).alias("b"),
        )

    key = F.variant_get("v", "$.id", "string")
    return whole.select(
        F.when(key.isNull(), F.raise_error(F.lit("a line without an id"))).otherwise(key).alias("key"), (kind == "BIGINT").alias("numeric"), F.variant_get("v", "$.vector", "array<float>").alias("vector"),
        F.coalesce(F.transform_values(fields, tagged), F.create_map().cast(META)).alias("meta"),
    )


def hits_json(hits: DataFrame) -> DataFrame:
    """One column, value: each hit as a JSON object."""
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("value"))


def from_arrays(spark: SparkSession, ids: Sequence[int], vectors: np.ndarray | Sequence[Sequence[float]]) -> DataFrame:
    """id, vector and empty metadata from a matrix, through Arrow."""
    x = np.asarray(vectors, np.float32)
    if x.ndim != 2 or len(x) != len(ids):
        raise InvalidConfig("vectors are a matrix with a row for each id")
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)[: len(x) + 1]), pa.array(x.ravel()))
    t = pa.table({"id": pa.array(list(ids), pa.int64()), "vector": column})
    return spark.createDataFrame(t).withColumn("meta", F.create_map().cast(META))


def write_vecs(df: DataFrame, path: str, kind: str = "fvecs") -> None:
    """Vectors (id, vector) in the order of ids as a folder of .fvecs or .ivecs files, one for each task, which the reader
    takes as one. The folder is on a file system that driver and executors share."""
    os.makedirs(path)
    form = "<f4" if kind == "fvecs" else "<i4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        tmp = f"{path}/.{part}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            for b in batches:
                for v in b.column("vector").to_pylist():
                    f.write(np.int32(len(v)).tobytes() + np.array(v, form).tobytes())
                    n += 1
        # a task that runs again replaces its file
        os.replace(tmp, f"{path}/part-{part:08d}.{kind}") if n else os.unlink(tmp)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.select("id", "vector").orderBy("id").mapInArrow(run, "n long").agg(F.sum("n")).collect()


class _Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int, before: int):
        super().__init__((path, start, stop, before))
        self.path, self.start, self.stop, self.before = path, start, stop, before


class VecsReader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.path = options.get("path", "")
        self.limit = int(options.get("limit", -1))
        self.rows = int(options.get("rowsperpartition", 50_000))
        self.kind = kind

    @staticmethod
    def _shape(path: str) -> tuple[int, int]:
        size = os.path.getsize(path)
        if not size:
            return 0, 0
        with open(path, "rb") as f:
            dim = int(np.frombuffer(f.read(4), "<i4")[0])
        if dim <= 0 or size % (4 + 4 * dim):
            raise Corrupted(f"{path} isn't a file of vectors of {dim} numbers")
        return dim, size // (4 + 4 * dim)

    def partitions(self) -> list[_Part]:
        path = self.path.removeprefix("file://")
        found = sorted(f"{path}/{x}" for x in os.listdir(path) if not x.startswith((".", "_"))) if os.path.isdir(path) else [path]
        out, before = [], 0
        for p in found:
            _, n = self._shape(p)
            n = n if self.limit < 0 else max(0, min(n, self.limit - before))
            out += [_Part(p, s, min(s + self.rows, n), before) for s in range(0, n, self.rows)]
            before += n
        return out or [_Part(path, 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.start == partition.stop:
            return
        dim, _ = self._shape(partition.path)
        width = 4 + 4 * dim
        with open(partition.path, "rb") as f:
            f.seek(partition.start * width)
            data = np.frombuffer(f.read((partition.stop - partition.start) * width), "<i4").reshape(-1, dim + 1)
        if (data[:, 0] != dim).any():
            raise Corrupted(f"vectors of different lengths in {partition.path}")
        values = data[:, 1:].copy().view("<f4" if self.kind == "fvecs" else "<i4")
        for k, row in enumerate(values.tolist(), partition.before + partition.start):
            yield k, row


class FvecsSource(DataSource):
    """spark.read.format("fvecs").load(path): id from 0 and vector. Options: limit, rowsPerPartition."""

    kind = "fvecs"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType() if self.kind == "fvecs" else T.IntegerType()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return VecsReader(self.options, self.kind)


class IvecsSource(FvecsSource):
    kind = "ivecs"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)

"""Shared helpers: durable intermediate tables, row keys and word arithmetic on numpy byte arrays."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract of this package: space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]"
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session whose driver and executors are one process may do
    without one (tests); elsewhere a local folder would lose rows, so an error is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vecspan-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/vecspan/{name}-{uuid.uuid4().hex}"
    out = df.write if codec is None else df.write.option("compression", codec)
    out.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._vecspan_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Removes the files of materialised tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_vecspan_path", None)
        if not path:
            continue
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Arrow batches to Python end at this many bytes, so that rows of any length take bounded memory.
ARROW_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's limit of bytes for an Arrow batch, unless the session has one of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, ARROW_BYTES)


def release() -> None:
    """Gives a Python worker's free memory back to the system; Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run: Callable) -> Callable:
    """run (batches to batches, or tables to a table) that releases memory at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two non-null longs that tell rows apart: repeated rows (same id, same text) share a key and so a result."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("kd"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("kh")


_POWER_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, _kept: dict = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_kept["p"]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(_POWER_BASE), -1, 1 << 64))
        for k, base in (("p", _POWER_BASE), ("i", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _kept[k] = np.multiply.accumulate(steps)
    return _kept["p"], _kept["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of one text as spans over its bytes with every white-space run as one space.

    ``hashes(k)`` gives a 64-bit hash of every run of k consecutive words from one prefix sum, so the cost
    doesn't depend on k.
    """

    def __init__(self, text: str | None, lower: bool = False):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if lower:
            raw = _LOWER[raw]
        space = _SPACE[raw]
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        if len(raw) and space[0]:
            keep[0] = False
        data, at = raw[keep], space[keep]
        if len(data) and at[-1]:
            data, at = data[:-1], at[:-1]
        if len(data):
            data = np.where(at, np.uint8(32), data)
            gaps = np.flatnonzero(at)
            self.starts = np.concatenate([[0], gaps + 1])
            self.ends = np.concatenate([gaps, [len(data)]])
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.data = data
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, k: int) -> np.ndarray:
        n = len(self) - k + 1
        if n <= 0 or k <= 0:
            return np.zeros(0, np.uint64)
        p, i = _powers(len(self.data) + 1)
        if self._sums is None:
            values = (self.data.astype(np.uint64) + np.uint64(1)) * p[: len(self.data)]
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        s, e = self.starts[:n], self.ends[k - 1 :]
        return mix((self._sums[e] - self._sums[s]) * i[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def digests(self, k: int) -> np.ndarray:
        """A second 64-bit hash of every run of k words, of the words' hashes instead of the bytes: with the first one
        128 bits tell runs apart."""
        n = len(self) - k + 1
        if n <= 0 or k <= 0:
            return np.zeros(0, np.uint64)
        p, i = _powers(len(self) + 1)
        values = mix(self.hashes(1) ^ np.uint64(0x6A09E667F3BCC909)) * p[: len(self)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        at = np.arange(n)
        return mix((sums[at + k] - sums[at]) * i[at])

    def text(self, first: int, n: int) -> str:
        """n words from the first on, with one space between them."""
        return self.data[self.starts[first] : self.ends[first + n - 1]].tobytes().decode("utf-8", "surrogatepass")

    def join(self, keep: np.ndarray) -> bytes:
        """The kept words joined by one space."""
        if keep.all():
            return self.data.tobytes()
        mask = np.zeros(len(self.data) + 1, np.int8)
        s, e = self.starts[keep], self.ends[keep]
        np.add.at(mask, s, 1)
        np.add.at(mask, np.minimum(e + 1, len(self.data)), -1)
        out = self.data[np.cumsum(mask[:-1]).astype(bool)].tobytes()
        return out[:-1] if out and len(e) and e[-1] < len(self.data) else out

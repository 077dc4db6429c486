"""Which hashed items of a corpus occur more than once: one shuffle of packed arrays, pre-aggregated in every batch.

Each task hashes the items of its texts in batches of a bounded number of bytes. Items that a batch has twice are known
to recur, and only one entry of them goes on, so no item, however common, sends more than one entry from a batch. The
other entries go to a bucket by the upper bits of their hashes; buckets are of equal size whatever the data, and their
number follows the bytes of the texts. A bucket answers every batch, and the answers meet the batch's own keys again.
Memory is bounded by a bucket or a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, releasing

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
BATCH_ROWS = 60_000
_NOBODY = 65535
_SENT = "bucket int, batch long, info boolean, a binary, b binary, c binary, d binary, e binary"
_BACK = "batch long, info boolean, a binary, b binary, c binary, d binary, e binary"

#: From one row's values: hashes, their positions or None, whole numbers to keep with the row, and with ``wide`` second
#: hashes of the same items.
Items = Callable[..., tuple]


def text_bytes(df: DataFrame, text_col: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0)


def buckets_for(df: DataFrame, n_bytes: int = 0) -> int:
    """Two for each shuffle partition, or more where the texts have so many bytes that buckets would grow too large."""
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))


def _order(h: np.ndarray, h2: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Items sorted, and which of the sorted ones differ from the one before. Second hashes are compared where first
    ones agree."""
    order = np.argsort(h, kind="stable")
    first = np.ones(len(h), bool)
    first[1:] = h[order][1:] != h[order][:-1]
    if h2 is not None and len(h):
        other = np.ones(len(h), bool)
        other[1:] = h2[order][1:] != h2[order][:-1]
        if (other & ~first).any():
            order = np.lexsort((h2, h))
            first[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    return order, first


def batches_of(rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield held
            held, total = [], 0
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in names], strict=True)


def _table(schema: str, rows: list[tuple]) -> list:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]


def _forward(names: list[str], items: Items, buckets: int, wide: bool) -> Callable:
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for ordinal, rows in enumerate(batches_of(_rows(batches, names), lambda r: len(r[1] or "") + 64)):
            name = task << 32 | ordinal
            found = [items(*r[1:]) for r in rows]
            sizes = [len(f[0]) for f in found]
            h = np.concatenate([f[0] for f in found])
            idx = np.repeat(np.arange(len(rows), dtype=np.uint16), sizes)
            pos = np.concatenate([f[1] for f in found]).astype(np.uint32) if found[0][1] is not None else np.zeros(0, np.uint32)
            h2 = np.concatenate([f[3] for f in found]) if wide else None
            order, first = _order(h, h2)
            starts = np.flatnonzero(first)
            count = np.diff(np.append(starts, len(h)))
            again = np.repeat(count > 1, count)
            known = np.sort(order[again])
            # what occurs once here, and of what occurs more often one entry that nobody asks for
            send = np.concatenate([order[~again], order[starts[count > 1]]])
            owner = idx[send].copy()
            owner[len(send) - int((count > 1).sum()) :] = _NOBODY
            bucket = ((h[send] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            by = np.lexsort((send, bucket))
            send, owner, bucket = send[by], owner[by], bucket[by]
            keys = np.array([r[0] for r in rows], np.int64)
            extras = np.array([f[2] for f in found], np.int64)
            out = [(name % buckets, name, True, keys.tobytes(), extras.tobytes(), idx[known].tobytes(), (pos[known] if len(pos) else pos).tobytes(), None)]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            values = h if wide else h.astype(np.uint32)
            for k in range(buckets):
                s, e = cuts[k], cuts[k + 1]
                if s < e:
                    out.append((k, name, False, values[send[s:e]].tobytes(), owner[s:e].tobytes(), (pos[send[s:e]] if len(pos) else pos).tobytes(), h2[send[s:e]].tobytes() if wide else None, None))
            yield pa.RecordBatch.from_arrays(*_table(_SENT, out))

    return run


def _answer(wide: bool, positions: bool) -> Callable:
    kind = np.uint64 if wide else np.uint32

    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*[t.column(c).to_pylist() for c in ("batch", "info", "a", "b", "c", "d", "e")], strict=True))
        asked = [r for r in rows if not r[1]]
        out = [r for r in rows if r[1]]
        if asked:
            h = np.concatenate([np.frombuffer(r[2], kind) for r in asked])
            order, first = _order(h, np.concatenate([np.frombuffer(r[5], kind) for r in asked]) if wide else None)
            same = ~first
            same[:-1] |= ~first[1:]
            recurs = np.empty(len(h), bool)
            recurs[order] = same
            at = 0
            for r in asked:
                owner = np.frombuffer(r[3], np.uint16)
                mine, at = recurs[at : at + len(owner)], at + len(owner)
                asks = owner != _NOBODY
                if positions:
                    take = asks & mine
                    if take.any():
                        out.append((r[0], False, owner[take].tobytes(), np.frombuffer(r[4], np.uint32)[take].tobytes(), None, None, None))
                else:
                    single = owner[asks & ~mine]
                    if len(single):
                        out.append((r[0], False, np.bincount(single).astype(np.uint32).tobytes(), None, None, None, None))
        return pa.Table.from_arrays(*_table(_BACK, out))

    return run


def _batch_parts(t: pa.Table, n_extras: int):
    rows = list(zip(*[t.column(c).to_pylist() for c in ("info", "a", "b", "c", "d")], strict=True))
    info = next(r for r in rows if r[0])
    keys = np.frombuffer(info[1], np.int64)
    extras = np.frombuffer(info[2], np.int64).reshape(len(keys), n_extras)
    return keys, extras, info, [r for r in rows if not r[0]]


def _sent(rows: DataFrame, items: Items, wide: bool, positions: bool, n_bytes: int) -> DataFrame:
    """rows: a long key and then the values that items takes, the text first."""
    buckets = buckets_for(rows, n_bytes)
    bound_batches(rows.sparkSession)
    sent = rows.mapInArrow(_forward(rows.columns, items, buckets, wide), _SENT)
    return sent.groupBy("bucket").applyInArrow(_answer(wide, positions), _BACK)


def count_single(rows: DataFrame, items: Items, extras: list[str], n_bytes: int = 0) -> DataFrame:
    """For every row its key, the extras, and ``single``: how many of its items no other row has. Items that agree in
    32 bits and the bucket count as equal, so single is at most the true number."""

    def merge(t: pa.Table) -> pa.Table:
        keys, numbers, _, answers = _batch_parts(t, len(extras))
        single = np.zeros(len(keys), np.int64)
        for r in answers:
            c = np.frombuffer(r[1], np.uint32)
            single[: len(c)] += c
        return pa.Table.from_arrays([pa.array(keys), *[pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(len(extras))], pa.array(single)], names=["key", *extras, "single"])

    schema = ", ".join(f"{c} long" for c in ["key", *extras, "single"])
    return _sent(rows, items, False, False, n_bytes).groupBy("batch").applyInArrow(merge, schema)


def recurring(rows: DataFrame, items: Items, wide: bool, n_bytes: int = 0) -> DataFrame:
    """key and ``found`` (sorted unsigned 32-bit positions of recurring items) of the rows that have any; keys are
    distinct. With wide, items are told apart by 128 bits; without, a few positions of single items may be among them."""

    def merge(t: pa.Table) -> pa.Table:
        keys, _, info, answers = _batch_parts(t, 0)
        idx = np.concatenate([np.frombuffer(info[3], np.uint16), *[np.frombuffer(r[1], np.uint16) for r in answers]]).astype(np.int64)
        pos = np.concatenate([np.frombuffer(info[4], np.uint32), *[np.frombuffer(r[2], np.uint32) for r in answers]])
        order = np.lexsort((pos, idx))
        idx, pos = idx[order], pos[order]
        whose, starts = np.unique(idx, return_index=True)
        found = [x.tobytes() for x in np.split(pos, starts[1:])] if len(whose) else []
        return pa.Table.from_arrays([pa.array(keys[whose], pa.int64()), pa.array(found, pa.binary())], names=["key", "found"])

    return _sent(rows, items, wide, True, n_bytes).groupBy("batch").applyInArrow(merge, "key long, found binary")


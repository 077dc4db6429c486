"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of distinct words.

1. Python splits texts by the tokenizer's pattern. Rows are gathered into shards of a bounded number of bytes; a shard
   keeps its texts as numbers of its own distinct words, which go to buckets by a hash.
2. A bucket meets the words of all shards (of a slice of them, where there are very many), so that a word is folded once
   for the corpus and not once for each shard.
3. Spark folds the merges: a word is an array of pieces, one for each byte, beside the ranks of adjacent pairs; each step
   joins the leftmost pair of the lowest rank, looks up the ranks of the two pairs beside it and takes over the others by
   their places, until no pair has a rank. The ranks are a literal map: an array of small maps chosen by a hash, as Spark
   searches a map from end to end. (Two flat arrays of hashes and ranks in place of the maps took longer.)
4. The words' ids return to their shards, where the ids of a text are gathered by its words' numbers. The shards are a
   table bucketed by their number, so the texts stay where they are.

Decoding is Spark's too: the pieces of the ids, from a literal array, are concatenated.

A step costs a word's length, and so a fold its square. Words over ``LONG`` bytes, which only runs without any break have, are merged
by the same rule with a heap in Python, so every word is merged whole and equally.

Cases: null and empty texts have no ids; repeated rows have equal results; a byte sequence without a rank can't occur, as
every single byte has one; ids may be of any type; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, release, releasing, shared_dir

BUCKETS = 1 << 14
LONG = 1024
SHARD_BYTES = 8 << 20
GROUP_BYTES = 2 << 20
CHUNK = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of maps from byte strings (one Latin-1 letter for each byte) to ranks."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        maps[xxhash.xxh64_intdigest(text.encode(), seed=42) % BUCKETS][text] = rank  # Spark's xxhash64
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def piece_array(ranks: dict[bytes, int]) -> Column:
    """The pieces by rank as a literal, one Latin-1 letter for each byte."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def _bound(value: Column, use) -> Column:
    """use(value), computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encoded(word: Column, ranks: Column) -> Column:
    """The ids of a word (binary), by folding merges."""

    def rank(x: Column) -> Column:
        return F.try_element_at(F.get(ranks, F.xxhash64(x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), x)

    def paired(pieces: Column):  # the rank of the pair that begins at a place, null where it has none
        return lambda piece, i: rank(F.concat(piece, F.get(pieces, i + 1)))

    def state_of(pieces: Column, pairs: Column, open_: bool) -> Column:
        return F.struct(pieces.alias("pieces"), pairs.alias("pairs"), F.lit(open_).alias("open"))

    def step(state: Column, _: Column) -> Column:
        pieces, pairs = state["pieces"], state["pairs"]

        def merged(at: Column) -> Column:
            both = F.concat(F.get(pieces, at), F.get(pieces, at + 1))

            def renewed(new: Column) -> Column:
                own = lambda piece, i: F.when(i > at, F.get(pairs, i + 1)).when(i < at - 1, F.get(pairs, i)).otherwise(paired(new)(piece, i))
                return state_of(new, F.transform(new, own), True)

            return _bound(F.concat(F.slice(pieces, F.lit(1), at), F.array(both), F.slice(pieces, at + 3, F.size(pieces))), renewed)

        # the first of equal ranks is the leftmost pair
        lowest = lambda best: F.when(best.isNull(), state_of(pieces, pairs, False)).otherwise(_bound((F.array_position(pairs, best) - 1).cast("int"), merged))
        return F.when(state["open"], _bound(F.array_min(pairs), lowest)).otherwise(state)

    def folded(text: Column) -> Column:
        def whole(letters: Column) -> Column:
            steps = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
            return F.aggregate(steps, state_of(letters, F.transform(letters, paired(letters)), True), step, lambda state: F.transform(state["pieces"], rank))

        return _bound(F.slice(F.split(text, "", -1), F.lit(1), F.length(text)), whole)

    def one(text: Column) -> Column:
        return _bound(rank(text), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(folded(text)))

    return _bound(F.decode(word, "ISO-8859-1"), one)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, lowest rank first and leftmost among equals, for words of any length."""
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def push(a: int) -> None:
        b = nxt[a]
        if b < n and (r := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (r, a, end[b]))

    for a in range(n):
        push(a)
    while heap:
        _, a, e = heapq.heappop(heap)
        b = nxt[a] if alive[a] else n
        if b >= n or end[b] != e or end[a] != b:
            continue
        alive[b], end[a], nxt[a] = False, e, nxt[b]
        if nxt[b] < n:
            prev[nxt[b]] = a
        push(a)
        if prev[a] >= 0:
            push(prev[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = nxt[a]
    return out


class _Numbers(dict):
    """Numbers of words in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed with bytes of equal weight side by side."""
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def _with_firsts(flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words in the order of their first places → the same with 0 in first places and other numbers by falling
    frequency from 1, and each word's frequency rank: what is met first needs no number."""
    order = np.argsort(-np.bincount(flat, minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    coded = rank[flat] + 1
    coded[np.unique(flat, return_index=True)[1]] = 0
    return coded, rank


def _from_firsts(coded: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Frequency ranks of the words of a text."""
    out = coded - 1
    out[coded == 0] = rank
    return out


def _all(packed: pa.ChunkedArray) -> list[np.ndarray]:
    return [_unpacked(x) for x in packed.to_pylist()]


def _split(pattern: str, buckets: int):
    """doc_id, text → of each shard a row with its texts, as numbers of its words, and for each bucket one with the
    bucket's words and their numbers."""
    names = ["shard", "ids", "sizes", "numbers", "ranks", "long", "bucket", "words", "lengths", "at"]

    def shard_of(ids: list[pa.Array], found: list[np.ndarray], numbers: _Numbers, shard: int) -> Iterator[pa.RecordBatch]:
        own = pa.concat_arrays(ids)
        coded, rank = _with_firsts(np.concatenate(found), len(numbers))
        words = [b""] * len(rank)
        for w, k in zip(numbers, rank.tolist(), strict=True):
            words[k] = w.encode("utf-8", "surrogatepass")
        long = [{"at": k, "word": w} for k, w in enumerate(words) if len(w) > LONG]
        where = np.array([zlib.crc32(w) % buckets if len(w) <= LONG else buckets for w in words], np.int64)
        by = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[by], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        held: tuple[list, ...] = ([None], [None], [None])
        for k in full:
            at = by[cuts[k] : cuts[k + 1]]
            mine = [words[i] for i in at]
            held[0].append(pa.Codec("zstd").compress(b"".join(mine), asbytes=True))
            held[1].append(_packed(np.array([len(w) for w in mine])))
            held[2].append(_packed(np.diff(at, prepend=0)))
        n = len(full) + 1
        head = lambda x, kind: pa.array([x, *[None] * (n - 1)], kind)
        lists = pa.ListArray.from_arrays(pa.array([0] + [len(own)] * n, pa.int32()), own)
        sizes, marked = head([len(x) for x in found], pa.list_(pa.int64())), head(long, pa.list_(pa.struct([("at", pa.int64()), ("word", pa.binary())])))
        columns = [pa.array([shard] * n, pa.int64()), lists, sizes, head(_packed(coded), pa.binary()), head(_packed(rank), pa.binary()), marked, pa.array([None, *full], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.binary()) for x in held]], names=names)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words = regex.compile(pattern).findall
        shard, total = TaskContext.get().partitionId() << 32, 0
        ids, found, numbers = [], [], _Numbers()
        for b in batches:
            first = 0
            for row, text in enumerate(b.column("text").to_pylist()):
                found.append(np.array(list(map(numbers.__getitem__, words(text or ""))), np.uint32))
                total += len(text or "") + 64
                if total >= SHARD_BYTES:
                    ids.append(b.column("doc_id").slice(first, row + 1 - first))
                    yield from shard_of(ids, found, numbers, shard)
                    shard, total, first = shard + 1, 0, row + 1
                    ids, found, numbers = [], [], _Numbers()
            if first < b.num_rows:
                ids.append(b.column("doc_id").slice(first))
        if found:
            yield from shard_of(ids, found, numbers, shard)

    return run


def _distinct(t: pa.Table) -> pa.Table:
    """A bucket's words once each, in chunks, with the shards and places that ask for them."""
    parts, lengths = [], _all(t.column("lengths"))
    for data, n in zip(t.column("words").to_pylist(), lengths, strict=True):
        ends = np.append(0, np.cumsum(n)).astype(np.int32)
        parts.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.Codec("zstd").decompress(data, int(ends[-1]))]))
    found = pa.concat_arrays(parts).dictionary_encode()
    which = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    shards = np.repeat(t.column("shard").to_numpy(), [len(n) for n in lengths])
    at = np.concatenate([np.cumsum(x) for x in _all(t.column("at"))])
    order = np.lexsort((shards, which // CHUNK))
    which, shards, at = which[order], shards[order], at[order]
    starts = range(0, len(found.dictionary), CHUNK)
    cuts = np.searchsorted(which // CHUNK, np.arange(len(starts) + 1))
    cut = lambda x: pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in range(len(starts))], pa.binary())
    words = pa.ListArray.from_arrays(pa.array([*starts, len(found.dictionary)], pa.int32()), found.dictionary)
    return pa.table({"words": words, "which": cut((which % CHUNK).astype("<u4")), "shards": cut(shards.astype("<i8")), "at": cut(at.astype("<u4"))})


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@releasing
def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids (of a chunk's words), which, shards, at → for each shard the places and what stands there."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for row in range(b.num_rows):
            new = b.column("ids")[row].values
            ends = new.offsets.to_numpy().astype(np.int64)
            values = new.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = ends - ends[0]
            which, shards, at = (np.frombuffer(b.column(c)[row].as_py(), kind).astype(np.int64) for c, kind in (("which", "<u4"), ("shards", "<i8"), ("at", "<u4")))
            whose, first = np.unique(shards, return_index=True)
            for shard, s, e in zip(whose.tolist(), first, np.append(first[1:], len(shards)), strict=True):
                sizes = ends[which[s:e] + 1] - ends[which[s:e]]
                for x, v in zip(out, (shard, _packed(np.diff(at[s:e], prepend=0)), _packed(sizes), _packed(values[_ranges(ends[which[s:e]], sizes)])), strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["shard", "at", "sizes", "ids"])


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    """df written to the shared folder as a table bucketed by a column, which later needs no shuffle by it."""
    spark, name = df.sparkSession, f"vecspan_{uuid.uuid4().hex}"
    out = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("compression", "none")
    out.option("path", f"{shared_dir(spark)}/vecspan/{name}").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with keep_ids also ``ids``, an array of integers."""
    ranks = read_ranks(ranks_path)
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType().add("shard", "long").add("ids", T.ArrayType(kind)).add("sizes", T.ArrayType(T.LongType())).add("numbers", "binary").add("ranks", "binary")
    schema = schema.add("long", T.ArrayType(T.StructType().add("at", "long").add("word", "binary"))).add("bucket", "integer").add("words", "binary").add("lengths", "binary").add("at", "binary")
    cut = _bucketed(rows.mapInArrow(_split(pattern, buckets), schema), "shard")
    asked = cut.where(F.col("bucket").isNotNull())
    slices = max(1, -(-(asked.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0) // (buckets * GROUP_BYTES)))
    dealt = asked.select("bucket", F.pmod(F.xxhash64("shard"), F.lit(slices)).alias("slice"), "shard", "words", "lengths", "at")
    distinct = dealt.groupBy("bucket", "slice").applyInArrow(_distinct, "words array<binary>, which binary, shards binary, at binary")
    table = rank_map(ranks)
    # the map is bound once, so that the plan has one copy of it
    folded = distinct.select(_bound(table, lambda t: F.transform("words", lambda w: encoded(w, t))).alias("ids"), "which", "shards", "at")
    answers = folded.mapInArrow(_answers, "shard long, at binary, sizes binary, ids binary")
    final = T.StructType().add("doc_id", kind).add("n_tokens", "long").add("ids_sha256", "string").add("ids", T.ArrayType(T.IntegerType()))

    def gather(held: pa.Table, given: pa.Table) -> pa.Table:
        ids = held.column("ids").combine_chunks()
        own = ids.chunk(0).flatten() if isinstance(ids, pa.ChunkedArray) else ids.flatten()
        words, long = _from_firsts(*(_unpacked(held.column(c)[0].as_py()) for c in ("numbers", "ranks"))), held.column("long")[0].as_py()
        none = [np.zeros(0, np.int64)]
        at = np.concatenate(none + [np.cumsum(x) for x in _all(given.column("at"))])
        size, values = (np.concatenate(none + _all(given.column(c))) for c in ("sizes", "ids"))
        if long:
            merged = [merge_long(x["word"], ranks) for x in long]
            at, size = np.append(at, [x["at"] for x in long]), np.append(size, [len(x) for x in merged])
            values = np.append(values, np.concatenate(merged))
        starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[at], sizes[at] = np.cumsum(size) - size, size
        n = sizes[words]
        tokens = values[_ranges(starts[words], n)].astype("<u4") if len(words) else np.zeros(0, "<u4")
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(np.array(held.column("sizes")[0].as_py(), np.int64))])]
        data = tokens.tobytes()
        digests = [hashlib.sha256(data[4 * s : 4 * e]).hexdigest() for s, e in zip(ends[:-1], ends[1:], strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.astype(np.int32), pa.int32()))
        release()
        return pa.table({"doc_id": own, "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "ids": lists})

    texts = cut.where(F.col("bucket").isNull()).select("shard", "ids", "sizes", "numbers", "ranks", "long")
    out = texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(gather, final)
    out = out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(_decoded(F.col("ids"), piece_array(ranks)), 256).alias("decoded_sha256"), "ids")
    return out if keep_ids else out.drop("ids")


def _decoded(ids: Column, pieces: Column) -> Column:
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with a binary column (in place of one of that name) of the concatenated pieces of their ids, an array of
    integers; null for null ids."""
    return rows.withColumn(out, _decoded(F.col(ids_col), piece_array(read_ranks(ranks_path))))

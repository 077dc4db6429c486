"""Best-fit packing of token sequences into bins with several capacities.

Texts become token ids (a public tokenizer, then an end id); only texts longer than a bin are cut. Pieces are dealt to
shards by a hash and each shard is packed by vector best-fit: pieces in order of falling size, each into the open bin that
suits it best under every constraint (tokens, number of documents, attention cost as the sum of squared lengths). "Best"
is either the largest weighted dot product of a piece's needs and a bin's residual capacities, each as a share of the
whole capacity, or the smallest weighted norm of what would be left. A bin's loss is at most its shard's last bins, so
shards of thousands of pieces cost well under a thousandth in bins.

Cases: null and empty texts become one piece, the end id; repeated rows are packed each; an empty table gives an empty
result; a text of exactly a bin's size isn't cut.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialise, releasing

SHARD_PIECES = 8192


@dataclass(frozen=True)
class Capacity:
    """What a bin can hold, and the weight of each need in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """Bin and offset of every piece. Open bins are those that can still take the smallest piece."""
    whole = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    order = np.argsort(-lengths, kind="stable")
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    smallest = float(lengths.min()) if n else 0.0
    left = np.zeros((3, 64))  # residual capacities of open bins
    names, used, total = np.zeros(64, np.int64), 0, 0
    for at in order:
        size = float(lengths[at])
        need = np.array([size, 1.0, size * size])
        best = -1
        if used:
            free = left[:, :used]
            fits = (free[0] >= size) & (free[1] >= 1) & (free[2] >= need[2])
            if fits.any():
                if capacity.rule == "dot":
                    value = (weights * need / whole**2) @ free
                else:
                    rest = (free - need[:, None]) / whole[:, None]
                    value = -(weights @ (rest * rest))
                value[~fits] = -np.inf
                best = int(value.argmax())
        if best < 0:
            if used == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
                names = np.concatenate([names, np.zeros_like(names)])
            best, used = used, used + 1
            left[:, best], names[best] = whole, total
            total += 1
        bins[at], offsets[at] = names[best], capacity.tokens - int(left[0, best])
        left[:, best] -= need
        if left[0, best] < smallest or left[1, best] < 1 or left[2, best] < smallest * smallest:
            used -= 1
            left[:, best], names[best] = left[:, used], names[used]
    return bins, offsets


#: Python's str.split also cuts at these characters, which the tokenizer keeps.
_KEPT_CONTROLS = re.compile("[\x1c-\x1f]")
#: Letters whose lower case in Python depends on what stands beside them.
_CONTEXT = re.compile("[\u03a3\u0130]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordCache:
    """Token ids (as bytes) of white-space separated words. The tokenizer drops white space and never merges across it,
    so a text's ids are those of its words in turn. A word that isn't known yet goes through the tokenizer's own steps
    (lower case, splitting pattern, merges). Two generations bound the memory, and a task's cache ends with it: workers
    outlive tasks and stages, and what they hold counts against the executor."""

    tokenizers: ClassVar[dict[str, tuple]] = {}

    def __init__(self, path: str, most: int):
        import json

        import regex
        from tokenizers import Tokenizer

        if path not in self.tokenizers:
            with open(path, encoding="utf-8") as f:
                stated = json.load(f)
            marks = [t["content"] for t in stated["added_tokens"]]
            pattern = regex.compile(stated["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.tokenizers[path] = Tokenizer.from_file(path), pattern, re.compile("|".join(map(re.escape, marks)) or "(?!)")
        self.tokenizer, pattern, self.marks = self.tokenizers[path]
        self.model, self.pieces = self.tokenizer.model, pattern.findall
        self.letters = _byte_letters()
        self.most, self.new, self.old = most, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        low = "".join(map(str.lower, word)) if _CONTEXT.search(word) else word.lower()
        ids = [t.id for p in ([low] if low.isalpha() else self.pieces(low)) for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters))]
        return array("I", ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """After this all the words are in the newer generation."""
        if len(self.new) + len(words) > self.most:
            self.old, self.new = self.new, {}
        for w in words:
            if w not in self.new:
                found = self.old.get(w)
                self.new[w] = self.word(w) if found is None else found

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            # the tokenizer's marks in a text are tokens of their own, as the library has it
            if _KEPT_CONTROLS.search(text) or self.marks.search(text) or not unicodedata.is_normalized("NFC", text):
                yield self.whole(text)
                continue
            words = text.split()
            try:
                yield b"".join(map(self.new.__getitem__, words))
            except KeyError:
                self.learn(set(words))
                yield b"".join(map(self.new.__getitem__, words))


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 350_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit) of every piece."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("ids", "binary")

    bound_batches(docs.sparkSession)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(tokenizer_path, cached_words)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, data in enumerate(cache.ids([x or "" for x in b.column("text").to_pylist()])):
                data += end
                for k, s in enumerate(range(0, len(data), 4 * size)):
                    part = data[s : s + 4 * size]
                    at.append(row), piece.append(k), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part)), ids.append(part)  # noqa: B018
            columns = [b.column("doc_id").take(pa.array(at, pa.int64()))]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, shards: int, capacity: Capacity = Capacity()) -> DataFrame:  # noqa: B008
    """pieces (columns ending in doc_id, piece, start, length, ids_crc32 and a unique number ``_row``) with sequence_id
    and offset. A shard's number is the upper part of its ids. Pieces are dealt by their number, so rows that are
    repeated any number of times spread over all shards."""
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))
    schema = T.StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long")

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("_shard")[0].as_py()
        # the largest first; among equals by checksum and number
        lengths, crc, row = (t.column(c).to_numpy() for c in ("length", "ids_crc32", "_row"))
        order = np.lexsort((row, crc, -lengths))
        t = t.take(pa.array(order)).drop_columns(["_shard"])
        bins, offsets = best_fit(lengths[order].astype(np.int64), capacity)
        return t.append_column("sequence_id", pa.array((shard << 32) + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_shard").applyInArrow(run, schema)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES, keep_ids: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and with keep_ids its ids; a
    sequence's tokens are the ids of its pieces by offset. The number of shards follows the number of rows. Pieces are
    packed by lengths and checksums. To keep the ids, the pieces are written to the shared folder with a number each, and
    the ids meet their places by it in one more shuffle, so that no task holds a shard's ids."""
    pieces = tokenised_pieces(docs, tokenizer_path, capacity.tokens, end_id, id_col, text_col)
    shards = max(1, -(-docs.select(id_col).count() // shard_pieces))
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    if not keep_ids:
        return pack(pieces.drop("ids"), shards, capacity).drop("_row")
    pieces = materialise(pieces, "pieces", "zstd")
    packed = pack(pieces.drop("ids"), shards, capacity)
    ids = pieces.select(F.col("_row").alias("_r"), "ids")
    return packed.join(ids.hint("merge"), F.col("_row") == F.col("_r")).drop("_row", "_r")

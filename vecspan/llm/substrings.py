"""Substring dedup with automata of repeated phrases.

1. A window of ``window`` words that recurs makes its lexically chosen phrase (the one of ``phrase`` words with the
   smallest hash among those inside it) recur too. The phrases chosen in any window are counted by short hashes, which
   leaves out what can't recur; the rest are counted as strings, and those that occur again are the confirmed phrases.
2. All rows are dealt to shards of a bounded number of bytes. A shard gets the confirmed phrases that were chosen in it, an
   Aho-Corasick automaton is compiled from them once, and every text of the shard is streamed through it: it finds each
   occurrence of each phrase, as a string. Only these occurrences tell where recurring windows may be.
3. The windows around the occurrences are counted by 128 bits over all rows; words that recurring windows cover go.

Rows are numbered when they are first written, so repeated rows spread over the shards and ids may be of any type.

Cases: null and empty texts have no words, nothing removed, and the digest of the empty string; texts shorter than a
window lose nothing; repeated rows count as occurrences of their own, so a repeated row of at least a window's length
loses all its words; overlapping occurrences within a text count; an empty table gives an empty result; other columns of
any name are kept apart from the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, discard, materialise, release, releasing
from .recurrence import recurring, text_bytes

SHARD_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    window: int = 35
    phrase: int = 8


def chosen(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of every ``width`` consecutive hashes (the last of equals), each place once."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    # minima over powers of two, then two overlapping ones cover the width
    span, low = 1, h
    at = np.arange(len(h))
    while span * 2 <= width:
        a, b = low[:-span], low[span:]
        left = a < b
        low, at = np.where(left, a, b), np.where(left, at[:-span], at[span:])
        span *= 2
    rest = width - span
    if rest:
        a, b = low[: len(low) - rest], low[rest:]
        at = np.where(a < b, at[: len(at) - rest], at[rest:])
    return np.unique(at)


def _spans(mask_starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Whether each of n places lies in [s, s + width) for some start s."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, mask_starts, 1)
    np.add.at(d, np.minimum(mask_starts + width, n), -1)
    return np.cumsum(d[:n]) > 0


def compiled(phrases: list[str]) -> ahocorasick.Automaton | None:
    """The automaton of a shard's phrases, each with a space at both ends."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(p)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton | None, w: Words, phrase: int) -> np.ndarray:
    """The first words of all occurrences of the automaton's phrases in a text."""
    if automaton is None or len(w) < phrase:
        return np.zeros(0, np.int64)
    line = f" {w.data.tobytes().decode('utf-8', 'surrogatepass')} "
    ends = np.array([e for e, _ in automaton.iter(line)], np.int64)
    if not len(ends):
        return ends
    # a match ends on the blank behind its last word; blanks are counted up to there
    blanks = np.cumsum(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    return np.unique(blanks[ends] - 1 - phrase)


def _runs(mask: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.astype(np.uint32)


def _from_runs(data: bytes) -> np.ndarray:
    edges = np.frombuffer(data, np.uint32).reshape(-1, 2)
    return np.concatenate([np.arange(a, b) for a, b in edges]) if len(edges) else np.zeros(0, np.int64)


def _anchors(s: Settings):
    def items(text: str | None):
        h = Words(text).hashes(s.phrase)
        at = chosen(h, s.window - s.phrase + 1)
        return h[at], at, ()

    return items


def _candidates(s: Settings):
    def items(text: str | None, runs: bytes):
        w, at = Words(text), _from_runs(runs)
        return w.hashes(s.window)[at], at, (), w.digests(s.window)[at]

    return items


def _phrases(s: Settings):
    """shard, text, found (places of phrases that may recur) → the phrases as strings, with their number of places."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[int, str], int] = {}
            for shard, text, found in zip(*[b.column(c).to_pylist() for c in ("shard", "_text", "found")], strict=True):
                w = Words(text)
                for at in np.frombuffer(found, np.uint32).tolist():
                    key = shard, f" {w.text(at, s.phrase)} "
                    counts[key] = counts.get(key, 0) + 1
            columns = [pa.array([k for k, _ in counts], pa.int64()), pa.array([p for _, p in counts], pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "phrase", "places"])

    return run


def confirmed_phrases(texts: DataFrame, s: Settings, n_bytes: int, used: list[DataFrame]) -> DataFrame:
    """n, shard, _text → shard, phrase: every phrase that recurs, for each shard in which it was chosen. used takes up the
    tables behind the result."""
    found = recurring(texts.select("n", "_text"), _anchors(s), wide=False, n_bytes=n_bytes)
    flagged = texts.join(found.hint("merge"), F.col("n") == F.col("key")).select("shard", "_text", "found")
    placed = materialise(flagged.mapInArrow(_phrases(s), "shard long, phrase string, places long"), "phrases")
    again = placed.groupBy("phrase").agg(F.sum("places").alias("places")).where("places > 1").select(F.col("phrase").alias("_p"))
    # written, so that the join meets two plain shuffles, of which a common phrase's can be split; a shard may have a
    # phrase more than once
    again = materialise(again, "confirmed")
    used += [placed, again]
    return placed.join(again.hint("merge"), F.col("phrase") == F.col("_p")).select("shard", "phrase")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    out = _cut(docs.select(F.col(id_col).alias("_row"), F.col(text_col).alias("_text")), s, False)
    return out.select(F.col("_row").alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def _cut(rows: DataFrame, s: Settings, keep_text: bool) -> DataFrame:
    """_row, _text → _row, n_words, n_removed, sha, and _text, which only keep_text fills: what stays of the text, or the
    text itself where nothing goes."""
    numbered = materialise(rows.withColumn("n", F.monotonically_increasing_id()), "numbered", "zstd")
    n_bytes = text_bytes(numbered, "_text")
    shards = max(1, -(-n_bytes // SHARD_BYTES))
    texts = numbered.withColumn("shard", F.pmod(F.xxhash64("n"), F.lit(shards)))
    used = [numbered]
    phrases = confirmed_phrases(texts.select("n", "shard", "_text"), s, n_bytes, used)
    schema = texts.select("n", "_row", "_text").schema.add("runs", "binary").add("n_words", "long").add("sha", "string")
    bound_batches(rows.sparkSession)

    def scan(held: pa.Table, known: pa.Table) -> pa.Table:
        automaton = compiled(known.column("phrase").to_pylist())
        out: dict[str, list] = {k: [] for k in ("_text", "runs", "n_words", "sha")}
        for text in held.column("_text").to_pylist():
            w = Words(text)
            places = occurrences(automaton, w, s.phrase)
            n = len(w) - s.window + 1
            mask = np.zeros(max(n, 0), bool)
            if n > 0 and len(places):
                # windows that hold a located phrase start up to window - phrase words before it
                back = s.window - s.phrase
                mask = _spans(np.maximum(places - back, 0), back + 1, len(w))[:n]
            hit = bool(mask.any())
            out["_text"].append(text if hit or keep_text else None)
            out["runs"].append(_runs(mask).tobytes() if hit else None)
            out["n_words"].append(len(w))
            out["sha"].append(None if hit else hashlib.sha256(w.data.tobytes()).hexdigest())
        kinds = {"_text": pa.string(), "runs": pa.binary(), "n_words": pa.int64(), "sha": pa.string()}
        found = pa.Table.from_arrays([held.column("n"), held.column("_row"), *[pa.array(v, kinds[k]) for k, v in out.items()]], names=schema.names)
        release()
        return found

    dealt = texts.select("shard", "n", "_row", "_text").groupBy("shard").cogroup(phrases.groupBy("shard"))
    located = materialise(dealt.applyInArrow(scan, schema), "located", "zstd")
    discard(*used)
    open_rows = located.where(F.col("runs").isNotNull())
    windows = recurring(open_rows.select("n", "_text", "runs"), _candidates(s), wide=True, n_bytes=n_bytes)
    windows = windows.mapInArrow(_compress, "key long, covered binary")
    whole = open_rows.join(windows.hint("merge"), F.col("n") == F.col("key"), "left").select("_row", "_text", "covered")
    final = whole.select("_row").schema.add("n_words", "long").add("n_removed", "long").add("sha", "string").add("_text", "string")

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for text, covered in zip(b.column("_text").to_pylist(), b.column("covered").to_pylist(), strict=True):
                w = Words(text)
                gone = _spans(_from_runs(covered or b""), s.window, len(w))
                data = w.join(~gone) if len(w) else b""
                n_words.append(len(w))
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(data).hexdigest())
                kept.append((data.decode("utf-8", "surrogatepass") if gone.any() else text) if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=final.names)

    rest = located.where(F.col("runs").isNull()).select("_row", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", "_text")
    return rest.unionByName(whole.mapInArrow(cut, final))


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted positions as runs of consecutive ones."""
    for b in batches:
        out = []
        for data in b.column("found").to_pylist():
            p = np.unique(np.frombuffer(data, np.uint32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(p) > 1)
            out.append(np.column_stack([p[np.append(0, cuts + 1)], p[np.append(cuts, len(p) - 1)] + 1]).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], names=["key", "covered"])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """docs with recurring passages cut from the texts; texts that lose nothing stay as they are. A column n_chars
    follows the text where words went."""
    rest = [c for c in docs.columns if c != text_col]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)], F.lit(True).alias("row"))
    out = _cut(docs.select(packed.alias("_row"), F.col(text_col).alias("_text")), s, True)
    own = {c: F.col(f"_row.c{k}") for k, c in enumerate(rest)}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") == 0, own["n_chars"]).otherwise(F.char_length("_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[(F.col("_text") if c == text_col else own[c]).alias(c) for c in docs.columns])

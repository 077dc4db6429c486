"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: its content (shares of kinds of characters, repeated and
distinct words, word forms) and its page metadata (language, source, length, layout of lines). Both start from the same
labelled rows. Over several rounds each names the documents that it is surest of, and those, with the labels it gives
them, are fitted by the other beside the labelled rows. At the end both are calibrated on labelled rows they weren't
fitted on, and the sum of their calibrated log odds, fitted once more on these rows, scores every document.

The labelled rows are a bounded sample on the driver (``Settings.labelled`` rows with the smallest hashes of their ids).
The pool of documents that the views label for one another is the whole corpus: both views of every document are computed
once and written, and each pass over them returns sums only, a histogram of logits (from which the bounds of "surest"
follow) or the gradients and curvatures of a Newton step, some two thousand numbers whatever the input.

Cases: null texts count as empty, null metadata as a value of its own; of conflicting labels of an id the better one
holds; without labels, or with labels of one kind, every document gets that kind's share (1 where there are none);
repeated rows get equal scores; an empty table gives an empty result; other columns of any name are kept apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, discard, materialise, releasing


@dataclass(frozen=True)
class Settings:
    labelled: int = 6000
    rounds: int = 4
    steps: int = 2
    exchanged: float = 0.05
    sure: float = 2.0
    sources: int = 32
    seed: int = 5


_KINDS = np.zeros(256, np.int64)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".", b",", b"!?", b"|", b"#", b"$", b"%", b"&", b"*", b"\"'()[]{}<>/\\=+-_:;@^`~"), 1):
    _KINDS[list(_set)] = _k
_KINDS[128:] = 16
N_CONTENT = 24


def content(text: str | None) -> np.ndarray:
    """The content view of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(N_CONTENT)
    if not len(raw):
        out[17] = 1
        return out
    out[:17] = np.log1p(100 * np.bincount(_KINDS[raw], minlength=17) / len(raw))
    w = Words(text)
    n = len(w)
    if n:
        h = w.hashes(1)
        first, last = w.data[w.starts], w.data[w.ends - 1]
        size = w.ends - w.starts
        upper = (first >= 65) & (first <= 90)
        marked = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128))
        out[18:24] = (
            len(np.unique(h)) / n, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, size.mean() / 10, marked.mean(), upper.mean(), np.log1p(n) / 10,
        )
    return out


def metadata(lang: str | None, source: str | None, n_chars: float, lines: int, sources: int) -> np.ndarray:
    """The metadata view of one row."""
    out = np.zeros(8 + sources + 4)
    out[zlib.crc32(str(lang).encode()) % 8] = 1
    out[8 + zlib.crc32(str(source).encode()) % sources] = 1
    per_line = n_chars / max(lines, 1)
    out[-4:] = np.log1p(n_chars) / 10, np.log1p(lines) / 5, np.log1p(per_line) / 5, 1.0 if n_chars == 0 else 0.0
    return out


@dataclass
class Logistic:
    """Logistic regression by Newton steps, over standardised features."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
        # what hardly varies here may vary elsewhere
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.05)
        z = self.inputs(x)
        self.w = np.zeros(z.shape[1])
        ridge = penalty * np.eye(z.shape[1])
        ridge[-1, -1] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge
            step = np.linalg.solve(h, z.T @ (p - y) + ridge @ self.w)
            self.w = self.w - step
            if np.abs(step).max() < 1e-5:
                break
        return self

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient of the loss over some rows; those of several lots add up."""
        z = self.inputs(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z, z.T @ (p - y)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.inputs(x) @ self.w, -30, 30)


@dataclass
class Model:
    content: Logistic
    metadata: Logistic
    calibrations: tuple[Logistic, Logistic]
    combined: Logistic
    sources: int

    def scores(self, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibrations[0].logit(self.content.logit(c)[:, None])
        b = self.calibrations[1].logit(self.metadata.logit(m)[:, None])
        return tuple(1 / (1 + np.exp(-x)) for x in (a, b, self.combined.logit(np.column_stack([a, b]))))


_BINS = 601


def logit_counts(views: tuple[np.ndarray, np.ndarray], models: list[Logistic]) -> np.ndarray:
    """Of each view a histogram of its logits, tenths from -30 to 30."""
    return np.concatenate([np.bincount(((m.logit(x) + 30) * 10).astype(np.int64), minlength=_BINS) for m, x in zip(models, views, strict=True)]).astype(float)


def exchanged_sums(views: tuple[np.ndarray, np.ndarray], models: list[Logistic], cuts: list[tuple[float, float]]) -> np.ndarray:
    """Of each view curvature, gradient and number of the rows that the other view is sure of."""
    out = []
    for k in (0, 1):
        z = models[1 - k].logit(views[1 - k])
        low, high = cuts[1 - k]
        sure = (z <= low) | (z >= high)
        h, g = models[k].sums(views[k][sure], (z[sure] >= high).astype(float))
        out += [h.ravel(), g, [float(sure.sum())]]
    return np.concatenate(out)


def _cuts(counts: np.ndarray, share: float, good: float, sure: float) -> tuple[float, float]:
    """Logits below and above which lie the given share of the rows, split as the labels are; never within sure of 0."""
    edges, n = np.arange(_BINS) / 10 - 30, counts.sum()
    low = edges[min(int(np.searchsorted(np.cumsum(counts), share * n * (1 - good))), _BINS - 1)]
    high = edges[::-1][min(int(np.searchsorted(np.cumsum(counts[::-1]), share * n * good)), _BINS - 1)]
    return min(float(low), -sure), max(float(high), sure)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Callable, s: Settings = Settings()) -> Model | float:  # noqa: B008
    """views: both views of the labelled rows. pool(f, ...) is the sum of f(views, ...) over lots of all documents."""
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    r = np.random.default_rng(s.seed)
    spare = r.permutation(len(y)) % 4 == 0
    if len(y) < 12 or len(set(y[spare])) < 2 or len(set(y[~spare])) < 2:
        spare = np.zeros(len(y), bool)
    train, check = ~spare, spare if spare.any() else ~spare
    own, target = [views[k][train] for k in (0, 1)], y[train].astype(float)
    models = [Logistic().fit(x, target) for x in own]
    good = float(y.mean())
    for turn in range(1, s.rounds + 1):
        counts = pool(logit_counts, models).reshape(2, _BINS)
        cuts = [_cuts(c, min(1.0, s.exchanged * turn), good, s.sure) for c in counts]
        for _ in range(s.steps):
            sums, at = pool(exchanged_sums, models, cuts), 0
            for k, m in enumerate(models):
                d = len(m.w)
                h, g, n = sums[at : at + d * d].reshape(d, d), sums[at + d * d : at + d * d + d], sums[at + d * d + d]
                at += d * d + d + 1
                # all that the other view names weighs at most as much as the labelled rows
                weight = min(1.0, len(target) / max(n, 1.0))
                ridge = np.diag([*[1.0] * (d - 1), 1e-3])
                h0, g0 = m.sums(own[k], target)
                step = np.linalg.solve(h0 + weight * h + ridge, g0 + weight * g + ridge @ m.w)
                step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
                # rounded: sums in another order give the same model
                m.w = np.round(m.w - step, 6)
    logits = [models[k].logit(views[k][check]) for k in (0, 1)]
    calibrations = tuple(Logistic().fit(z[:, None], y[check].astype(float), 0.1) for z in logits)
    both = np.column_stack([calibrations[k].logit(logits[k][:, None]) for k in (0, 1)])
    return Model(models[0], models[1], calibrations, Logistic().fit(both, y[check].astype(float), 0.1), s.sources)


_COLUMNS = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}


def _rows(docs: DataFrame, id_col: str) -> DataFrame:
    """The columns that the views need; those that docs lacks are null."""
    return docs.select(F.col(id_col).alias("doc_id"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _COLUMNS.items()])


def _views(b: pa.RecordBatch, sources: int) -> tuple[np.ndarray, np.ndarray]:
    c, m = [], []
    for text, lang, source, n in zip(*[b.column(x).to_pylist() for x in _COLUMNS], strict=True):
        c.append(content(text))
        n = len(text or "") if n is None or n != n else n
        m.append(metadata(lang, source, max(n, 0.0), (text or "").count("\n") + 1, sources))
    return np.array(c).reshape(-1, N_CONTENT), np.array(m).reshape(len(c), -1)


def _packed_views(docs: DataFrame, id_col: str, s: Settings) -> DataFrame:
    """doc_id and both views, packed as 32-bit floats."""
    rows = _rows(docs, id_col)
    schema = rows.select("doc_id").schema.add("content", "binary").add("metadata", "binary")
    bound_batches(docs.sparkSession)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, m = (v.astype(np.float32) for v in _views(b, s.sources))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in c], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _unpacked(rows, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Views from pairs of packed ones."""
    sides = list(zip(*rows, strict=True)) or [(), ()]
    return tuple(np.frombuffer(b"".join(x), np.float32).astype(float).reshape(len(x), n) for x, n in zip(sides, (N_CONTENT, 8 + s.sources + 4), strict=True))


def _pool(views: DataFrame, s: Settings) -> Callable:
    """The pool of co_train over a table: every task returns its sums by place, and places are added up."""

    def total(f: Callable, *args) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for b in batches:
                if b.num_rows:
                    own = f(_unpacked(zip(b.column("content").to_pylist(), b.column("metadata").to_pylist(), strict=True), s), *args)
                    found = own if found is None else found + own
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int64()), pa.array(found)], names=["place", "x"])

        # as many rows as there are sums, whatever the input
        rows = views.select("content", "metadata").mapInArrow(run, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect()
        if not rows:
            return f(_unpacked([], s), *args)
        out = np.zeros(len(rows))
        out[[r["place"] for r in rows]] = [r["x"] for r in rows]
        return out

    return total


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label_col: str = "quality", id_col: str = "doc_id") -> Model | float:  # noqa: B008
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.labelled)
    views = materialise(_packed_views(docs, id_col, s), "views")
    # at most as many rows as labels were chosen: of an id that comes more than once, one
    found = views.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("content", "metadata")).alias("v")).collect()
    found.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in found], np.int64)
    model = co_train(_unpacked([(r["v"]["content"], r["v"]["metadata"]) for r in found], s), y, _pool(views, s), s)
    discard(views)
    return model


def quality(docs: DataFrame, model: Model | float, id_col: str = "doc_id") -> DataFrame:
    """doc_id, content_score, metadata_score and score (that the quality is good) of every row."""
    return _scored(_rows(docs, id_col), "doc_id", model, ["content_score", "metadata_score", "score"])


def _scored(rows: DataFrame, first: str, model: Model | float, names: list[str]) -> DataFrame:
    """The first column and the last scores, as many as names."""
    bound_batches(rows.sparkSession)
    schema = rows.select(first).schema
    for c in names:
        schema = schema.add(c, "double")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if isinstance(model, float):
                scores = (np.full(b.num_rows, model),) * 3
            elif b.num_rows:
                scores = model.scores(*_views(b, model.sources))
            else:
                scores = (np.zeros(0),) * 3
            yield pa.RecordBatch.from_arrays([b.column(first)] + [pa.array(x, pa.float64()) for x in scores[-len(names) :]], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model | float, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """The rows whose score reaches the threshold, with their columns as they are."""
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows = docs.select(whole.alias("_row"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _COLUMNS.items()])
    scored = _scored(rows, "_row", model, ["_quality"]).where(F.col("_quality") >= threshold)
    return scored.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])

"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, written in numpy.

A text's words are read in overlapping windows. A word's input has a word part (its log odds of marking toxic documents
and a trained vector) and a character part (the largest log odds among its character n-grams and the mean of their
trained vectors), so that words never seen in training are judged by their letters. Gated recurrent units run over a
window in both directions, attention pools their states, and the largest window logit, calibrated, is the document's
score. The word inputs' projections are computed once for each distinct word and then looked up.

The network is fitted on the driver to a bounded sample of labelled rows (``Settings.positives`` and ``negatives``, those
with the smallest hashes of their ids, whose texts come once each); every window of every text is scored. In training a
document's log odds come from the other folds of the sample, as they do for documents that nobody has labelled. A
document is as toxic as its worst window: before each pass the network scores all windows of the sample and learns from
the largest of each document (and, for documents that aren't toxic, from one more). The calibration comes from a network
that is fitted in the same way without a part of the sample, on that part.

Cases: null and empty texts get the score of a text without evidence; repeated rows get equal scores; of conflicting
labels of an id the toxic one holds; without labelled rows, or with labels of one kind only, every score is that kind's
share (0 where there are none); an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, releasing

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    positives: int = 1500
    negatives: int = 2500
    vocabulary: int = 20_000
    buckets: int = 1 << 16
    sizes: tuple[int, ...] = (3, 5)
    vector: int = 4
    hidden: int = 8
    attention: int = 8
    window: int = 64
    stride: int = 48
    folds: int = 5
    spare: int = 4
    epochs: int = 3
    steps: int = 80
    batch: int = 256
    rate: float = 0.02
    decay: float = 0.02
    seed: int = 7


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def ngrams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of "^word$", and where each word's begin."""
    data = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    found, whose = [], []
    for n in s.sizes:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = np.arange(m) + n <= ends[owner[:m]]
        found.append((h[inside] % np.uint64(s.buckets)).astype(np.int64))
        whose.append(owner[:m][inside])
    ids, whose = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(whose or [np.zeros(0, np.int64)])
    order = np.argsort(whose, kind="stable")
    return ids[order], np.searchsorted(whose[order], np.arange(len(words)))


def windows(n: int, s: Settings) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words; a text without words has one empty window."""
    starts = [0]
    while starts[-1] + s.window < n:
        starts.append(starts[-1] + s.stride)
    return [(a, min(a + s.window, n)) for a in starts]


def _evidence(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log odds less two standard errors, at least 0."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return (np.maximum(0, odds - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))) / 4).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; forward for scoring and training, backward for training."""

    def __init__(self, s: Settings, vocabulary: dict[str, int], word_odds: np.ndarray, gram_odds: np.ndarray):
        r = np.random.default_rng(s.seed)
        d, h = 2 + 2 * s.vector, s.hidden
        normal = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.s, self.vocabulary, self.word_odds, self.gram_odds = s, vocabulary, word_odds, gram_odds
        self.p = {"word": np.zeros((len(word_odds), s.vector), np.float32), "gram": (0.1 * r.standard_normal((s.buckets, s.vector))).astype(np.float32)}
        for k in "fb":
            self.p |= {f"{k}x": normal(d, 3 * h), f"{k}h": normal(h, 3 * h), f"{k}c": np.zeros(3 * h, np.float32)}
        self.p |= {"aw": normal(2 * h, s.attention), "ac": np.zeros(s.attention, np.float32), "av": normal(s.attention, 1)[:, 0], "ow": normal(2 * h, 1)[:, 0], "oc": np.zeros(1, np.float32)}
        self.calibration = (1.0, 0.0)

    def inputs(self, words: list[str], odds: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple]:
        """Every word's inputs; odds (of words and of n-grams) stand in for the network's own."""
        word_odds, gram_odds = odds or (self.word_odds, self.gram_odds)
        ids, starts = ngrams(words, self.s)
        at = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        counts = np.diff(np.append(starts, len(ids)))
        x = np.zeros((len(words), 2 + 2 * self.s.vector), np.float32)
        x[:, 0] = word_odds[at]
        full = counts > 0
        if full.any():
            x[full, 1] = np.maximum.reduceat(gram_odds[ids], starts[full])
            x[full, 2 + self.s.vector :] = np.add.reduceat(self.p["gram"][ids], starts[full], axis=0) / counts[full, None]
        x[:, 2 : 2 + self.s.vector] = self.p["word"][at]
        return x, (ids, counts, at)

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["fx"] + self.p["fc"], x @ self.p["bx"] + self.p["bc"]], axis=1)

    def run(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits. table: projections by word; at, mask: word numbers and validity, time by window."""
        steps, n = at.shape
        h = self.s.hidden
        states = np.zeros((steps, n, 2 * h), np.float32)
        trace = {}
        for k, name in enumerate("fb"):
            u, now = self.p[f"{name}h"], np.zeros((n, h), np.float32)
            for t in range(steps) if name == "f" else range(steps - 1, -1, -1):
                x = table[at[t], 3 * h * k : 3 * h * (k + 1)]
                g = now @ u
                zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, rr = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + rr * g[:, 2 * h :])
                m = mask[t][:, None]
                new = np.where(m, c + z * (now - c), now)
                if keep:
                    trace[name, t] = (now, z, rr, c, g[:, 2 * h :])
                now = new
                states[t, :, h * k : h * (k + 1)] = now
        a = np.tanh(states @ self.p["aw"] + self.p["ac"])
        e = np.where(mask, a @ self.p["av"], -1e9)
        e = np.exp(e - e.max(axis=0))
        e = np.where(mask, e, 0)
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logits = pooled @ self.p["ow"] + self.p["oc"][0]
        return (logits, states, a, alpha, pooled, trace) if keep else logits

    def step(self, words: list[str], at: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray, odds: tuple | None = None) -> dict:
        """Gradients of the weighted cross entropy."""
        p, h, g = self.p, self.s.hidden, {}
        x, (ids, counts, known) = self.inputs(words, odds)
        logits, states, a, alpha, pooled, trace = self.run(self.project(x), at, mask, keep=True)
        d = ((_sigmoid(logits) - target) * weight / weight.sum()).astype(np.float32)
        g["ow"], g["oc"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * p["ow"]
        ds = alpha[:, :, None] * dp
        da = np.einsum("tnh,nh->tn", states, dp)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["av"] = np.einsum("tna,tn->a", a, de)
        dt = de[:, :, None] * p["av"] * (1 - a * a)
        g["aw"], g["ac"] = np.einsum("tnh,tna->ha", states, dt), dt.sum(axis=(0, 1))
        ds = ds + dt @ p["aw"].T
        dtable = np.zeros((len(words), 6 * h), np.float32)
        for k, name in enumerate("fb"):
            u, carry, gu = p[f"{name}h"], np.zeros((at.shape[1], h), np.float32), np.zeros_like(p[f"{name}h"])
            for t in range(at.shape[0] - 1, -1, -1) if name == "f" else range(at.shape[0]):
                before, z, r, c, gc = trace[name, t]
                dn = ds[t, :, h * k : h * (k + 1)] + carry
                m = mask[t][:, None]
                live = np.where(m, dn, 0)
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (before - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                gu += before.T @ dg
                carry = np.where(m, live * z, dn) + dg @ u.T
                np.add.at(dtable[:, 3 * h * k : 3 * h * (k + 1)], at[t], dx)
            g[f"{name}h"] = gu
        g["fx"], g["bx"] = x.T @ dtable[:, : 3 * h], x.T @ dtable[:, 3 * h :]
        g["fc"], g["bc"] = dtable[:, : 3 * h].sum(axis=0), dtable[:, 3 * h :].sum(axis=0)
        dx = dtable[:, : 3 * h] @ p["fx"].T + dtable[:, 3 * h :] @ p["bx"].T
        v = self.s.vector
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], known, dx[:, 2 : 2 + v])
        g["word"][0] = 0
        np.add.at(g["gram"], ids, np.repeat(dx[:, 2 + v :] / np.maximum(counts, 1)[:, None], counts, axis=0))
        return g


def _layout(spans: list[list[int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros((s.window, len(spans)), np.int64)
    mask = np.zeros((s.window, len(spans)), bool)
    for k, x in enumerate(spans):
        at[: len(x), k], mask[: len(x), k] = x, True
    return at, mask


class _Counts:
    """How many documents of each kind, in each fold, have a word or an n-gram."""

    def __init__(self, docs: list[list[str]], labels: np.ndarray, fold: np.ndarray, s: Settings):
        self.s, self.n = s, np.zeros((s.folds, 2))
        words: dict[str, np.ndarray] = {}
        self.grams = np.zeros((s.folds, 2, s.buckets), np.float32)
        for x, label, k in zip(docs, labels.astype(int).tolist(), fold.tolist(), strict=True):
            self.n[k, label] += 1
            distinct = sorted(set(x))
            for w in distinct:
                if w not in words:
                    words[w] = np.zeros((s.folds, 2), np.int32)
                words[w][k, label] += 1
            if distinct:
                self.grams[k, label, np.unique(ngrams(distinct, s)[0])] += 1
        common = sorted(w for w, c in words.items() if c.sum() >= 3)
        counts = np.array([words[w] for w in common], float).reshape(-1, s.folds, 2)
        order = np.argsort(-self._odds(counts.sum(axis=1).T, self.n.sum(axis=0)), kind="stable")[: s.vocabulary]
        self.vocabulary = {common[i]: k + 1 for k, i in enumerate(order)}
        self.words = counts[order]

    def _odds(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _evidence(found[1], found[0], n[1], n[0])

    def odds(self, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of words and n-grams, from all folds or all but one."""
        use = np.arange(self.s.folds) != (-1 if without is None else without)
        n = self.n[use].sum(axis=0)
        return np.append(np.float32(0), self._odds(self.words[:, use].sum(axis=1).T, n)), self._odds(self.grams[use].sum(axis=0), n)


def _learnt(docs: list[list[str]], y: np.ndarray, fold: np.ndarray, s: Settings) -> Network:
    """A network without calibration."""
    r = np.random.default_rng(s.seed)
    counts = _Counts(docs, y, fold, s)
    net = Network(s, counts.vocabulary, *counts.odds())
    odds = [counts.odds(k) for k in range(s.folds)]
    rows = [np.flatnonzero(fold == k) for k in range(s.folds)]
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    time = 0
    # a small sample is passed over more often, for as many steps at least
    for epoch in range(max(s.epochs, -(-s.steps * s.batch // (2 * len(docs))))):
        parts = []
        for k in range(s.folds):
            whose, starts, lengths, logits = Scorer(net, odds=odds[k]).each([docs[i] for i in rows[k]], by_evidence=not epoch)
            order = np.lexsort((-logits, whose))
            first = np.flatnonzero(np.append(True, whose[order][1:] != whose[order][:-1])) if len(order) else order
            picked = order[first]
            clean = np.flatnonzero((y[rows[k]][whose] == 0) & (r.random(len(whose)) < 1 / np.bincount(whose, minlength=1)[whose])) if len(whose) else picked
            both = np.unique(np.append(picked, clean))
            for part in np.array_split(r.permutation(both), max(1, len(both) // s.batch)):
                owners = rows[k][whose[part]]
                parts.append((k, [docs[i][a : a + n] for i, a, n in zip(owners, starts[part], lengths[part], strict=True)], owners))
        for i in r.permutation(len(parts)):
            k, spans, whose = parts[i]
            names = sorted(set().union(*spans))
            if not names:
                continue
            number = {w: j for j, w in enumerate(names)}
            at, mask = _layout([[number[w] for w in x] for x in spans], s)
            time += 1
            for name, g in net.step(names, at, mask, y[whose], balance[whose], odds[k]).items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                net.p[name] = net.p[name] * (1 - s.rate * s.decay) - s.rate * (m[name] / (1 - 0.9**time)) / (np.sqrt(v[name] / (1 - 0.99**time)) + 1e-7)
    return net


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn logits into probabilities, with a weak pull towards the plain logit."""
    a, b = 1.0, float(np.log(max(y.sum(), 0.5) / max((1 - y).sum(), 0.5)))
    for _ in range(50):
        q = _sigmoid(a * z + b)
        w = np.maximum(q * (1 - q), 1e-6)
        hess = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        grad = np.array([((q - y) * z).sum() + 1.0 * (a - 1), (q - y).sum() + 0.1 * b])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> Network | float:  # noqa: B008
    """The network, or a constant where labels are of one kind."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    docs = [words_of(t) for t in texts]
    # equal texts share a fold
    mark = np.array([zlib.crc32(" ".join(x).encode("utf-8", "surrogatepass")) for x in docs])
    net = _learnt(docs, y, mark % s.folds, s)
    spare = mark // s.folds % s.spare == 0
    kinds = lambda x: len(set(x.tolist()))
    if kinds(y[spare]) < 2 or kinds(y[~spare]) < 2:  # too few to keep some back
        net.calibration = _platt(np.clip(Scorer(net).logits(docs), -30, 30), y)
        return net
    other = _learnt([x for x, k in zip(docs, spare, strict=True) if not k], y[~spare], mark[~spare] % s.folds, s)
    net.calibration = _platt(np.clip(Scorer(other).logits([x for x, k in zip(docs, spare, strict=True) if k]), -30, 30), y[spare])
    return net


class Scorer:
    """Scores texts; keeps the projections of words it has met, up to a bound, as long as a task lasts."""

    def __init__(self, net: Network, most: int = 200_000, odds: tuple | None = None):
        self.net, self.most, self.odds = net, most, odds
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, 6 * net.s.hidden), np.float32)
        self.used = 0

    def _learn(self, docs: list[list[str]]) -> None:
        fresh = list(set().union(*docs).difference(self.number)) if docs else []
        if self.used + len(fresh) > self.most:
            self.number, self.used = {}, 0
            fresh = list(set().union(*docs))
        if not fresh:
            return
        fresh.sort()
        rows = self.net.project(self.net.inputs(fresh, self.odds)[0])
        if self.used + len(fresh) > len(self.table):
            grown = np.zeros((max(self.used + len(fresh), min(2 * len(self.table), self.most)), rows.shape[1]), np.float32)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        self.table[self.used : self.used + len(fresh)] = rows
        self.number.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
        self.used += len(fresh)

    def each(self, docs: list[list[str]], together: int = 2048, by_evidence: bool = False) -> tuple[np.ndarray, ...]:
        """Of every window its document, first word, number of words and logit; or in place of the logit the sum of its
        words' log odds."""
        s = self.net.s
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        k = 0
        while k < len(docs):  # so many texts as fill a batch of windows
            n = e = 0
            while k + e < len(docs) and (e == 0 or n < together):
                n += len(windows(len(docs[k + e]), s))
                e += 1
            part = docs[k : k + e]
            self._learn(part)
            flat = np.array([self.number[w] for x in part for w in x] or [0], np.int64)
            starts, lengths, whose, base, first = [], [], [], 0, []
            for j, x in enumerate(part):
                for a, b in windows(len(x), s):
                    starts.append(base + a), lengths.append(b - a), whose.append(k + j), first.append(a)  # noqa: B018
                base += len(x)
            if not self.used:
                self._learn([["-"]])
            starts, lengths, whose, first = np.array(starts), np.array(lengths), np.array(whose), np.array(first)
            if by_evidence:
                names = list(self.number)
                sums = np.append(0, np.cumsum(self.net.inputs(names, self.odds)[0][:, :2].sum(axis=1)[flat]))
                found.append((whose, first, lengths, np.where(lengths > 0, sums[starts + lengths] - sums[np.minimum(starts, len(flat))], 0)))
            for c in range(0, 0 if by_evidence else len(starts), together):
                span = slice(c, c + together)
                steps = np.arange(max(1, lengths[span].max()))[:, None]
                mask = steps < lengths[span]
                at = flat[np.minimum(starts[span] + steps, len(flat) - 1)]
                found.append((whose[span], first[span], lengths[span], self.net.run(self.table, at, mask)))
            k += e
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def logits(self, docs: list[list[str]]) -> np.ndarray:
        """The largest window logit of every document."""
        whose, _, _, z = self.each(docs)
        out = np.full(len(docs), -np.inf)
        np.maximum.at(out, whose, z)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.net.calibration
        return _sigmoid(a * np.clip(self.logits([words_of(t) for t in texts]), -30, 30) + b)


def in_fold(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is held out: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label_col: str = "toxic") -> Network | float:  # noqa: B008
    """Fits the network on labelled rows outside the held-out fold, a bounded number of each kind."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id"))
    known = known.groupBy("doc_id").agg(F.max((F.col(label_col) > 0).cast("int")).alias("label")).withColumn("h", F.xxhash64("doc_id"))
    ids = None
    for kind, most in ((1, s.positives), (0, s.negatives)):
        part = known.where(F.col("label") == kind).orderBy("h", "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    # at most positives + negatives ids, and of each the row with the smallest text
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows], s)


def toxicity(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), in_fold(id_col).alias("held_out"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id", "held_out").schema.add("score", "double")
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a size that Settings bounds

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        scorer = None if isinstance(net, float) else Scorer(net)
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = np.full(len(texts), net) if scorer is None else scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

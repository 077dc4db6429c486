"""The toxicity network on the labelled documents, and against a plain forward pass."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from vecspan.llm import toxicity


def labelled(sf: str) -> tuple[list, list, list, list]:
    """Texts and labels to learn from, and held-out ones."""
    docs = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    marks = pq.read_table(f"/root/testdata/{sf}/labels.parquet").to_pydict()
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    sides: tuple[list, ...] = ([], [], [], [])
    for i, label in zip(marks["doc_id"], marks["toxic"], strict=True):
        if i in text:
            k = 2 * (zlib.crc32(str(i).encode()) % 4 == 2)
            sides[k].append(text[i])
            sides[k + 1].append(label)
    return sides


def auc(z: np.ndarray, y: np.ndarray) -> float:
    pairs = z[y > 0][:, None] - z[y == 0]
    return float((pairs > 0).mean() + 0.5 * (pairs == 0).mean())


@pytest.mark.parametrize(("sf", "least", "recall"), [("sf0.01", 0.75, 0.5), ("sf0.1", 0.965, 0.9)])
def test_held_out_labels(sf, least, recall):
    texts, labels, held, truth = labelled(sf)
    z, y = toxicity.Scorer(toxicity.fit(texts, labels)).scores(held), np.array(truth)
    assert auc(z, y) >= least and (z[y > 0] >= 0.3).mean() >= recall and (z[y == 0] >= 0.3).mean() <= 0.06


def test_scorer_equals_a_plain_forward_pass():
    """Window by window and word by word, with one loop for each step and no tables."""
    s = toxicity.Settings(hidden=3, vector=2, attention=3, window=6, stride=4, buckets=97)
    r = np.random.default_rng(4)
    net = toxicity.Network(s, {"a": 1, "bb": 2}, np.array([0, 0.5, 0.2], np.float32), np.abs(r.standard_normal(97)).astype(np.float32))
    for k in net.p:
        net.p[k] = (net.p[k] + 0.3 * r.standard_normal(net.p[k].shape)).astype(np.float32)
    p, h = net.p, s.hidden
    g = lambda x: 1 / (1 + np.exp(-x))

    def direction(x: list, name: str) -> list:
        now, out = np.zeros(h), []
        for v in x:
            a, b = v @ p[f"{name}x"] + p[f"{name}c"], now @ p[f"{name}h"]
            z, reset = g(a[:h] + b[:h]), g(a[h : 2 * h] + b[h : 2 * h])
            now = z * now + (1 - z) * np.tanh(a[2 * h :] + reset * b[2 * h :])
            out.append(now)
        return out

    def window(words: list[str]) -> float:
        if not words:
            return float(p["oc"][0])
        x = [net.inputs([w])[0][0].astype(float) for w in words]
        states = np.concatenate([direction(x, "f"), direction(x[::-1], "b")[::-1]], axis=1)
        e = np.exp(np.tanh(states @ p["aw"] + p["ac"]) @ p["av"])
        return float((e / e.sum()) @ states @ p["ow"] + p["oc"][0])

    docs = [[str(r.choice(["a", "bb", "ccc", "dddd", "ee"])) for _ in range(n)] for n in (1, 5, 6, 7, 0, 23, 60)]
    want = [max(window(x[a:b]) for a, b in toxicity.windows(len(x), s)) for x in docs]
    for together in (1, 2048):
        whose, _, _, z = toxicity.Scorer(net).each(docs, together)
        assert [z[whose == k].max() for k in range(len(docs))] == pytest.approx(want, abs=1e-4)

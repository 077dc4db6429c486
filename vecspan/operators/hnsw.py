"""A navigable small-world graph over the rows of one shard, in numpy.

Node 0..n-1 are the shard's rows in id order. Every node has a level drawn from a seeded generator; each level links a
node to neighbours that are spread out around it. A search walks down the levels with a narrow beam and searches level 0
with a beam of ``ef``. A mask keeps rows out of the results but not out of the walk. With ``ef`` at least the number of
rows the result is exact.

Shards are built and searched as Spark tasks: see ``build_index`` and ``search_index``. ``bulk`` builds a graph of all rows
at once, ``Builder`` row by row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Corrupted
from ..functions import metrics, sq8
from ..types import HnswParams
from .search import exact_keys, ranked

HIGHEST_LEVEL = 31
UPPER_BEAM = 8
MAGIC = 0x56535031


def keys_to(matrix: np.ndarray, q: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    x = matrix[rows]
    if metric == "l2":
        d = x - q
        return np.einsum("ij,ij->i", d, d)
    return -(x @ q)


class Graph:
    """Levels of adjacency: ``links[level][node]`` is an array of neighbours."""

    def __init__(self, n: int, levels: np.ndarray, links: list[dict[int, np.ndarray]], entry: int):
        self.n, self.levels, self.links, self.entry = n, levels, links, entry

    def neighbours(self, level: int, node: int) -> np.ndarray:
        return self.links[level].get(node, _NONE)

    def to_bytes(self) -> bytes:
        """Magic, node count, entry and levels, then for each level its nodes, offsets and neighbours."""
        parts = [np.array([MAGIC, self.n, self.entry & 0xFFFFFFFF, len(self.links)], "<u4"), self.levels.astype("<u4")]
        for level in self.links:
            nodes = np.array(sorted(level), "<u4")
            ends = np.cumsum([0] + [len(level[x]) for x in nodes.tolist()]).astype("<u4")
            flat = np.concatenate([level[x] for x in nodes.tolist()]) if len(nodes) else _NONE
            parts += [np.array([len(nodes), len(flat)], "<u4"), nodes, ends, flat.astype("<u4")]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        if len(data) % 4 or len(data) < 16:
            raise Corrupted("a graph of the wrong size")
        words, at = np.frombuffer(data, "<u4"), 4

        def take(k: int) -> np.ndarray:
            nonlocal at
            if at + k > len(words):
                raise Corrupted("a graph that ends too early")
            at += k
            return words[at - k : at].astype(np.int64)

        magic, n, entry, count = words[:4].astype(np.int64)
        if magic != MAGIC or count > HIGHEST_LEVEL + 1:
            raise Corrupted("not a graph")
        levels = take(int(n))
        links = []
        for _ in range(int(count)):
            k, m = take(2)
            nodes, ends, flat = take(int(k)), take(int(k) + 1), take(int(m))
            if (nodes >= n).any() or (flat >= n).any() or (np.diff(ends) < 0).any() or (len(ends) and ends[-1] != m):
                raise Corrupted("a graph with links to nowhere")
            links.append({int(x): flat[ends[i] : ends[i + 1]] for i, x in enumerate(nodes)})
        if at != len(words) or (n and entry >= n):
            raise Corrupted("a graph of the wrong size")
        return cls(int(n), levels, links, int(entry) if n else -1)


_NONE = np.zeros(0, np.int64)


def draw_levels(n: int, p: HnswParams) -> np.ndarray:
    u = np.random.default_rng(p.seed).random(n)
    return np.minimum(np.floor(-np.log(1.0 - u) / math.log(p.m)), HIGHEST_LEVEL).astype(np.int64)


def beam(graph: Graph, distance: Callable[[np.ndarray], np.ndarray], starts: list[tuple[float, int]], level: int, width: int, mask: np.ndarray | None = None) -> list[tuple[float, int]]:
    """Up to width nearest allowed nodes of a level, nearest first, by best-first search."""
    seen = bytearray(graph.n)
    open_, best = [], []
    for d, x in starts:
        if not seen[x]:
            seen[x] = 1
            open_.append((d, x))
            if mask is None or mask[x]:
                heapq.heappush(best, (-d, -x))
    heapq.heapify(open_)
    while len(best) > width:
        heapq.heappop(best)
    while open_:
        d, x = heapq.heappop(open_)
        if len(best) >= width and d > -best[0][0]:
            break
        near = [y for y in graph.neighbours(level, x).tolist() if not seen[y]]
        if not near:
            continue
        for y in near:
            seen[y] = 1
        for dy, y in zip(distance(np.array(near)).tolist(), near, strict=True):
            if len(best) < width or dy < -best[0][0]:
                heapq.heappush(open_, (dy, y))
                if mask is None or mask[y]:
                    heapq.heappush(best, (-dy, -y))
                    if len(best) > width:
                        heapq.heappop(best)
    return sorted((-d, -x) for d, x in best)


def search(graph: Graph, distance: Callable[[np.ndarray], np.ndarray], k: int, ef: int, mask: np.ndarray | None = None) -> list[tuple[float, int]]:
    """The k nearest nodes that were found, as (key, node). distance gives the keys of an array of nodes."""
    if not graph.n or k == 0:
        return []
    starts = [(float(distance(np.array([graph.entry]))[0]), graph.entry)]
    for level in range(len(graph.links) - 1, 0, -1):
        starts = beam(graph, distance, starts, level, UPPER_BEAM)
    return beam(graph, distance, starts, 0, max(ef, k), mask)[:k]


class Builder:
    """Inserts rows one by one; the same seed and rows give the same graph."""

    def __init__(self, matrix: np.ndarray, metric: str, p: HnswParams = HnswParams()):  # noqa: B008
        self.x, self.metric, self.p = matrix, metric, p
        n = len(matrix)
        levels = draw_levels(n, p)
        self.graph = Graph(n, levels, [], -1)
        for node in range(n):
            self._insert(node, int(levels[node]))

    def _keys(self, node: int, rows: np.ndarray) -> np.ndarray:
        return keys_to(self.x, self.x[node], rows, self.metric)

    def spread(self, candidates: list[tuple[float, int]], m: int) -> list[int]:
        """Up to m of the candidates (nearest first): those nearer to the centre than to any chosen one, then the
        nearest of the others."""
        chosen: list[int] = []
        rows = np.array([x for _, x in candidates], np.int64)
        x = self.x[rows]
        # distance from each candidate to the nearest chosen one so far
        nearest = np.full(len(rows), np.inf)
        rest = []
        for i, (d, node) in enumerate(candidates):
            if len(chosen) == m:
                break
            if d < nearest[i]:
                chosen.append(node)
                if self.metric == "l2":
                    diff = x - x[i]
                    nearest = np.minimum(nearest, np.einsum("ij,ij->i", diff, diff))
                else:
                    nearest = np.minimum(nearest, -(x @ x[i]))
            else:
                rest.append(node)
        return chosen + rest[: m - len(chosen)]

    def _extended(self, node: int, level: int, found: list[tuple[float, int]]) -> list[tuple[float, int]]:
        known = {x for _, x in found} | {node}
        more = {y for _, x in found for y in self.graph.neighbours(level, x).tolist()} - known
        if more:
            rows = np.array(sorted(more))
            found = sorted(found + list(zip(self._keys(node, rows).tolist(), rows.tolist(), strict=True)))
        return found

    def _insert(self, node: int, level: int) -> None:
        g = self.graph
        top = len(g.links) - 1
        if g.entry >= 0:
            distance = lambda rows: self._keys(node, rows)
            starts = [(float(distance(np.array([g.entry]))[0]), g.entry)]
            for at in range(top, level, -1):
                starts = beam(g, distance, starts, at, 1)
            for at in range(min(level, top), -1, -1):
                found = beam(g, distance, starts, at, self.p.ef_construction)
                starts = found
                candidates = self._extended(node, at, found) if self.p.extend_candidates else found
                most = self.p.m0 if at == 0 else self.p.m
                links = self.spread(candidates, self.p.m)
                g.links[at][node] = np.array(links, np.int64)
                for other in links:
                    own = np.append(g.neighbours(at, other), node)
                    if len(own) > most:
                        order = sorted(zip(self._keys(other, own).tolist(), own.tolist(), strict=True))
                        own = np.array(self.spread(order, most), np.int64)
                    g.links[at][other] = own
        for _ in range(len(g.links), level + 1):
            g.links.append({})
        for at in range(level + 1):
            g.links[at].setdefault(node, _NONE)
        if level > top or g.entry < 0:
            g.entry = node


#: Numbers in one matrix of the bulk build.
BULK_NUMBERS = 8_000_000


def _candidates(x: np.ndarray, metric: str, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every row the c nearest other ones, nearest first, and their keys: products of blocks of rows."""
    n = len(x)
    squares = np.einsum("ij,ij->i", x, x)
    ids, keys = np.zeros((n, c), np.int64), np.zeros((n, c))
    step = max(1, BULK_NUMBERS // n)
    for at in range(0, n, step):
        part = slice(at, min(at + step, n))
        d = -(x[part] @ x.T)
        if metric == "l2":
            d = np.maximum(squares[part, None] + squares + 2 * d, 0)
        own = np.arange(part.start, part.stop)
        d[own - at, own] = np.inf
        near = np.argpartition(d, c - 1, axis=1)[:, :c] if c < n - 1 else np.argsort(d, axis=1)[:, :c]
        k = np.take_along_axis(d, near, axis=1)
        order = np.lexsort((near, k), axis=1)
        ids[part], keys[part] = np.take_along_axis(near, order, axis=1), np.take_along_axis(k, order, axis=1)
    return ids, keys


def _spread_all(x: np.ndarray, ids: np.ndarray, keys: np.ndarray, m: int, metric: str) -> np.ndarray:
    """Builder.spread for many rows side by side: which candidates (nearest first, keys infinite where there is none) of
    each row are kept, at most m."""
    n, c = ids.shape
    kept = np.zeros((n, c), bool)
    step = max(1, BULK_NUMBERS // (c * max(c, x.shape[1])))
    for at in range(0, n, step):
        part = slice(at, at + step)
        v = x[ids[part]]
        gram = -np.einsum("ncd,ned->nce", v, v, optimize=True)
        if metric == "l2":
            s = np.einsum("ncd,ncd->nc", v, v)
            gram = s[:, :, None] + s[:, None, :] + 2 * gram
        real = np.isfinite(keys[part])
        nearest, chosen, own = np.full(real.shape, np.inf), np.zeros(real.shape, bool), keys[part]
        for i in range(c):
            take = real[:, i] & (chosen.sum(axis=1) < m) & (own[:, i] < nearest[:, i])
            chosen[:, i] = take
            nearest = np.where(take[:, None], np.minimum(nearest, gram[:, i]), nearest)
        # then the nearest of the others, up to m
        rest = real & ~chosen
        room = m - chosen.sum(axis=1)
        kept[part] = chosen | (rest & (np.cumsum(rest, axis=1) <= room[:, None]))
    return kept


def _level_links(x: np.ndarray, metric: str, p: HnswParams, most: int, entry: int) -> list[np.ndarray]:
    """Links of one level over rows 0..n-1, all of which can be reached from entry."""
    n = len(x)
    if n == 1:
        return [_NONE]
    c = min(n - 1, p.ef_construction, 4 * p.m)
    ids, keys = _candidates(x, metric, c)
    kept = _spread_all(x, ids, keys, p.m, metric)
    a, b, d = np.repeat(np.arange(n), kept.sum(axis=1)), ids[kept], keys[kept]
    # both directions, each once, nearest first
    a, b, d = np.append(a, b), np.append(b, a), np.append(d, d)
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    pairs = np.unique(a * n + b, return_index=True)[1]
    pairs.sort()
    a, b, d = a[pairs], b[pairs], d[pairs]
    starts = np.searchsorted(a, np.arange(n + 1))
    links = [b[starts[k] : starts[k + 1]] for k in range(n)]
    over = np.flatnonzero(np.diff(starts) > most)
    if len(over):
        width = min(int(np.diff(starts)[over].max()), 3 * most)
        ids, keys = np.zeros((len(over), width), np.int64), np.full((len(over), width), np.inf)
        for row, k in enumerate(over.tolist()):
            s, e = starts[k], min(starts[k + 1], starts[k] + width)
            ids[row, : e - s], keys[row, : e - s] = b[s:e], d[s:e]
        for row, k in zip(_spread_all(x, ids, keys, most, metric), over.tolist(), strict=True):
            links[k] = ids[np.searchsorted(over, k)][row]
    # what can't be reached gets a link from, and to, the nearest row that can
    seen = np.zeros(n, bool)
    fresh = [entry]
    while True:
        while fresh:
            seen[fresh] = True
            fresh = [k for k in np.unique(np.concatenate([links[k] for k in fresh])).tolist() if not seen[k]]
        left = np.flatnonzero(~seen)
        if not len(left):
            return links
        there = np.flatnonzero(seen)
        near = int(there[keys_to(x, x[left[0]], there, metric).argmin()])
        links[near], links[left[0]] = np.append(links[near], left[0]), np.append(links[left[0]], near)
        fresh = [int(left[0])]


def bulk(matrix: np.ndarray, metric: str, p: HnswParams = HnswParams()) -> Graph:  # noqa: B008
    """The graph of all rows at once: every level's candidates are the exact nearest rows, from products of blocks, and
    are spread as single inserts do it. The same seed and rows give the same graph."""
    n = len(matrix)
    levels = draw_levels(n, p)
    if not n:
        return Graph(0, levels, [], -1)
    entry = int(levels.argmax())
    links = []
    for level in range(int(levels[entry]) + 1):
        rows = np.flatnonzero(levels >= level)
        found = _level_links(matrix[rows], metric, p, p.m0 if level == 0 else p.m, int(np.searchsorted(rows, entry)))
        links.append({int(rows[k]): rows[x] for k, x in enumerate(found)})
    return Graph(n, levels, links, entry)


#: Queries that walk a graph side by side, and the open nodes of each that are followed in one step.
SIDE_BY_SIDE, STEP = 256, 4
#: Nodes that a filter keeps out and that are passed over, for each node followed.
BRIDGES = 4


class Walker:
    """Walks of many queries side by side: the same best-first search as ``search``, except that a step follows the
    nearest STEP open nodes of every query. distance(rows, nodes) gives the keys of pairs of a query and a node."""

    def __init__(self, graph: Graph):
        self.n, self.entry = graph.n, graph.entry
        self.levels = []
        for level in graph.links:
            counts = np.zeros(graph.n + 1, np.int64)
            for x, to in level.items():
                counts[x + 1] = len(to)
            order = sorted(level)
            self.levels.append((np.cumsum(counts), np.concatenate([level[x] for x in order]) if order else _NONE))

    def search(self, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], queries: int, ef: int, mask: np.ndarray | None = None, most: int | None = None, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries 0..queries-1 up to ef nodes and their keys (-1 and infinite where there are fewer), in no order, and
        which walks were given up: with a mask, those that looked at more than most nodes or ended without ef. without: a
        node for each query that its walk takes to be missing."""
        nodes, keys = np.full((queries, 1), self.entry), np.zeros((queries, 1))
        keys[:, 0] = distance(np.arange(queries), nodes[:, 0])
        for level in range(len(self.levels) - 1, 0, -1):
            nodes, keys, _ = self._beam(distance, nodes, keys, level, UPPER_BEAM, without=without)
        nodes, keys, looked = self._beam(distance, nodes, keys, 0, ef, mask, most, without)
        short = np.zeros(queries, bool) if mask is None else (nodes < 0).any(axis=1) & (looked < self.n)
        return nodes, keys, short if most is None else short | (looked > most)

    def _fresh(self, level: int, pairs: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Links of nodes that weren't seen; a pair is the query's number times n plus the node."""
        starts, flat = self.levels[level]
        query, node = np.divmod(pairs, self.n)
        count = starts[node + 1] - starts[node]
        ends = np.cumsum(count)
        to = np.repeat(query, count) * self.n + flat[np.repeat(starts[node] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        return np.unique(to[~seen[to]])

    def _beam(self, distance, nodes, keys, level, width, mask=None, most=None, without=None):
        n = self.n
        q = len(nodes)
        seen = np.zeros(q * n, bool)
        looked = (nodes >= 0).sum(axis=1)
        r, c = np.nonzero(nodes >= 0)
        seen[r * n + nodes[r, c]] = True
        if without is not None:
            seen[np.arange(q) * n + without] = True
        open_nodes, open_keys = _lowest(nodes, keys, max(width, keys.shape[1]))
        best_nodes, best_keys = _lowest(nodes, keys if mask is None else np.where((nodes >= 0) & mask[nodes], keys, np.inf), width)
        rows = np.arange(q)
        while len(rows):
            worst = best_keys[rows].max(axis=1)
            own = open_keys[rows]
            at = np.argpartition(own, STEP - 1, axis=1)[:, :STEP] if own.shape[1] > STEP else np.tile(np.arange(own.shape[1]), (len(rows), 1))
            near = np.take_along_axis(own, at, axis=1)
            go = np.isfinite(near) & (near <= worst[:, None])
            if most is not None:
                go &= (looked[rows] <= most)[:, None]
            open_keys[rows[:, None], at] = np.inf
            live = go.any(axis=1)
            rows, at, go = rows[live], at[live], go[live]
            if not len(rows):
                break
            i, j = np.nonzero(go)
            pair = self._fresh(level, rows[i] * n + open_nodes[rows[i], at[i, j]], seen)
            if mask is not None:
                # what the filter keeps out is a bridge: the links of some of them, taken as by chance, are followed at once
                fits = mask[pair % n]
                bridges = pair[~fits]
                bridges = bridges[np.lexsort((bridges % n * 0x9E3779B1 % 0xFFFFFFFB, bridges // n))]
                nth = np.arange(len(bridges)) - np.searchsorted(bridges // n, bridges // n)
                bridges = bridges[nth < BRIDGES * STEP]
                seen[bridges] = True
                beyond = self._fresh(level, bridges, seen)
                pair = np.union1d(pair[fits], beyond[mask[beyond % n]])
            seen[pair] = True
            row, to = np.divmod(pair, n)
            first = np.searchsorted(row, rows)
            many = np.diff(np.append(first, len(row)))
            looked[rows] += many
            if not len(row):
                continue
            more_nodes, more_keys = np.full((len(rows), many.max()), -1), np.full((len(rows), many.max()), np.inf)
            place = np.repeat(np.arange(len(rows)), many), np.arange(len(row)) - np.repeat(first, many)
            more_nodes[place], more_keys[place] = to, distance(row, to)
            best_nodes[rows], best_keys[rows] = _lowest(np.hstack([best_nodes[rows], more_nodes]), np.hstack([best_keys[rows], more_keys]), width)
            worst = best_keys[rows].max(axis=1)
            more_keys[more_keys > worst[:, None]] = np.inf
            open_nodes[rows], open_keys[rows] = _lowest(np.hstack([open_nodes[rows], more_nodes]), np.hstack([open_keys[rows], more_keys]), open_keys.shape[1])
        return best_nodes, best_keys, looked


def _lowest(nodes: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width nodes of lowest keys of each row, filled up with -1 at infinity."""
    if keys.shape[1] > width:
        at = np.argpartition(keys, width - 1, axis=1)[:, :width]
        nodes, keys = np.take_along_axis(nodes, at, axis=1), np.take_along_axis(keys, at, axis=1)
    out, own = np.full((len(keys), width), -1), np.full((len(keys), width), np.inf)
    out[:, : keys.shape[1]], own[:, : keys.shape[1]] = np.where(np.isfinite(keys), nodes, -1), keys
    return out, own


def _pair_keys(x: np.ndarray, q: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def keys(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        if metric == "l2":
            d = x[nodes] - q[rows]
            return np.einsum("ij,ij->i", d, d)
        return -np.einsum("ij,ij->i", x[nodes], q[rows])

    return keys


def _distances(x: np.ndarray, codes: np.ndarray | None, q: np.ndarray, metric: str, coded: sq8.Range | None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keys of pairs by vectors, or by codes where there are some."""
    if codes is None:
        return _pair_keys(x, q, metric)
    own = sq8.code_matrix(q, coded)
    return lambda rows, nodes: sq8.keys_of_pairs(codes[nodes], own[rows], coded, metric)


def _exact_nodes(x: np.ndarray, q: np.ndarray, k: int, metric: str, allowed: np.ndarray) -> Iterator[np.ndarray]:
    """For each query the allowed nodes that may be among its k nearest, by products of blocks."""
    y = x[allowed].astype(float)
    squares = np.einsum("ij,ij->i", y, y)
    step = max(1, BULK_NUMBERS // max(1, len(y)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        own = np.einsum("ij,ij->i", part, part)
        near = -(part @ y.T)
        if metric == "l2":
            near = own[:, None] + squares + 2 * near
        n = min(k, len(y))
        edge = np.partition(near, n - 1, axis=1)[:, n - 1] if n else np.zeros(len(part))
        # products in another order may differ in the last digits: keep a margin
        edge = edge + 1e-9 * (1 + own + squares.max(initial=0))
        for row, most in zip(near, edge, strict=True):
            yield allowed[np.flatnonzero(row <= most)]


#: A shard measures its recall on at most so many of its rows, for so many neighbours; beams are as wide as this recall needs.
TRIED, TRIED_K, WANTED_RECALL = 256, 10, 0.92


def needed_beam(graph: Graph, x: np.ndarray, metric: str, p: HnswParams, seed: int, coded: sq8.Range | None = None) -> int:
    """The beam, p.ef_search or wider, that reaches WANTED_RECALL, measured by searches for a bounded sample of the rows
    against comparing all. A row is taken to be missing while it is searched for, as most queries aren't rows of the
    shard: from a row that is a node its links lead straight to its neighbours."""
    k = min(TRIED_K, len(x) - 1)
    if k < 1:
        return p.ef_search
    some = np.sort(np.random.default_rng(seed).choice(len(x), min(TRIED, len(x)), replace=False))
    q = x[some].astype(float)
    codes = None if coded is None else sq8.code_matrix(x.astype(float), coded)
    distance, keys = _distances(x, codes, q, metric, coded), _pair_keys(x, q, metric)
    walker, truth = Walker(graph), []
    for row, nodes in enumerate(_exact_nodes(x, q, k + 1, metric, np.arange(len(x)))):
        nodes = nodes[nodes != some[row]]
        truth.append(nodes[np.argsort(keys(np.full(len(nodes), row), nodes), kind="stable")[:k]])
    ef = p.ef_search
    while True:
        found = walker.search(distance, len(q), ef, without=some)[0]
        hits = sum(len(np.intersect1d(t, f)) for t, f in zip(truth, found, strict=True))
        if hits >= WANTED_RECALL * k * len(q) or ef >= len(x):
            return ef
        ef = math.ceil(ef * 1.25)


INDEX = "shard int, n int, ids binary, vectors binary, dim int, graph binary, codes binary, starts binary, beam int"
#: Walks by codes keep at least this many times k candidates for the exact keys.
REFETCH = 4


def build_index(df: DataFrame, metric: str, p: HnswParams = HnswParams(), shards: int = 1, id_col: str = "id", vector: str = "vector", coded: sq8.Range | None = None, by_inserts: bool = False) -> DataFrame:  # noqa: B008
    """One row for each shard: its ids, distinct vectors, graph, and with coded the vectors' codes. Shards are built side by side; rows are dealt by a hash
    of their ids, so shards are of equal size. A shard's rows must fit a task: choose shards accordingly. by_inserts
    builds the graphs row by row in place of all at once.

    Rows of equal vectors are one node of the graph (starts: where each node's ids begin), so copies don't crowd out its
    links. beam is what ``needed_beam`` measured."""
    rows = df.select(F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).cast("long").alias("id"), metrics.doubles(F.col(vector)).alias("v"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy(np.int64)
        order = np.argsort(ids.astype(np.uint64), kind="stable")
        # stored numbers have 32 bits; + 0 makes -0 and 0 equal bytes
        x = np.stack(pdf["v"].to_numpy())[order].astype("<f4") + np.float32(0)
        ids, dim = ids[order], x.shape[1]
        _, first, node = np.unique(x.view(f"V{4 * dim}").ravel(), return_index=True, return_inverse=True) if dim else (None, np.zeros(1, np.int64), np.zeros(len(x), np.int64))
        # nodes in the order of their smallest ids
        place = np.empty(len(first), np.int64)
        place[np.argsort(first)] = np.arange(len(first))
        node = place[node]
        ids, x = ids[np.argsort(node, kind="stable")], x[np.sort(first)]
        starts = np.append(0, np.cumsum(np.bincount(node)))
        own = HnswParams(p.m, p.m0, p.ef_construction, p.ef_search, p.seed + int(key[0]), p.extend_candidates)
        wide = x.astype(np.float64)
        graph = Builder(wide, metric, own).graph if by_inserts else bulk(wide, metric, own)
        codes = None if coded is None else sq8.code_matrix(wide, coded).tobytes()
        kept = None if len(x) == len(ids) else starts.astype("<u4").tobytes()
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(ids)], "ids": [ids.tobytes()], "vectors": [x.tobytes()], "dim": [dim], "graph": [graph.to_bytes()], "codes": [codes], "starts": [kept], "beam": [needed_beam(graph, x, metric, p, own.seed, coded)]})

    return rows.groupBy("shard").applyInPandas(build, INDEX)


def search_index(index: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, ef: int, metric: str, allowed: DataFrame | None = None, coded: sq8.Range | None = None, shards: int | None = None) -> DataFrame:
    """qid, id, key: every shard's k nearest of each query. A beam is at least as wide as the shard measured it to need. With coded, the range of
    the index's codes, the graph is walked by codes and all that its beam holds are compared exactly. shards: their
    number, else it is counted. allowed: ids that may be found (a filter's), joined to their shards' rows; without it all
    may. A walk under a filter looks at as many nodes as it lets through or as twice its beam has links, whichever is
    less; queries whose walks go beyond that (what is let through lies far from them) are compared with all rows that the
    filter lets through, exactly."""
    if not queries:
        return index.sparkSession.createDataFrame([], "qid long, id long, key double")
    masked = allowed is not None
    qids, q = np.array([x for x, _ in queries]), np.array([v for _, v in queries], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                starts = np.arange(r.n + 1) if r.starts is None else np.frombuffer(r.starts, "<u4").astype(np.int64)
                nodes = len(starts) - 1
                x = np.frombuffer(r.vectors, "<f4").reshape(nodes, r.dim)
                graph = Graph.from_bytes(r.graph)
                mask = None
                if masked:
                    own = np.isin(ids, np.array(list(r.allowed) if r.allowed is not None else [], np.int64))
                    many = np.bincount(np.repeat(np.arange(nodes), np.diff(starts))[own], minlength=nodes)
                    ids, starts, mask = ids[own], np.append(0, np.cumsum(many)), many > 0
                if k and len(ids):
                    codes = None if coded is None else np.frombuffer(r.codes, np.uint8).reshape(nodes, r.dim)
                    width = min(nodes, max(ef, k if coded is None else REFETCH * k, 0 if pd.isna(r.beam) else int(r.beam)))
                    walker, most = Walker(graph), None if mask is None else min(int(mask.sum()), 2 * HnswParams.m0 * width)
                    for at in range(0, len(q), SIDE_BY_SIDE):
                        yield answered(walker, x, ids, starts, codes, qids[at : at + SIDE_BY_SIDE], q[at : at + SIDE_BY_SIDE], width, mask, most)

    def answered(walker, x, ids, starts, codes, names, part, width, mask, most) -> pd.DataFrame:
        found, _, short = walker.search(_distances(x, codes, part, metric, coded), len(part), width, mask, most)
        rest = iter(_exact_nodes(x, part[short], k, metric, np.flatnonzero(mask))) if short.any() else None
        out = []
        for row, near in enumerate(found):
            near = next(rest) if short[row] else near[near >= 0]
            keys = exact_keys(x[near].astype(float), np.repeat(part[row][None], len(near), axis=0), metric)
            if len(keys) > k:
                few = keys <= np.partition(keys, k - 1)[k - 1]
                near, keys = near[few], keys[few]
            # of equal vectors the first k ids
            count = np.minimum(starts[near + 1] - starts[near], k)
            ends = np.cumsum(count)
            own = ids[np.repeat(starts[near] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
            keys = np.repeat(keys, count)
            best = np.lexsort((own.astype(np.uint64), keys))[:k]
            out.append((np.full(len(best), names[row]), own[best], keys[best]))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(("qid", "id", "key"))})

    rows = index
    for name, kind in (("starts", "binary"), ("beam", "int")):
        if name not in index.columns:  # an index of before
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if masked:
        shards = shards or index.count()
        own = allowed.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id")
        # a shard's allowed ids are at most its rows, which fit a task
        rows = rows.join(own.groupBy("shard").agg(F.collect_list("id").alias("allowed")), "shard", "left")
    return rows.mapInPandas(run, "qid long, id long, key double")


def nearest(index: DataFrame, query: Sequence[float], k: int, metric: str, ef: int = 64, allowed: DataFrame | None = None, coded: sq8.Range | None = None) -> DataFrame:
    """rank, id, score of the k nearest rows over all shards."""
    found = search_index(index, [(0, query)], k, ef, metric, allowed, coded)
    top = found.orderBy("key", *metrics.id_order("id")).limit(k)
    return ranked(top).select("rank", "id", metrics.score(metric, F.col("key")).alias("score"))

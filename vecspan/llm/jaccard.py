"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Similar documents are partitioned into groups, each group's union of tokens is kept,
and a query document opens only those groups whose union could hold enough of its tokens: a partner at similarity s has
at least s times the query's tokens, so has the union of the partner's group.

1. All tokens are counted in one packed shuffle. A document more than 1 - s of whose tokens nobody else has can't have a
   partner and is done. Documents with equal sets become one representative.
2. Representatives are sorted by a min-hash; runs of equal min-hashes are cut into groups of a bounded size and linked
   within them by exact comparison, leaving out pairs that are connected already. A second min-hash does so again with
   other runs. Connected documents form components.
3. Each component's union of tokens meets the others' in one packed shuffle, which leaves the tokens that more than one
   component has, with their number of components. A document with too few of these has no partner outside its component.
   Of the others, the prefix (the share 1 - s of the tokens and one more, the rarest ones first; partners share at least
   one of it) is entered.
4. The matrix: by order of the min-hash, so that similar documents are side by side, these documents are dealt into parts
   of a bounded number of members and tokens, and within a part into groups. A document asks the parts in which it shares
   a token of the prefix. There every group's union bounds the overlap, the members of qualifying groups only are opened
   and compared, and components that are connected already are left out. A part that many ask is asked in slices.
5. Links and equal sets give the connected components. Steps 2 to 4 need only enough links for these.
6. All links: both ends of a link are in one component, so the representatives of each component are compared with one
   another, every pair of them, in blocks of a bounded number of members and tokens. What goes on is each
   representative's number of linked rows, never the links themselves, of which a component can have the square of its
   size.

So every pair of linked documents ends up in one component, none that isn't linked by a chain, and every link is counted
at both of its ends. Tokens are 64-bit hashes of shingles. Rows are numbered when they are first written; ids may be of
any type and value.

Cases: null and empty texts have no tokens and are linked with nothing; texts of fewer words than a shingle are one
token; repeated rows, and rows that share an id, are rows of their own, of which equal ones are linked; the component of
null ids is null unless a row with an id is in it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, bound_batches, discard, materialise, mix, releasing
from .graph import components
from .recurrence import batches_of, buckets_for, count_single, text_bytes


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    group: int = 64
    chunk: int = 128
    part: int = 2048
    part_tokens: int = 1 << 20
    asked: int = 8192
    block: int = 512
    block_tokens: int = 1 << 20


def tokens(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    w = Words(text, lower=True)
    return np.unique(w.hashes(min(k, len(w)))) if len(w) else np.zeros(0, np.uint64)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with a partner."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


_SALTS = [np.uint64(0x51A7C0DE12345677), np.uint64(0x0DDBA11CAFEF00D1)]


def _prints(t: np.ndarray) -> tuple[int, int]:
    """With the number of tokens these tell sets apart."""
    return (int(t.sum(dtype=np.uint64).astype(np.int64)), int(mix(t ^ _SALTS[0]).sum(dtype=np.uint64).astype(np.int64))) if len(t) else (0, 0)


def _counted(s: Settings):
    def items(text: str | None):
        t = tokens(text, s.shingle)
        # half of the tokens are counted, by a bit of their hash; single ones among them are still single
        return t[(t & np.uint64(1)) == 0], None, (len(t), *_prints(t))

    return items


def _supported(rows: DataFrame, s: Settings, n_bytes: int) -> DataFrame:
    """key, text → key, n, p1, p2 and whether the row may have a partner."""
    counts = count_single(rows, _counted(s), ["n", "p1", "p2"], n_bytes)
    return counts.withColumn("open", (F.col("n") > 0) & (F.col("single") <= F.floor(F.col("n") * (100 - s.percent) / 100)))


def _min_hashes(rows: DataFrame, s: Settings) -> DataFrame:
    """key, text → key, text, n, p1, p2, m0, m1."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens(x, s.shingle) for x in b.column("text").to_pylist()]
            mins = [[int(mix(t ^ salt).min().astype(np.int64)) if len(t) else 0 for salt in _SALTS] for t in found]
            numbers = [[len(t), *_prints(t), *m] for t, m in zip(found, mins, strict=True)]
            columns = [pa.array([x[k] for x in numbers], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), *columns], names=["key", "text", "n", "p1", "p2", "m0", "m1"])

    return rows.select("key", "text").mapInArrow(run, "key long, text string, n long, p1 long, p2 long, m0 long, m1 long").where("n > 0")


def _link(found: list[tuple[int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected within a list of documents; pairs that are connected already are left out."""
    parent = list(range(len(found)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            if root(i) != root(j) and linked(found[i][1], found[j][1], percent):
                parent[root(j)] = root(i)
                yield found[i][0], found[j][0]


def _grouped_links(rows: DataFrame, by: str, s: Settings) -> DataFrame:
    """Links within runs of equal min-hashes. Sorting by the document too lets a long run span many tasks."""
    salted = F.xxhash64("key", F.lit(by))
    dealt = rows.select("key", "text", F.col(by).alias("m"), salted.alias("x")).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "m", "x").sortWithinPartitions("m", "x")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            links = list(_link(held, s.percent)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["u", "v"])

        for b in batches:
            for key, text, m in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("m").to_pylist(), strict=True):
                if m != now or len(held) >= s.chunk:
                    if len(held) > 1:
                        yield close()
                    # the run's first document stays to be linked with the next ones
                    held = held[:1] if m == now else []
                    now = m
                held.append((key, tokens(text, s.shingle)))
        if len(held) > 1:
            yield close()

    return dealt.select("key", "text", "m").mapInArrow(run, "u long, v long")


def _mixed_tokens(rows: DataFrame, s: Settings, n_bytes: int) -> DataFrame:
    """component, sorted tokens (binary, unsigned 64-bit) and their numbers of components (unsigned 32-bit): the tokens of
    each component that another one has too.

    rows (component, key, text) are dealt by component, so that a batch knows most of a component's union and sends each
    of its tokens once.
    """
    buckets = buckets_for(rows, n_bytes)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("component", "key", "text").repartitionByRange(n, "component", "key").sortWithinPartitions("component", "key")

    @releasing
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for r in zip(b.column("component").to_pylist(), b.column("text").to_pylist(), strict=True))
        for part in batches_of(flat, lambda r: len(r[1] or "") + 64):
            found = [tokens(x, s.shingle) for _, x in part]
            h = np.concatenate(found)
            c = np.repeat(np.array([c for c, _ in part], np.int64), [len(t) for t in found])
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            h, c = h[new], c[new]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with h
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([h[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()), pa.array([c[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())],
                names=["bucket", "h", "c"],
            )

    def meet(t: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(t.column("h").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(t.column("c").to_pylist()), np.int64)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        # sorted by component too, so the first and the last of equal tokens tell
        last = np.append(starts[1:], len(h)) - 1
        size = last - starts + 1
        mixed = np.repeat(c[starts] != c[last], size)
        f = np.repeat(size, size)[mixed].astype(np.uint32)
        h, c = h[mixed], c[mixed]
        # a batch sends a token of a component once, so a component may count for each batch that it is in: the same way
        # for all, and only the order of tokens follows from it
        slot = (mix(c.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        h, c, f, slot = h[order], c[order], f[order], slot[order]
        full, at = np.unique(slot, return_index=True)
        cut = lambda x: pa.array([p.tobytes() for p in np.split(x, at[1:])] if len(full) else [], pa.binary())
        return pa.table({"slot": pa.array(full, pa.int32()), "h": cut(h), "c": cut(c), "f": cut(f)})

    def merge(t: pa.Table) -> pa.Table:
        h, c, f = (np.frombuffer(b"".join(t.column(k).to_pylist()), kind) for k, kind in (("h", np.uint64), ("c", np.int64), ("f", np.uint32)))
        order = np.lexsort((h, c))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
        order = order[new]
        h, c, f = h[order], c[order], f[order]
        whose, at = np.unique(c, return_index=True)
        parts = lambda x: pa.array([p.tobytes() for p in np.split(x, at[1:])] if len(whose) else [], pa.binary())
        return pa.table({"component": pa.array(whose, pa.int64()), "tokens": parts(h), "df": parts(f)})

    out = dealt.mapInArrow(send, "bucket int, h binary, c binary").groupBy("bucket").applyInArrow(meet, "slot int, h binary, c binary, f binary")
    return out.groupBy("slot").applyInArrow(merge, "component long, tokens binary, df binary")


def _reaching(rows: DataFrame, s: Settings) -> DataFrame:
    """component, key, text, m0, tokens and df (the component's mixed ones) → the rows with enough mixed tokens for a
    partner in another component, with the number of their tokens, their mixed ones (packed) and ``prefix``: the order of
    tokens is that of their numbers of components, in which unmixed ones come first, so of the prefix only what is mixed
    remains."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sizes, packed, prefixes = [], [], [], []
            for row, (text, mixed, df) in enumerate(zip(*[b.column(c).to_pylist() for c in ("text", "tokens", "df")], strict=True)):
                t, union = tokens(text, s.shingle), np.frombuffer(mixed, np.uint64)
                at = np.minimum(np.searchsorted(union, t), len(union) - 1)
                both = union[at] == t
                own, often = t[both], np.frombuffer(df, np.uint32)[at[both]]
                spare = len(t) - needed(len(t), s.percent) + 1 - (len(t) - len(own))
                if spare > 0:
                    keep.append(row)
                    sizes.append(len(t))
                    packed.append(own.tobytes())
                    prefixes.append(own[np.lexsort((own, often))[:spare]].astype(np.int64).tolist())
            at = pa.array(keep, pa.int64())
            columns = [pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("component", "key", "m0")], *columns], names=["component", "key", "m0", "n", "tokens", "prefix"])

    return rows.select("component", "key", "text", "m0", "tokens", "df").mapInArrow(run, "component long, key long, m0 long, n long, tokens binary, prefix array<long>")


def _dealt(rows: DataFrame, s: Settings, used: list[DataFrame]) -> DataFrame:
    """_reaching's rows with a part, in the order of min-hashes. A row weighs its share of a part's members or of its
    tokens, whichever is more; parts are cut from the running sum of weights, the same for any number of tasks. used takes up the
    tables behind the result."""
    ranges = max(1, -(-rows.count() // s.part))
    by = rows.withColumn("x", F.xxhash64("key")).repartitionByRange(ranges, "m0", "x").sortWithinPartitions("m0", "x")
    names = ["component", "key", "m0", "n", "tokens", "prefix", "range", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = TaskContext.get().partitionId(), 0.0
        for b in batches:
            weights = [max(1 / s.part, len(x) / 8 / s.part_tokens) for x in b.column("tokens").to_pylist()]
            sums = np.concatenate([[total], total + np.cumsum(weights)])
            total = float(sums[-1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:6]], pa.array([at] * len(weights), pa.int64()), pa.array(sums[:-1]), pa.array(sums[1:])], names=names)

    kinds = "component long, key long, m0 long, n long, tokens binary, prefix array<long>, range long, before double, after double"
    placed = materialise(by.drop("x").mapInArrow(run, kinds), "placed-parts")
    # one row for each range
    sums = placed.groupBy("range").agg(F.max("after").alias("sum")).withColumn("all", F.sum("sum").over(Window.orderBy("range")))
    first = materialise(sums.select(F.col("range").alias("_r"), (F.col("all") - F.col("sum")).alias("first")), "ranges")
    used += [placed, first]
    out = placed.join(first.hint("merge"), F.col("range") == F.col("_r"))
    return out.withColumn("part", F.floor(F.col("first") + F.col("before"))).drop("range", "before", "after", "_r", "first")


class _Postings:
    """For each of some sorted tokens, which of n holders have it."""

    def __init__(self, found: list[np.ndarray], n: int):
        h = np.concatenate(found)
        who = np.repeat(np.arange(n), [len(t) for t in found])
        order = np.argsort(h, kind="stable")
        h, self.who, self.n = h[order], who[order], n
        self.tokens, self.starts = np.unique(h, return_index=True)
        self.ends = np.append(self.starts[1:], len(h))

    def overlaps(self, t: np.ndarray) -> np.ndarray:
        """How many tokens of t each holder has."""
        at = np.minimum(np.searchsorted(self.tokens, t), len(self.tokens) - 1)
        at = at[self.tokens[at] == t]
        size = self.ends[at] - self.starts[at]
        before = np.cumsum(size) - size
        return np.bincount(self.who[np.repeat(self.starts[at] - before, size) + np.arange(size.sum())], minlength=self.n)


class _Part:
    """Members of one part: similar ones beside one another in groups, each with its union of tokens."""

    def __init__(self, members: list[tuple[int, int, int, np.ndarray]], s: Settings):
        self.s, self.members = s, members
        self.components, self.sizes = np.array([m[1] for m in members]), np.array([m[2] for m in members])
        unions = [np.unique(np.concatenate([m[3] for m in members[k : k + s.group]])) for k in range(0, len(members), s.group)]
        self.unions, self.opened = _Postings(unions, len(unions)), {}
        self.of = {c: c for c in set(self.components.tolist())}

    def root(self, c: int) -> int:
        while self.of.setdefault(c, c) != c:
            self.of[c] = c = self.of[self.of[c]]
        return c

    def open(self, group: int) -> _Postings:
        """The group's members by token; only groups that qualify for some query are ever opened."""
        if group not in self.opened:
            found = [m[3] for m in self.members[group * self.s.group : (group + 1) * self.s.group]]
            self.opened[group] = _Postings(found, len(found))
        return self.opened[group]

    def links(self, key: int, component: int, n: int, t: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of a query to members of components that it isn't connected with yet."""
        for group in np.flatnonzero(self.unions.overlaps(t) >= needed(n, self.s.percent)).tolist():
            first = group * self.s.group
            span = slice(first, first + self.s.group)
            if (self.components[span] == component).all():
                continue
            both = self.open(group).overlaps(t)
            fits = (self.components[span] != component) & (100 * both >= self.s.percent * (self.sizes[span] + n - both))
            for i in (first + np.flatnonzero(fits)).tolist():
                a, b = self.root(component), self.root(int(self.components[i]))
                if a != b:
                    self.of[a] = b
                    yield key, self.members[i][0]


_ASKED = ["part", "slice", "query", "m0", "key", "component", "n", "tokens"]


def _asked(parts: DataFrame, s: Settings, used: list[DataFrame]) -> DataFrame:
    """_dealt's rows → members of parts and the queries to them, by part and slice. Of two parts that share a token of a
    prefix the one asks the other; within a part all are asked."""
    matrix = parts.select("key", "part", F.explode("prefix").alias("token"))
    groups = matrix.select("token", F.col("part").alias("p")).distinct()
    asks = matrix.join(groups.hint("merge"), "token").where(F.col("p") >= F.col("part")).select(F.col("key").alias("_k"), "p").distinct()
    asks = materialise(asks, "asks")
    slices = materialise(asks.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / s.asked).alias("slices")), "slices")
    used += [asks, slices]
    members = parts.join(slices.hint("merge"), F.col("part") == F.col("p")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    placed = asks.join(slices.select(F.col("p").alias("_p"), "slices").hint("merge"), F.col("p") == F.col("_p")).select("_k", "p", F.pmod(F.xxhash64("_k"), "slices").alias("slice"))
    queries = parts.drop("part").join(placed.hint("merge"), F.col("key") == F.col("_k")).withColumnRenamed("p", "part")
    return members.withColumn("query", F.lit(False)).select(*_ASKED).unionByName(queries.withColumn("query", F.lit(True)).select(*_ASKED))


def _opened_links(rows: DataFrame, s: Settings) -> DataFrame:
    """_asked's rows → links."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "part", "slice").sortWithinPartitions("part", "slice", "query", "m0", "key")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for b in batches:
            u, v = [], []
            for number, piece, query, _, key, component, n, packed in zip(*[b.column(c).to_pylist() for c in _ASKED], strict=True):
                if (number, piece) != now:
                    now, held, part = (number, piece), [], None
                t = np.frombuffer(packed, np.uint64)
                if not query:
                    held.append((key, component, n, t))
                    continue
                if part is None:
                    part = _Part(held, s)
                for x, y in part.links(key, component, n, t):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


_CLASS = ["n", "p1", "p2"]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many tokens each set of a shares with each of b: products of 0/1 matrices, some tokens at a time."""
    out = np.zeros((len(a), len(b)), np.int64)
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    sides = []
    for found in (a, b):
        h = np.concatenate(found)
        at = np.searchsorted(both, h)
        shared = both[np.minimum(at, len(both) - 1)] == h if len(both) else np.zeros(len(h), bool)
        who, at = np.repeat(np.arange(len(found)), [len(t) for t in found])[shared], at[shared]
        order = np.argsort(at, kind="stable")
        sides.append((who[order], at[order]))
    for lo in range(0, len(both), width):
        n = min(width, len(both) - lo)
        ones = []
        for found, (who, at) in zip((a, b), sides, strict=True):
            s, e = np.searchsorted(at, [lo, lo + n])
            m = np.zeros((len(found), n), np.float32)
            m[who[s:e], at[s:e] - lo] = 1
            ones.append(m)
        # sums of at most width ones are exact in 32-bit floats
        out += (ones[0] @ ones[1].T).astype(np.int64)
    return out


def _block_links(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a are linked with which of b."""
    if len(a) * len(b) <= 16:
        return np.array([[linked(x, y, percent) for y in b] for x in a], bool).reshape(len(a), len(b))
    both = _overlaps(a, b)
    na, nb = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    return 100 * both >= percent * (na[:, None] + nb[None, :] - both)


def _link_counts(few: DataFrame, classes: DataFrame, found: DataFrame, s: Settings, used: list[DataFrame]) -> DataFrame:
    """n, p1, p2 (a set of tokens) → ``links``: the rows whose sets are other ones and linked with it.

    few are representatives, found their components. Each component is cut into blocks
    by a hash of the set, and each pair of blocks is met in one place.
    """
    n = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = few.select("key", "text", *_CLASS).join(found.hint("merge"), F.col("key") == F.col("node")).select("component", "text", *_CLASS)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / s.block), F.ceil(F.col("all") / s.block_tokens))
    sizes = materialise(sizes.select(F.col("component").alias("_c"), blocks.alias("blocks")), "sizes")
    used.append(sizes)
    members = members.join(sizes.hint("merge"), F.col("component") == F.col("_c")).drop("_c")
    weights = classes.select(*[F.col(c).alias(f"_{c}") for c in _CLASS], "rows")
    same = (F.col("n") == F.col("_n")) & (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2"))
    members = members.join(weights.hint("merge"), same).withColumn("block", F.pmod(F.xxhash64(*_CLASS), F.col("blocks")))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *_CLASS, "rows", "text")
    dealt = paired.repartition(n, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ({}, {})

        def close() -> Iterator[pa.RecordBatch]:
            one = now[1] == now[2]
            (ka, a, wa), (kb, b, wb) = [(list(x), [t for t, _ in x.values()], np.array([w for _, w in x.values()], np.int64)) for x in (sides[0], sides[0] if one else sides[1])]
            if not a or not b:
                return
            links = _block_links(a, b, s.percent)
            if one:
                np.fill_diagonal(links, False)
            counts = [(ka, links @ wb)] if one else [(ka, links @ wb), (kb, wa @ links)]
            for keys, c in counts:
                rows = [(*k, x) for k, x in zip(keys, c.tolist(), strict=True) if x]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=[*_CLASS, "links"])

        for batch in batches:
            for component, lo, hi, block, *key, rows, text in zip(*[batch.column(c).to_pylist() for c in ("component", "lo", "hi", "block", *_CLASS, "rows", "text")], strict=True):
                if (component, lo, hi) != now:
                    if now is not None:
                        yield from close()
                    now, sides = (component, lo, hi), ({}, {})
                side = sides[0 if block == lo else 1]
                if tuple(key) not in side:
                    side[tuple(key)] = (tokens(text, s.shingle), rows)
        if now is not None:
            yield from close()

    counted = dealt.mapInArrow(run, "n long, p1 long, p2 long, links long")
    return counted.groupBy(*_CLASS).agg(F.sum("links").alias("links"))


def _with_components(rows: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    found = found.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(found.hint("merge"), F.col(key) == F.col("_n"), "left").withColumn("component", F.coalesce("_c", key)).drop("_n", "_c")


def _connected(numbered: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """numbered: key, _id, text. Every row's key, id and set; the classes of equal sets that may have partners, with
    their component and ``best``, the least id (null ones last) and key of the component; the representatives that may be
    linked with other ones; node and component of all of them that are linked."""
    n_bytes = text_bytes(numbered, "text")
    keyed = numbered.select("key", "text")
    base = _supported(keyed, s, n_bytes).select(F.col("key").alias("_k"), "n", "p1", "p2", "open")
    base = materialise(numbered.select("key", "_id").join(base.hint("merge"), F.col("key") == F.col("_k")).drop("_k"), "support")
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("key").alias("key"))).alias("best")
    classes = base.where("open").groupBy(*_CLASS).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows"), best)
    classes = materialise(classes, "classes")
    # representatives, whole; then only those that other representatives support
    texts = materialise(keyed.join(classes.select(F.col("first").alias("_f")).hint("merge"), F.col("key") == F.col("_f")).select("key", "text"), "representatives", "zstd")
    again = _supported(texts, s, n_bytes).where("open").select(F.col("key").alias("_f"))
    few = materialise(_min_hashes(texts.join(again.hint("merge"), F.col("key") == F.col("_f")), s), "few", "zstd")
    discard(texts)
    near = materialise(_grouped_links(few, "m0", s).unionByName(_grouped_links(few, "m1", s)), "grouped")
    placed = materialise(_with_components(few.select("key", "text", "m0"), components(near)), "placed", "zstd")
    mixed = materialise(_mixed_tokens(placed, s, n_bytes), "mixed")
    own = mixed.select(F.col("component").alias("_c"), "tokens", "df")
    reaching = materialise(_reaching(placed.join(own.hint("merge"), F.col("component") == F.col("_c")), s), "reaching")
    discard(placed, mixed)
    used: list[DataFrame] = []
    parts = materialise(_dealt(reaching, s, used), "parts")
    discard(reaching, *used)
    used = [parts, near]
    links = materialise(near.unionByName(_opened_links(_asked(parts, s, used), s)), "links")
    discard(*used)
    found = components(links)
    discard(links)
    placed = materialise(_with_components(classes, found, "first"), "classes")
    discard(classes)
    classes = placed
    least = classes.groupBy("component").agg(F.min("best").alias("least")).select(F.col("component").alias("_c"), "least")
    least = materialise(least, "least")
    classes = classes.drop("best").join(least.hint("merge"), F.col("component") == F.col("_c")).drop("_c").withColumnRenamed("least", "best")
    placed = materialise(classes, "placed-classes")
    discard(least)
    return base, placed, few, found


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (the least id of the component) and n_links of every row: the exact number of
    other rows that a row is linked with, those of equal sets among them."""
    bound_batches(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    numbered = materialise(numbered, "numbered", "zstd")
    base, classes, few, found = _connected(numbered, s)
    discard(numbered)
    used: list[DataFrame] = [few]
    counts = materialise(_link_counts(few, classes, found, s, used), "counts")
    discard(*used)
    # rows that can't have a partner don't take part: many may have the same, empty set
    total = classes.join(counts.hint("merge"), _CLASS, "left").select(*_CLASS, F.col("best.id").alias("component_id"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    total = materialise(total, "totals")
    linked_rows = base.where("open").join(total.hint("merge"), _CLASS).select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = base.where("not open").select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked_rows.unionByName(alone)


def document_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles and component_id of every row: the join's result without the number of links, which the
    query's SQL doesn't have."""
    return jaccard_join(docs, id_col, text_col, s).drop("n_links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Of the rows of each component that with the least id, and every row without a partner; all columns as they are."""
    bound_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)], F.lit(True).alias("row"))
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"), packed.alias("_row")), "numbered", "zstd")
    base, classes, few, _ = _connected(numbered, s)
    discard(few)
    stays = classes.select(*_CLASS, F.col("best.key").alias("_stays"))
    gone = base.where("open").join(stays.hint("merge"), _CLASS).where("key <> _stays").select(F.col("key").alias("_gone"))
    kept = numbered.join(gone.hint("merge"), F.col("key") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"_row.c{rest.index(c)}").alias(c) for c in docs.columns])

"""The number of links of the Jaccard join against brute force."""

from __future__ import annotations

import random

from tests.llm import brute
from tests.llm.test_operators import corner_rows, text
from vecspan.llm import jaccard


def n_links(rows: list[tuple]) -> list[int]:
    """Of every row the other rows that it is linked with, each pair compared."""
    sets = [brute.shingles(t) for _, t in rows]
    out = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                out[i] += 1
                out[j] += 1
    return out


def check(spark, rows: list[tuple], s: jaccard.Settings) -> list[int]:
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), s=s).collect()
    want = n_links(rows)
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((x.doc_id, x.n_shingles, x.n_links) for x in got), key=order) == sorted(((d, len(brute.shingles(t)), n) for (d, t), n in zip(rows, want, strict=True)), key=order)
    return want


def test_links_of_near_copies(spark):
    """A group in which nearly all pairs are linked, copies of some of its texts, and a chain, whole and in small blocks."""
    r = random.Random(31)
    base, rows = text(r, 250).split(), []
    for i in range(70):
        w = list(base)
        w[r.randrange(len(w))] = f"m{i}"
        w[r.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i % 5][1]) for i in range(12)]
    w = text(r, 100).split()
    for i in range(30):
        rows.append((200 + i, " ".join(w)))
        w[3 * i % 100] = f"c{i}"
    rows += [(300 + i, text(r, 40)) for i in range(10)]
    for s in (jaccard.Settings(), jaccard.Settings(block=9), jaccard.Settings(block_tokens=800)):
        want = check(spark, rows, s)
    # more links than a spanning forest has
    assert sum(want) > 2 * 1000


def test_links_in_corner_cases(spark):
    check(spark, [(d, t) for d, t, *_ in corner_rows()], jaccard.Settings(block=2))
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_qualifying_groups_are_opened():
    """A query's tokens are all in one group: that one is opened, others never."""
    import numpy as np

    s = jaccard.Settings(group=4)
    tokens = [np.unique(mixed.astype(np.uint64)) for mixed in (np.arange(100 * k, 100 * k + 50) for k in range(12))]
    part = jaccard._Part([(k, k, 50, t) for k, t in enumerate(tokens)], s)
    assert list(part.links(99, 99, 50, tokens[5])) == [(99, 5)] and list(part.opened) == [1]
    assert list(part.links(98, 98, 50, np.arange(5000, 5050, dtype=np.uint64))) == [] and list(part.opened) == [1]
    # too few tokens in any one group, though enough in all together
    assert list(part.links(97, 97, 60, np.sort(np.concatenate([t[:5] for t in tokens])))) == [] and list(part.opened) == [1]


def test_ids_of_any_value(spark):
    r = random.Random(3)
    base = text(r, 60)
    rows = [(2**62 + 5, base), (-7, base + " x"), (2**63 - 1, text(r, 60))]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.component_id, x.n_links) for x in got} == {2**62 + 5: (-7, 1), -7: (-7, 1), 2**63 - 1: (2**63 - 1, 0)}
    named = jaccard.jaccard_join(spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")).collect()
    assert {x.doc_id: x.component_id for x in named}[f"d{2**62 + 5}"] == min(f"d{2**62 + 5}", "d-7")


def test_parts_follow_the_rows(spark):
    """Documents of 6 of 30 passages share tokens with most others: within one part's size every document asks once, and
    a part that many ask is cut into slices without losing a link."""
    r = random.Random(4)
    passages = [text(r, 30) for _ in range(30)]
    rows = [(i, " ".join(r.sample(passages, 6))) for i in range(240)]
    rows += [(1000 + i, rows[i][1].replace(rows[i][1].split()[7], f"n{i}", 1)) for i in range(0, 240, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.components(rows))
    seen, asked = [], jaccard._asked

    def spy(parts, s, used):
        out = asked(parts, s, used)
        seen.append((out.where("query").count(), out.where("not query").count(), out.select("part", "slice").distinct().count()))
        return out

    jaccard._asked = spy
    try:
        for s in (jaccard.Settings(), jaccard.Settings(part=64, asked=50)):
            assert sorted(map(tuple, jaccard.document_components(df, s=s).collect())) == want
    finally:
        jaccard._asked = asked
    assert all(q <= m for q, m, _ in seen[:1]) and seen[0][2] == 1 and seen[1][2] > 4

"""Each operator against a plain version, an exact round trip or held-out rows, and in the corner cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm import brute
from tests.oracle import compare
from vecspan.llm import bpe, exact_dedup, graph, jaccard, licenses, media, packing, quality, queries, substrings, toxicity, url_filter
from vecspan.llm.common import Words
from vecspan.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(r: random.Random, n: int, words: int = 5000) -> str:
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def corner_rows() -> list[tuple]:
    """Nulls in any column, empty and white texts, a long one, exact and near copies, repeated rows, shared passages."""
    r = random.Random(4)
    base, passage = text(r, 120), text(r, 50)
    near = base.split()
    near[60] = "changed"
    long = text(r, 6000)
    texts = [
        None, "", " \t\n", "one", "one two three four", base, base, base.replace(" ", "\n "), " ".join(near), base.upper(), text(r, 40) + " " + passage + " " + text(r, 40),
        passage + " " + text(r, 30), long, "x" * 3000, text(r, 34), "a b " * 60, "Licensed under the Apache License, Version 2.0.\nfine.", "ünïcödé — 文字 \u2028 tést " * 8, "|" * 40,
    ]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (500, text(r, 60), None, None, None), (None, text(r, 70), "de", None, 3)]
    return rows


@pytest.fixture(scope="module")
def corner(spark):
    return spark.createDataFrame(corner_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def key(row) -> tuple:
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_queries_equal_their_sql(spark):
    for name, sql in queries.ORACLES.items():
        compare(queries.QUERIES[name](spark, SMALL), sql, SMALL)


def test_words():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("ab é\t\n \x0b文") for _ in range(r.randrange(30)))
        w, want = Words(t), brute.WORD.findall(t)
        assert len(w) == len(want) and w.data.tobytes().decode() == " ".join(want)
        keep = np.array([r.random() < 0.5 for _ in want], bool)
        assert w.join(keep).decode() == " ".join(x for x, k in zip(want, keep, strict=True) if k) if want else True
        for k in (1, 2, 5):
            h = w.hashes(k).tolist()
            runs = [tuple(want[i : i + k]) for i in range(len(want) - k + 1)]
            assert len(h) == len(runs) and len(set(h)) == len(set(runs))


def test_jaccard(spark, corner, none, small):
    rows = corner_rows()
    ids = [(1 << 40 if d is None else d, t) for d, t, *_ in rows]
    want = sorted((None if d == 1 << 40 else d, n, None if c == 1 << 40 else c) for d, n, c in brute.components(ids) if d != 1 << 40)
    got = [tuple(x) for x in jaccard.document_components(corner).collect()]
    assert sorted(x for x in got if x[0] is not None) == want
    assert [x for x in got if x[0] is None] == [(None, 66, None)]
    assert jaccard.document_components(none).count() == 0
    own = [(x.doc_id, x.text) for x in small.collect()]
    assert sorted(map(tuple, jaccard.document_components(small).collect())) == sorted(brute.components(own))
    kept = jaccard.keep_one_of_each(corner.withColumn("key", F.lit(1)).withColumn("n", F.lit(2)))
    assert kept.columns == [*corner.columns, "key", "n"]
    assert sorted({x.doc_id for x in kept.collect() if x.doc_id is not None}) == sorted({d for d, _, c in want if d == c})


def test_jaccard_with_large_groups_and_chains(spark):
    """Groups beyond the size of a chunk and a part, a chain of near copies, and a passage that everything shares."""
    r = random.Random(9)
    base, passage = text(r, 100).split(), text(r, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[r.randrange(len(w))] = f"m{i}"
        rows.append((i, " ".join(w)))
    w = text(r, 100).split()
    for i in range(30):
        rows.append((100 + i, " ".join(w)))
        w[3 * i % 100] = f"c{i}"
    rows += [(200 + i, " ".join(passage + text(r, 5 + i % 12).split())) for i in range(40)]
    rows += [(300 + i, " ".join(text(r, 90).split() + passage)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (jaccard.Settings(), jaccard.Settings(group=4, chunk=5, part=7)):
        assert sorted(map(tuple, jaccard.document_components(df, s=s).collect())) == sorted(brute.components(rows))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    parent = {}
    for a, b in edges:
        parent.setdefault(a, {a}), parent.setdefault(b, {b})  # noqa: B018
        if parent[a] is not parent[b]:
            parent[a] |= parent[b]
            for x in parent[b]:
                parent[x] = parent[a]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == min(p) for n, p in parent.items())


def test_substrings(spark, corner, none, small):
    rows = [(d, t) for d, t, *_ in corner_rows()]
    assert sorted(map(tuple, substrings.substring_dedup(corner).collect()), key=key) == sorted(brute.substrings(rows), key=key)
    assert substrings.substring_dedup(none).count() == 0
    own = [(x.doc_id, x.text) for x in small.collect()]
    assert sorted(map(tuple, substrings.substring_dedup(small).collect())) == sorted(brute.substrings(own))
    cut = substrings.cut_repeats(corner.withColumn("found", F.lit(1)).withColumn("_text", F.lit(2)))
    assert cut.columns == [*corner.columns, "found", "_text"] and cut.schema["n_chars"].dataType == corner.schema["n_chars"].dataType
    assert {(x.found, x._text) for x in cut.collect()} == {(1, 2)}
    texts = {x.doc_id: x for x in cut.collect()}
    assert texts[10].text is not None and texts[10].n_chars == len(texts[10].text) and len(texts[10].text.split()) == 80 and texts[4].text == "one two three four" and texts[0].text is None


def test_substrings_at_random(spark):
    """Few words, so that windows recur everywhere, within texts too."""
    r = random.Random(8)
    s = substrings.Settings(window=6, phrase=3)
    rows = [(i, text(r, r.randrange(40), 4)) for i in range(25)]
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), s=s)
    assert sorted(map(tuple, got.collect())) == sorted(brute.substrings(rows, 6))


def test_substrings_need_the_automata(spark):
    """Without the automata's occurrences nothing is removed; ids may be strings."""
    r = random.Random(18)
    passage = text(r, 50)
    rows = [(f"d{i}", f"{text(r, 20)} {passage} {text(r, 20)}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, substrings.substring_dedup(df).collect())) == sorted(brute.substrings(rows))
    automaton = substrings.compiled([" a b c "])
    assert substrings.occurrences(automaton, Words("x a b c a b c d a b"), 3).tolist() == [1, 4]
    assert substrings.occurrences(substrings.compiled([]), Words("a b c"), 3).tolist() == []


def test_chosen_phrases_agree_between_equal_windows():
    r = np.random.default_rng(3)
    h = r.integers(0, 50, 300).astype(np.uint64)
    picked = set(substrings.chosen(h, 7).tolist())
    for i in range(len(h) - 6):
        w = h[i : i + 7]
        assert i + 6 - int(np.argmin(w[::-1])) in picked
    assert len(substrings.chosen(h[:5], 7)) == 0


def test_exact_dedup(spark, corner, none):
    rows = corner_rows()
    normal = lambda t: brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(normal(t), []).append(d)
    want = []
    for d, t, *_ in rows:
        g = groups[normal(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    for block in (512, 16):
        got = exact_dedup.exact_dedup(corner, block=block).drop("copies")
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_exact_copies(corner.withColumn("name", F.lit("x")).withColumn("_k", F.lit("y")).withColumn("_row", F.lit("z")))
    assert kept.columns == [*corner.columns, "name", "_k", "_row"] and {(x.name, x._k, x._row) for x in kept.collect()} == {("x", "y", "z")}
    assert sorted((x.doc_id for x in kept.collect()), key=lambda x: -1 if x is None else x) == sorted({w[0] for w in want if w[3]}, key=lambda x: -1 if x is None else x)


def test_exact_dedup_has_no_python(corner):
    plan = exact_dedup.exact_dedup(corner)._jdf.queryExecution().toString() + licenses.licence_scan(corner)._jdf.queryExecution().toString()
    # operators of a plan stand at the start of a line; a licence has the language's name
    names = {line.lstrip(" :+-").split(" ")[0] for line in plan.split("\n")}
    assert "Project" in names and not any(x in n for n in names for x in ("Python", "Arrow", "Pandas")) and "PythonUDF" not in plan


def test_licenses(spark, corner, none):
    rows = [
        (1, "Code.\nLicensed under the Apache License, Version 2.0.\nyou may not use this file except in compliance with the License."),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files! The software is provided as is, without warranty of any kind. Released under the MIT License."),
        (3, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.\nEither version 3 of the License, or (at your option) any later version."),
        (4, "Released under the MIT Licence."), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0.\r\nother words. This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {x.doc_id: x for x in licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].licenses == "Apache-2.0" and got[1].sentence_ids == "~,Apache2,Apache2Comply" and got[1].n_sentences == 3
    assert got[2].licenses == "MIT" and got[3].licenses == "GPL-3.0-or-later" and got[4].licenses == "" and got[4].sentence_ids == ""
    assert got[5].n_sentences == 0 and got[6].licenses == "" and got[7].licenses == "GPL-3.0-only,CC-BY-NC-4.0"
    assert licenses.licence_scan(corner.withColumn("ids", F.lit(1))).count() == len(corner_rows()) and licenses.licence_scan(none).count() == 0


def test_media(spark, corner, none):
    rows = {x.doc_id: x for x in media.text_media(corner).collect()}
    for d, t, *_ in corner_rows():
        data = (t or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        x = rows[d]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert x.tail_crc32 == zlib.crc32(full[-64:]) and x.codec == "raw " and x.duration == len(full) and x.n_samples == len(full) // 64
        stored = media.mux(full)
        assert (x.media_bytes, x.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert b"".join(stored[k["offset"] : k["offset"] + k["size"]] for k in x.keyframes) == b"".join(full[i : i + 64] for i in range(0, len(full), 1024))
    assert media.text_media(none).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(media.mux(bytes(64))[:-70]))], "doc_id long, media binary")
    assert [x.codec for x in media.probe_media(bad).orderBy("doc_id").collect()] == [None, None, None]
    again = media.probe_media(media.to_media(spark.createDataFrame([(1, bytearray(b"x"), "y", 7)], "doc_id long, payload binary, codec string, n_bytes int"), "payload"))
    assert again.first().codec == "raw " and again.first().n_bytes == 1 and again.columns.count("codec") == 1


def box(kind: bytes, body: bytes) -> bytes:
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def words4(*x: int) -> bytes:
    return b"".join(k.to_bytes(4, "big") for k in x)


def movie(*tracks: tuple) -> bytes:
    """A file written here, byte by byte: of each track handler, codec, sizes, samples of each chunk, offsets and sync
    samples (None: no such box)."""
    out = b""
    for handler, codec, sizes, per, offsets, sync in tracks:
        runs = b"".join(words4(k + 1, n, 1) for k, n in enumerate(per))
        table = box(b"stsd", words4(0, 1) + box(codec, bytes(8))) + box(b"stsz", words4(0, 0, len(sizes), *sizes)) + box(b"stsc", words4(0, len(per)) + runs) + box(b"stco", words4(0, len(offsets), *offsets))
        table += box(b"stss", words4(0, len(sync), *sync)) if sync is not None else b""
        out += box(b"trak", box(b"mdia", box(b"mdhd", words4(0, 0, 0, 600, 1200, 0)) + box(b"hdlr", words4(0, 0) + handler + bytes(12)) + box(b"minf", box(b"stbl", table))))
    return box(b"moov", out)


def test_media_of_several_tracks():
    sound, picture = (b"soun", b"mp4a", [3, 4, 5], [2, 1], [2000, 2100], None), (b"vide", b"avc1", [10, 20, 30, 40], [1, 3], [2200, 2300], [1, 3])
    for tracks in ((sound, picture), (picture, sound)):
        data = movie(*tracks) + box(b"mdat", bytes(range(256)) * 10)
        p = media.probe(data)
        assert (p["codec"], p["timescale"], p["duration"]) == ("avc1", 600, 1200)
        assert p["samples"].tolist() == [[2200, 10], [2300, 20], [2320, 30], [2350, 40]] and p["keyframes"].tolist() == [[2200, 10], [2320, 30]]
        assert media.demux(data, p["samples"]) == data[2200:2210] + data[2300:2390]
    p = media.probe(movie(sound) + box(b"mdat", bytes(3000)))
    assert p["codec"] == "mp4a" and p["keyframes"].tolist() == p["samples"].tolist() == [[2000, 3], [2003, 4], [2100, 5]]


def test_media_that_lie():
    """Counts, sizes and nesting beyond the file are errors before anything is allocated; random damage is never more."""
    whole = media.mux(bytes(640))
    at = whole.index(b"stsz")
    nested = box(b"moov", b"")
    for _ in range(3000):
        nested = box(b"moov", nested)
    bad = [whole[: at + 12] + b"\xff\xff\xff\xff" + whole[at + 16 :], nested, whole[: at + 8] + words4(0, (1 << 32) - 1) + whole[at + 16 :]]
    for kind in (b"stco", b"stss", b"stsc", b"stsz"):
        k = whole.index(kind) + 8 + 4 * (kind == b"stsz")
        bad.append(whole[:k] + b"\x7f\xff\xff\xff" + whole[k + 4 :])
    for data in bad:
        with pytest.raises((ValueError, KeyError)):
            media.demux(data, media.probe(data)["samples"])
    r = random.Random(12)
    for _ in range(500):
        data = bytearray(whole)
        for _ in range(r.randrange(1, 6)):
            data[r.randrange(len(data) - 640)] = r.randrange(256)
        try:
            media.demux(bytes(data), media.probe(bytes(data))["samples"])
        except (ValueError, KeyError, IndexError, media.struct.error):
            pass


def test_packing(spark, corner, none):
    path = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert t.encode("hello <|startoftext|> world", add_special_tokens=False).ids == np.frombuffer(next(packing.WordCache(path, 9).ids(["hello <|startoftext|> world"])), "<u4").tolist()
    small = packing.Capacity(tokens=64, attention=64 * 64, documents=64)
    for capacity in (packing.Capacity(), small, packing.Capacity(tokens=64, documents=2, attention=3000, rule="dot")):
        got = packing.best_fit_packing(corner, path, capacity, shard_pieces=10).collect()
        pieces = []
        for d, x, *_ in corner_rows():
            ids = t.encode(x or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), capacity.tokens):
                part = ids[k : k + capacity.tokens]
                pieces.append((d, k // capacity.tokens, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert sorted((tuple(x)[:5] for x in got), key=key) == sorted(pieces, key=key)
        bins = {}
        for x in got:
            bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))]
            total = sum(n for _, n in b)
            assert total <= capacity.tokens and len(b) <= capacity.documents and (len(b) == 1 or sum(n * n for _, n in b) <= capacity.attention)
    assert packing.best_fit_packing(none, path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_is_close_to_the_bound(rule):
    r = np.random.default_rng(3)
    lengths = np.minimum(r.lognormal(6, 1, 3000).astype(int) + 1, 2048)
    bins, offsets = packing.best_fit(lengths, packing.Capacity(rule=rule))
    assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 2048) + 1
    assert (offsets + lengths <= 2048).all()


def test_word_cache_equals_the_tokenizer():
    c = packing.WordCache(tokenizer_path("word_bpe_49k.json"), 50)
    r = random.Random(5)
    texts = ["a\u0085b", "Σ Σας ΑΣ İx", "é ́x", "don't x'll we'RE", "  ", "a\u2028b\u00a0c", "ﬁ Ⅷ ½", "x\x1cy \x1d", "<|endoftext|> a", "\u200bq", "１２ x9y"]
    texts += ["".join(r.choice("abÀé'1 .,-\n文Σ") for _ in range(r.randrange(40))) for _ in range(300)]
    assert list(c.ids(texts)) == [c.whole(t) for t in texts]


def test_bpe(spark, corner, none, monkeypatch):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x.doc_id: x for x in bpe.encode(corner, path, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for d, t, *_ in corner_rows():
        ids = enc.encode_ordinary(t or "")
        assert got[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(corner, path, public_tokenizers.PATTERN, keep_ids=True), path)
    assert {x.doc_id: bytes(x.decoded).decode() for x in back.collect()} == {d: t or "" for d, t, *_ in corner_rows()}
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    # words at and above the fold's length, ids of another type, several shards of one task
    monkeypatch.setattr(bpe, "SHARD_BYTES", 3000)
    r = random.Random(2)
    texts = ["".join(r.choice("abcde") for _ in range(n)) for n in (300, bpe.LONG, bpe.LONG + 1, 9000)] + ["é" * 700, "it's  a\n\n test 123"]
    texts += [text(r, r.randrange(300)) for _ in range(40)]
    named = bpe.encode(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1), path, public_tokenizers.PATTERN, keep_ids=True)
    assert {x.doc_id: x.ids for x in named.collect()} == {f"d{i}": enc.encode_ordinary(t) for i, t in enumerate(texts)}
    for _ in range(100):
        w = "".join(r.choice("aabcde th") for _ in range(r.randrange(1, 300))).encode()
        assert bpe.merge_long(w, ranks) == enc._core_bpe.encode_single_piece(w)


def test_urls(spark):
    rows = [
        (1, "http://a.EXAMPLE.com/en/123?x=1"), (2, "https://example.com/en/7"), (3, "https://example.com/fr/7"), (4, "http://x.net/de/8"), (5, "http://m.example.net/de/81#t"), (6, None),
        (7, "no separator"), (8, "http://notexample.org/es/"), (9, "http://org/es/x"), (10, "x://b.com?q=/en/"), (11, "a://b.org/es/://c.com/en/"), (12, ""), (13, "http://com/en"), (1, "http://a.EXAMPLE.com/en/123?x=1"),
    ]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))).collect()
    by = {x.page_id: tuple(x)[1:] for x in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.example.com", "/en/123", "com/en/", "block") and by[2] == ("example.com", "/en/7", "example.com/en/7", "allow") and by[3][2:] == (None, "allow")
    assert by[4][2:] == ("net/de/", "allow") and by[5][2:] == ("example.net/de/8", "block") and by[6] == ("", "", None, "allow") and by[7] == by[6] == by[12]
    assert by[8][2] == "org/es/" and by[9][2] == "org/es/" and by[10] == ("b.com", "", None, "allow") and by[11][0] == "b.org" and by[13][2] is None
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), []).where("verdict = 'allow'").count() == len(rows)


def test_toxicity(spark, corner, none):
    r = random.Random(6)
    bad = ["scum", "moron", "loser"]
    rows, labels = [], []
    for i in range(400):
        w = text(r, r.randrange(3, 150), 300).split()
        if toxic := i % 4 == 0:
            for _ in range(1 + len(w) // 40):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, toxicity.train(docs, marks)).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    held = [x for x in got if x.held_out]
    truth = {i: t for i, _, t in labels}
    assert len(held) > 50 and sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    model = toxicity.train(docs, marks)
    marked = toxicity.toxicity(corner, model).collect()
    assert len(marked) == len(corner_rows()) and all(0 <= x.score <= 1 for x in marked)
    assert len({x.score for x in marked if x.doc_id == 5}) == 1
    assert toxicity.toxicity(none, model).count() == 0
    assert {x.score for x in toxicity.toxicity(corner, toxicity.train(docs, marks.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.train(docs, marks.limit(0)) == 0.0 and toxicity.train(none, marks) == 0.0


def test_toxicity_gradients():
    s = toxicity.Settings(hidden=3, vector=2, attention=3, window=5, stride=3, buckets=50)
    r = np.random.default_rng(0)
    net = toxicity.Network(s, {"a": 1, "bb": 2}, np.array([0, 0.5, 0.2]), np.abs(r.standard_normal(50)))
    for k in net.p:
        net.p[k] = net.p[k].astype(float) + 0.1 * r.standard_normal(net.p[k].shape)
    words, at, mask = ["a", "bb", "ccc", "dddd"], r.integers(0, 4, (5, 3)), np.ones((5, 3), bool)
    mask[3:, 1] = mask[1:, 2] = False
    y = np.array([1.0, 0, 1])

    def loss():
        q = 1 / (1 + np.exp(-net.run(net.project(net.inputs(words)[0]), at, mask)))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    for k, g in net.step(words, at, mask, y, np.ones(3)).items():
        flat, i = net.p[k].reshape(-1), int(np.abs(g).argmax())
        old = flat[i]
        flat[i] = old + 1e-2
        up = loss()
        flat[i] = old - 1e-2
        down = loss()
        flat[i] = old
        assert (up - down) / 2e-2 == pytest.approx(g.reshape(-1)[i], rel=1e-3, abs=1e-6), k


def test_windows_cover_everything():
    s = toxicity.Settings()
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        w = toxicity.windows(n, s)
        assert w[0][0] == 0 and w[-1][1] == n and all(b[0] <= a[1] and b[0] - a[0] == s.stride for a, b in zip(w, w[1:]))


def test_quality(spark, corner, none, small):
    """Trained on some labels, held against the others."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    known = F.col("doc_id") % 3 > 0
    model = quality.train(small, labels.where(known))
    truth = {x.doc_id: x.quality for x in labels.where(~known).collect()}
    got = [x for x in quality.quality(small, model).collect() if x.doc_id in truth]
    assert len(got) > 20 and sum((x.score >= 0.5) == truth[x.doc_id] for x in got) >= 0.9 * len(got)
    again = quality.train(small.repartition(7), labels.where(known))
    assert [x.score for x in quality.quality(small, again).orderBy("doc_id").collect()] == pytest.approx([x.score for x in quality.quality(small, model).orderBy("doc_id").collect()], abs=1e-4)
    assert quality.quality(none, model).count() == 0 and quality.train(small, labels.limit(0)) == 1.0 and quality.train(none, labels) == 1.0
    scored = quality.quality(corner, model).collect()
    assert len(scored) == len(corner_rows()) and all(0 <= x.score <= 1 for x in scored)
    kept = quality.keep_good(corner.withColumn("_quality", F.lit(1)).withColumn("_row", F.lit(2)), model)
    assert kept.columns == [*corner.columns, "_quality", "_row"] and 0 < kept.count() <= len(corner_rows()) and {(x._quality, x._row) for x in kept.collect()} == {(1, 2)}
    assert quality.quality(small.select("doc_id", "text"), model).count() == small.count()
    # scores are those of a plain pass over the views
    row = small.orderBy("doc_id").first()
    c, m = quality.content(row.text), quality.metadata(row.lang, row.source, row.n_chars, row.text.count("\n") + 1, model.sources)
    assert quality.quality(small.where(f"doc_id = {row.doc_id}"), model).first().score == pytest.approx(model.scores(c[None], m[None])[2][0])


def test_co_training_uses_the_pool():
    """Few labels and many documents: each view is better with what the other names than on the labels alone."""
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 6000)
    views = [y[:, None] + 1.1 * r.standard_normal((6000, n)) for n in (12, 9)]
    lots = [tuple(x[k : k + 500] for x in views) for k in range(0, 4000, 500)]
    few = tuple(x[:24] for x in views), y[:24]
    together = quality.co_train(*few, lambda f, *x: sum(f(v, *x) for v in lots))
    alone = quality.co_train(*few, lambda f, *x: f(tuple(v[:0] for v in views), *x))

    def ranked(m) -> float:
        sides = [v.logit(x[4000:]) for v, x in zip((m.content, m.metadata), views, strict=True)]
        return sum(float((z[y[4000:] == 1][:, None] > z[y[4000:] == 0]).mean()) for z in sides)

    assert ranked(together) > ranked(alone) + 0.005


def test_exchanged_sums_add_up():
    r = np.random.default_rng(2)
    views = (r.standard_normal((50, 4)), r.standard_normal((50, 3)))
    y = (views[0][:, 0] + views[1][:, 0] > 0).astype(float)
    models = [quality.Logistic().fit(x, y) for x in views]
    cuts = [(-0.5, 0.5), (-1.0, 0.2)]
    parts = [tuple(x[k : k + 7] for x in views) for k in range(0, 50, 7)]
    assert sum(quality.exchanged_sums(p, models, cuts) for p in parts) == pytest.approx(quality.exchanged_sums(views, models, cuts))
    assert sum(quality.logit_counts(p, models) for p in parts).tolist() == quality.logit_counts(views, models).tolist()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want, columns = docs, docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before = want
        stage(spark, before, SMALL).write.parquet(str(tmp_path / str(k)))
        want = spark.read.parquet(str(tmp_path / str(k)))
        rows = [(x.doc_id, x.text) for x in before.collect()]
        if name != "best_fit_packing":
            assert want.columns == columns
            got = {x.doc_id: x.text for x in want.collect()}
        if name == "exact_dedup":
            first = {}
            for d, t in sorted(rows):
                first.setdefault(brute.re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
            assert set(got) == set(first.values())
        elif name == "ngram_jaccard_join":
            assert set(got) == {d for d, _, c in brute.components(rows) if d == c}
        elif name == "substring_dedup":
            removed = {d: (n, sha) for d, _, n, sha in brute.substrings(rows)}
            assert set(got) == set(removed)
            for d, t in rows:
                n, sha = removed[d]
                assert got[d] == t if not n else hashlib.sha256(got[d].encode()).hexdigest() == sha
    assert want.select("doc_id").distinct().count() == len(got)
    assert sorted(map(tuple, p.run(spark, SMALL).drop("sequence_id", "offset").collect())) == sorted(map(tuple, want.drop("sequence_id", "offset").collect()))

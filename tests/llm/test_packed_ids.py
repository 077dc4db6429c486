"""Packed sequences hold their tokens."""

from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_operators import DOCS, corner_rows, key
from vecspan.llm import packing
from vecspan.llm.queries import tokenizer_path


def test_packed_ids(spark):
    """Ids of every piece, repeated rows' and null ids' too, beside the same places as without them."""
    path, capacity = tokenizer_path("word_bpe_49k.json"), packing.Capacity(tokens=64, attention=64 * 64, documents=64)
    docs = spark.createDataFrame(corner_rows(), DOCS)
    cache, want = packing.WordCache(path, 1000), []
    for d, t, *_ in corner_rows():
        ids = [*np.frombuffer(cache.whole(t or ""), "<u4").tolist(), 0]
        want += [(d, k // 64, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    got = packing.best_fit_packing(docs, path, capacity, shard_pieces=10, keep_ids=True)
    rows = [(x.doc_id, x.piece, np.frombuffer(bytes(x.ids), "<u4").tolist()) for x in got.collect()]
    assert sorted(rows, key=lambda x: (key(x[:2]), x[2])) == sorted(want, key=lambda x: (key(x[:2]), x[2]))
    thin = packing.best_fit_packing(docs, path, capacity, shard_pieces=10)
    assert got.columns == [*thin.columns, "ids"] and sorted(map(tuple, got.drop("ids").collect()), key=key) == sorted(map(tuple, thin.collect()), key=key)
    empty = packing.best_fit_packing(spark.createDataFrame([], DOCS), path, keep_ids=True)
    assert empty.count() == 0


def test_the_last_stage_keeps_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.packed_sequences(spark, docs, SMALL).collect()
    assert rows and all(len(x.ids) == 4 * x.length and zlib.crc32(bytes(x.ids)) == x.ids_crc32 for x in rows)

"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard, licenses, media, packing, quality, substrings, toxicity, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.document_components(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.text_media(table(spark, sf_dir, "documents"))
    first, last = F.try_element_at("keyframes", F.lit(1)), F.try_element_at("keyframes", F.lit(-1))
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["size"])), ",")
    feature = F.concat_ws(
        ";", "codec", F.concat(F.lit("seconds="), F.col("duration") / F.col("timescale")), F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("keyframes="), F.size("keyframes")),
        F.concat(F.lit("first="), first["offset"]), F.concat(F.lit("last="), last["offset"]), F.concat(F.lit("ranges="), F.crc32(ranges)),
    )
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scans": op3_license_scans,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_media_columns": op6_media_columns,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filters": op10_url_filters,
}

ORACLES = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT w.doc_id, count(t) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * m >= 80 * (x.n + y.n - m)),
        reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u)
        SELECT n.doc_id, n.n AS n_shingles, min(v) AS component_id FROM n JOIN reach ON n.doc_id = u GROUP BY ALL""",
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        k AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        r AS (SELECT t FROM k GROUP BY t HAVING count(*) > 1),
        c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM k SEMI JOIN r USING (t))),
        f AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM w),
        a AS (SELECT f.doc_id, count(c.j) AS n, string_agg(CASE WHEN c.j IS NULL THEN x END, ' ' ORDER BY f.j) AS kept FROM f LEFT JOIN c ON f.doc_id = c.doc_id AND f.j = c.j GROUP BY f.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON w.doc_id = a.doc_id""",
    "op3_license_scans": licenses.oracle(),
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
        g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""",
    "op10_url_filters": url_filter.oracle(),
}

"""Exact dedup by deterministic block naming (DataFrame functions only).

A normalised text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name (the distinct blocks
are sorted and numbered); then adjacent names are paired and the pairs are named in the same way, level by level, until
one name is left. Byte length and last name together identify a text without any chance of a collision.

A document whose length and first block occur once is told apart from all others already, so only documents that tie
there go through the remaining levels. Names and groups are counted before they are shuffled, and they are joined back
by sort-merge joins whose hot keys adaptive execution splits; no group is ever gathered in one task.

Cases: null texts count as empty; texts of white space only equal one space; repeated rows (same id, same text) count
singly in ``group_size`` and share one result; the smallest non-null id stays; a null id stays only where its whole
group has none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

BLOCK = 512


def normalised(text: Column) -> Column:
    """Each run of white space as one space; the pattern passes over single spaces, which stay."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a column name: the place of their key columns among the distinct ones, sorted by a hash and then by
    themselves, as an integer."""
    names = rows.groupBy(*keys).agg(F.xxhash64(*keys).alias("_"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges are cut by the short hash, so what is sampled for their bounds stays small whatever the keys' length
    names = names.repartitionByRange(n, "_").sortWithinPartitions("_", *keys).withColumn("name", F.monotonically_increasing_id())
    names = names.select(*[F.col(k).alias(f"_{k}") for k in keys], "name")
    on = None
    for k in keys:
        on = F.col(k) == F.col(f"_{k}") if on is None else on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(names.hint("merge"), on).drop(*[f"_{k}" for k in keys], *keys)


def identities(texts: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """texts: key columns, ``n_bytes`` and ``bytes`` (binary), one row for each key. Returns key, n_bytes, name."""
    last = F.greatest(F.ceil(F.col("n_bytes") / block).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("bytes"), i * block + 1, F.lit(block)))
    at = texts.select(*key, "n_bytes", F.posexplode(blocks).alias("pos", "block"))
    names = materialise(_named(at, ["block"]), "names-0")
    done, level = [], 1
    while True:
        # one name left: finished; the others pair up
        width = block * 2 ** (level - 1)
        done.append(names.where(F.col("n_bytes") <= width).select(*key, "n_bytes", "name"))
        rest = names.where(F.col("n_bytes") > width)
        if rest.isEmpty():
            break
        half = F.col("pos") % 2
        pairs = rest.groupBy(*key, "n_bytes", F.floor(F.col("pos") / 2).cast("int").alias("next")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        names = materialise(_named(pairs.withColumnRenamed("next", "pos"), ["left", "right"]), f"names-{level}")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and ``copies``, the number of rows
    that share both id and text."""
    text = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    heads = materialise(
        base.select("doc_id", F.octet_length("t").alias("n_bytes"), F.sha2(F.col("t"), 256).alias("sha"), F.substring(F.col("t").cast("binary"), F.lit(1), F.lit(block)).alias("head")), "heads"
    )
    ties = heads.groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("n_bytes").alias("_n"), F.col("head").alias("_h"))
    # written, so that the join below meets two plain shuffles, whose hot keys can be split
    ties = materialise(ties, "ties")
    tied = heads.join(ties.hint("merge"), (F.col("n_bytes") == F.col("_n")) & (F.col("head") == F.col("_h"))).select("doc_id", "sha")
    tied = materialise(tied.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("copies")), "tied")
    discard(ties)
    whole = base.select(F.col("doc_id").alias("_d"), F.col("t"))
    texts = whole.join(tied.hint("merge"), F.col("_d").eqNullSafe(F.col("doc_id"))).where(F.sha2(F.col("t"), 256) == F.col("sha"))
    # repeated rows have one key and one text; the join has brought the rows of a key together
    first = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("copies"))
    texts = materialise(texts.withColumn("_r", first).where("_r = 1").select("doc_id", "sha", "copies", F.octet_length("t").alias("n_bytes"), F.col("t").cast("binary").alias("bytes")), "texts")
    discard(tied)
    named = identities(texts, ["doc_id", "sha", "copies"], block)
    discard(texts)
    groups = named.groupBy("n_bytes", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialise(groups.select(F.col("n_bytes").alias("_n"), F.col("name").alias("_m"), "keep_id", "group_size"), "groups")
    found = named.join(groups.hint("merge"), (F.col("n_bytes") == F.col("_n")) & (F.col("name") == F.col("_m")))
    found = found.select(F.col("doc_id").alias("_d"), F.col("sha").alias("_s"), "copies", "keep_id", "group_size")
    out = heads.select("doc_id", "sha").join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sha") == F.col("_s")), "left")
    keep = F.when(F.col("_s").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without the rows whose text another row keeps; of repeated rows one stays. All columns stay as they are."""
    kept = exact_dedup(docs, id_col, text_col, block).where("kept").select(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s")).distinct()
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    keyed = docs.select(whole.alias("_row"), F.col(id_col).alias("_i"), F.sha2(normalised(F.col(text_col)), 256).alias("_k"))
    rows = keyed.join(kept.hint("merge"), F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_s")))
    first = F.row_number().over(Window.partitionBy("_d", "_k").orderBy("_s"))
    return rows.withColumn("_r", first).where("_r = 1").select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])

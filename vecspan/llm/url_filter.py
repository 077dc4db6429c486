"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL's host and path are expanded into the expressions that a rule could have: host suffixes of as many labels as
some rule has, with path prefixes of as many characters as some rule's path has. Expressions and rules are hashed; a
short hash prefix is the key of an equi-join, the full digests confirm it, and of the rules that fit the longest wins
(of equally long ones that with the longer host). Only distinct hosts and paths are expanded.

Cases: a null URL and one without ``://`` have an empty host and path, fit no rule and get the default verdict; repeated
rows keep their own result each; an empty table or rule list works; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) of the production rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
PREFIX = 8
#: Rule tables up to this many rows are broadcast; longer ones are shuffled like any other table.
BROADCAST_RULES = 100_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = [(v, h, p) for v, h, p in rules]
    t = spark.createDataFrame(rows, "rule_verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat("rule_host", "rule_path"), 256)
    return t.select("rule_verdict", F.concat("rule_host", "rule_path").alias("rule_text"), F.length("rule_host").alias("rule_host_length"), digest.alias("rule_digest"), F.substring(digest, 1, PREFIX).alias("prefix"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, or null) and verdict of every row."""
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    numbers = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")
    names = F.split("host", r"\.", -1)
    suffixes = F.transform(F.filter(numbers(labels), lambda k: k <= F.size(names)), lambda k: F.array_join(F.slice(names, -k, k), "."))
    prefixes = F.transform(F.filter(numbers(lengths), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    # the rules' table has as many rows as the list that was passed in
    table = rule_table(pages.sparkSession, rules)
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    expressions = urls.select("host", "path").distinct().select("host", "path", F.explode(both).alias("expression"))
    expressions = expressions.select("host", "path", F.sha2("expression", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX))
    hits = expressions.join(table, "prefix").where(F.col("digest") == F.col("rule_digest"))
    best = F.max(F.struct(F.length("rule_text").alias("n"), "rule_host_length", "rule_text", "rule_verdict")).alias("best")
    found = hits.groupBy("host", "path").agg(best).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "best")
    out = urls.join(found.hint("merge"), (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select("page_id", "host", "path", F.col("best.rule_text").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def oracle(rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> str:
    """DuckDB SQL for the same rows, by plain comparison with every rule."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
        WITH rules(v, h, p) AS (VALUES {values}),
        cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        urls AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        best AS (SELECT host, path, max(row(length(h) + length(p), length(h), h || p, v)) AS b
                 FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
        SELECT page_id, u.host, u.path, b[3] AS rule, coalesce(b[4], '{default}') AS verdict
        FROM urls u LEFT JOIN best ON u.host = best.host AND u.path = best.path"""

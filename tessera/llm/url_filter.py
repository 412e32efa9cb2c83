"""URL filters: expressions of host suffix and path prefix, matched by short hash, then by digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower

#: verdict, host, path
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
PREFIX_HEX = 8


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(verdict, host, path) of a list of rules, as a plan whose size the planner knows."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("verdict", "host", "path")))
    lits = [F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("verdict", "host", "path"), strict=True))) for r in rules]
    return spark.range(1).select(F.explode(F.array(*lits)).alias("r")).select("r.*")


def parts(url) -> tuple[F.Column, F.Column]:
    """Host and path of a URL; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, SPLIT, 1)), F.regexp_extract(url, SPLIT, 2)


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict.

    Each URL expands into host suffix + path prefix, for the numbers of labels and path lengths that
    rules have (the shapes; as many as the rules' distinct lengths, whatever the number of rules). The
    expressions meet the rules on the first `PREFIX_HEX` hex digits of their SHA-256; a hit counts
    if the whole digests agree. Of several rules the longest expression wins, then the longer
    host, then `allow`. A page that no rule fits gets `default` and a null rule. The rules
    are broadcast only below Spark's size threshold; beyond it the join is by prefix, its hot
    prefixes split by AQE. The rule expressions are unique after their own precedence is settled.

    Nulls: a null URL has an empty host and path; a null id is kept. Rules with nulls
    fit nothing. Repeated pages give repeated rows. Empty tables are fine on either side.
    """
    rules = (
        rules.select("verdict", ascii_lower("host").alias("host"), "path")
        .dropna()
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .select("host", "path", "verdict", F.concat("host", "path").alias("expr"))
        .withColumn("digest", F.sha2("expr", 256))
    )
    shapes = sorted(
        rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct().collect()
    )
    host, path = parts(F.col(url_col))
    labels = F.split("host", r"\.")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    pieces = [
        F.when(
            (F.size(labels) >= n) & (F.length("path") >= m),
            F.struct(
                F.lit(n).alias("n"),
                F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring("path", 1, m)).alias("expr"),
            ),
        )
        for n, m in shapes
    ]
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("expr"))
    expressions = F.array_compact(F.array(none, *pieces))
    hits = (
        base.select("page_id", "url", "host", "path", F.explode(expressions).alias("e"))
        .select("page_id", "url", "host", "path", "e.n", F.sha2("e.expr", 256).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    listed = rules.select(
        F.substring("digest", 1, PREFIX_HEX).alias("prefix"),
        F.col("digest").alias("full"),
        F.struct(F.length("expr").alias("long"), F.length("host").alias("host_long"), F.col("expr"), F.col("verdict")).alias("r"),
    )
    return (
        hits.join(listed, "prefix", "left")
        .withColumn("r", F.when(F.col("full") == F.col("digest"), F.col("r")))
        .groupBy("page_id", "url", "host", "path")
        .agg(F.max("r").alias("r"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("copies"))
        .select(
            "page_id",
            "url",
            "host",
            "path",
            F.col("r.expr").alias("rule"),
            F.coalesce("r.verdict", F.lit(default)).alias("verdict"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        )
        .drop("copy")
    )

"""Exact dedup by skew-safe combining, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Runs that one space replaces, without the runs that are one space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text) -> F.Column:
    """The text with each run of blanks replaced by one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("body")).select(
        "doc_id", "body", F.unhex(F.sha2("body", 256)).alias("digest")
    )


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, body, keep_id, group_size), one row per distinct content."""
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    return (
        salted.repartition("digest")
        .groupBy("digest", "body")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised contents are; of equal texts the row with the smallest
    id stays. The stages: Spark's partial aggregation deduplicates each task's rows locally; the
    rows of a digest then merge under one of `salts` salts; the winners of the salts are combined
    globally. Every stage groups by the whole text beside the digest, so contents are compared. A
    group, however large, reaches the last stage as `salts` rows. Groups return to the documents
    by digest, and, should one digest stand for several contents, by content for those.

    Nulls: a null text is the empty text. A null id counts as after all others; a group of null
    ids only has a null keep_id and keeps each row. Rows that repeat the smallest id of their
    group are all kept. An empty table gives no rows. No other column is read.
    """
    rows = _rows(docs, id_col, text_col)
    by_digest = written(
        _groups(rows, salts)
        .groupBy("digest")
        .agg(
            F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents")
        ),
        "digests",
    )
    plain = by_digest.where("contents = 1").select("digest", "keep_id", "group_size")
    out = rows.select("doc_id", "digest").join(plain, "digest")
    shared = by_digest.where("contents > 1").select("digest")
    if shared.limit(1).count():
        several = rows.join(shared, "digest", "left_semi")
        out = out.unionByName(
            several.join(_groups(several, salts), ["digest", "body"]).select("doc_id", "digest", "keep_id", "group_size")
        )
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

"""Counts and checks over a projection's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows replaced by, or added as, `rows`."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def replace_chunks(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """chunks without those of changed documents, plus fresh ones."""
    return chunks.join(changed.select("document_id"), "document_id", "left_anti").unionByName(fresh)


def integrity(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, links: DataFrame, dimension: int) -> DataFrame:
    """One row of defect counts and `ok`."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        count(chunks.join(docs, "document_id", "left_anti"), "orphan_chunks"),
        count(docs.join(chunks, "document_id", "left_anti"), "documents_without_chunks"),
        count(missing_vectors(chunks, vectors), "chunks_without_vector"),
        count(vectors.join(chunks, "chunk_id", "left_anti"), "orphan_vectors"),
        count(vectors.where(F.size("embedding") != dimension), "wrong_dimension"),
        count(chunks.groupBy("document_id", "position").count().where("count > 1"), "duplicate_positions"),
        count(docs.groupBy("path").count().where("count > 1"), "duplicate_paths"),
        count(links.where("target is not null").join(docs.select(F.col("document_id").alias("target")), "target", "left_anti"), "dangling_links"),
    ]
    out = parts[0]
    names = list(out.columns)
    for p in parts[1:]:
        out = out.crossJoin(p)
        names += p.columns
    bad = F.lit(0)
    for n in names:
        bad = bad + F.col(n)
    return out.withColumn("ok", bad == 0)


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out

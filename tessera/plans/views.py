"""The corpus of linked documents that the queries read, derived from the driver's tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import META, classify

#: Search texts that the batch's queries ask in turn.
SEARCHES = (
    (0, "the entry of ing thand tionble"),
    (1, "licensed under the Apache-License"),
    (2, "where is the MIT License, Version 2.0?"),
    (3, "reserved rights and heit von der"),
    (4, "Doc 17 que ciónmente"),
    (5, "über größe thatand ment-ion"),
)
#: Every vector whose id this divides is a query, against all rows.
QUERY_STEP = 100
#: Texts for the rules over queries.
ASKED = (
    (0, ""),
    (1, "good morning!"),
    (2, "ok."),
    (3, "which port does the gateway use"),
    (4, "why was parquet picked instead of avro files"),
    (5, "what happened on 2025-02-11 after the restart"),
    (6, "quote the article about columnar storage"),
    (7, "latest status of the billing migration"),
    (8, "compare broadcast joins versus sorted merges and how does skew change them"),
    (9, "delete the stale branches now"),
    (10, "look up the retention rules in our notes"),
    (11, "project: p3 ingest layout and partitions"),
    (12, "foo AND NOT bar* (baz:qux) \"quoted\""),
    (13, "Row row ROW"),
    (14, "north south east west up down"),
    (15, "see ```select 1``` there please"),
    (16, "the of and"),
    (17, "when do snapshots expire; what is the row limit and why is it so low?"),
    (18, "entry rights and also reserved license versus thand ing"),
)
RAW_LINKS = (
    (0, "side-note"), (1, "projects/p2/Plans#Later|plans"), (2, "/wiki/harbour.md"), (3, "  |x"), (4, "C/d/E.md"), (5, "Long Name|short"), (6, "#only"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows, names: tuple[str, ...]) -> DataFrame:
    """A short fixed list as a plan of known size."""
    structs = [F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with paths, titles, times and path classes."""
    i = F.col("doc_id")
    n, own = i.cast("string"), F.concat(F.lit("wiki/projects/p"), (F.floor(i / 10) % 7).cast("string"), F.lit("/"))
    shapes = [
        (F.lit("raw/papers/doc-"), F.lit(".md")), (F.lit("Clippings/ideas/doc-"), F.lit(".md")), (F.lit("Clippings/doc-"), F.lit(".md")),
        (F.lit("wiki/index-"), F.lit(".md")), (F.concat(own, F.lit("d")), F.lit("/current-state.md")), (F.concat(own, F.lit("d")), F.lit("/decisions.md")),
        (F.concat(own, F.lit("d")), F.lit("/log.md")), (F.concat(own, F.lit("note-")), F.lit(".md")), (F.lit("wiki/page-"), F.lit(".md")),
        (F.lit("ops/op-"), F.lit(".md")),
    ]
    path = F.concat(shapes[9][0], n, shapes[9][1])
    for k in range(9):
        path = F.when(i % 10 == k, F.concat(shapes[k][0], n, shapes[k][1])).otherwise(path)
    rows = table(spark, sf_dir, "documents").select(
        i.alias("document_id"), path.alias("path"), F.concat(F.lit("Doc "), n).alias("title"), (i * 1000).alias("updated_at_ns"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.withColumn("m", classify(F.col("path"))).select("*", *(F.col(f"m.{c}").alias(c) for c in META)).drop("m")


def body() -> F.Column:
    return F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))


def links(docs: DataFrame) -> DataFrame:
    """(link_id, source, key, hint): each document has four links. Two name others by the stem of their path, the third by the
    path from the root, the fourth by the path's last two parts or, every other time, relative to its own folder."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    i = F.col("document_id")
    aims = F.array((i * 7 + 3) % F.col("n"), (i * 13 + 5) % F.col("n"), (i * 11 + 2) % F.col("n"), (i * 5 + 4) % F.col("n"))
    to = docs.crossJoin(F.broadcast(n)).select(i.alias("source"), F.posexplode(aims).alias("k", "aim"))
    whole = F.lower(F.regexp_replace("path", r"\.md$", ""))
    names = docs.select(i.alias("aim"), whole.alias("whole"))
    parts = F.split("whole", "/")
    tail = F.array_join(F.slice(parts, -2, 2), "/")
    hint = F.when(F.col("k") == 2, F.col("whole")).when((F.col("k") == 3) & (F.col("source") % 2 == 0), tail).when(F.col("k") == 3, F.concat(F.lit("../"), tail))
    rows = to.join(names, "aim")
    return rows.select((F.col("source") * 4 + F.col("k")).alias("link_id"), "source", F.element_at(parts, -1).alias("key"), hint.alias("hint"))

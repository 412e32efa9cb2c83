"""A run of the indexer: what changed, chunks with their ids kept, vectors, links, and the log of runs."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import embedding_input
from tessera.operators.chunking import chunk_documents
from tessera.operators.graph import communities, link_rows, resolve_links
from tessera.operators.lexical import WEIGHTS, build_index
from tessera.plans.evaluation import corpus_fingerprint
from tessera.plans.projection import missing_vectors, summary
from tessera.settings import Settings
from tessera.sources.embedding import Embedder, embed_rows, upsert_vectors
from tessera.sources.vault import Projection, changes, needs_reembed, parse, reuse_chunks, scan

RUN_LOG = "run_id long, mode string, started_ns long, finished_ns long, added long, updated long, removed long, skipped long, state string, error string"
VECTORS = "chunk_id long, embedding array<float>, model string"


@dataclass(frozen=True)
class IndexRun:
    """What a run did."""

    mode: str
    added: int
    updated: int
    removed: int
    skipped: int
    embedded: int


def numbered(rows: DataFrame, key: str, known: DataFrame | None, out: str) -> DataFrame:
    """rows with a long `out`: that of `known` (key, out) where it has the key, else a hash of the key, cleared of the sign.

    No count over all rows is needed, so none meet in one task; a rebuild gives the same ids.
    """
    fresh = F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    if known is None:
        return rows.withColumn(out, fresh)
    return rows.join(known.select(key, F.col(out).alias("__known")), key, "left").withColumn(out, F.coalesce("__known", fresh)).drop("__known")


def merge_documents(old: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents as they are now, change of each path). A document whose hash and time are unchanged keeps its stored row; one
    whose time alone differs takes the new time (a refresh of metadata); others are replaced."""
    if old is None:
        return numbered(new, "path", None, "document_id"), new.select("path", F.lit("added").alias("change"), F.lit(True).alias("text_changed"))
    change = changes(old, new)
    hashes = old.select("path", F.col("content_hash").alias("was")).join(new.select("path", F.col("content_hash").alias("is")), "path", "full_outer")
    change = change.join(hashes, "path").select("path", "change", (~F.col("was").eqNullSafe(F.col("is"))).alias("text_changed"))
    fresh = numbered(new, "path", old, "document_id")
    same = change.where("change = 'skipped'").select("path")
    kept = old.join(same, "path", "left_semi")
    return kept.unionByName(fresh.join(same, "path", "left_anti").select(*kept.columns)), change


def chunk_rows(docs: DataFrame, old: DataFrame | None, settings: Settings) -> DataFrame:
    """Chunks of docs with ids: an old chunk of equal embedding input keeps its id, and so its vector."""
    made = chunk_documents(docs, settings.chunk_chars).join(docs.select("document_id", "title", "aliases", "tags"), "document_id")
    made = made.withColumn("input", embedding_input(F.col("title"), F.col("heading_path"), F.col("aliases"), F.col("tags"), F.col("text")))
    made = made.withColumn("input_hash", F.sha2("input", 256)).drop("title", "aliases", "tags")
    turn = F.row_number().over(Window.partitionBy("document_id", "input_hash").orderBy("position"))
    keyed = made.withColumn("__key", F.concat_ws("/", F.col("document_id").cast("string"), "input_hash", turn.cast("string")))
    fresh = F.xxhash64("__key").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    if old is None:
        return keyed.withColumn("chunk_id", fresh).drop("__key")
    reused = reuse_chunks(old.select("document_id", "chunk_id", F.col("input_hash").alias("input")), keyed.select("document_id", "position", F.col("input_hash").alias("input")))
    return keyed.join(reused.select("document_id", "position", "chunk_id"), ["document_id", "position"]).withColumn("chunk_id", F.coalesce("chunk_id", fresh)).drop("__key")


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with a body whose chunks are lost; a run chunks them anew, changed or not."""
    return docs.where("trim(body) <> ''").join(chunks.select("document_id").distinct(), "document_id", "left_anti")


def snapshot(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, postings_of: DataFrame) -> DataFrame:
    """One row: counts of the tables and the corpus fingerprint."""
    counts = summary({"documents": documents, "chunks": chunks, "vectors": vectors, "indexed": postings_of})
    wide = counts.groupBy().pivot("name", ["documents", "chunks", "vectors", "indexed"]).agg(F.first("n"))
    return wide.crossJoin(corpus_fingerprint(documents))


def run_index(projection: Projection, root: str, embedder: Embedder, settings: Settings = Settings(), mode: str = "incremental") -> IndexRun:
    """Brings the projection in step with the documents under root; readers see all of it or none.

    incremental: only changed documents, and those whose chunks are lost, are chunked; chunks keep their ids where their input
    is the same; only chunks without a vector are embedded, unless model, dimension or recipes changed. full: nothing old
    is used. The state is in_progress while it runs, then ready, or failed with the error in the log, and the old tables stand.
    """
    if mode not in ("incremental", "full"):
        raise ValueError("mode is incremental or full")
    spark, state = projection.spark, projection.manifest()
    tables = state.get("tables", {}) if mode == "incremental" else {}
    started = time.time_ns()
    recipe = {"model": embedder.model, "dimension": str(embedder.dimension), "chunker": f"headings-{settings.chunk_chars}", "document_recipe": "document-v1"}
    projection.set_state("in_progress")

    def log(state: str, error: str, counts: dict[str, int]) -> DataFrame:
        old = projection.read("runs") if "runs" in projection.manifest().get("tables", {}) else spark.createDataFrame([], RUN_LOG)
        n = [counts.get(k, 0) for k in ("added", "updated", "removed", "skipped")]
        return old.unionByName(spark.createDataFrame([(started, mode, started, time.time_ns(), *n, state, error)], RUN_LOG))

    try:
        old = projection.read("documents") if "documents" in tables else None
        docs, change = merge_documents(old, parse(scan(spark, root, settings)))
        docs = projection.stage("documents", docs)
        change = projection.stage("changes", change)
        counts = {r["change"]: r["n"] for r in change.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        old_chunks = projection.read("chunks") if "chunks" in tables else None
        if old_chunks is None:
            chunks = chunk_rows(docs, None, settings)
        else:
            stale = docs.join(change.where("text_changed"), "path", "left_semi").select(*docs.columns)
            todo = stale.unionByName(without_chunks(docs, old_chunks)).dropDuplicates(["document_id"])
            kept = old_chunks.join(todo.select("document_id"), "document_id", "left_anti").join(docs.select("document_id"), "document_id", "left_semi")
            chunks = kept.unionByName(chunk_rows(todo, old_chunks, settings).select(*kept.columns))
        chunks = projection.stage("chunks", chunks)
        vectors = projection.read("vectors") if "vectors" in tables else spark.createDataFrame([], VECTORS)
        if needs_reembed(state.get("recipe", {}), recipe, vectors.limit(1).count()):
            vectors = spark.createDataFrame([], VECTORS)
        wanted = missing_vectors(chunks, vectors)
        fresh = projection.stage("fresh_vectors", embed_rows(wanted.select("chunk_id", "input"), embedder))
        kept = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        vectors = projection.stage("vectors", upsert_vectors(kept, fresh, embedder.dimension))
        raw = link_rows(docs).withColumn("link_id", F.xxhash64("source", "target_text"))
        links = projection.stage("links", resolve_links(raw, docs))
        groups = projection.stage("communities", communities(links, docs))
        rows = index_rows(docs, chunks)
        index = build_index(rows, "id", WEIGHTS, path=projection.new_path("lexical"), analyse=analyser(settings))
        postings, lengths = projection.stage("postings", index.postings), projection.stage("lengths", index.lengths)
        done = IndexRun(mode, counts.get("added", 0), counts.get("updated", 0), counts.get("removed", 0), counts.get("skipped", 0), fresh.count())
        runs = projection.stage("runs", log("ready", "", counts))
        named = {"documents": docs, "chunks": chunks, "vectors": vectors, "links": links, "communities": groups, "postings": postings, "lengths": lengths, "runs": runs}
        projection.publish(list(named), recipe)
        return done
    except Exception as e:
        projection.stage("runs", log("failed", type(e).__name__, {}))
        projection.publish(["runs"], state.get("recipe", {}), "failed")
        raise


def analyser(settings: Settings):
    from tessera.functions.stem import stemmed
    from tessera.functions.text import tokens

    return stemmed if settings.stem else tokens


def index_rows(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row per chunk with its document's classes: what channels and the lexical index read."""
    classes = docs.select("document_id", "path", "title", "source_kind", "page_role", "project_id", "is_route_map", "updated_at_ns")
    heading = F.array_join("heading_path", " ").alias("heading")
    return chunks.select(F.col("chunk_id").alias("id"), "document_id", "position", "heading_path", "section_name", heading, "text", "text_hash").join(classes, "document_id")

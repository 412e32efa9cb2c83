"""Hybrid retrieval of many queries as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.intent import decompose, intent
from tessera.functions.paths import in_profile, updated_between
from tessera.operators.dense import knn
from tessera.operators.fusion import diversify, reciprocal_rank_fusion
from tessera.operators.graph import neighbours
from tessera.operators.lexical import WEIGHTS, LexicalIndex, best, bm25, build_index, query_phrases, top_k
from tessera.operators.policy import authority_policy, conflict_labels, recency
from tessera.operators.rerank import Reranker, rerank
from tessera.settings import Settings
from tessera.sources.working import materialised, plain_unions

META = ("document_id", "path", "source_kind", "page_role", "project_id", "is_route_map", "updated_at_ns")


@dataclass(frozen=True)
class Scope:
    """Which rows a search may return: a profile, documents that are added to it, dates, and only some documents."""

    profile: str = "answer"
    widened: DataFrame | None = None
    updated_from_ns: int | None = None
    updated_to_ns: int | None = None
    only: DataFrame | None = None

    def allowed(self, rows: DataFrame) -> DataFrame:
        """(id) of the rows in scope. Every filter comes before the channels' cuts."""
        fits: Column = in_profile(self.profile)
        if self.widened is not None:
            flagged = self.widened.select("document_id").distinct().withColumn("__wide", F.lit(True))
            rows, fits = rows.join(flagged, "document_id", "left"), fits | F.coalesce("__wide", F.lit(False))
        if self.updated_from_ns is not None or self.updated_to_ns is not None:
            fits = fits & updated_between(self.updated_from_ns, self.updated_to_ns)
        rows = rows.where(fits)
        if self.only is not None:
            rows = rows.join(self.only.select("document_id").distinct(), "document_id", "left_semi")
        return rows.select("id")


def dense_channel(vectors: DataFrame, queries: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of the allowed rows, which are filtered before the search."""
    return knn(vectors.join(allowed.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), queries, k)


def lexical_channel(index: LexicalIndex, queries: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): statistics of the whole index, results of the allowed rows."""
    return best(index, query_phrases(queries, index.analyse), k, allowed)


def graph_channel(fused: DataFrame, rows: DataFrame, links: DataFrame, index: LexicalIndex, queries: DataFrame, k: int, s: Settings = Settings()) -> DataFrame:
    """BM25 over the pages next to a query's first documents, which are left out."""
    first = fused.where("rank <= 15").join(rows.select("id", "document_id"), "id").groupBy("query_id", "document_id").agg(F.min("rank").alias("rank"))
    seeds = top_k(first, s.graph_seeds, F.col("rank"), key="document_id").select("query_id", "document_id")
    near = neighbours(links, seeds, 1, s.graph_neighbours).select("query_id", "document_id")
    # a few rows a query, read by the scores and by what they are dealt to
    near = materialised(near.join(rows.select("id", "document_id"), "document_id").select("query_id", "id"), "near")
    return top_k(bm25(index, query_phrases(queries, index.analyse), near), k, F.round("score", 9).desc())


def search(
    queries: DataFrame,
    rows: DataFrame,
    vectors: DataFrame | None = None,
    links: DataFrame | None = None,
    scope: Scope = Scope(),
    settings: Settings = Settings(),
    mode: str = "hybrid",
    recent: bool = False,
    index: LexicalIndex | None = None,
    reranker: Reranker | None = None,
    rerank_limit: int = 20,
) -> DataFrame:
    """Ranked candidates of queries (query_id, query, vector) over index rows (id, document_id, path classes, texts).

    Channels, fusion, rerank, authority, recency, diversification and the final cut, in this order. Each channel is computed once:
    its rank and score ride through the fusion. Candidates carry them, null where a channel didn't return them; texts
    are joined by the caller to the few rows that remain. A blank query has no rows. The index may be given
    (a written one, see build_index); else it is built from the rows.
    """
    s = settings
    if mode not in ("dense", "lexical", "hybrid"):
        raise ValueError("mode is dense, lexical or hybrid")
    plain_unions(rows.sparkSession)
    asked = queries.where("trim(query) <> ''")
    index = index or build_index(rows, "id", WEIGHTS)
    allowed = scope.allowed(rows)
    channels: dict[str, tuple[DataFrame, float]] = {}
    if mode != "lexical":
        channels["dense"] = (dense_channel(vectors, asked.where("vector is not null").select("query_id", "vector"), allowed, s.k_dense), s.dense_weight)
    if mode != "dense":
        channels["lexical"] = (lexical_channel(index, asked, allowed, s.k_lexical), s.lexical_weight)
    carry = {"dense": "distance", "lexical": "score", "graph": "score"}
    if links is not None:
        # the channels feed both fusions; their few rows are written once
        channels = {name: (materialised(df, name), w) for name, (df, w) in channels.items()}
        channels["graph"] = (graph_channel(reciprocal_rank_fusion(channels, s.rrf_k), rows, links, index, asked, s.k_lexical, s), s.graph_weight)
    fused = reciprocal_rank_fusion(channels, s.rrf_k, carry)
    names = {"dense": "distance", "lexical": "bm25", "graph": "graph_bm25"}
    for name in ("dense", "lexical", "graph"):
        if name in channels:
            fused = fused.withColumnRenamed(f"{name}_value", names[name])
        elif name != "graph":
            fused = fused.withColumn(f"{name}_rank", F.lit(None).cast("int")).withColumn(names[name], F.lit(None).cast("double"))
    told = asked.select("query_id", "query", intent(F.col("query")).alias("intent"))
    if reranker is not None:
        # the head and the rest both read it
        fused = materialised(fused, "fused")
    cands = fused.join(rows.select("id", *META), "id").join(told, "query_id")
    if reranker is not None:
        cands = rerank(cands, reranker, rerank_limit, rows)
    ranked = authority_policy(cands.drop("query").withColumn("profile", F.lit(scope.profile)))
    if recent:
        ranked = recency(ranked)
    return diversify(ranked, s.per_document).where(F.col("rank") <= s.k_final)


def keep_order(ids: DataFrame, rows: DataFrame, profile: str) -> DataFrame:
    """ids (query_id, id, place) that are in the profile, in their order, places closed up."""
    kept = ids.join(rows.where(in_profile(profile)).select("id"), "id", "left_semi")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))


def lookup_paths(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted (path, ...) with the document at each path, relative to the root; empty paths and those with a `..` part find nothing."""
    clean = F.regexp_replace(F.trim("path"), "^/+", "")
    fine = wanted.withColumn("path", clean).where((F.col("path") != "") & ~F.array_contains(F.split("path", "/"), ".."))
    return fine.join(docs, "path")


def with_conflicts(ranked: DataFrame) -> DataFrame:
    """Ranked candidates with `conflicts`, the labels of their query's contradictions in order."""
    labels = conflict_labels(ranked).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "label")))["label"].alias("conflicts"))
    return ranked.join(labels, "query_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<string>")))


def fuse_parts(queries: DataFrame, retrieve, k: int = 20, parts: int = 4) -> DataFrame:
    """Compound questions: their parts and the whole are retrieved as queries of one batch, then fused by rank.

    retrieve: (query_id, query) -> (query_id, id, rank). Part ids are query_id * 8 + turn. Each part is a channel of
    weight one; all come from one retrieval, in which turn tells them apart.
    """
    split = queries.select("query_id", F.array_distinct(F.concat(decompose(F.col("query")), F.array("query"))).alias("p"))
    flat = split.select("query_id", F.posexplode(F.slice("p", 1, parts)).alias("turn", "query")).withColumn("part", F.col("query_id") * 8 + F.col("turn"))
    got = retrieve(flat.select(F.col("part").alias("query_id"), "query"))
    back = got.select(F.floor(F.col("query_id") / 8).alias("query_id"), "id", "rank")
    fused = back.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("score"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("parts"))
    return top_ranked(fused)


def top_ranked(fused: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "best_rank", "id")
    return fused.withColumn("rank", F.row_number().over(order))

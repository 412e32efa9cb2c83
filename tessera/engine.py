"""What a user calls: search, related pages, status, reindex and automatic injection, over a projection."""

from __future__ import annotations

import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.intent import route
from tessera.functions.text import query_input
from tessera.operators.context import build_context, citations
from tessera.operators.graph import link_keys, mention_keys, mentions, project_scope, related_pages
from tessera.operators.lexical import LexicalIndex, occurrences
from tessera.operators.rerank import Reranker
from tessera.plans import gate as gates
from tessera.plans.calibration import Gate
from tessera.plans.evaluation import latest
from tessera.plans.indexing import IndexRun, analyser, index_rows, run_index
from tessera.plans.pipeline import Scope, fuse_parts, search, with_conflicts
from tessera.plans.projection import integrity, summary
from tessera.settings import Settings
from tessera.sources.embedding import Embedder
from tessera.sources.vault import Projection, contained, relative_path, safe_message
from tessera.sources.working import materialised

#: Results, related pages and decisions that a call returns or an engine remembers at most.
MOST_RESULTS, MOST_RELATED, DECISIONS = 20, 50, 50


class Engine:
    """One corpus: documents under `root`, tables under `home`. Calls that return frames are plans; the others return plain values."""

    def __init__(
        self, spark: SparkSession, root: str, home: str, embedder: Embedder, settings: Settings = Settings(), reranker: Reranker | None = None, gate: Gate | None = None
    ) -> None:
        self.spark, self.root, self.embedder, self.settings, self.reranker, self.gate = spark, root, embedder, settings, reranker, gate
        self.projection = Projection(spark, home)
        self.decisions: deque[dict] = deque(maxlen=DECISIONS)

    def rows(self) -> DataFrame:
        return index_rows(self.projection.read("documents"), self.projection.read("chunks"))

    def index(self) -> LexicalIndex:
        return LexicalIndex(self.projection.read("postings"), self.projection.read("lengths"), analyser(self.settings))

    def questions(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, query) with their vectors, embedded in tasks."""
        from tessera.sources.embedding import embed_rows

        asked = queries.select(F.col("query_id").alias("chunk_id"), query_input(F.col("query"), self.settings.query_recipe).alias("input"))
        vectors = embed_rows(asked, self.embedder).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
        return queries.join(vectors, "query_id", "left")

    def scope(self, profile: str, updated_from_ns: int | None = None, updated_to_ns: int | None = None, only: DataFrame | None = None) -> Scope:
        """A project's scope is widened by the curated pages that its own pages link to."""
        wide = None
        if profile.startswith("project:"):
            wide = project_scope(self.projection.read("documents"), self.projection.read("links"), profile.partition(":")[2], max_linked=self.settings.scope_linked)
        return Scope(profile, wide, updated_from_ns, updated_to_ns, only)

    def search(
        self,
        queries: DataFrame,
        profile: str = "answer",
        mode: str | None = None,
        updated_from_ns: int | None = None,
        updated_to_ns: int | None = None,
        only: DataFrame | None = None,
        recent: bool = False,
        rerank: bool | None = None,
    ) -> DataFrame:
        """Ranked candidates of queries (query_id, query) with their texts, places and conflicts. Compound queries are split and
        fused if settings say so."""
        s = self.settings
        rows, scope = self.rows(), self.scope(profile, updated_from_ns, updated_to_ns, only)
        use = self.reranker if (s.rerank if rerank is None else rerank) else None
        links = self.projection.read("links") if s.graph else None

        def retrieve(asked: DataFrame) -> DataFrame:
            return search(self.questions(asked), rows, self._vectors(), links, scope, s, mode or s.mode, recent, self.index(), use, s.rerank_limit)

        found = retrieve(queries)
        if s.expand_queries:
            # the whole question's candidates keep their place in the order of the fusion, parts add theirs
            fused = fuse_parts(queries, retrieve).select("query_id", "id", F.col("rank").alias("fused_rank")).where(F.col("fused_rank") <= s.k_final)
            first = latest(found.select("query_id", "id", "rank", "authority_class"), ("query_id", "id"), "rank")
            found = fused.join(first.drop("rank"), ["query_id", "id"], "left").withColumnRenamed("fused_rank", "rank").join(rows.select("id", "document_id", "path", "source_kind", "page_role", "project_id", "is_route_map", "updated_at_ns"), "id")
        texts = rows.select(F.col("id"), F.col("id").alias("chunk_id"), "position", "title", "heading_path", "section_name", "text", "text_hash")
        return with_conflicts(found).join(texts, "id")

    def context(self, found: DataFrame, tokens: int | None = None, per_document: int | None = None, excerpts: int | None = None) -> DataFrame:
        s = self.settings
        return build_context(found, tokens or s.context_tokens, per_document or s.document_tokens, excerpts or s.max_excerpts, s.mode)

    def citations(self, found: DataFrame) -> DataFrame:
        return citations(found)

    def answer(self, query: str, profile: str = "answer", mode: str | None = None, max_results: int | None = None, include_context: bool = True) -> dict:
        """One query's results as plain values, with citations and, if wanted, the context."""
        most = min(max(max_results or self.settings.k_final, 1), MOST_RESULTS)
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        found = materialised(self.search(asked, profile, mode).where(F.col("rank") <= most), "candidates")
        excerpt = F.when(F.length("text") > 600, F.concat(F.left("text", F.lit(600)), F.lit(" …"))).otherwise(F.col("text"))
        columns = ("rank", "path", "title", "section_name", "position", "authority_class", "authority_match", "source_kind", "page_role", "project_id", "score")
        results = [r.asDict() for r in found.orderBy("rank").select(*(c for c in columns if c in found.columns), F.left("text_hash", F.lit(16)).alias("chunk_hash"), excerpt.alias("excerpt")).collect()]
        out = {"query": query, "profile": profile, "mode": mode or self.settings.mode, "results": results, "untrusted_reference": True}
        out["conflicts"] = next((list(r["conflicts"]) for r in found.select("conflicts").limit(1).collect()), [])
        out["citations"] = [r["citation"].asDict() for r in citations(found).orderBy("rank").collect()]
        if include_context:
            block = self.context(found).first()
            out |= {"context": block["context"] if block else "", "context_tokens": block["total_tokens"] if block else 0}
        return out

    def related(self, path: str, limit: int = 20) -> dict:
        """Pages related to the page at a path, by links, mentions and community."""
        rel = relative_path(path)
        docs = self.projection.read("documents")
        own = docs.where(F.col("path") == rel).select("document_id", "title").limit(1).collect()
        if not own:
            return {"path": rel, "found": False, "related": []}
        keys = mention_keys(docs, link_keys(docs))
        index = self.index()
        words = keys.select("document_id", index.analyse(F.col("phrase")).alias("t")).select("document_id", F.array_join("t", " ").alias("phrase"), F.size("t").alias("words")).where("words > 0").distinct()
        owner = self.projection.read("chunks").select(F.col("chunk_id").alias("id"), F.col("document_id").alias("owner_id"))
        named = mentions(occurrences(index.of_cells(0), words), words, owner)
        seed = self.spark.createDataFrame([(own[0]["document_id"],)], "document_id long")
        found = related_pages(seed, self.projection.read("links"), named, owner, self.projection.read("communities"), max(1, min(limit, MOST_RELATED)))
        pages = found.join(docs.select("document_id", "path", "title"), "document_id").orderBy("rank").select("path", "title", "relation", "weight")
        return {"path": rel, "title": own[0]["title"], "found": True, "related": [r.asDict() for r in pages.collect()]}

    def status(self) -> dict:
        """State, recipe, counts, integrity, the last run and the latest decisions."""
        state = self.projection.manifest()
        if not state.get("tables", {}).get("documents"):
            return {"state": state.get("state", "empty"), "counts": {}, "ok": False}
        read = {n: self.projection.read(n) for n in ("documents", "chunks", "vectors", "links", "communities", "runs")}
        counts = summary({k: v for k, v in read.items() if k != "runs"} | {"resolved_links": read["links"].where("target is not null")})
        report = integrity(read["documents"], read["chunks"], read["vectors"], read["links"], self.embedder.dimension).first().asDict()
        last = read["runs"].orderBy(F.col("run_id").desc()).limit(1).collect()
        return {
            "state": state["state"],
            "recipe": state["recipe"],
            "counts": {r["name"]: r["n"] for r in counts.collect()},
            "models": sorted(r["model"] for r in read["vectors"].select("model").distinct().collect()),
            "integrity": report,
            "missing_files": self.missing_files().count(),
            "ok": bool(report["ok"]) and state["state"] == "ready",
            "last_run": last[0].asDict() if last else None,
            "decisions": list(self.decisions)[-5:],
        }

    def missing_files(self) -> DataFrame:
        """(path) of documents whose file is gone from the root."""
        from tessera.sources.vault import scan

        return self.projection.read("documents").select("path").join(scan(self.spark, self.root, self.settings).select("path"), "path", "left_anti")

    def reindex(self, mode: str = "incremental", confirm: bool = False) -> IndexRun:
        """Brings the projection in step with the documents. A full rebuild must be allowed and confirmed."""
        if not self.settings.allow_reindex:
            raise PermissionError("reindexing is off")
        if mode == "full" and not (self.settings.allow_full_rebuild and confirm):
            raise PermissionError("a full rebuild must be allowed by settings and confirmed")
        return run_index(self.projection, self.root, self.embedder, self.settings, mode)

    def source(self, path: str) -> str:
        """The text of a document's file, if it still lies within the root."""
        with open(contained(self.root, f"{self.root.rstrip('/')}/{relative_path(path)}"), encoding="utf-8", errors="replace") as f:
            return f.read()

    def inject(self, message: str, known_projects: tuple[str, ...] = ()) -> dict:
        """{"inject": bool, "reason": ..., "context": ...}: the context for a message, if a certified gate lets it pass.

        In this order: off, no gate, gate not certified, route, deadline, gate, empty context. Never raises: any error means nothing is
        injected. The last DECISIONS are kept.
        """
        began, record = time.monotonic(), {"inject": False, "reason": ""}
        try:
            record |= self._inject(message, known_projects)
        except Late:
            record["reason"] = "timeout"
        except Exception as e:  # noqa: BLE001
            record |= {"reason": f"error:{type(e).__name__}", "message": safe_message(e, self.root)}
        record["elapsed_ms"] = round((time.monotonic() - began) * 1000, 1)
        self.decisions.append({k: v for k, v in record.items() if k != "context"})
        return record

    def _inject(self, message: str, known_projects: tuple[str, ...]) -> dict:
        s = self.settings
        for off, reason in ((not s.inject, "disabled"), (self.gate is None, "no-calibrated-gate"), (self.gate is not None and not self.gate.certified, "gate-not-certified")):
            if off:
                return {"reason": reason}
        asked = self.spark.createDataFrame([(0, message)], "query_id long, query string")
        way = asked.select(route(F.col("query"), s.inject_profile, known_projects).alias("r")).first()["r"]
        if not way["retrieve"]:
            return {"reason": f"route:{way['reason']}"}
        pool = ThreadPoolExecutor(1)
        try:
            found = pool.submit(self._gathered, asked, way["profile"]).result(s.inject_deadline_ms / 1000)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        decided = gates.decide(gates.scored(gates.features(found), self.gate.weights, self.gate.bias), self.gate.threshold).first()
        if decided is None or not decided["inject"]:
            return {"reason": decided["reason"] if decided else "no-candidates", "profile": way["profile"]}
        block = self.context(found, s.inject_tokens, max(s.inject_tokens // 2, 100), s.inject_excerpts).first()
        if not block or not block["context"]:
            return {"reason": "empty-context", "profile": way["profile"]}
        return {"inject": True, "reason": "injected", "profile": way["profile"], "score": round(decided["gate_score"], 3), "excerpts": block["excerpts"], "context": block["context"]}

    def _gathered(self, asked: DataFrame, profile: str) -> DataFrame:
        """One query's few candidates, computed."""
        return materialised(self.search(asked, profile, rerank=False), "candidates")

    def _vectors(self) -> DataFrame:
        return self.projection.read("vectors").select(F.col("chunk_id").alias("vec_id"), "embedding")

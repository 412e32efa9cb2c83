"""Queries of filters, retrieval, fusion, policy and context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog.base import (
    ANSWER, ASKED_SQL, BM25, CHANNELS, KNN, LINKS, SEARCHED, VAULT, asked, bm25_sql, decompose_sql, index_of, intent_sql, query, questions, resolved_links, rows_of, values_sql,
)
from tessera.functions import paths
from tessera.functions.stem import stemmed
from tessera.operators import chunking, context, dense, fusion, lexical, policy
from tessera.operators.rerank import OverlapReranker, rerank
from tessera.plans import pipeline
from tessera.plans.views import QUERY_STEP, body, table, vault
from tessera.sources.working import materialised, once, working_path

#: Ids that a broadcast holds at most; beyond it the planner joins by shuffle.
BROADCAST_IDS = 1_000_000

# ---------------------------------------------------------------- filters and joins


def _profile(name: str, sql: str) -> None:
    def f(spark, sf_dir, name=name):
        return vault(spark, sf_dir).where(paths.in_profile(name)).select("document_id", "path")

    f.__name__ = "profile_filter_" + name.partition(":")[0]
    query(f"WITH {VAULT} SELECT document_id, path FROM vault WHERE {sql}")(f)


_profile("answer", ANSWER)
_profile("evidence", "source_kind IN ('raw', 'clipping')")
_profile("history", "source_kind = 'wiki' AND page_role = 'log'")
_profile("current", "source_kind = 'wiki' AND page_role = 'current-state'")
_profile("project:p3", f"project_id = 'p3' AND {ANSWER}")
_profile("all", "true")


@query(f"WITH {VAULT} SELECT document_id FROM vault WHERE updated_at_ns BETWEEN 100000 AND 600000")
def date_filter(spark, sf_dir):
    return vault(spark, sf_dir).where(paths.updated_between(100_000, 600_000)).select("document_id")


@query(f"WITH {VAULT} SELECT vec_id AS id, path, title, label FROM embeddings JOIN vault ON document_id = vec_id")
def hydrate_join(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rows_of(vault(spark, sf_dir)).join(found, "id").select("id", "path", "title", "label")


@query(f"""WITH {VAULT}, c AS (SELECT label AS query_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 37) % 1009, vec_id) AS place FROM embeddings)
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS place FROM c JOIN vault ON document_id = id WHERE {ANSWER}""")
def ordered_id_filter(spark, sf_dir):
    order = Window.partitionBy("query_id").orderBy((F.col("id") * 37) % 1009, "id")
    ids = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id")).withColumn("place", F.row_number().over(order))
    return pipeline.keep_order(ids, rows_of(vault(spark, sf_dir)), "answer").select("query_id", "id", "place")


@query(f"""WITH {VAULT}, asked AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/' WHEN 1 THEN ' //' WHEN 2 THEN '../' ELSE '' END || path || CASE WHEN doc_id % 5 = 0 THEN '/..' ELSE '' END AS p
    FROM documents JOIN vault ON document_id = doc_id),
  clean AS (SELECT doc_id, ltrim(trim(p), '/') AS p FROM asked WHERE NOT list_contains(string_split(ltrim(trim(p), '/'), '/'), '..') AND ltrim(trim(p), '/') <> '')
  SELECT doc_id AS asked_id, document_id, title FROM clean JOIN vault ON path = p""")
def path_lookup(spark, sf_dir):
    docs = vault(spark, sf_dir)
    i = F.col("document_id")
    before = F.when(i % 4 == 0, "/").when(i % 4 == 1, " //").when(i % 4 == 2, "../").otherwise("")
    wanted = docs.select(i.alias("asked_id"), F.concat(before, "path", F.when(i % 5 == 0, "/..").otherwise("")).alias("path"))
    return pipeline.lookup_paths(wanted, docs).select("asked_id", "document_id", "title")


# ---------------------------------------------------------------- retrieval


@query(f"WITH {KNN} SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM dist QUALIFY rank <= 10")
def knn_l2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.knn(vectors, wanted, 10)


def _allowed(spark, sf_dir):
    return pipeline.Scope("answer").allowed(rows_of(vault(spark, sf_dir)))


@query(f"WITH {VAULT}, {KNN}, {BM25}, {CHANNELS} SELECT query_id, id, distance, rank::INT AS rank FROM dn")
def dense_channel(spark, sf_dir):
    return pipeline.dense_channel(table(spark, sf_dir, "embeddings"), questions(spark, sf_dir).select("query_id", "vector"), _allowed(spark, sf_dir), 50)


@query(f"WITH {VAULT}, {BM25} SELECT query_id::BIGINT AS query_id, id, score FROM bm25")
def bm25_search(spark, sf_dir):
    return lexical.bm25(index_of(spark, sf_dir), lexical.query_phrases(questions(spark, sf_dir)))


@query(None)
def bm25_stemmed(spark, sf_dir):
    """As bm25_search, with index and queries reduced to stems, the ten best of each query."""
    make = lambda: lexical.build_index(rows_of(vault(spark, sf_dir)), "id", {"text": 1.0, "title": 4.0}, stemmed, working_path(spark, "stemmed"))
    index = once(spark, sf_dir, "stemmed", make)
    return lexical.best(index, lexical.query_phrases(questions(spark, sf_dir), stemmed), 10)


@query(f"WITH {VAULT}, {KNN}, {BM25}, {CHANNELS} SELECT query_id::BIGINT AS query_id, id, score, rank::INT AS rank FROM lx")
def lexical_channel(spark, sf_dir):
    return pipeline.lexical_channel(index_of(spark, sf_dir), questions(spark, sf_dir), _allowed(spark, sf_dir), 50)


@query(f"WITH {VAULT}, {KNN}, {BM25}, {CHANNELS} SELECT query_id::BIGINT AS query_id, id, score, best_rank::INT AS best_rank, rank::INT AS rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return fusion.reciprocal_rank_fusion({"dense": (dense_channel(spark, sf_dir), 1.0), "lexical": (lexical_channel(spark, sf_dir), 1.0)}, 20)


@query("""WITH r AS (SELECT label AS query_id, vec_id, vec_id % 7 AS document_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS t FROM r QUALIFY t <= 3)
  SELECT query_id, vec_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM k""")
def diversify(spark, sf_dir):
    order = Window.partitionBy("query_id").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), "vec_id", (F.col("vec_id") % 7).alias("document_id"))
    return fusion.diversify(rows.withColumn("rank", F.row_number().over(order)), 3)


# ---------------------------------------------------------------- policy

#: Documents that make one query's candidates: each document is a candidate of one query.
GROUP = 50
_INTENTS = ("current-state", "decision", "chronology", "evidence", "general")
_POLICY = f"""{VAULT}, {values_sql("intents", ("turn", "intent"), list(enumerate(_INTENTS)))},
cand AS (SELECT *, document_id // {GROUP} AS query_id, row_number() OVER (PARTITION BY document_id // {GROUP} ORDER BY (document_id * 37) % 61, document_id) AS old_rank,
  CASE WHEN source_kind IN ('raw', 'clipping') THEN CASE WHEN page_role = 'idea' THEN 'idea' ELSE 'evidence' END WHEN page_role = 'route-map' THEN 'route-map'
    WHEN page_role IN ('current-state', 'decision', 'log', 'project') THEN page_role ELSE 'durable' END AS authority_class
  FROM vault JOIN intents ON turn = (document_id // {GROUP}) % 5),
tiered AS (SELECT *, CASE intent
  WHEN 'current-state' THEN CASE WHEN authority_class = 'current-state' THEN 0 WHEN authority_class IN ('idea', 'route-map') THEN 2 ELSE 1 END
  WHEN 'decision' THEN CASE WHEN authority_class = 'decision' THEN 0 WHEN authority_class IN ('idea', 'route-map') THEN 2 ELSE 1 END
  WHEN 'chronology' THEN CASE WHEN authority_class = 'log' THEN 0 WHEN authority_class IN ('idea', 'route-map') THEN 2 ELSE 1 END
  WHEN 'evidence' THEN CASE WHEN authority_class = 'evidence' THEN 0 WHEN authority_class = 'route-map' THEN 2 ELSE 1 END
  ELSE CASE WHEN authority_class IN ('durable', 'project', 'current-state', 'decision') THEN 0 WHEN authority_class IN ('log', 'evidence') THEN 1 ELSE 2 END END AS tier FROM cand),
placed AS (SELECT *, tier = 0 AS authority_match, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN tier = 0 AND old_rank > 20 THEN 1 ELSE tier END, old_rank) AS rank FROM tiered)"""


def _placed(spark, sf_dir):
    docs = vault(spark, sf_dir).withColumn("query_id", F.floor(F.col("document_id") / GROUP))
    names = F.array(*map(F.lit, _INTENTS))
    order = Window.partitionBy("query_id").orderBy((F.col("document_id") * 37) % 61, "document_id")
    told = docs.withColumns({"intent": F.element_at(names, (F.col("query_id") % 5 + 1).cast("int")), "profile": F.lit("answer")})
    return policy.authority_policy(told.withColumn("rank", F.row_number().over(order)))


@query(f"WITH {_POLICY} SELECT query_id, document_id, authority_class, authority_match, old_rank::INT AS old_rank, rank::INT AS rank FROM placed")
def authority_policy(spark, sf_dir):
    return _placed(spark, sf_dir).select("query_id", "document_id", "authority_class", "authority_match", "old_rank", "rank")


@query(f"""WITH {_POLICY}, head AS (SELECT * FROM placed WHERE rank <= 10 AND project_id IS NOT NULL),
  cs AS (SELECT query_id, project_id, arg_max(path, rank) AS cs_path, arg_max(updated_at_ns, rank) AS cs_at FROM head WHERE page_role = 'current-state' GROUP BY ALL)
  SELECT query_id, 'competing-projects: ' || string_agg(DISTINCT project_id, ', ' ORDER BY project_id) AS label FROM head GROUP BY query_id HAVING count(DISTINCT project_id) > 1
  UNION SELECT query_id, 'older-than-current-state: ' || path || ' predates ' || cs_path FROM head JOIN cs USING (query_id, project_id)
  WHERE page_role <> 'current-state' AND updated_at_ns <> 0 AND cs_at <> 0 AND updated_at_ns < cs_at""")
def conflict_labels(spark, sf_dir):
    return policy.conflict_labels(_placed(spark, sf_dir)).select("query_id", "label")


@query(f"""WITH {_POLICY} SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN intent = 'current-state' AND NOT authority_match THEN 1 ELSE 0 END,
  CASE WHEN intent = 'current-state' AND authority_match THEN -updated_at_ns ELSE 0 END, rank)::INT AS rank FROM placed""")
def recency_reorder(spark, sf_dir):
    return policy.recency(_placed(spark, sf_dir)).select("query_id", "document_id", "rank")


@query("""WITH c AS (SELECT doc_id // 50 AS query_id, doc_id AS id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY (doc_id * 37) % 61, doc_id) AS rank FROM documents),
  a AS (SELECT *, ['the', 'and', 'license'] AS q, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) AS w FROM c),
  s AS (SELECT *, len(list_filter(q, lambda t: list_contains(w, t))) / 3.0 - 1e-6 * length(text) AS score FROM a)
  SELECT query_id, id, CASE WHEN rank <= 20 THEN round(score, 9) END AS rerank_score,
    row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN -score ELSE 0 END, rank)::INT AS rank FROM s""")
def rerank_head(spark, sf_dir):
    order = Window.partitionBy("query_id").orderBy((F.col("id") * 37) % 61, "id")
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("query_id"), F.col("doc_id").alias("id"), "text")
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("query", F.lit("The and license"))
    return rerank(ranked, OverlapReranker(), 20).select("query_id", "id", F.round("rerank_score", 9).alias("rerank_score"), "rank")


# ---------------------------------------------------------------- the whole pipeline


def _search(spark, sf_dir, **kw):
    return pipeline.search(questions(spark, sf_dir), rows_of(vault(spark, sf_dir)), table(spark, sf_dir, "embeddings"), index=index_of(spark, sf_dir), **kw)


def _pipeline_sql(fused: str) -> str:
    return f"""c AS (SELECT f.query_id, f.id, f.score, f.rank AS old_rank, {intent_sql("query")} AS intent, CASE WHEN page_role IN ('current-state', 'decision', 'project') THEN page_role ELSE 'durable' END AS class
      FROM {fused} f JOIN vault ON document_id = id JOIN searches s ON s.query_id = f.query_id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN class = intent OR intent NOT IN ('current-state', 'decision', 'chronology', 'evidence')
      THEN CASE WHEN old_rank > 20 THEN 1 ELSE 0 END ELSE 1 END, old_rank) AS rank FROM c)"""


@query(f"""WITH {VAULT}, {KNN}, {BM25}, {CHANNELS}, {_pipeline_sql("fused")}
SELECT query_id::BIGINT AS query_id, id, score, class AS authority_class, rank::INT AS rank FROM p WHERE rank <= 10""")
def hybrid_pipeline(spark, sf_dir):
    return _search(spark, sf_dir).select("query_id", "id", "score", "authority_class", "rank")


@query(f"""WITH {VAULT}, {KNN}, {BM25}, {CHANNELS}, narrow AS (SELECT document_id FROM vault WHERE document_id % 3 <> 0 AND updated_at_ns BETWEEN 50000 AND 800000),
dn2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist JOIN narrow ON document_id = id JOIN vault USING (document_id)
        WHERE {ANSWER} OR document_id % 10 = 6 QUALIFY rank <= 50),
lx2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm25 JOIN narrow ON document_id = id JOIN vault USING (document_id)
        WHERE {ANSWER} OR document_id % 10 = 6 QUALIFY rank <= 50),
u2 AS (SELECT * FROM dn2 UNION ALL SELECT * FROM lx2), f2 AS (SELECT query_id, id, sum(1.0 / (20 + rank)) AS score, min(rank) AS best FROM u2 GROUP BY 1, 2)
SELECT query_id::BIGINT AS query_id, id, score FROM f2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, id) <= 20""")
def scoped_search(spark, sf_dir):
    """The fused channels within dates and some documents only, the profile widened by the logs."""
    rows = rows_of(vault(spark, sf_dir))
    scope = pipeline.Scope("answer", rows.where("document_id % 10 = 6").select("document_id"), 50_000, 800_000, rows.where("document_id % 3 <> 0").select("document_id"))
    allowed, own = scope.allowed(rows), questions(spark, sf_dir)
    channels = {
        "dense": (pipeline.dense_channel(table(spark, sf_dir, "embeddings"), own.select("query_id", "vector"), allowed, 50), 1.0),
        "lexical": (pipeline.lexical_channel(index_of(spark, sf_dir), own, allowed, 50), 1.0),
    }
    return fusion.reciprocal_rank_fusion(channels, 20).where("rank <= 20").select("query_id", "id", "score")


@query(f"""WITH {VAULT}, {LINKS}, {KNN}, {BM25}, {CHANNELS},
seeds AS (SELECT query_id, id AS document_id FROM fused WHERE rank <= 15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, id) <= 5),
steps AS (SELECT DISTINCT source AS a, target AS b, 0 AS way FROM resolved WHERE target IS NOT NULL UNION ALL SELECT DISTINCT target, source, 1 FROM resolved WHERE target IS NOT NULL),
near AS (SELECT query_id, b, min(way) AS way FROM seeds JOIN steps ON a = document_id WHERE (query_id, b) NOT IN (SELECT (query_id, document_id) FROM seeds) GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(way), b) <= 30),
gx AS (SELECT b.query_id, b.id, row_number() OVER (PARTITION BY b.query_id ORDER BY round(score, 9) DESC, b.id) AS rank FROM bm25 b JOIN near n ON n.query_id = b.query_id AND n.b = b.id QUALIFY rank <= 50),
ug AS (SELECT query_id, id, rank, 1.0 AS w FROM un UNION ALL SELECT query_id, id, rank, 0.5 FROM gx),
gf0 AS (SELECT query_id, id, sum(w / (20 + rank)) AS score, min(rank) AS best FROM ug GROUP BY 1, 2),
gf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, id) AS rank FROM gf0),
c AS (SELECT f.query_id, f.id, f.score, f.rank AS old_rank, {intent_sql("query")} AS intent, page_role,
        CASE WHEN source_kind IN ('raw', 'clipping') THEN CASE WHEN page_role = 'idea' THEN 'idea' ELSE 'evidence' END WHEN page_role = 'route-map' THEN 'route-map'
          WHEN page_role IN ('current-state', 'decision', 'log', 'project') THEN page_role ELSE 'durable' END AS class
      FROM gf f JOIN vault ON document_id = id JOIN searches s ON s.query_id = f.query_id),
t AS (SELECT *, CASE WHEN intent = 'evidence' THEN CASE WHEN class = 'evidence' THEN 0 WHEN class = 'route-map' THEN 2 ELSE 1 END
        WHEN class = 'route-map' OR class = 'idea' THEN 2 WHEN intent = 'chronology' THEN CASE WHEN class = 'log' THEN 0 ELSE 1 END
        WHEN intent IN ('current-state', 'decision') THEN CASE WHEN class = intent THEN 0 ELSE 1 END WHEN class IN ('log', 'evidence') THEN 1 ELSE 0 END AS tier FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN tier = 0 AND old_rank > 20 THEN 1 ELSE tier END, old_rank) AS rank FROM t)
SELECT query_id::BIGINT AS query_id, id, score, rank::INT AS rank FROM p WHERE rank <= 10""")
def graph_channel(spark, sf_dir):
    return _search(spark, sf_dir, links=resolved_links(spark, sf_dir)[1]).select("query_id", "id", "score", "rank")


@query(f"""WITH {VAULT}, {decompose_sql()},
p0 AS (SELECT query_id AS owner, list_distinct(list_append(parts, query)) AS d, list_append(parts, query) AS l FROM parted),
p1 AS (SELECT owner, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4]) AS query, generate_subscripts(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], 1) - 1 AS turn FROM p0),
searches AS (SELECT owner * 8 + turn AS query_id, query FROM p1), {bm25_sql()},
r AS (SELECT query_id // 8 AS owner, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm25 QUALIFY rank <= 20),
f AS (SELECT owner, id, sum(1.0 / (20 + rank)) AS score, min(rank) AS best_rank, count(*) AS parts FROM r GROUP BY 1, 2)
SELECT owner::BIGINT AS query_id, id, score, best_rank::INT AS best_rank, parts,
  row_number() OVER (PARTITION BY owner ORDER BY round(score, 12) DESC, best_rank, id)::INT AS rank FROM f""")
def multiquery_fuse(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return pipeline.fuse_parts(asked(spark), lambda q: lexical.best(index, lexical.query_phrases(q), 20))


@query(None)
def reranked_pipeline(spark, sf_dir):
    return _search(spark, sf_dir, reranker=OverlapReranker()).select("query_id", "id", "score", "rerank_score", "authority_class", "rank")


@query(None)
def context_block(spark, sf_dir):
    """The context of each query from all chunks of the documents that the pipeline found."""
    docs = vault(spark, sf_dir)
    found = _search(spark, sf_dir).select("query_id", "rank", F.col("id").alias("document_id"), "authority_class")
    found = materialised(found, "found")
    ids = materialised(found.select("document_id").distinct(), "ids")
    # texts stay where they are read while the ids of those wanted fit a broadcast
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    wanted = docs.join(ids, "document_id", "left_semi")
    chunks = chunking.chunk_documents(wanted.withColumn("body", body()))
    meta = wanted.select("document_id", "path", "title", "source_kind", "page_role")
    rows = found.join(meta, "document_id").join(chunks, "document_id")
    order = Window.partitionBy("query_id").orderBy("rank", "position")
    rows = rows.withColumn("chunk_id", F.col("document_id") * 1000 + F.col("position")).withColumn("rank", F.row_number().over(order))
    return context.build_context(rows)


@query(None)
def citation_rows(spark, sf_dir):
    docs = vault(spark, sf_dir)
    found = _search(spark, sf_dir).select("query_id", "rank", "id", "authority_class")
    rows = found.join(rows_of(docs), "id").select(
        "query_id", "rank", "document_id", F.col("id").alias("chunk_id"), F.lit(0).alias("position"), "path", "title", F.array("title").alias("heading_path"),
        F.lit("").alias("section_name"), "text", "source_kind", "page_role", "authority_class",
    )
    return context.citations(rows)

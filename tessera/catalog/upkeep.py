"""Queries of sources, projection tables and their upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.base import LINKS, VAULT, index_of, query, resolved_links
from tessera.functions import paths, text
from tessera.plans import evaluation, indexing, projection
from tessera.plans.views import table, vault
from tessera.sources import embedding
from tessera.sources.vault import changes, reuse_chunks, stale_models


@query(f"WITH {VAULT} SELECT path, list_has_any(string_split(path, '/'), ['raw', '.git']) OR regexp_full_match(path, 'ops/.*7\\.md') AS skipped FROM vault")
def skip_predicate(spark, sf_dir):
    return vault(spark, sf_dir).select("path", paths.skipped(F.col("path"), ("raw", ".git"), ("ops/*7.md",)).alias("skipped"))


@query("SELECT doc_id AS document_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return vault(spark, sf_dir).select("document_id", text.content_hash(F.col("text")).alias("content_hash"))


_LINE = "path || chr(9) || sha256(text) || chr(10)"


@query(f"""WITH {VAULT}, b AS (SELECT substr(sha256(path), 1, 3) AS bucket, sha256(string_agg({_LINE}, '' ORDER BY {_LINE})) AS hash FROM vault GROUP BY 1)
  SELECT sha256(string_agg(bucket || ':' || hash, ',' ORDER BY bucket)) AS fingerprint FROM b""")
def corpus_fingerprint(spark, sf_dir):
    return evaluation.corpus_fingerprint(vault(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256)))


def _snapshots(spark, sf_dir):
    docs = vault(spark, sf_dir).select("path", "document_id", F.sha2("text", 256).alias("content_hash"), F.col("updated_at_ns").alias("mtime_ns"))
    old = docs.where("document_id % 11 <> 0").drop("document_id")
    i = F.col("document_id")
    new = docs.where("document_id % 13 <> 0").select(
        "path", F.when(i % 17 == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(i % 19 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
    )
    return old, new


@query(f"""WITH {VAULT} SELECT path, CASE WHEN document_id % 11 = 0 THEN 'added' WHEN document_id % 13 = 0 THEN 'removed'
  WHEN document_id % 17 = 0 OR document_id % 19 = 0 THEN 'updated' ELSE 'skipped' END AS change FROM vault
  WHERE NOT (document_id % 11 = 0 AND document_id % 13 = 0)""")
def change_diff(spark, sf_dir):
    return changes(*_snapshots(spark, sf_dir))


@query(f"""WITH {VAULT} SELECT path, CASE WHEN document_id % 13 = 0 THEN NULL WHEN document_id % 17 = 0 THEN sha256(sha256(text) || 'x') ELSE sha256(text) END AS content_hash
  FROM vault WHERE document_id % 13 <> 0 UNION ALL SELECT path, sha256(text) FROM vault WHERE document_id % 13 = 0 AND document_id % 11 <> 0""")
def document_upsert(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return projection.upsert(old, new, "path").select("path", "content_hash")


_OLD_CHUNKS = """
base AS (SELECT doc_id AS document_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
old AS (SELECT document_id, n * 10 AS chunk_id, line AS input FROM base WHERE n % 5 <> 0),
new AS (SELECT document_id, n AS position, line AS input FROM base)"""


@query(f"""WITH {_OLD_CHUNKS},
a AS (SELECT *, row_number() OVER (PARTITION BY document_id, input ORDER BY chunk_id DESC) AS t FROM old),
b AS (SELECT *, row_number() OVER (PARTITION BY document_id, input ORDER BY position) AS t FROM new)
SELECT b.document_id, b.position, a.chunk_id FROM b LEFT JOIN a ON a.document_id = b.document_id AND a.input = b.input AND a.t = b.t""")
def chunk_reuse(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "input"))
    lines = lines.withColumn("n", (F.col("p") + 1).cast("long"))
    old = lines.where("n % 5 <> 0").select("document_id", (F.col("n") * 10).alias("chunk_id"), "input")
    return reuse_chunks(old, lines.select("document_id", F.col("n").alias("position"), "input")).select("document_id", "position", "chunk_id")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return projection.missing_vectors(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), vectors)


@query("""SELECT min('model-' || (label % 2)) AS low, max('model-' || (label % 2)) AS high,
  min('model-' || (label % 2)) <> 'model-0' OR max('model-' || (label % 2)) <> 'model-0' AS stale FROM embeddings""")
def needs_reembed(spark, sf_dir):
    tag = F.concat(F.lit("model-"), (F.col("label") % 2).cast("string"))
    return stale_models(table(spark, sf_dir, "embeddings").select(tag.alias("model")), "model-0")


_DEFECTS = """
chunks AS (SELECT document_id * 3 AS chunk_id, document_id, 0 AS position FROM vault WHERE document_id % 17 <> 5 UNION ALL
           SELECT document_id * 3 + 1, document_id, CASE WHEN document_id % 23 = 4 THEN 0 ELSE 1 END FROM vault WHERE document_id % 17 <> 5 UNION ALL
           SELECT document_id * 3 + 2, document_id + 1000000000, 0 FROM vault WHERE document_id % 41 = 0),
vectors AS (SELECT vec_id * 3 AS chunk_id, CASE WHEN vec_id % 19 = 0 THEN embedding[1:10] ELSE embedding END AS embedding FROM embeddings),
paths AS (SELECT document_id, CASE WHEN document_id % 29 = 1 THEN 'same/' || (document_id // 58) ELSE path END AS path FROM vault),
found AS (SELECT link_id, CASE WHEN link_id % 31 = 0 THEN -1 ELSE target END AS target FROM resolved)"""


def _defects(spark, sf_dir):
    """The corpus with planted defects: lost and stray chunks, repeated positions and paths, odd vectors, dangling links."""
    docs, resolved = resolved_links(spark, sf_dir)
    i = F.col("document_id")
    chunk = lambda n, owner, at, keep: docs.where(keep).select((i * 3 + n).alias("chunk_id"), owner.alias("document_id"), at.alias("position"))
    own = i % 17 != 5
    chunks = (
        chunk(0, i, F.lit(0), own)
        .unionByName(chunk(1, i, F.when(i % 23 == 4, 0).otherwise(1), own))
        .unionByName(chunk(2, i + 1_000_000_000, F.lit(0), i % 41 == 0))
    )
    short = F.when(F.col("vec_id") % 19 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("chunk_id"), short.alias("embedding"))
    twice = F.when(i % 29 == 1, F.concat(F.lit("same/"), F.floor(i / 58).cast("string"))).otherwise(F.col("path"))
    dangling = F.when(F.col("link_id") % 31 == 0, F.lit(-1)).otherwise(F.col("target"))
    return docs.withColumn("path", twice), chunks, vectors, resolved.withColumn("target", dangling)


@query(f"""WITH {VAULT}, {LINKS}, {_DEFECTS},
n AS (SELECT (SELECT count(*) FROM chunks WHERE document_id NOT IN (SELECT document_id FROM vault)) AS orphan_chunks,
  (SELECT count(*) FROM vault WHERE document_id NOT IN (SELECT document_id FROM chunks)) AS documents_without_chunks,
  (SELECT count(*) FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors)) AS chunks_without_vector,
  (SELECT count(*) FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)) AS orphan_vectors,
  (SELECT count(*) FROM vectors WHERE len(embedding) <> 64) AS wrong_dimension,
  (SELECT count(*) FROM (SELECT 1 FROM chunks GROUP BY document_id, position HAVING count(*) > 1)) AS duplicate_positions,
  (SELECT count(*) FROM (SELECT 1 FROM paths GROUP BY path HAVING count(*) > 1)) AS duplicate_paths,
  (SELECT count(*) FROM found WHERE target IS NOT NULL AND target NOT IN (SELECT document_id FROM vault)) AS dangling_links)
SELECT *, orphan_chunks + documents_without_chunks + chunks_without_vector + orphan_vectors + wrong_dimension + duplicate_positions + duplicate_paths + dangling_links = 0 AS ok FROM n""")
def integrity_report(spark, sf_dir):
    return projection.integrity(*_defects(spark, sf_dir), 64)


@query(f"""WITH {VAULT}, {LINKS} SELECT 'documents' AS name, count(*) AS n FROM vault UNION ALL SELECT 'links', count(*) FROM resolved
  UNION ALL SELECT 'resolved', count(*) FROM resolved WHERE target IS NOT NULL UNION ALL SELECT 'vectors', count(*) FROM embeddings""")
def status_summary(spark, sf_dir):
    docs, resolved = resolved_links(spark, sf_dir)
    return projection.summary({"documents": docs, "links": resolved, "resolved": resolved.where("target is not null"), "vectors": table(spark, sf_dir, "embeddings")})


@query(f"""WITH {VAULT}, b AS (SELECT substr(sha256(path), 1, 3) AS bucket, sha256(string_agg({_LINE}, '' ORDER BY {_LINE})) AS hash FROM vault GROUP BY 1)
  SELECT (SELECT count(*) FROM vault) AS documents, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM vault) AS indexed,
  (SELECT sha256(string_agg(bucket || ':' || hash, ',' ORDER BY bucket)) FROM b) AS fingerprint""")
def projection_snapshot(spark, sf_dir):
    docs = vault(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    return indexing.snapshot(docs, docs, table(spark, sf_dir, "embeddings"), index_of(spark, sf_dir).lengths)


@query("""WITH c AS (SELECT doc_id AS document_id, doc_id * 10 AS chunk_id FROM documents WHERE doc_id % 7 <> 3)
  SELECT doc_id AS document_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id NOT IN (SELECT document_id FROM c)""")
def orphan_backfill(spark, sf_dir):
    docs = vault(spark, sf_dir).withColumn("body", F.col("text"))
    chunks = docs.where("document_id % 7 <> 3").select("document_id", (F.col("document_id") * 10).alias("chunk_id"))
    return indexing.without_chunks(docs, chunks).select("document_id")


@query("""SELECT doc_id * 2 + k AS chunk_id, doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'fresh' ELSE 'old' END AS made
  FROM documents, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 5 <> 0 OR k = 0""")
def chunk_replace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    old = docs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("document_id") * 2 + F.col("k")).alias("chunk_id"), "document_id", F.lit("old").alias("made"))
    changed = docs.where("document_id % 5 = 0")
    return projection.replace_chunks(old, changed, changed.select((F.col("document_id") * 2).alias("chunk_id"), "document_id", F.lit("fresh").alias("made")))


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'model-0' END AS model, 64::BIGINT AS width FROM documents
  WHERE doc_id IN (SELECT vec_id FROM embeddings) OR doc_id % 3 = 0 UNION ALL
  SELECT vec_id, 'model-0', 64 FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def vector_upsert(spark, sf_dir):
    """Vectors of every third document are made anew by the word hasher, in admitted batches, and replace or join the others."""
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit("model-0").alias("model"))
    inputs = vault(spark, sf_dir).where("document_id % 3 = 0").select(F.col("document_id").alias("chunk_id"), F.col("text").alias("input"))
    out = embedding.upsert_vectors(old, embedding.embed_rows(inputs, embedding.HashEmbedder(64, "new")), 64)
    return out.select("chunk_id", "model", F.size("embedding").cast("long").alias("width"))

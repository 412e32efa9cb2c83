"""Queries of the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.base import ANALYSE, ANSWER, LINKS, VAULT, query, resolved_links, terms_sql
from tessera.functions import text
from tessera.operators import graph, lexical
from tessera.plans.views import vault
from tessera.sources.working import materialised, once, working_path


@query(f"WITH {VAULT}, {LINKS} SELECT aim AS document_id, key FROM stems")
def link_keys(spark, sf_dir):
    return graph.link_keys(vault(spark, sf_dir))


@query(f"WITH {VAULT}, {LINKS} SELECT link_id, target FROM resolved")
def resolve_links(spark, sf_dir):
    return resolved_links(spark, sf_dir)[1].select("link_id", "target")


_NEAR = """seeds AS (SELECT doc_id // 100 AS query_id, doc_id AS document_id FROM documents WHERE doc_id % 50 = 4),
steps AS (SELECT DISTINCT source AS a, target AS b, 0 AS way FROM resolved WHERE target IS NOT NULL UNION ALL SELECT DISTINCT target, source, 1 FROM resolved WHERE target IS NOT NULL),
r1 AS (SELECT query_id, b, min(way) AS way FROM seeds JOIN steps ON a = document_id WHERE (query_id, b) NOT IN (SELECT (query_id, document_id) FROM seeds) GROUP BY 1, 2),
h1 AS (SELECT query_id, b AS document_id, row_number() OVER (PARTITION BY query_id ORDER BY way, b) AS turn FROM r1 QUALIFY turn <= 30),
r2 AS (SELECT query_id, b, min(way) AS way FROM h1 JOIN steps ON a = document_id WHERE (query_id, b) NOT IN (SELECT (query_id, document_id) FROM seeds)
       AND (query_id, b) NOT IN (SELECT (query_id, document_id) FROM h1) GROUP BY 1, 2),
used AS (SELECT query_id, count(*) AS n FROM h1 GROUP BY 1),
h2 AS (SELECT query_id, b AS document_id, row_number() OVER (PARTITION BY query_id ORDER BY way, b) + n AS turn FROM r2 JOIN used USING (query_id) QUALIFY turn <= 30)"""


@query(f"""WITH {VAULT}, {LINKS}, {_NEAR} SELECT query_id, document_id, 1 AS hop, turn::INT AS turn FROM h1 UNION ALL SELECT query_id, document_id, 2, turn::INT FROM h2""")
def neighbours(spark, sf_dir):
    docs, resolved = resolved_links(spark, sf_dir)
    seeds = docs.where("document_id % 50 = 4").select(F.floor(F.col("document_id") / 100).alias("query_id"), "document_id")
    return graph.neighbours(resolved, seeds, 2, 30).select("query_id", "document_id", "hop", F.col("turn").cast("int").alias("turn"))


@query(f"""WITH {VAULT}, {LINKS}, own AS (SELECT document_id FROM vault WHERE project_id = 'p3' AND {ANSWER}),
far AS (SELECT DISTINCT target AS d FROM resolved WHERE source IN (SELECT document_id FROM own) AND target IS NOT NULL AND target NOT IN (SELECT document_id FROM own) ORDER BY target LIMIT 40)
SELECT document_id FROM own UNION SELECT d FROM far JOIN vault ON document_id = d WHERE {ANSWER}""")
def project_scope(spark, sf_dir):
    docs, resolved = resolved_links(spark, sf_dir)
    return graph.project_scope(docs, resolved, "p3")


_MENTION = f"""
mk0 AS (SELECT DISTINCT document_id, unnest([title, replace(key, '-', ' ')]) AS phrase FROM vault JOIN stems ON aim = document_id WHERE {ANSWER}),
mk AS (SELECT DISTINCT document_id, lower(trim(phrase)) AS phrase FROM mk0 WHERE length(trim(phrase)) >= 5 AND lower(trim(phrase)) NOT IN ({", ".join(f"'{w}'" for w in graph.GENERIC_KEYS)})
       AND NOT (len({terms_sql("trim(phrase)")}) = 0) AND NOT (len({terms_sql("trim(phrase)")}) = 1 AND length(trim(phrase)) < 8))"""


@query(f"WITH {VAULT}, {LINKS}, {_MENTION} SELECT document_id, phrase FROM mk")
def mention_keys(spark, sf_dir):
    docs = vault(spark, sf_dir)
    return graph.mention_keys(docs, graph.link_keys(docs))


def _mentions(spark, sf_dir):
    """Chunks are whole documents here, each with a sentence after its text that names another document's title."""
    docs = vault(spark, sf_dir)

    def build():
        n = docs.agg(F.count(F.lit(1)).alias("n"))
        other = ((F.col("document_id") * 3 + 1) % F.col("n")).cast("string")
        said = F.concat("text", F.lit("\nsee doc "), other, F.lit(" and current state"))
        rows = docs.crossJoin(F.broadcast(n)).select(F.col("document_id").alias("id"), said.alias("text"))
        return lexical.build_index(rows, "id", {"text": 1.0}, path=working_path(spark, "said"))

    index = once(spark, sf_dir, "said", build)
    keys = graph.mention_keys(docs, graph.link_keys(docs))
    words = keys.select("document_id", text.tokens(F.col("phrase")).alias("t")).select("document_id", F.array_join("t", " ").alias("phrase"), F.size("t").alias("words"))
    words = once(spark, sf_dir, "mention_words", lambda: materialised(words.where("words > 0").distinct(), "mention_words"))
    found = once(spark, sf_dir, "mentions", lambda: materialised(graph.mentions(lexical.occurrences(index, words), words, docs.select(F.col("document_id").alias("id"), F.col("document_id").alias("owner_id"))), "mentions"))
    return docs, found


_FOUND = f"""{_MENTION},
mp AS (SELECT DISTINCT document_id, array_to_string({ANALYSE.format("phrase")}, ' ') AS phrase FROM mk),
said0 AS (SELECT document_id AS id, text || chr(10) || 'see doc ' || ((document_id * 3 + 1) % (SELECT count(*) FROM vault)) || ' and current state' AS t FROM vault),
said AS (SELECT id, {ANALYSE.format("t")} AS w FROM said0),
grams AS (SELECT DISTINCT id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM said, (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM mp WHERE phrase <> ''))),
hits AS (SELECT id, document_id, phrase, row_number() OVER (PARTITION BY document_id, phrase ORDER BY id) AS turn
         FROM grams JOIN mp USING (phrase) WHERE id <> document_id QUALIFY turn <= 400),
few AS (SELECT document_id, phrase FROM hits GROUP BY ALL HAVING count(DISTINCT id) <= 40),
ment AS (SELECT DISTINCT id AS chunk_id, document_id FROM hits JOIN few USING (document_id, phrase))"""


@query(f"WITH {VAULT}, {LINKS}, {_FOUND} SELECT chunk_id, document_id FROM ment")
def mentions(spark, sf_dir):
    return _mentions(spark, sf_dir)[1]


@query(f"""WITH {VAULT}, {LINKS}, e AS (SELECT source AS a, target AS b FROM resolved WHERE target <> source AND source % 10 <> 3 AND target % 10 <> 3)
SELECT a, b FROM e UNION SELECT b, a FROM e""")
def community_graph(spark, sf_dir):
    docs, resolved = resolved_links(spark, sf_dir)
    return graph.community_edges(resolved, docs)


@query(None)
def label_propagation(spark, sf_dir):
    docs, resolved = resolved_links(spark, sf_dir)
    return graph.communities(resolved, docs)


@query(f"""WITH {VAULT}, {LINKS}, {_FOUND}, seeds AS (SELECT document_id AS seed FROM vault WHERE document_id % 100 = 0),
com AS (SELECT document_id, document_id % 97 AS community_id FROM vault),
same AS (SELECT seed, c.document_id FROM seeds JOIN com s ON s.document_id = seed JOIN com c ON c.community_id = s.community_id AND c.document_id <> seed
         QUALIFY row_number() OVER (PARTITION BY seed ORDER BY c.document_id) <= 200),
w AS (SELECT seed, target AS d, 3 AS w, 'links-to' AS r FROM seeds JOIN resolved ON source = seed WHERE target IS NOT NULL UNION ALL
      SELECT seed, source, 2, 'linked-from' FROM seeds JOIN resolved ON target = seed UNION ALL
      SELECT DISTINCT seed, document_id, 2, 'mentions' FROM seeds JOIN ment ON chunk_id = seed UNION ALL
      SELECT DISTINCT seed, chunk_id, 1, 'mentioned-in' FROM seeds JOIN ment ON document_id = seed UNION ALL SELECT seed, document_id, 1, 'same-community' FROM same),
g AS (SELECT seed, d, sum(w) AS weight, max({{'w': w, 'r': r}}).r AS relation FROM w WHERE d <> seed GROUP BY seed, d)
SELECT seed, d AS document_id, weight::BIGINT AS weight, relation, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, d)::INT AS rank FROM g QUALIFY rank <= 10""")
def related_pages(spark, sf_dir):
    docs, resolved = resolved_links(spark, sf_dir)
    _, found = _mentions(spark, sf_dir)
    owner = docs.select(F.col("document_id").alias("id"), F.col("document_id").alias("owner_id"))
    community = docs.select("document_id", (F.col("document_id") % 97).alias("community_id"))
    return graph.related_pages(docs.where("document_id % 100 = 0"), resolved, found, owner, community)


@query(f"""WITH {VAULT}, com AS (SELECT document_id, title, document_id % 97 % 13 AS community_id FROM vault),
top AS (SELECT community_id, count(*) AS size FROM com GROUP BY community_id ORDER BY size DESC, community_id LIMIT 10)
SELECT community_id, size, (SELECT array_to_string(list(title ORDER BY document_id)[1:5], '|') FROM com WHERE com.community_id = top.community_id) AS titles FROM top""")
def community_summary(spark, sf_dir):
    docs = vault(spark, sf_dir)
    return graph.community_summary(docs.select("document_id", (F.col("document_id") % 97 % 13).alias("community_id")), docs).withColumn("titles", F.array_join("titles", "|"))

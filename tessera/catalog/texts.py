"""Queries of parsing, classification and the rules over texts and queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.catalog.base import ASKED_SQL, VAULT, asked, decompose_sql, intent_sql, query, terms_sql, values_sql
from tessera.functions import intent as rules
from tessera.functions import paths, text
from tessera.operators import chunking, fusion, graph
from tessera.plans import evaluation
from tessera.plans.views import RAW_LINKS, body, literal, table, vault


def marked(spark, sf_dir):
    """Documents whose lines carry marks: a heading every third line, a fence every fifth, a link and a tag in some."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    line = lambda x, i: (
        F.when(i % 5 == 4, F.concat(F.lit("```\n# fenced\n"), x, F.lit("\n```")))
        .when(i % 3 == 0, F.concat(F.lit("## "), F.left(x, F.lit(30)), F.lit(" ##")))
        .when(i % 7 == 1, F.concat(x, F.lit(" [["), F.left(x, F.lit(12)), F.lit("|as]] #Tag/"), i.cast("string"), F.lit(" #not!")))
        .otherwise(x)
    )
    return docs.select("document_id", F.array_join(F.transform("lines", line), "\n").alias("body"))


_MARKED = """
l0 AS (SELECT doc_id AS document_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l1 AS (SELECT document_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS x FROM l0),
l2 AS (SELECT document_id, i, CASE WHEN i % 5 = 4 THEN '```' || chr(10) || '# fenced' || chr(10) || x || chr(10) || '```'
         WHEN i % 3 = 0 THEN '## ' || x[1:30] || ' ##' WHEN i % 7 = 1 THEN x || ' [[' || x[1:12] || '|as]] #Tag/' || i || ' #not!' ELSE x END AS y FROM l1),
marked AS (SELECT document_id, string_agg(y, chr(10) ORDER BY i) AS body FROM l2 GROUP BY 1),
bare AS (SELECT document_id, body, regexp_replace(body, '(?ms)^```.*?^```', '', 'g') AS free FROM marked)"""


@query(rf"""WITH {_MARKED}, h AS (SELECT document_id, unnest(regexp_extract_all(free, '(?m)^(#{{1,6}})[^\S\n]+([^\n]+?)[^\S\n]*#*[^\S\n]*$', 2)) AS name FROM bare)
  SELECT document_id, count(name) AS headings, sha256(coalesce(string_agg(name, '|' ORDER BY name), '')) AS names FROM bare LEFT JOIN h USING (document_id) GROUP BY 1""")
def heading_outline(spark, sf_dir):
    found = marked(spark, sf_dir).select("document_id", text.heading_outline(F.col("body")).alias("h"))
    names = F.array_sort(F.transform("h", lambda x: x["text"]))
    return found.select("document_id", F.size("h").cast("long").alias("headings"), F.sha2(F.array_join(names, "|"), 256).alias("names"))


@query(rf"""WITH {_MARKED} SELECT document_id,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(free, '(?:^|\s)#([A-Za-z0-9_\-][A-Za-z0-9_/\-]*)', 1), lambda t: lower(t)))), ',') AS tags FROM bare""")
def body_tags(spark, sf_dir):
    return marked(spark, sf_dir).select("document_id", F.array_join(F.array_sort(text.body_tags(F.col("body"))), ",").alias("tags"))


_TARGETS = r"list_filter(list_transform(regexp_extract_all(body, '\[\[([^\[\]\n]+?)\]\]', 1), lambda t: trim(t)), lambda t: t <> '')"


@query(f"WITH {_MARKED} SELECT document_id, array_to_string(list_sort(list_distinct({_TARGETS})), chr(10)) AS targets FROM marked")
def wikilinks(spark, sf_dir):
    return marked(spark, sf_dir).select("document_id", F.array_join(F.array_sort(text.wikilinks(F.col("body"))), "\n").alias("targets"))


@query(rf"""WITH {_MARKED}, t AS (SELECT DISTINCT document_id AS source, unnest({_TARGETS}) AS target_text FROM marked),
  p AS (SELECT source, target_text, trim(regexp_replace(trim(split_part(split_part(target_text, '|', 1), '#', 1)), '\.md$', ''), '/') AS p FROM t)
  SELECT source, target_text, lower(string_split(p, '/')[-1]) AS key, CASE WHEN contains(p, '/') THEN lower(p) END AS hint FROM p WHERE string_split(p, '/')[-1] <> ''""")
def link_rows(spark, sf_dir):
    docs = marked(spark, sf_dir).select("document_id", text.wikilinks(F.col("body")).alias("wikilinks"))
    return graph.link_rows(docs)


@query(f"""WITH {VAULT}, t AS (SELECT document_id, path, CASE WHEN document_id % 3 = 0 THEN '  Front ' || document_id WHEN document_id % 3 = 1 THEN ' ' END AS front,
    CASE WHEN document_id % 2 = 0 THEN 'Head ' || document_id END AS head FROM vault)
  SELECT document_id, coalesce(nullif(trim(front), ''), head, regexp_extract(path, '([^/]*)\\.md$', 1)) AS title FROM t""")
def document_title(spark, sf_dir):
    i = F.col("document_id")
    front = F.when(i % 3 == 0, F.concat(F.lit("  Front "), i.cast("string"))).when(i % 3 == 1, F.lit(" "))
    body = F.when(i % 2 == 0, F.concat(F.lit("```\n# no\n```\n# Head "), i.cast("string"), F.lit(" #\ntext"))).otherwise(F.lit("no heading"))
    return vault(spark, sf_dir).select("document_id", text.document_title(front, body, F.col("path")).alias("title"))


@query(r"""WITH t AS (SELECT doc_id AS document_id, ['##' || upper(lang), ' ' || source || ' ', '#', lang] AS tags FROM documents)
  SELECT document_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(regexp_replace(trim(t), '^#+', '')))), lambda t: t <> ''))), ',') AS tags FROM t""")
def frontmatter_tags(spark, sf_dir):
    tags = F.array(F.concat(F.lit("##"), F.upper("lang")), F.concat(F.lit(" "), "source", F.lit(" ")), F.lit("#"), F.col("lang"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.array_join(F.array_sort(text.frontmatter_tags(tags)), ",").alias("tags"))


@query(r"""WITH t AS (SELECT doc_id AS document_id, '<<<' || coalesce(text, '') || '>> [/Excerpt 1] >>>> <b>' AS x FROM documents),
  m AS (SELECT document_id, regexp_replace(x, '(?i)\[/?excerpt\b[^\]]*\]', '[excerpt-marker-removed]', 'g') AS x FROM t)
  SELECT document_id, sha256(array_to_string(list_transform(regexp_extract_all(x, '<{3,}|>{3,}|<{1,2}|>{1,2}|[^<>]+'),
    lambda p: CASE WHEN starts_with(p, '<<<') THEN repeat('‹', length(p)) WHEN starts_with(p, '>>>') THEN repeat('›', length(p)) ELSE p END), '')) AS safe FROM m""")
def neutralise(spark, sf_dir):
    made = F.concat(F.lit("<<<"), F.coalesce("text", F.lit("")), F.lit(">> [/Excerpt 1] >>>> <b>"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2(text.neutralise(made), 256).alias("safe"))


@query(f"WITH {VAULT} SELECT document_id, source_kind, page_role, project_id, is_route_map FROM vault")
def classify_path(spark, sf_dir):
    return vault(spark, sf_dir).select("document_id", "source_kind", "page_role", "project_id", "is_route_map")


@query(f"""WITH {values_sql("raw", ("n", "link"), RAW_LINKS)}, t AS (SELECT n, link, trim(regexp_replace(trim(split_part(split_part(link, '|', 1), '#', 1)), '\\.md$', ''), '/') AS p FROM raw)
  SELECT n, lower(string_split(p, '/')[-1]) AS key, CASE WHEN contains(p, '/') THEN lower(p) END AS hint FROM t""")
def normalise_link(spark, sf_dir):
    rows = literal(spark, RAW_LINKS, ("n", "link")).withColumn("t", paths.link_target(F.col("link")))
    return rows.select("n", "t.key", "t.hint")


@query(f"WITH {ASKED_SQL} SELECT query_id::BIGINT AS query_id, array_to_string(list_transform({terms_sql('query')}, lambda t: '\"' || t || '\"'), ' OR ') AS match FROM asked")
def tokenize_query(spark, sf_dir):
    return asked(spark).select("query_id", text.match_expression(F.col("query")).alias("match"))


@query(f"WITH {ASKED_SQL} SELECT query_id::BIGINT AS query_id, len({terms_sql('query')})::BIGINT AS terms FROM asked")
def informative_terms(spark, sf_dir):
    return asked(spark).select("query_id", text.informative_terms(F.col("query")).cast("long").alias("terms"))


@query(f"WITH {ASKED_SQL} SELECT query_id::BIGINT AS query_id, {intent_sql('query')} AS intent FROM asked")
def detect_intent(spark, sf_dir):
    return asked(spark).select("query_id", rules.intent(F.col("query")).alias("intent"))


def _project_sql(known: tuple[str, ...]) -> str:
    cued = f"regexp_extract(query, '(?i){rules.PROJECT}', 1)"
    if not known:
        return cued
    named = " ".join(f"WHEN contains(lower(query), '{k}') THEN '{k}'" for k in known)
    return f"CASE WHEN {cued} IN ({', '.join(repr(k) for k in known)}) THEN {cued} {named} ELSE '' END"


def _route_sql(known: tuple[str, ...] = ()) -> str:
    has = lambda p: f"regexp_matches(q, '(?i){p.replace(chr(39), chr(39) * 2)}')"
    words = ", ".join(f"'{w}'" for w in rules.QUESTION_WORDS)
    reason = (
        f"CASE WHEN q = '' THEN 'empty' WHEN {has(rules.GREETING)} THEN 'greeting-or-ack' WHEN contains(q, '```') THEN 'contains-code-block' "
        f"WHEN length(q) > 2000 THEN 'too-long' WHEN terms < 2 THEN 'too-few-terms' WHEN {has(rules.HISTORY)} OR intent = 'chronology' THEN 'chronology-cue' "
        f"WHEN {has(rules.EVIDENCE)} OR intent = 'evidence' THEN 'evidence-cue' WHEN project <> '' THEN 'project-cue:' || project "
        f"WHEN {has(rules.EXPLICIT)} THEN 'explicit-wiki-reference' WHEN {has(rules.COMMAND)} THEN 'imperative-command' "
        f"WHEN ends_with(q, '?') OR trim(string_split(lower(q), ' ')[1], '?,.!') IN ({words}) OR intent <> 'general' THEN 'question-like' "
        "WHEN terms >= 6 THEN 'long-informative-statement' ELSE 'no-retrieval-cue' END"
    )
    return (
        f"WITH {ASKED_SQL}, a AS (SELECT query_id, trim(query) AS q, {intent_sql('query')} AS intent, len({terms_sql('query')}) AS terms, "
        f"{_project_sql(known)} AS project FROM asked), b AS (SELECT *, {reason} AS reason FROM a) "
        "SELECT query_id::BIGINT AS query_id, intent, reason, reason IN ('chronology-cue', 'evidence-cue', 'explicit-wiki-reference', 'question-like', "
        "'long-informative-statement') OR starts_with(reason, 'project-cue') AS retrieve, CASE WHEN reason = 'chronology-cue' THEN 'history' "
        "WHEN reason = 'evidence-cue' THEN 'evidence' WHEN starts_with(reason, 'project-cue') THEN 'project:' || project ELSE 'answer' END AS profile FROM b"
    )


@query(_route_sql())
def route_query(spark, sf_dir):
    return asked(spark).withColumn("r", rules.route(F.col("query"))).select("query_id", "r.intent", "r.reason", "r.retrieve", "r.profile")


@query(_route_sql(known=("p3", "billing", "gateway")))
def route_known_projects(spark, sf_dir):
    routed = rules.route(F.col("query"), known_projects=("p3", "billing", "gateway"))
    return asked(spark).withColumn("r", routed).select("query_id", "r.intent", "r.reason", "r.retrieve", "r.profile")


@query(f"""WITH r AS ({_route_sql()}) SELECT reason, count(*) AS n, count(*) FILTER (WHERE retrieve) AS retrieved FROM r GROUP BY reason""")
def routing_histogram(spark, sf_dir):
    rows = asked(spark).withColumn("r", rules.route(F.col("query")))
    return rows.groupBy("r.reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("r.retrieve").alias("retrieved"))


@query(f"""WITH r AS ({_route_sql()}), q AS (SELECT *, query_id % 4 <> 0 AS wanted, CASE WHEN query_id % 3 = 0 THEN 'history' ELSE 'answer' END AS own FROM r)
  SELECT count(*) AS n, count(*) FILTER (WHERE wanted AND retrieve) / count(*) FILTER (WHERE wanted) AS retrieve_routed_recall,
  count(*) FILTER (WHERE wanted AND retrieve AND profile = own) / count(*) FILTER (WHERE wanted AND retrieve) AS profile_accuracy,
  count(*) FILTER (WHERE NOT wanted AND retrieve) / count(*) FILTER (WHERE NOT wanted) AS abstain_routed_to_retrieve FROM q""")
def routing_report(spark, sf_dir):
    i = F.col("query_id")
    rows = asked(spark).withColumn("mode", F.when(i % 4 != 0, "retrieve").otherwise("abstain")).withColumn("profile", F.when(i % 3 == 0, "history").otherwise("answer"))
    return evaluation.routing_report(rows, rules.route(F.col("query")))


@query(f"WITH {decompose_sql()} SELECT query_id::BIGINT AS query_id, array_to_string(parts, '|') AS parts FROM parted")
def decompose_query(spark, sf_dir):
    return asked(spark).select("query_id", F.array_join(rules.decompose(F.col("query")), "|").alias("parts"))


@query("""SELECT doc_id AS document_id, sha256('Title: Doc ' || doc_id || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Heading: A > ' || doc_id || chr(10) ELSE '' END
  || 'Tags: ' || lang || ', ' || source || chr(10) || chr(10) || coalesce(text, '')) AS input FROM documents""")
def embedding_input(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    none = F.array().cast("array<string>")
    made = text.embedding_input(
        F.concat(F.lit("Doc "), n), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A"), n)).otherwise(none), none, F.array("lang", "source"), F.coalesce("text", F.lit(""))
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2(made, 256).alias("input"))


@query(f"WITH {ASKED_SQL} SELECT query_id::BIGINT AS query_id, 'Represent this sentence for searching relevant passages: ' || trim(query) AS input FROM asked")
def query_input(spark, sf_dir):
    return asked(spark).select("query_id", text.query_input(F.col("query")).alias("input"))


@query("SELECT doc_id AS document_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id AS document_id, source, CASE WHEN mx > mn THEN (n_chars - mn) / (mx - mn) ELSE 0.0 END AS scaled FROM (SELECT *, min(n_chars) OVER (PARTITION BY source) AS mn, max(n_chars) OVER (PARTITION BY source) AS mx FROM documents)")
def minmax_normalise(spark, sf_dir):
    return fusion.min_max(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id"), "n_chars", "scaled", "source").select("document_id", "source", "scaled")


@query(r"""WITH t AS (SELECT doc_id, text, CASE WHEN contains(text[1:400], chr(10)) THEN 400 - strpos(reverse(text[1:400]), chr(10)) ELSE -1 END AS nl,
  CASE WHEN contains(text[1:400], ' ') THEN 400 - strpos(reverse(text[1:400]), ' ') ELSE -1 END AS sp FROM documents)
  SELECT doc_id AS document_id, sha256(CASE WHEN length(text) <= 400 THEN text
    ELSE regexp_replace(text[1:CASE WHEN nl >= 200 THEN nl WHEN sp >= 200 THEN sp ELSE 400 END], '\s+$', '') || ' …' END) AS cut FROM t""")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2(text.truncate(F.col("text"), F.lit(100)), 256).alias("cut"))


@query("""WITH RECURSIVE t AS (SELECT doc_id, 0 AS n, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS rest, CAST(NULL AS VARCHAR) AS piece FROM documents UNION ALL
  SELECT doc_id, n + 1, CASE WHEN cut > 0 THEN ltrim(rest[cut + 1:], ' ' || chr(10)) ELSE '' END, CASE WHEN cut > 0 THEN rtrim(rest[1:cut], ' ' || chr(10)) ELSE rest END
  FROM (SELECT doc_id, n, rest, CASE WHEN length(rest) <= 2000 THEN 0 ELSE 2002 - strpos(reverse(rest[1:2002]), chr(10) || chr(10)) - 1 END * CASE WHEN length(rest) > 2000 AND NOT contains(rest[1:2002], chr(10) || chr(10)) THEN 0 ELSE 1 END AS cut FROM t WHERE rest <> ''))
  SELECT doc_id AS document_id, n - 1 AS position, sha256(piece) AS text_hash FROM t WHERE piece IS NOT NULL""")
def oversize_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("body"))

    def run(batches):
        for pdf in batches:
            rows = [(d, i, p) for d, b in zip(pdf["document_id"], pdf["body"], strict=True) for i, p in enumerate(chunking.split_oversized(b, 2000))]
            yield pd.DataFrame(rows, columns=["document_id", "position", "piece"])

    return docs.mapInPandas(run, "document_id long, position int, piece string").select("document_id", "position", F.sha2("piece", 256).alias("text_hash"))


@query(r"""WITH RECURSIVE b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '^\s+', ''), '\s+$', '') AS body FROM documents),
  t AS (SELECT doc_id, 0 AS n, body AS rest, CAST(NULL AS VARCHAR) AS piece FROM b UNION ALL
  SELECT doc_id, n + 1, CASE WHEN cut > 0 THEN ltrim(rest[cut + 1:], ' ' || chr(10)) ELSE '' END, CASE WHEN cut > 0 THEN rtrim(rest[1:cut], ' ' || chr(10)) ELSE rest END
  FROM (SELECT doc_id, n, rest, CASE WHEN length(rest) <= 2000 THEN 0 ELSE 2002 - strpos(reverse(rest[1:2002]), chr(10) || chr(10)) - 1 END
          * CASE WHEN length(rest) > 2000 AND NOT contains(rest[1:2002], chr(10) || chr(10)) THEN 0 ELSE 1 END AS cut FROM t WHERE rest <> ''))
  SELECT doc_id AS document_id, n - 1 AS position, 'Doc ' || doc_id AS heading, 'Doc ' || doc_id AS section_name, sha256(piece) AS text_hash, length(piece) AS char_count
  FROM t WHERE piece IS NOT NULL""")
def chunk_documents(spark, sf_dir):
    chunks = chunking.chunk_documents(vault(spark, sf_dir).withColumn("body", body()))
    return chunks.select("document_id", "position", F.array_join("heading_path", "|").alias("heading"), "section_name", "text_hash", F.col("char_count").cast("long").alias("char_count"))

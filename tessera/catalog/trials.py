"""Queries of evaluation, the abstain gate and change events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog.base import VAULT, query
from tessera.plans import calibration, evaluation, gate
from tessera.plans.views import literal, table, vault
from tessera.streaming.watch import bursts

#: Vectors that make one question's candidates: each vector is a candidate of one question.
GROUP = 20
_OUT = f"""
cand AS (SELECT vec_id // {GROUP} AS question_id, (vec_id * 7) % 12 AS document_id, 'p' || ((vec_id * 7) % 12) AS path, 's' || (vec_id % 3) AS section_name, label,
           CASE label % 4 WHEN 0 THEN 'durable' WHEN 1 THEN 'project' WHEN 2 THEN 'decision' ELSE 'evidence' END AS authority_class,
           row_number() OVER (PARTITION BY vec_id // {GROUP} ORDER BY (vec_id * 31) % 499, vec_id) AS rank FROM embeddings),
qs AS (SELECT DISTINCT vec_id // {GROUP} AS question_id FROM embeddings),
rel AS (SELECT DISTINCT question_id, 'p' || u.k AS path, CASE WHEN u.k % 2 = 0 THEN ['s' || (u.k % 3)] END AS sections
        FROM qs, (SELECT unnest([question_id % 12, (question_id + 9) % 12, (question_id * 5 + 1) % 15]) AS k) u),
dr AS (SELECT question_id, path, row_number() OVER (PARTITION BY question_id ORDER BY best, path) AS doc_rank FROM (SELECT question_id, path, min(rank) AS best FROM cand GROUP BY ALL)),
pinned AS (SELECT c.question_id, c.path, c.rank FROM cand c JOIN rel r USING (question_id, path) WHERE sections IS NULL OR list_contains(sections, section_name)),
hit AS (SELECT DISTINCT question_id, path FROM pinned),
hr AS (SELECT question_id, doc_rank FROM hit JOIN dr USING (question_id, path)),
nr AS (SELECT question_id, count(DISTINCT path) AS n FROM rel GROUP BY 1),
m AS (SELECT n.question_id, n.n, min(doc_rank) AS first, count(*) FILTER (WHERE doc_rank <= 1) AS w1, count(*) FILTER (WHERE doc_rank <= 3) AS w3, count(*) FILTER (WHERE doc_rank <= 5) AS w5,
        count(*) FILTER (WHERE doc_rank <= 10) AS w10, coalesce(sum(1.0 / log2(doc_rank + 1)) FILTER (WHERE doc_rank <= 10), 0) AS dcg FROM nr n LEFT JOIN hr USING (question_id) GROUP BY 1, 2),
outc AS (SELECT question_id, CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END AS hit_at_1, CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END AS hit_at_3, CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END AS hit_at_5,
   CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END AS hit_at_10, w1 / n AS recall_at_1, w3 / n AS recall_at_3, w5 / n AS recall_at_5, w10 / n AS recall_at_10,
   coalesce(1.0 / first, 0.0) AS reciprocal_rank, dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg_at_10 FROM m)"""


def _candidates(spark, sf_dir):
    """(questions, candidates): every vector is a candidate of the question of its group."""
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("question_id", F.floor(v / GROUP))
    klass = F.element_at(F.array(*map(F.lit, ("durable", "project", "decision", "evidence"))), F.col("label") % 4 + 1)
    section = F.concat(F.lit("s"), (v % 3).cast("string"))
    order = Window.partitionBy("question_id").orderBy((v * 31) % 499, "vec_id")
    rows = e.select(
        "question_id", ((v * 7) % 12).alias("document_id"), F.concat(F.lit("p"), ((v * 7) % 12).cast("string")).alias("path"), section.alias("section_name"),
        F.array(section).alias("heading_path"), klass.alias("authority_class"), F.row_number().over(order).alias("rank"),
    )
    return e.select("question_id").distinct(), rows


def _relevant(q):
    i = F.col("question_id")
    k = q.select("question_id", F.explode(F.array(i % 12, (i + 9) % 12, (i * 5 + 1) % 15)).alias("k"))
    pin = F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("s"), (F.col("k") % 3).cast("string"))))
    return k.select("question_id", F.concat(F.lit("p"), F.col("k").cast("string")).alias("path"), pin.alias("sections")).distinct()


@query(f"WITH {_OUT} SELECT DISTINCT question_id, path FROM hit")
def relevance_match(spark, sf_dir):
    q, cand = _candidates(spark, sf_dir)
    return evaluation.relevance(cand, _relevant(q)).select("question_id", "path").distinct()


_METRICS = [f"{m}_at_{k}" for m in ("hit", "recall") for k in (1, 3, 5, 10)]


@query(f"WITH {_OUT} SELECT question_id, {', '.join(_METRICS)}, reciprocal_rank FROM outc")
def hit_recall_mrr(spark, sf_dir):
    q, cand = _candidates(spark, sf_dir)
    return evaluation.hit_metrics(q, cand, _relevant(q)).select("question_id", *_METRICS, "reciprocal_rank")


@query(f"WITH {_OUT} SELECT question_id, ndcg_at_10 FROM outc")
def ndcg(spark, sf_dir):
    q, cand = _candidates(spark, sf_dir)
    return evaluation.hit_metrics(q, cand, _relevant(q)).select("question_id", "ndcg_at_10")


@query(f"""WITH {_OUT} SELECT question_id, max(CASE WHEN rank = 1 THEN authority_class IN ('durable', 'project') END) AS top1, max(authority_class IN ('durable', 'project')) AS any3
  FROM cand WHERE rank <= 3 GROUP BY question_id""")
def authority_accuracy(spark, sf_dir):
    q, cand = _candidates(spark, sf_dir)
    return evaluation.authority_accuracy(q.select("*", F.lit("retrieve").alias("mode"), F.lit("durable").alias("authority_class")), cand)


@query("""SELECT doc_id % 50 AS question_id, avg(CASE WHEN sha256(coalesce(text, '')) = CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AND source = CASE WHEN doc_id % 11 = 0 THEN 'y' ELSE source END THEN 1.0 ELSE 0.0 END) AS citation_fidelity
  FROM documents GROUP BY 1""")
def citation_fidelity(spark, sf_dir):
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return evaluation.citation_fidelity(docs.select(
        (i % 50).alias("question_id"), "text", F.when(i % 7 == 0, "x").otherwise(F.sha2("text", 256)).alias("text_hash"), F.col("source").alias("section_name"),
        F.array(F.lit("a"), F.when(i % 11 == 0, "y").otherwise(F.col("source"))).alias("heading_path"),
    ))


@query(f"WITH {_OUT}, c AS (SELECT question_id, document_id, count(*) AS n FROM cand WHERE rank <= 10 GROUP BY ALL) SELECT question_id, max(n) / sum(n) AS duplicate_share FROM c GROUP BY 1")
def dup_concentration(spark, sf_dir):
    return evaluation.duplicate_share(_candidates(spark, sf_dir)[1])


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"))


def _outcomes(spark, sf_dir):
    q, cand = _candidates(spark, sf_dir)
    i = F.col("question_id")
    rows = evaluation.hit_metrics(q, cand, _relevant(q))
    return rows.withColumns({
        "category": F.concat(F.lit("c"), (i % 4).cast("string")), "elapsed_ms": (i * i % 37).cast("double"), "mode": F.when(i % 6 == 5, "abstain").otherwise("retrieve"),
        "error": F.when(i % 9 == 8, "late").otherwise(""), "has_conflict": i % 3 == 0,
    })


_TOLD = """oo AS (SELECT *, question_id % 9 <> 8 AS fine, question_id % 9 <> 8 AND question_id % 6 <> 5 AS asked, (question_id * question_id % 37)::DOUBLE AS ms FROM outc)"""
_AGG = """count(*) AS n, count(*) FILTER (WHERE asked) AS n_retrieve, count(*) FILTER (WHERE fine AND NOT asked) AS n_abstain, count(*) FILTER (WHERE NOT fine) AS errors,
  avg(hit_at_1) FILTER (WHERE asked) AS hit_at_1, avg(hit_at_5) FILTER (WHERE asked) AS hit_at_5, avg(recall_at_10) FILTER (WHERE asked) AS recall_at_10,
  avg(reciprocal_rank) FILTER (WHERE asked) AS mrr, avg(ndcg_at_10) FILTER (WHERE asked) AS ndcg_at_10, avg((question_id % 3 = 0)::INT) FILTER (WHERE asked) AS conflict_rate,
  quantile_cont(ms, 0.5) FILTER (WHERE fine) AS p50_ms, quantile_cont(ms, 0.95) FILTER (WHERE fine) AS p95_ms"""


@query(f"WITH {_OUT}, {_TOLD} SELECT 'c' || (question_id % 4) AS category, {_AGG} FROM oo GROUP BY 1")
def aggregate_by_category(spark, sf_dir):
    return evaluation.aggregate(_outcomes(spark, sf_dir), ("category",))


@query(f"""WITH {_OUT}, {_TOLD}, a AS (SELECT avg(hit_at_5) AS h, avg(reciprocal_rank) AS r, avg(hit_at_1) AS t FROM oo WHERE asked), x(metric, base, candidate, tolerance) AS (
  SELECT 'hit_at_5', h, h - 0.03, 0.02 FROM a UNION ALL SELECT 'mrr', r, r - 0.01, 0.02 FROM a UNION ALL SELECT 'authority_top1', t, t * 0.5, 0.05 FROM a)
  SELECT metric, base, candidate, base - candidate AS drop, base - candidate > tolerance AS regressed FROM x""")
def regression_rule(spark, sf_dir):
    same = {"split": F.lit("heldout"), "version": F.lit("1"), "fingerprint": F.lit("f")}
    one = evaluation.aggregate(_outcomes(spark, sf_dir)).withColumns(same | {"authority_top1": F.col("hit_at_1")})
    other = one.withColumns({"hit_at_5": F.col("hit_at_5") - 0.03, "mrr": F.col("mrr") - 0.01, "authority_top1": F.col("authority_top1") * 0.5})
    return evaluation.regressions(one, other).select("metric", "base", "candidate", "drop", "regressed")


@query("SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return evaluation.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ("user_id",), "ts")


@query("""WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY event_type)
  SELECT event_type, p50, v[greatest(floor(len(v) * 0.95)::INT, 1)] AS p95, len(v) AS n FROM s""")
def bench_latency(spark, sf_dir):
    return evaluation.bench_latency(table(spark, sf_dir, "events"), ("event_type",), "value")


GATE = """
g AS (SELECT question_id AS query_id, rank, 1.0 / (20 + rank) + (document_id % 5) * 0.001 AS score, CASE WHEN document_id % 3 <> 0 THEN rank END AS dense_rank, CASE WHEN document_id % 2 = 0 THEN rank END AS lexical_rank,
   CASE WHEN document_id % 3 <> 0 THEN (document_id % 20) / 10.0 END AS distance, CASE WHEN document_id % 2 = 0 THEN document_id * 0.5 END AS bm25, authority_class = 'durable' AS authority_match FROM cand),
feat AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS rrf_top, greatest(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 0.0) AS rrf_margin,
   count(*) FILTER (WHERE rank <= 5 AND dense_rank IS NOT NULL AND lexical_rank IS NOT NULL) / 5 AS channel_agreement_top5,
   max(CASE WHEN rank = 1 AND dense_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 1.0 ELSE 0.0 END) AS top1_in_both_channels, max(CASE WHEN rank = 1 AND authority_match THEN 1.0 ELSE 0.0 END) AS authority_top1,
   coalesce(1 - min(distance) / 2, 0.0) AS dense_top_similarity, CASE WHEN max(bm25) > 0 THEN 1 - exp(-max(bm25) / 10) ELSE 0.0 END AS bm25_top_norm, least(count(*), 10) / 10 AS n_candidates_norm FROM g GROUP BY query_id),
sc AS (SELECT query_id, 1 / (1 + exp(-(-1.0 + 20 * rrf_top + channel_agreement_top5 + 2 * authority_top1 - dense_top_similarity))) AS gate_score, query_id % 3 <> 0 AS label, query_id % 5 = 0 AS abstain FROM feat)"""
_WEIGHTS = {"rrf_top": 20.0, "channel_agreement_top5": 1.0, "authority_top1": 2.0, "dense_top_similarity": -1.0}


def _gate_rows(spark, sf_dir):
    _, cand = _candidates(spark, sf_dir)
    d, r = F.col("document_id"), F.col("rank")
    return cand.select(
        F.col("question_id").alias("query_id"), "rank", (F.lit(1.0) / (20 + r) + (d % 5) * 0.001).alias("score"), F.when(d % 3 != 0, r).alias("dense_rank"), F.when(d % 2 == 0, r).alias("lexical_rank"),
        F.when(d % 3 != 0, (d % 20) / 10).alias("distance"), F.when(d % 2 == 0, d * 0.5).alias("bm25"), (F.col("authority_class") == "durable").alias("authority_match"),
    )


def _gate_scored(spark, sf_dir):
    i = F.col("query_id")
    return gate.scored(gate.features(_gate_rows(spark, sf_dir)), _WEIGHTS, -1.0).withColumn("label", i % 3 != 0).withColumn("abstain", i % 5 == 0)


@query(f"WITH {_OUT}, {GATE} SELECT * FROM feat")
def gate_features(spark, sf_dir):
    return gate.features(_gate_rows(spark, sf_dir))


@query(f"WITH {_OUT}, {GATE} SELECT query_id, gate_score, gate_score >= 0.6 AS inject FROM sc")
def gate_score(spark, sf_dir):
    return gate.decide(_gate_scored(spark, sf_dir), 0.6).select("query_id", "gate_score", "inject")


@query(f"""WITH {_OUT}, {GATE}, p AS (SELECT gate_score, avg(label::INT) OVER (ORDER BY gate_score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS precision FROM sc)
  SELECT coalesce(min(gate_score) FILTER (WHERE precision >= 0.7), max(gate_score)) AS threshold FROM p""")
def gate_threshold(spark, sf_dir):
    return gate.threshold(_gate_scored(spark, sf_dir), 0.7)


@query(f"""WITH {_OUT}, {GATE}, t AS (SELECT *, gate_score >= 0.6 AS inj FROM sc) SELECT count(*) FILTER (WHERE inj AND NOT abstain AND label) / count(*) FILTER (WHERE inj AND NOT abstain) AS precision,
  count(*) FILTER (WHERE inj AND NOT abstain) / count(*) FILTER (WHERE NOT abstain) AS coverage, 1 - count(*) FILTER (WHERE inj AND abstain) / count(*) FILTER (WHERE abstain) AS abstain_rate,
  (count(*) FILTER (WHERE inj AND NOT abstain AND NOT label) + count(*) FILTER (WHERE inj AND abstain)) / count(*) FILTER (WHERE inj) AS pollution, count(*) FILTER (WHERE inj)::DOUBLE AS injected, count(*)::DOUBLE AS n FROM t""")
def gate_report(spark, sf_dir):
    return gate.report(_gate_scored(spark, sf_dir), 0.6)


@query(None)
def gate_fit(spark, sf_dir):
    weights, bias = gate.fit(_gate_scored(spark, sf_dir))
    return literal(spark, [*weights.items(), ("bias", bias)], ("name", "value"))


@query(f"""WITH {_OUT}, {GATE}, k AS (SELECT query_id, count(*) AS n FROM g WHERE rank % 7 = 0 GROUP BY 1)
SELECT g.query_id, min(distance) AS dense_top_distance, max(bm25) AS bm25_top_score, max(CASE WHEN rank = 1 THEN score END) AS rrf_top,
  max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS rrf_margin,
  count(*) FILTER (WHERE rank <= 5 AND dense_rank IS NOT NULL AND lexical_rank IS NOT NULL) / 5 AS channel_agreement_top5,
  max(CASE WHEN rank = 1 THEN CASE WHEN dense_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS top1_in_both_channels,
  NULL::DOUBLE AS rerank_top, max(CASE WHEN rank = 1 THEN CASE WHEN authority_match THEN 1.0 ELSE 0.0 END END) AS authority_top1, count(*)::DOUBLE AS n_candidates,
  coalesce(max(k.n), 0)::DOUBLE AS n_conflicts FROM g LEFT JOIN k ON k.query_id = g.query_id GROUP BY g.query_id""")
def diagnostic_features(spark, sf_dir):
    rows = _gate_rows(spark, sf_dir)
    return evaluation.diagnostics(rows, rows.where("rank % 7 = 0").select("query_id", F.col("rank").cast("string").alias("label")))


def _golden(spark, sf_dir):
    """A question per document, with faults in some."""
    i = F.col("doc_id")
    none = F.array().cast("array<struct<path:string,sections:array<string>>>")
    path = F.when(i % 37 == 0, "/abs").when(i % 41 == 0, "a/../b").otherwise(F.concat(F.lit("p"), (i % 7).cast("string")))
    source = F.array(F.struct(path.alias("path"), F.when(i % 4 == 0, F.array(F.concat(F.lit("h"), (i % 5).cast("string")))).alias("sections")))
    abstain = i % 10 == 0
    name = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (i % k + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("g"), (i - F.when(i % 11 == 1, 1).otherwise(0)).cast("string")).alias("question_id"), name(9, (*evaluation.CATEGORIES, "odd")).alias("category"),
        name(8, ("dev",) * 4 + ("heldout",) * 3 + ("test",)).alias("split"), F.when(abstain & (i % 20 == 0), "none").when(i % 23 == 0, "best").otherwise("durable").alias("authority_class"),
        F.when(abstain, "abstain").when(i % 29 == 0, "maybe").otherwise("retrieve").alias("mode"), F.when(i % 13 == 0, " ").otherwise("ask").alias("query"),
        F.when(i % 17 == 0, "project:").when(i % 19 == 0, "project:x").otherwise("answer").alias("profile"), F.when(i % 6 == 0, none).otherwise(source).alias("relevant"),
    )


_GOLDEN = """q AS (SELECT doc_id AS i, 'g' || (doc_id - CASE WHEN doc_id % 11 = 1 THEN 1 ELSE 0 END) AS question_id, doc_id % 10 = 0 AS abstain, doc_id % 10 <> 0 AND doc_id % 29 = 0 AS odd_mode, doc_id % 6 = 0 AS bare,
  CASE WHEN doc_id % 37 = 0 THEN '/abs' WHEN doc_id % 41 = 0 THEN 'a/../b' ELSE 'p' || (doc_id % 7) END AS path FROM documents)"""


@query(f"""WITH {_GOLDEN} SELECT question_id, 'duplicate id' AS problem FROM q GROUP BY 1 HAVING count(*) > 1 UNION SELECT question_id, 'unknown category' FROM q WHERE i % 9 = 8
  UNION SELECT question_id, 'unknown split' FROM q WHERE i % 8 = 7 UNION SELECT question_id, 'unknown authority class' FROM q WHERE i % 23 = 0 AND NOT (abstain AND i % 20 = 0)
  UNION SELECT question_id, 'unknown mode' FROM q WHERE odd_mode UNION SELECT question_id, 'empty query' FROM q WHERE i % 13 = 0 UNION SELECT question_id, 'invalid profile' FROM q WHERE i % 17 = 0
  UNION SELECT question_id, 'abstain with sources' FROM q WHERE abstain AND NOT bare UNION SELECT question_id, 'abstain with a class' FROM q WHERE abstain AND i % 20 <> 0
  UNION SELECT question_id, 'no sources' FROM q WHERE NOT abstain AND bare UNION SELECT question_id, 'path not relative' FROM q WHERE NOT bare AND path IN ('/abs', 'a/../b')
  UNION SELECT question_id, 'unknown path' FROM q WHERE NOT bare AND path NOT IN ('p0', 'p1', 'p2', 'p3')
  UNION SELECT question_id, 'unknown heading' FROM q WHERE NOT bare AND path IN ('p0', 'p1', 'p2', 'p3') AND i % 4 = 0 AND i % 5 NOT IN (0, 1)""")
def golden_validation(spark, sf_dir):
    known = literal(spark, [("p0",), ("p1",), ("p2",), ("p3",)], ("path",))
    headings = known.withColumn("heading", F.explode(F.array(F.lit("h0"), F.lit("h1"))))
    return evaluation.validate_golden(_golden(spark, sf_dir), known, headings)


_CATEGORY = "['" + "', '".join((*evaluation.CATEGORIES, "odd")) + "']"


@query(f"""WITH q AS (SELECT ({_CATEGORY})[doc_id % 9 + 1] AS category, doc_id % 8 IN (4, 5, 6) AS held FROM documents),
  k AS (SELECT unnest(({_CATEGORY})[1:8]) AS category), g AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE held) AS heldout FROM q GROUP BY 1)
  SELECT k.category, coalesce(n, 0) AS n, coalesce(heldout, 0) AS heldout, CASE WHEN n IS NULL THEN 'no questions' WHEN heldout = 0 THEN 'no held-out questions' END AS problem FROM k LEFT JOIN g USING (category)
  UNION ALL SELECT NULL, count(*), count(*) FILTER (WHERE held), CASE WHEN count(*) < 60 THEN 'too few questions' END FROM q""")
def stratification(spark, sf_dir):
    return evaluation.stratification(_golden(spark, sf_dir))


@query(f"""SELECT ({_CATEGORY})[doc_id % 9 + 1] AS category, count(*) FILTER (WHERE doc_id % 8 < 4) AS dev, count(*) FILTER (WHERE doc_id % 8 IN (4, 5, 6)) AS heldout FROM documents GROUP BY 1""")
def counts_by_split(spark, sf_dir):
    return evaluation.counts_by_split(_golden(spark, sf_dir))


@query(None)
def calibrate(spark, sf_dir):
    """The gate fitted on one half of the questions and reported on the other, flattened."""
    q, cand = _candidates(spark, sf_dir)
    i = F.col("question_id")
    rel = _relevant(q).groupBy("question_id").agg(F.collect_list(F.struct("path", "sections")).alias("relevant"))
    asked = q.join(rel, "question_id").select(
        "question_id", F.when(i % 2 == 0, "dev").otherwise("heldout").alias("split"), F.when(i % 5 == 0, "abstain").otherwise("retrieve").alias("mode"),
        F.lit("what is the row limit of snapshots").alias("query"), F.lit("answer").alias("profile"), "relevant",
    )
    told = cand.join(_gate_rows(spark, sf_dir).withColumnRenamed("query_id", "question_id"), ["question_id", "rank"])
    made = calibration.calibrate(asked, told)
    held = made.metrics["heldout"]
    return literal(spark, [("threshold", float(made.threshold)), *((k, float(v)) for k, v in held.items()), ("safety_passed", float(made.certified))], ("name", "value"))


# ---------------------------------------------------------------- events


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
  SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 3600000000 AS ended_us, count(*) AS n_events FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = bursts(events, "1 hour", ("user_id",), late=None)
    return out.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_events")

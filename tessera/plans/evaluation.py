"""Retrieval metrics over all questions of a run at once, and the rules that compare runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
# The classes that satisfy an expected authority class.
SATISFIES = {
    "current-state": ("current-state",),
    "decision": ("decision",),
    "durable": ("durable", "project"),
    "evidence": ("evidence",),
    "idea": ("idea",),
    "log": ("log",),
}
#: Drops of a mean that count as a regression.
TOLERANCE = {"hit_at_5": 0.02, "mrr": 0.02, "authority_top1": 0.05}


def relevance(candidates: DataFrame, relevant: DataFrame) -> DataFrame:
    """Candidates (question_id, rank, path, section_name, heading_path) that match relevant (question_id, path, sections)."""
    wanted = F.col("sections")
    any_section = wanted.isNull() | (F.size(wanted) <= 0)
    hit = any_section | F.array_contains(wanted, F.col("section_name")) | F.arrays_overlap(F.col("heading_path"), wanted)
    return candidates.join(relevant, ["question_id", "path"]).where(F.coalesce(hit, F.lit(False)))


def document_ranks(candidates: DataFrame) -> DataFrame:
    """(question_id, path, doc_rank): documents by their best chunk, ranks closed up."""
    best = candidates.groupBy("question_id", "path").agg(F.min("rank").alias("best"))
    return best.withColumn("doc_rank", F.row_number().over(Window.partitionBy("question_id").orderBy("best", "path"))).drop("best")


def hit_metrics(questions: DataFrame, candidates: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per question: hit_at_k and recall_at_k for KS, reciprocal_rank, ndcg_at_10. A later chunk may satisfy a section pin."""
    hits = relevance(candidates, relevant).select("question_id", "path").distinct().join(document_ranks(candidates), ["question_id", "path"])
    n = relevant.groupBy("question_id").agg(F.countDistinct("path").alias("n_rel"))
    dcg = F.sum(F.when(F.col("doc_rank") <= 10, F.lit(1.0) / F.log2(F.col("doc_rank") + 1)).otherwise(0.0))
    per = hits.groupBy("question_id").agg(
        F.min("doc_rank").alias("first"), dcg.alias("dcg"), *(F.sum((F.col("doc_rank") <= k).cast("int")).alias(f"within_{k}") for k in KS)
    )
    rows = questions.select("question_id").join(n, "question_id", "left").join(per, "question_id", "left").na.fill(0, ["n_rel"])
    steps = F.sequence(F.lit(1), F.least("n_rel", F.lit(10)).cast("int"))
    ideal = F.when(F.col("n_rel") > 0, F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1)))
    share = lambda k: F.when(F.col("n_rel") > 0, F.coalesce(f"within_{k}", F.lit(0)) / F.col("n_rel")).otherwise(0.0)
    return rows.select(
        "question_id",
        *(F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in KS),
        *(share(k).alias(f"recall_at_{k}") for k in KS),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg_at_10"),
    )


def satisfied(expected: Column, got: Column) -> Column:
    out = F.lit(False)
    for name, classes in SATISFIES.items():
        out = F.when(expected == name, got.isin(*classes)).otherwise(out)
    return out


def authority_accuracy(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(question_id, top1, any3), null for questions to abstain on or without candidates."""
    rows = candidates.where("rank <= 3").join(questions.where("mode <> 'abstain'").select("question_id", F.col("authority_class").alias("expected")), "question_id")
    ok = satisfied(F.col("expected"), F.col("authority_class"))
    per = rows.groupBy("question_id").agg(F.max(F.when(F.col("rank") == 1, ok)).alias("top1"), F.max(ok).alias("any3"))
    return questions.select("question_id").join(per, "question_id", "left")


def duplicate_share(candidates: DataFrame, top_n: int = 10) -> DataFrame:
    """The largest share that one document has of a question's first top_n."""
    per = candidates.where(F.col("rank") <= top_n).groupBy("question_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("question_id").agg((F.max("n") / F.sum("n")).alias("duplicate_share"))


def citation_fidelity(candidates: DataFrame) -> DataFrame:
    """Share of a question's candidates whose text has the recorded hash and whose section ends the heading path."""
    same = F.sha2("text", 256) == F.col("text_hash")
    placed = F.col("section_name") == F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    return candidates.groupBy("question_id").agg(F.avg((same & placed).cast("double")).alias("citation_fidelity"))


def diagnostics(candidates: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """(query_id, signals) for later calibration, null where a query has nothing to tell them from.

    candidates: query_id, rank, score, dense_rank, lexical_rank, distance, bm25, authority_match and, if reranked, rerank_score.
    conflicts: (query_id, label), counted.
    """
    at = lambda r, c: F.max(F.when(F.col("rank") == r, c))
    both = (F.col("dense_rank").isNotNull() & F.col("lexical_rank").isNotNull()).cast("double")
    told = F.col("rerank_score") if "rerank_score" in candidates.columns else F.lit(None).cast("double")
    out = candidates.groupBy("query_id").agg(
        F.min("distance").alias("dense_top_distance"),
        F.max("bm25").alias("bm25_top_score"),
        at(1, F.col("score")).alias("rrf_top"),
        (at(1, F.col("score")) - at(2, F.col("score"))).alias("rrf_margin"),
        (F.sum(F.when(F.col("rank") <= 5, both).otherwise(0.0)) / 5).alias("channel_agreement_top5"),
        at(1, both).alias("top1_in_both_channels"),
        at(1, told).alias("rerank_top"),
        at(1, F.coalesce(F.col("authority_match"), F.lit(False)).cast("double")).alias("authority_top1"),
        F.count(F.lit(1)).cast("double").alias("n_candidates"),
    )
    if conflicts is None:
        return out.withColumn("n_conflicts", F.lit(0.0))
    n = conflicts.groupBy("query_id").agg(F.count(F.lit(1)).cast("double").alias("n_conflicts"))
    return out.join(n, "query_id", "left").na.fill(0.0, ["n_conflicts"])


def aggregate(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the questions to be answered, and interpolated latency percentiles over all without an error.

    outcomes: hit_at_k and recall_at_k, reciprocal_rank, ndcg_at_10, elapsed_ms; if there, mode (retrieve where there is none), error
    ("" where none), has_conflict, authority_top1, duplicate_share, citation_fidelity.
    """
    have = lambda c, other: F.coalesce(F.col(c), other) if c in outcomes.columns else other
    fine = have("error", F.lit("")) == ""
    asked = fine & (have("mode", F.lit("retrieve")) == "retrieve")
    mean = lambda c, out, when=asked: F.avg(F.when(when, F.col(c).cast("double"))).alias(out)
    named = {"hit_at_1": "hit_at_1", "hit_at_5": "hit_at_5", "recall_at_10": "recall_at_10", "reciprocal_rank": "mrr", "ndcg_at_10": "ndcg_at_10"}
    also = {"has_conflict": "conflict_rate", "authority_top1": "authority_top1", "duplicate_share": "duplicate_share"}
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(asked).alias("n_retrieve"),
        F.count_if(fine & ~asked).alias("n_abstain"),
        F.count_if(~fine).alias("errors"),
        *(mean(c, out) for c, out in named.items()),
        *(mean(c, out) for c, out in also.items() if c in outcomes.columns),
        *([mean("citation_fidelity", "citation_fidelity", fine)] if "citation_fidelity" in outcomes.columns else []),
        F.percentile(F.when(fine, F.col("elapsed_ms")), F.lit(0.5)).alias("p50_ms"),
        F.percentile(F.when(fine, F.col("elapsed_ms")), F.lit(0.95)).alias("p95_ms"),
    )


def latest(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The row with the greatest `at` of each key, by one aggregation; of equal ones the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("__at"), *rest)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def bench_latency(samples: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by, p50, p95, n): the median, and the value at place int(n * 0.95) of the sorted samples, counted from one; the only one of one."""
    sorted_ = samples.groupBy(*by).agg(F.percentile(column, F.lit(0.5)).alias("p50"), F.array_sort(F.collect_list(column)).alias("all"))
    place = F.greatest(F.floor(F.size("all") * 0.95).cast("int"), F.lit(1))
    return sorted_.select(*by, "p50", F.element_at("all", place).alias("p95"), F.size("all").cast("long").alias("n"))


def routing_report(questions: DataFrame, route: Column) -> DataFrame:
    """One row: n, recall of questions to be answered, accuracy of their profile, leakage of those to abstain on.

    questions: query, mode, profile; route: the router's struct over them.
    """
    rows = questions.select("mode", "profile", route.alias("r"))
    asked, sent = F.col("mode") == "retrieve", F.col("r.retrieve")
    share = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a) / F.count_if(b)).otherwise(0.0)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        share(asked & sent, asked).alias("retrieve_routed_recall"),
        share(asked & sent & (F.col("r.profile") == F.col("profile")), asked & sent).alias("profile_accuracy"),
        share(~asked & sent, ~asked).alias("abstain_routed_to_retrieve"),
    )


def regressions(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, base, candidate, drop, regressed) of two one-row aggregates that share split, version and fingerprint."""
    keys = ["split", "version", "fingerprint"]
    both = base.alias("b").join(candidate.alias("c"), keys)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").alias("base"), F.col(f"c.{m}").alias("candidate"), F.lit(t).alias("tolerance")) for m, t in TOLERANCE.items()]
    out = both.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    return out.withColumn("drop", F.col("base") - F.col("candidate")).withColumn("regressed", F.col("drop") > F.col("tolerance"))


#: Leading hex digits of a path's hash that name its bucket.
FINGERPRINT_DIGITS = 3


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """One row, fingerprint: of path and hash lines, sorted within buckets of the path's hash, then of the buckets in order.

    A bucket's lines meet in one row, a 4096th of the documents each; the last step holds 4096 hashes. A fingerprint is only
    compared with another of its kind.
    """
    line = F.concat("path", F.lit("\t"), "content_hash", F.lit("\n"))
    bucket = F.substring(F.sha2("path", 256), 1, FINGERPRINT_DIGITS).alias("bucket")
    parts = docs.groupBy(bucket).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("hash"))
    joined = F.array_sort(F.collect_list(F.concat("bucket", F.lit(":"), "hash")))
    return parts.agg(F.sha2(F.array_join(joined, ","), 256).alias("fingerprint"))


# Categories of a golden set in order, splits, classes a question may expect, modes and plain profiles.
CATEGORIES = ("current-state", "decision", "exact-term", "concept", "evidence", "chronology", "ambiguity", "no-answer")
SPLITS = ("dev", "heldout")
EXPECTED = ("current-state", "decision", "durable", "evidence", "log", "idea", "none")
QUESTION_MODES = ("retrieve", "abstain")
PROFILES = ("answer", "evidence", "history", "all", "current")


def validate_golden(questions: DataFrame, paths: DataFrame | None = None, headings: DataFrame | None = None) -> DataFrame:
    """(question_id, problem) of a golden set (question_id, category, split, authority_class, mode, query, profile, relevant:
    array of struct(path, sections)), against known paths (path) and their headings (path, heading), if given."""
    twice = questions.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("question_id", F.lit("duplicate id").alias("problem"))
    unknown = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    named = F.col("profile").startswith("project:") & (F.length("profile") > len("project:"))
    rules = (
        (unknown("category", CATEGORIES), "unknown category"),
        (unknown("split", SPLITS), "unknown split"),
        (unknown("authority_class", EXPECTED), "unknown authority class"),
        (unknown("mode", QUESTION_MODES), "unknown mode"),
        (F.trim(F.coalesce("query", F.lit(""))) == "", "empty query"),
        (unknown("profile", PROFILES) & ~F.coalesce(named, F.lit(False)), "invalid profile"),
        ((F.col("mode") == "abstain") & (F.size("relevant") > 0), "abstain with sources"),
        ((F.col("mode") == "abstain") & (F.col("authority_class") != "none"), "abstain with a class"),
        ((F.col("mode") != "abstain") & (F.size("relevant") <= 0), "no sources"),
    )
    found = F.array_compact(F.array(*(F.when(cond, F.lit(told)) for cond, told in rules)))
    out = twice.unionByName(questions.select("question_id", F.explode(found).alias("problem")))
    source = questions.select("question_id", F.explode("relevant").alias("r")).select("question_id", "r.path", "r.sections")
    outside = F.col("path").startswith("/") | F.contains("path", F.lit("\\")) | F.array_contains(F.split("path", "/"), "..")
    out = out.unionByName(source.where(outside).select("question_id", F.lit("path not relative").alias("problem")))
    if paths is not None:
        out = out.unionByName(source.join(paths, "path", "left_anti").select("question_id", F.lit("unknown path").alias("problem")))
        source = source.join(paths, "path", "left_semi")
    if headings is not None:
        pinned = source.select("question_id", "path", F.explode("sections").alias("heading"))
        out = out.unionByName(pinned.join(headings, ["path", "heading"], "left_anti").select("question_id", F.lit("unknown heading").alias("problem")))
    return out.distinct()


def counts_by_split(questions: DataFrame) -> DataFrame:
    """(category, dev, heldout): how many questions of each split."""
    return questions.groupBy("category").pivot("split", list(SPLITS)).count().na.fill(0, list(SPLITS))


def stratification(questions: DataFrame, least: int = 60, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """(category, n, heldout, problem): every category must be there and be held out too; `problem` is null where all is well. The
    row of the null category tells whether there are `least` questions."""
    spark = questions.sparkSession
    per = questions.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "heldout").alias("heldout"))
    known = spark.range(1).select(F.explode(F.array(*(F.lit(c) for c in categories))).alias("category"))
    rows = known.join(per, "category", "left").na.fill(0, ["n", "heldout"])
    rows = rows.withColumn("problem", F.when(F.col("n") == 0, "no questions").when(F.col("heldout") == 0, "no held-out questions"))
    total = questions.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "heldout").alias("heldout"))
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("category"), "n", "heldout", F.when(F.col("n") < least, "too few questions").alias("problem")))

"""Golden sets and run records as JSON files, the variants of a run, and tables of them as text."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.evaluation import CATEGORIES, aggregate, authority_accuracy, duplicate_share, hit_metrics, latest

#: What a variant searches with: the channels, and whether the head is reranked.
VARIANTS: Mapping[str, tuple[str, bool]] = {"dense": ("dense", False), "lexical": ("lexical", False), "hybrid": ("hybrid", False), "hybrid+rerank": ("hybrid", True)}
QUESTION = (
    "id string, category string, split string, query string, profile string, authority_class string, mode string, "
    "relevant array<struct<path:string,sections:array<string>>>, notes string"
)
GOLDEN = f"corpus string, version string, questions array<struct<{QUESTION.replace(' string', ':string').replace(' array', ':array')}>>"


def load_golden(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A row per question of one or more JSON documents {corpus, version, questions: [...]}."""
    docs = spark.read.schema(GOLDEN).option("multiLine", "true").json([path] if isinstance(path, str) else list(path))
    rows = docs.select("corpus", "version", F.explode("questions").alias("q")).select("corpus", "version", F.col("q.id").alias("question_id"), "q.*").drop("id")
    none = F.array().cast("array<struct<path:string,sections:array<string>>>")
    return rows.withColumn("relevant", F.coalesce("relevant", none)).withColumn("notes", F.coalesce("notes", F.lit("")))


def merge_drafts(drafts: DataFrame, corpus: str, version: str) -> DataFrame:
    """The questions of drafts as one set: ordered by category as golden sets list them, unknown ones last, then by id. It isn't validated."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category")), F.lit(0)), F.lit(len(CATEGORIES) + 1))
    return drafts.withColumns({"corpus": F.lit(corpus), "version": F.lit(version), "place": place}).orderBy("place", "question_id").drop("place")


def write_golden(questions: DataFrame, path: str) -> None:
    """One JSON document of a set's questions, which fits a row: a golden set is made by hand."""
    fields = [F.col("question_id").alias("id"), *(c for c in ("category", "split", "query", "profile", "authority_class", "mode", "relevant", "notes"))]
    place = F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category"))
    rows = questions.groupBy("corpus", "version").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.struct(*fields).alias("q"))))["q"].alias("questions"))
    rows.coalesce(1).write.json(path)


def relevant_rows(questions: DataFrame) -> DataFrame:
    """(question_id, path, sections) of the questions' sources."""
    return questions.select("question_id", F.explode("relevant").alias("r")).select("question_id", "r.path", "r.sections").distinct()


def outcomes(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row per question with its metrics: what `aggregate` takes. Latency and errors are a batch's, see run_variant."""
    rel = relevant_rows(questions)
    rows = questions.select("question_id", "category", "split", "mode").join(hit_metrics(questions, candidates, rel), "question_id")
    rows = rows.join(authority_accuracy(questions, candidates).select("question_id", F.col("top1").alias("authority_top1")), "question_id", "left")
    return rows.join(duplicate_share(candidates), "question_id", "left").na.fill(0.0, ["duplicate_share"])


def run_variant(questions: DataFrame, variant: str, retrieve: Callable[[DataFrame, str, bool], DataFrame], clock: Callable[[], float]) -> DataFrame:
    """Outcomes of all questions, retrieved as one batch of the variant.

    retrieve: (questions, mode, rerank) -> candidates (question_id, rank, path, section_name, heading_path, authority_class, document_id).
    elapsed_ms is a question's share of the batch. An error is recorded in each outcome, not raised.
    """
    if variant not in VARIANTS:
        raise ValueError(f"a variant is one of {sorted(VARIANTS)}")
    began = clock()
    try:
        got = retrieve(questions, *VARIANTS[variant]).persist()
        got.count()
        rows, error = outcomes(questions, got), ""
    except Exception as e:  # noqa: BLE001
        error = f"{type(e).__name__}: {str(e)[:200]}"
        nothing = "question_id string, rank int, path string, section_name string, heading_path array<string>, authority_class string, document_id long"
        rows = outcomes(questions, questions.sparkSession.createDataFrame([], nothing))
    share = (clock() - began) * 1000 / max(1, questions.count())
    return rows.withColumns({"variant": F.lit(variant), "elapsed_ms": F.lit(share), "error": F.lit(error)})


def run_record(rows: DataFrame, variant: str, split: str, started_at: str, facts: Mapping[str, str]) -> DataFrame:
    """One row: the variant, split, start and facts (fingerprint, golden version, counts, settings), with the aggregate over all questions
    and those by category."""
    overall = aggregate(rows).select(F.struct("*").alias("overall"))
    groups = aggregate(rows, ("category",)).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("by_category"))
    told = {"variant": variant, "split": split, "started_at": started_at} | dict(facts)
    return overall.crossJoin(groups).select(*(F.lit(v).alias(k) for k, v in told.items()), "overall", "by_category")


def record_name(started_at: str, variant: str, split: str) -> str:
    """The file name of a record: start without punctuation or fractions, variant, split."""
    stamp = started_at.split(".")[0].replace("-", "").replace(":", "").replace("+0000", "Z")
    return f"{stamp}-{variant.replace('+', '-')}-{split}.json"


def write_run(record: DataFrame, folder: str) -> str:
    row = record.select("started_at", "variant", "split").first()
    path = f"{folder.rstrip('/')}/{record_name(*row)}"
    record.coalesce(1).write.json(path)
    return path


def load_runs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.json([paths] if isinstance(paths, str) else list(paths))


def latest_runs(records: DataFrame) -> DataFrame:
    """The latest record of each golden version, split and variant."""
    return latest(records, ("golden_version", "split", "variant"), "started_at")


def as_markdown(title: str, rows: Sequence[Mapping[str, object]], columns: Sequence[str]) -> str:
    """A heading and a table; numbers with three digits, missing values as a dash."""

    def cell(v: object) -> str:
        return "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def benchmark_markdown(records: DataFrame) -> str:
    """The latest runs as a table, in order of golden version, split and variant."""
    flat = latest_runs(records).select("golden_version", "split", "variant", *(F.col(f"overall.{c}").alias(c) for c in ("n", "hit_at_5", "recall_at_10", "mrr", "ndcg_at_10", "p50_ms")))
    rows = [r.asDict() for r in flat.orderBy("golden_version", "split", "variant").collect()]
    return as_markdown("Benchmarks", rows, flat.columns)

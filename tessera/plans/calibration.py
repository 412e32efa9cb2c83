"""Calibration of the abstain gate on a golden set: fitted on one split, judged on the other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.intent import route
from tessera.plans import gate
from tessera.plans.evaluation import relevance, routing_report
from tessera.plans.runs import relevant_rows

# What the held-out report must reach. The first three permit injection at all; coverage beside them, by default.
LIMITS = {"precision": 0.90, "abstain_rate": 0.80, "pollution": 0.10, "coverage": 0.60}
#: Candidates of a question that injection would show.
HEAD = 4


@dataclass(frozen=True)
class Gate:
    """A fitted gate with its threshold, and what the held-out split says of it."""

    weights: dict[str, float]
    bias: float
    threshold: float | None
    metrics: dict[str, object] = field(default_factory=dict)

    @property
    def certified(self) -> bool:
        return bool(self.metrics.get("safety_passed", False))


def samples(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per question: the gate's features, label (the first candidate is relevant), shown (one of the first HEAD is) and abstain.

    candidates: question_id, rank, path, section_name, heading_path and what gate.features takes. Questions without candidates count with zeros.
    """
    hits = relevance(candidates, relevant_rows(questions)).groupBy("question_id").agg(F.min("rank").alias("first"))
    feats = gate.features(candidates.withColumnRenamed("question_id", "query_id")).withColumnRenamed("query_id", "question_id")
    asked = F.col("mode") != "abstain"
    rows = questions.select("question_id", "split", "mode").join(feats, "question_id", "left").na.fill(0.0, list(gate.FEATURES)).join(hits, "question_id", "left")
    within = lambda n: asked & F.coalesce(F.col("first") <= n, F.lit(False))
    return rows.select("question_id", "split", *gate.FEATURES, within(1).alias("label"), within(HEAD).alias("shown"), (~asked).alias("abstain"))


def calibrate(questions: DataFrame, candidates: DataFrame, known_projects: tuple[str, ...] = ()) -> Gate:
    """Fits weights and threshold on the split dev, reports on heldout, and tells whether the limits are met.

    Pollution of the context counts what injection would show: of held-out questions over the threshold, those to abstain on
    and those without a relevant candidate among the first HEAD.
    """
    rows = samples(questions, candidates).persist()
    dev = rows.where("split = 'dev'")
    weights, bias = gate.fit(dev)
    cut = gate.threshold(gate.scored(dev, weights, bias), LIMITS["precision"]).first()[0]
    of = lambda split: gate.scored(rows.where(F.col("split") == split), weights, bias)
    reports = {split: gate.report(of(split), cut).first().asDict() for split in ("dev", "heldout")}
    wrong = F.count_if(F.col("abstain") | ~F.col("shown"))
    held = of("heldout").where(F.col("gate_score") >= cut).agg(F.count(F.lit(1)).alias("n"), wrong.alias("wrong")).first()
    pollution = held["wrong"] / held["n"] if held["n"] else 0.0
    reports["heldout"]["context_pollution"] = pollution
    told = reports["heldout"]
    safe = told["precision"] >= LIMITS["precision"] and told["abstain_rate"] >= LIMITS["abstain_rate"] and pollution <= LIMITS["pollution"]
    routed = route(F.col("query"), known_projects=known_projects)
    routing = {s: routing_report(questions.where(F.col("split") == s), routed).first().asDict() for s in ("dev", "heldout")}
    rows.unpersist()
    metrics = reports | {"routing": routing, "limits": dict(LIMITS), "safety_passed": safe, "gate_passed": safe and told["coverage"] >= LIMITS["coverage"]}
    return Gate(weights, bias, cut, metrics)

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators.rerank import OverlapReranker
from tessera.plans import calibration, evaluation, gate, runs
from tessera.plans.calibration import Gate
from tessera.settings import Settings, load_settings
from tessera.sources import embedding
from tessera.sources.vault import Projection, contained, relative_path, safe_message, scan

PAGES = {
    "wiki/harbour.md": "---\ntitle: Harbour Master\n---\n# Harbour\nThe harbour master assigns berths to ships. See [[crane]].\n## Rules\nShips pay harbour dues.",
    "wiki/crane.md": "# Crane\nCranes lift containers from ships. Crane drivers rest at noon.",
    "wiki/projects/quay/current-state.md": "# State\nThe quay is being rebuilt; status is green. [[tide-tables]]",
    "wiki/tide-tables.md": "# Tides\nTide tables list high water. The Harbour Master prints them.",
    "wiki/empty.md": "",
    "raw/papers/waves.md": "# Waves\nMeasured waves of the bay.",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    for name, body in PAGES.items():
        (base / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (base / "docs" / name).write_text(body)
    os.symlink(base / "docs" / "wiki" / "crane.md", base / "docs" / "wiki" / "link.md")
    e = Engine(spark, str(base / "docs"), str(base / "home"), embedding.HashEmbedder(64), Settings(dimension=64, graph=True), OverlapReranker())
    first = e.reindex()
    assert (first.added, first.updated, first.removed) == (5, 0, 0) and first.embedded > 5
    return e


def test_links_are_pruned(engine):
    assert {r["path"] for r in scan(engine.spark, engine.root).select("path").collect()} == set(PAGES) - {"wiki/empty.md"}


def test_answer(engine):
    out = engine.answer("harbour dues for ships", mode="hybrid")
    assert out["results"][0]["path"] == "wiki/harbour.md" and out["citations"][0]["path"] == "wiki/harbour.md"
    assert out["context"].startswith("<<<UNTRUSTED") and out["context_tokens"] > 0
    assert all(r["source_kind"] == "wiki" for r in out["results"])
    # stems meet: the text says lift, assigns, cranes
    assert engine.answer("lifting a crane", mode="lexical", include_context=False)["results"][0]["path"] == "wiki/crane.md"


def test_scopes(engine):
    ask = engine.spark.createDataFrame([(0, "tide tables quay status"), (1, "  ")], "query_id long, query string")
    found = {r["path"] for r in engine.search(ask, "project:quay").collect()}
    # the project's page, and the curated page that it links to
    assert found == {"wiki/projects/quay/current-state.md", "wiki/tide-tables.md"}
    only = engine.projection.read("documents").where("path = 'wiki/crane.md'")
    assert {r["path"] for r in engine.search(ask, only=only).collect()} <= {"wiki/crane.md"}
    assert engine.search(ask, updated_from_ns=2**62).count() == 0
    assert engine.search(ask, rerank=True).where("rerank_score is not null").count() > 0


def test_expanded_queries(engine):
    wide = Engine(engine.spark, engine.root, engine.projection.root, engine.embedder, Settings(dimension=64, expand_queries=True))
    ask = engine.spark.createDataFrame([(3, "how do cranes lift containers; when is the high water of tides")], "query_id long, query string")
    assert {"wiki/crane.md", "wiki/tide-tables.md"} <= {r["path"] for r in wide.search(ask).collect()}


def test_related(engine):
    out = engine.related("/wiki/harbour.md")
    assert out["found"] and out["related"][0]["path"] == "wiki/crane.md" and {"wiki/tide-tables.md"} <= {r["path"] for r in out["related"]}
    assert not engine.related("wiki/none.md")["found"]
    for bad in ("", "a/../b"):
        with pytest.raises(ValueError):
            engine.related(bad)


def test_status_and_reindex(engine):
    before = engine.status()
    assert before["ok"] is False or before["integrity"]["documents_without_chunks"] == 0
    assert before["counts"]["documents"] == 5 and before["models"] == ["hash-v1"] and before["last_run"]["state"] == "ready" and before["missing_files"] == 0
    chunk_of = lambda: {(r["document_id"], r["input_hash"]): r["chunk_id"] for r in engine.projection.read("chunks").collect()}
    ids = chunk_of()
    path = f"{engine.root}/wiki/crane.md"
    with open(path, "a") as f:
        f.write("\n## New\nA new crane arrived.")
    os.remove(f"{engine.root}/raw/papers/waves.md")
    assert engine.missing_files().count() == 1
    run = engine.reindex()
    assert (run.added, run.updated, run.removed, run.skipped, run.embedded) == (0, 1, 1, 3, 1)
    now = chunk_of()
    assert all(now[k] == v for k, v in ids.items() if k in now) and len(set(now) - set(ids)) == 1
    again = engine.reindex()
    assert (again.updated, again.embedded, again.skipped) == (0, 0, 4)
    with pytest.raises(PermissionError):
        engine.reindex("full", confirm=True)
    assert engine.projection.read("runs").count() == 3
    # lost chunks are made anew though no document changed
    engine.projection.write({"chunks": engine.projection.read("chunks").where(F.col("document_id") != min(d for d, _ in now))})
    engine.reindex()
    assert set(chunk_of()) == set(now)


def test_failed_run_keeps_tables(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# A\ntext")

    class Bad:
        model, dimension = "bad", 4

        def embed(self, texts):
            return np.zeros((len(texts), 3))

    Engine(spark, str(tmp_path / "docs"), str(tmp_path / "home"), embedding.HashEmbedder(4)).reindex()
    broken = Engine(spark, str(tmp_path / "docs"), str(tmp_path / "home"), Bad())
    with pytest.raises(Exception, match="shape"):
        broken.reindex()
    p = Projection(spark, str(tmp_path / "home"))
    assert p.manifest()["state"] == "failed" and p.read("chunks").count() == 1 and p.read("runs").where("state = 'failed'").count() == 1


def test_two_writers(spark, tmp_path):
    a, b = Projection(spark, str(tmp_path)), Projection(spark, str(tmp_path))
    a.write({"t": spark.range(3)})
    b._number = lambda: -1  # began with no manifest
    b.stage("t", spark.range(5))
    with pytest.raises(RuntimeError):
        b.publish(["t"])
    assert a.read("t").count() == 3


def test_inject(engine):
    certified = Gate({"rrf_top": 1.0}, 0.0, 0.5, {"safety_passed": True})
    make = lambda g, **s: Engine(engine.spark, engine.root, engine.projection.root, engine.embedder, Settings(dimension=64, **s), gate=g)
    assert make(certified).inject("where do ships pay dues")["reason"] == "disabled"
    on = {"inject": True, "inject_deadline_ms": 120_000}
    assert make(None, **on).inject("x")["reason"] == "no-calibrated-gate"
    assert make(Gate({}, 0.0, 0.5), **on).inject("x")["reason"] == "gate-not-certified"
    assert make(certified, **on).inject("thanks!")["reason"] == "route:greeting-or-ack"
    e = make(certified, **on)
    done = e.inject("where do ships pay harbour dues?")
    assert done["inject"], done
    assert "harbour" in done["context"] and "context" not in e.decisions[-1]
    low = make(Gate({}, -9.0, 0.5, {"safety_passed": True}), **on).inject("where do ships pay harbour dues?")
    assert low["reason"] == "below-threshold", low
    assert make(certified, inject=True, inject_deadline_ms=1).inject("where do ships pay harbour dues?")["reason"] == "timeout"
    broken = make(certified, **on)
    broken.projection = None
    assert broken.inject("where do ships pay harbour dues?")["reason"].startswith("error:")


def test_paths(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("x")
    (tmp_path / "out.md").write_text("y")
    os.symlink(tmp_path / "out.md", tmp_path / "in" / "l.md")
    assert contained(str(tmp_path / "in"), str(tmp_path / "in" / "a.md")).endswith("a.md")
    for bad in ("in/l.md", "in/../out.md", "in"):
        with pytest.raises(ValueError):
            contained(str(tmp_path / "in"), str(tmp_path / bad))
    assert relative_path(" //a/b.md") == "a/b.md"
    assert safe_message(ValueError("no /data/x/file"), "/data/x/") == "no <root>/file" and len(safe_message(ValueError("z" * 900), "/r")) == 500


def test_batch_controller():
    seen = iter([(100, 900), (100, 900), (100, 900), (130, 900), (130, 900), (130, 900), (400, 900), (130, 10)])
    c = embedding.BatchController(lambda: next(seen), size=16, least=2, budget_mb=300, floor_mb=50)
    assert c.admit(0) == 0 and c.admit(40) == 16
    c.done()
    assert c.admit(5) == 5
    c.done()
    assert c.size == 8 and c.admit(40) == 8
    c.done()
    for _ in range(2):
        with pytest.raises(embedding.OverBudget):
            c.admit(9)


def test_vector_of_wrong_length(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0], "m")], "chunk_id long, embedding array<float>, model string")
    with pytest.raises(Exception, match="isn't of length 3"):
        embedding.upsert_vectors(v.limit(0), v, 3).collect()


def test_settings():
    assert load_settings({"mode": "dense", "k_final": 5}, {"k_final": None}, {"k_final": 7}) == Settings(mode="dense", k_final=7)
    for bad in ({"mod": "x"}, {"mode": "x"}, {"dimension": 0}):
        with pytest.raises(ValueError):
            load_settings(bad)


QUESTIONS = [
    {"id": f"q{i}", "category": evaluation.CATEGORIES[i % 8], "split": "heldout" if i % 2 else "dev", "query": "which berth is deep", "profile": "answer",
     "authority_class": "durable" if i % 3 else "none", "mode": "retrieve" if i % 3 else "abstain", "relevant": [{"path": f"p{i}", "sections": []}] if i % 3 else []}
    for i in range(24)
]


def test_golden_and_runs(spark, tmp_path):
    for k, part in enumerate((QUESTIONS[12:], QUESTIONS[:12])):
        (tmp_path / f"{k}.json").write_text(json.dumps({"corpus": "c", "version": "0", "questions": part}))
    drafts = runs.load_golden(spark, [str(tmp_path / "0.json"), str(tmp_path / "1.json")])
    golden = runs.merge_drafts(drafts, "harbour", "1")
    first = [r["question_id"] for r in golden.collect()][:3]
    assert first == ["q0", "q16", "q8"]
    runs.write_golden(golden, str(tmp_path / "golden"))
    back = runs.load_golden(spark, str(tmp_path / "golden"))
    assert back.count() == 24 and back.select("corpus", "version").distinct().collect() == [("harbour", "1")]
    assert evaluation.validate_golden(back).count() == 0

    def retrieve(questions, mode, rerank):
        if mode == "dense":
            raise RuntimeError("no vectors")
        at = F.when(F.lit(rerank), 1).otherwise(2)
        own = questions.select("question_id", at.alias("rank"), F.concat(F.lit("p"), F.substring("question_id", 2, 9)).alias("path"))
        other = questions.select("question_id", (3 - at).alias("rank"), F.lit("zz").alias("path"))
        rows = own.unionByName(other)
        return rows.withColumns({"section_name": F.lit(""), "heading_path": F.array().cast("array<string>"), "authority_class": F.lit("durable"), "document_id": F.lit(1)})

    ticks = iter(range(100))
    kept = []
    for n, variant in enumerate(("hybrid", "hybrid+rerank", "dense")):
        rows = runs.run_variant(back, variant, retrieve, lambda: float(next(ticks)))
        record = runs.run_record(rows, variant, "all", f"2026-01-0{n + 1}T10:00:00.5+0000", {"golden_version": "1", "fingerprint": "f"})
        kept.append(runs.write_run(record, str(tmp_path / "runs")))
    assert kept[1].endswith("20260102T100000-hybrid-rerank-all.json")
    records = runs.load_runs(spark, kept)
    got = {r["variant"]: r["overall"] for r in records.collect()}
    assert got["hybrid"]["mrr"] == 0.5 and got["hybrid+rerank"]["hit_at_1"] == 1.0 and got["dense"]["errors"] == 24 and got["hybrid"]["n_abstain"] == 8
    assert runs.latest_runs(records).count() == 3
    page = runs.benchmark_markdown(records)
    assert page.startswith("# Benchmarks") and "| 1 | all | hybrid+rerank |" in page and page.count("\n") == 7
    with pytest.raises(ValueError):
        runs.run_variant(back, "sparse", retrieve, lambda: 0.0)


def test_calibration(spark):
    none = "array<struct<path:string,sections:array<string>>>"
    rows, cands = [], []
    for i in range(80):
        abstain, good = i % 4 == 0, i % 4 != 0
        rows.append((i, "dev" if i % 2 else "heldout", "abstain" if abstain else "retrieve", "which berth is deep", "answer", [] if abstain else [(f"p{i}", None)]))
        cands.append((i, 1, f"p{i}" if good else "zz", "", [], 0.09 if good else 0.02, 1 if good else None, 1, 0.2 if good else 1.5, 9.0, good))
    q = spark.createDataFrame(rows, f"question_id int, split string, mode string, query string, profile string, relevant {none}")
    c = spark.createDataFrame(cands, "question_id int, rank int, path string, section_name string, heading_path array<string>, score double, dense_rank int, lexical_rank int, distance double, bm25 double, authority_match boolean")
    # dev holds no question to abstain on: one label only
    made = calibration.calibrate(q, c)
    assert made.metrics["dev"]["n"] == 40 and made.metrics["routing"]["heldout"]["n"] == 40
    assert made.metrics["heldout"]["context_pollution"] == pytest.approx(0 if made.metrics["heldout"]["injected"] == 20 else made.metrics["heldout"]["pollution"])
    both = calibration.calibrate(q.withColumn("split", F.when(F.col("question_id") % 8 < 4, "dev").otherwise("heldout")), c)
    assert both.certified and both.metrics["gate_passed"] and both.metrics["heldout"]["coverage"] == 1.0


def test_fit_matches_its_objective(spark):
    r = np.random.default_rng(3)
    x = r.random((60, 8))
    y = x[:, 0] + 0.3 * r.random(60) > 0.7
    df = spark.createDataFrame([(*map(float, row), bool(t)) for row, t in zip(x, y)], ", ".join(f"{f} double" for f in gate.FEATURES) + ", label boolean")
    w, b = gate.fit(df)
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / std
    theta = np.array([w[f] for f in gate.FEATURES]) * std
    bias = b + np.array([w[f] for f in gate.FEATURES]) @ mean
    cost = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    p = 1 / (1 + np.exp(-(z @ theta + bias)))
    # at the end the slope of loss and penalty is flat
    assert np.abs(z.T @ (cost * (p - y)) + 0.05 * theta).max() < 1e-3 and abs((cost * (p - y)).sum()) < 1e-3


def test_stratified_and_latest(spark):
    q = spark.createDataFrame([(f"q{i}", evaluation.CATEGORIES[i % 7], "dev" if i % 7 < 6 or i > 30 else "heldout") for i in range(40)], "question_id string, category string, split string")
    got = {r["category"]: r["problem"] for r in evaluation.stratification(q).collect()}
    assert got[None] == "too few questions" and got["no-answer"] == "no questions" and got["ambiguity"] is None and got["concept"] == "no held-out questions"
    d = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (1, 7, "a")], "k int, at int, v string")
    assert sorted(tuple(r) for r in evaluation.latest(d, ("k",), "at").select("k", "at", "v").collect()) == [(1, 7, "b"), (2, 1, "c")]
    one = spark.createDataFrame([("x", float(v)) for v in range(1, 41)] + [("y", 3.0)], "m string, v double")
    assert sorted(tuple(r) for r in evaluation.bench_latency(one, ("m",), "v").collect()) == [("x", 20.5, 38.0, 40), ("y", 3.0, 3.0, 1)]

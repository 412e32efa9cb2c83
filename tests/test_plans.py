import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, lexical
from tessera.plans import evaluation, gate, projection
from tessera.sources.vault import Projection, changes, needs_reembed, parse, reuse_chunks, scan, split_frontmatter
from tessera.streaming.watch import Watcher, bursts, may_start, relevant_events, watch


def test_metrics(spark):
    c = spark.createDataFrame([(1, k, p, "s", ["s"], d) for k, (p, d) in enumerate([("x", 1), ("x", 1), ("a", 2), ("b", 3)], 1)], "question_id int, rank int, path string, section_name string, heading_path array<string>, document_id int")
    rel = spark.createDataFrame([(1, "a", None), (1, "b", None)], "question_id int, path string, sections array<string>")
    q = spark.createDataFrame([(1,), (2,)], "question_id int")
    got = {r["question_id"]: r for r in evaluation.hit_metrics(q, c, rel).collect()}
    assert got[1]["reciprocal_rank"] == 0.5 and got[1]["recall_at_3"] == 1.0 and got[1]["hit_at_1"] == 0.0
    assert got[2]["ndcg_at_10"] == 0.0 and got[2]["recall_at_10"] == 0.0
    assert evaluation.duplicate_share(c).first()["duplicate_share"] == 0.5


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "elapsed_ms double")
    for m in ("hit_at_1", "hit_at_5", "recall_at_10", "reciprocal_rank", "ndcg_at_10"):
        df = df.withColumn(m, F.lit(1.0))
    r = evaluation.aggregate(df).first()
    assert (r["p50_ms"], r["p95_ms"]) == (25.0, pytest.approx(38.5))


def test_gate_fit_and_threshold(spark):
    data = [(i, *[float(i >= 10)] * 8, i >= 10) for i in range(20)]
    df = spark.createDataFrame(data, "query_id int, " + ", ".join(f"{f} double" for f in gate.FEATURES) + ", label boolean")
    w, b = gate.fit(df)
    out = gate.scored(df, w, b)
    cut = gate.threshold(out, 0.99).first()[0]
    r = gate.report(out.withColumn("abstain", F.lit(False)), cut).first()
    assert r["precision"] == 1.0 and r["injected"] == 10.0
    assert {x["reason"] for x in gate.decide(out, None).collect()} == {"no-gate"}


def test_changes_and_reuse(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], "path string, content_hash string, mtime_ns long")
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("d", "1", 1)], "path string, content_hash string, mtime_ns long")
    assert {tuple(r) for r in changes(old, new).collect()} == {("a", "skipped"), ("b", "updated"), ("c", "removed"), ("d", "added")}
    o = spark.createDataFrame([(1, 10, "x"), (1, 11, "x"), (1, 12, "y")], "document_id long, chunk_id long, input string")
    n = spark.createDataFrame([(1, 0, "x"), (1, 1, "z"), (1, 2, "x"), (1, 3, "x")], "document_id long, position int, input string")
    assert [r["chunk_id"] for r in reuse_chunks(o, n).orderBy("position").collect()] == [11, None, 10, None]


def test_frontmatter():
    assert split_frontmatter("---\ntitle: A\ntags: [x]\n---\nbody") == ({"title": "A", "tags": ["x"]}, "body")
    assert split_frontmatter("---\n: [bad\n---\nbody") == ({}, "body")
    assert split_frontmatter("plain") == ({}, "plain")


def test_scan_parse_project(spark, tmp_path):
    root = tmp_path / "v"
    for name, body in {"wiki/a.md": "---\ntitle: Alpha\ntags: [T1]\naliases: [al]\n---\n# H\n[[b]] #t2", "wiki/projects/r/b.md": "no title", ".git/x.md": "hidden", "wiki/c.txt": "not"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    docs = parse(scan(spark, str(root)))
    got = {r["path"]: r for r in docs.collect()}
    assert set(got) == {"wiki/a.md", "wiki/projects/r/b.md"}
    a = got["wiki/a.md"]
    assert (a["title"], a["tags"], a["wikilinks"], a["aliases"]) == ("Alpha", ["t1", "t2"], ["b"], ["al"])
    assert got["wiki/projects/r/b.md"]["title"] == "b" and got["wiki/projects/r/b.md"]["project_id"] == "r"
    p = Projection(spark, str(tmp_path / "proj"))
    p.write({"documents": docs}, {"model": "m"})
    first = p.manifest()
    p.write({"chunks": docs.select("path")})
    assert p.read("documents").count() == 2 and p.manifest()["tables"]["documents"] == first["tables"]["documents"]
    with pytest.raises(KeyError):
        p.read("absent")
    assert needs_reembed({"model": "a"}, {"model": "b"}, 1) and not needs_reembed({}, {"model": "b"}, 0)


def test_integrity(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, path string")
    c = spark.createDataFrame([(10, 1, 0), (11, 3, 0)], "chunk_id long, document_id long, position int")
    v = spark.createDataFrame([(10, [1.0, 2.0]), (99, [1.0])], "chunk_id long, embedding array<double>")
    link = spark.createDataFrame([(1, 7)], "source long, target long")
    r = projection.integrity(d, c, v, link, 2).first()
    assert (r["orphan_chunks"], r["documents_without_chunks"], r["chunks_without_vector"], r["orphan_vectors"], r["wrong_dimension"], r["dangling_links"], r["ok"]) == (1, 1, 1, 1, 1, 1, False)
    assert may_start(c, v) and not may_start(c, v, 0)


def _events(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, event_type string, path string, dest_path string, is_directory boolean")


def test_bursts(spark):
    t = dt.datetime(2026, 1, 1)
    s = dt.timedelta(seconds=1)
    ev = _events(spark, [(t, "modified", "a.md", None, False), (t + s, "moved", "b.md", "c.md", False), (t + 9 * s, "created", "d.md", None, False), (t, "opened", "x.md", None, False), (t, "created", "dir", None, True), (t, "modified", ".git/y.md", None, False)])
    got = bursts(relevant_events(ev)).orderBy("started").collect()
    assert [r["paths"] for r in got] == [["a.md", "b.md", "c.md"], ["d.md"]]


def test_watch_stream(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    ev = _events(spark, [(t, "modified", "a.md", None, False), (t + dt.timedelta(hours=1), "modified", "z.md", None, False)])
    # one file, so that no order of files makes the first event late
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = _events(spark, [(t + dt.timedelta(hours=3), "modified", "q.md", None, False)])
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = watch(stream, lambda df, i: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert "a.md" in seen


def test_watcher_states(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    for k, hour in enumerate((0, 1, 3)):
        _events(spark, [(t + dt.timedelta(hours=hour), "modified", f"{k}.md", None, False)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    p, seen = Projection(spark, str(tmp_path / "proj")), []
    w = Watcher(p, stream, lambda df, i: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "cp"))
    assert w.state == "idle" and w.start() == "refused" and w.reason == "no projection"
    p.write({"documents": spark.range(1)})
    assert w.start() == "refused" and "never filled" in w.reason
    one = spark.range(300).select(F.col("id").alias("chunk_id"))
    p.write({"chunks": one, "vectors": one.limit(10)})
    assert w.start() == "refused" and "lack vectors" in w.reason
    p.write({"vectors": one})
    assert w.start(once=True) == "running"
    w._query.awaitTermination(120)
    assert w.state == "stopped" and seen and w.status()["batches"] > 0 and w.stop() == "stopped"
    bad = Watcher(p, stream, lambda df, i: 1 / 0, str(tmp_path / "cp2"))
    bad.start(once=True)
    with pytest.raises(Exception):
        bad._query.awaitTermination(120)
    assert bad.state == "failed" and "ZeroDivision" in bad.reason, bad.reason


@pytest.mark.parametrize("name", ["bm25_search", "rrf_fuse"])
def test_searches_write_only_what_they_ask(spark, monkeypatch, tmp_path, name):
    """A batch's search writes what rows hold of its own tokens, not an index of all of them."""
    from tessera import catalog
    from tessera.sources import working

    (tmp_path / "in").symlink_to("/root/testdata/sf0.001")
    monkeypatch.setattr(working, "shared_folder", lambda spark: str(tmp_path / "shared"))
    assert catalog.queries()[name](spark, str(tmp_path / "in")).count() > 0
    written = sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*.parquet"))
    assert written < (tmp_path / "in/documents.parquet").stat().st_size / 2


def test_an_index_of_some_tokens(spark, tmp_path):
    """Of an index, written or not, a batch's phrases hold the postings of their own tokens in all rows."""
    df = spark.createDataFrame([(i, f"red fox {i}", "fox den " * (i % 3)) for i in range(20)], "id long, title string, text string")
    phrases = lexical.query_phrases(spark.createDataFrame([(0, "red-fox gone")], "query_id long, query string"))
    for index in (lexical.build_index(df, "id"), lexical.build_index(df, "id", path=str(tmp_path / "ix"))):
        held = index.held(phrases)
        assert {r["token"] for r in held.postings.collect()} == {"red", "fox"}
        assert held.of_cells(0).postings.count() == 13 and index.of_cells(0).held(phrases).postings.count() == 13
        said = lambda ix: {(r["id"], r["phrase"], r["f"]) for r in lexical.occurrences(ix, phrases).collect()}
        assert said(held) == said(index) and len(said(held)) == 20


def test_few_vectors_get_few_parts(spark):
    """The last shuffle holds k rows per query and part, so parts follow the rows, not the session's shuffle partitions."""
    v = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = dense.knn(v, q, 2)
        assert "[block#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "], 64" not in plan
        assert {(r["query_id"], r["id"]) for r in out.collect()} == {(0, 0), (0, 1), (100, 100), (100, 99), (200, 200), (200, 199)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_context_leaves_texts_where_they_are(spark, tmp_path):
    """Documents that no query found are left out before any shuffle of texts, however small a broadcast the planner would choose."""
    from tessera import catalog

    (tmp_path / "in").symlink_to("/root/testdata/sf0.001")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.queries()["context_block"](spark, str(tmp_path / "in"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin [document_id") >= 1 and "SortMergeJoin [document_id" in plan
        assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftSemi" in x]
        assert out.count() == len({r["query_id"] for r in out.collect()}) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

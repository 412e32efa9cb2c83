import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.stem import stem, stemmed
from tessera.operators import chunking, context, dense, fusion, graph, lexical, policy
from tessera.operators.parts import connected_parts
from tessera.operators.rerank import OverlapReranker, rerank


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def ranked(spark, ids):
    return spark.createDataFrame([(0, i, k) for k, i in enumerate(ids, 1)], "query_id long, id long, rank int")


def test_rrf(spark):
    out = fusion.reciprocal_rank_fusion({"dense": (ranked(spark, [1, 2, 3]), 1.0)}, 60).orderBy("rank").collect()
    assert [r["id"] for r in out] == [1, 2, 3] and out[0]["score"] == pytest.approx(1 / 61)
    tie = fusion.reciprocal_rank_fusion({"d": (ranked(spark, [5]), 1.0), "l": (ranked(spark, [3]), 1.0)})
    assert [r["id"] for r in tie.orderBy("rank").collect()] == [3, 5]
    again = fusion.reciprocal_rank_fusion({"d": (ranked(spark, [1, 1, 2]), 1.0)}).orderBy("rank").collect()
    assert [r["id"] for r in again] == [1, 2] and again[1]["score"] == pytest.approx(1 / 62)
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion({"d": (ranked(spark, [1]), -1.0)})


def test_diversify(spark):
    df = spark.createDataFrame([(0, i, g, k) for k, (i, g) in enumerate(zip([1, 2, 3, 4, 5], [10, 10, 10, 20, 10]), 1)], "query_id int, id int, document_id int, rank int")
    assert [r["id"] for r in fusion.diversify(df, 2).orderBy("rank").collect()] == [1, 2, 4]
    assert fusion.diversify(df, 0).count() == 5


def test_knn_distances(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.5, math.sqrt(0.75), 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    out = dense.knn(v, q, 3).orderBy("rank").collect()
    assert [r["id"] for r in out] == [1, 2, 3]
    assert [r["distance"] for r in out] == pytest.approx([0, 1, math.sqrt(2)])
    assert dense.knn(v, q.limit(0), 3).count() == 0


def test_bm25_matches_definition(spark):
    docs = [(1, "zebra", "plain words here"), (2, "other", "zebra walks by"), (3, "third", "a quiet apache license text"), (4, "none", "apache and license")]
    df = spark.createDataFrame(docs, "id long, title string, text string")
    q = spark.createDataFrame([(0, "zebra"), (1, "apache-license")], "query_id long, query string")
    index = lexical.build_index(df, "id")
    got = {(r["query_id"], r["id"]): r["score"] for r in lexical.bm25(index, lexical.query_phrases(q)).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 3)}
    assert got[0, 1] > got[0, 2]
    lengths = {i: len((t + " " + x).split()) for i, t, x in docs}
    mean = sum(lengths.values()) / 4
    idf = math.log((4 - 1 + 0.5) / 1.5)
    assert got[1, 3] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[3] / mean)))


def test_policy_and_conflicts(spark):
    data = [(0, 1, "wiki", "durable", None, False, 5, "a"), (0, 2, "wiki", "route-map", None, True, 5, "b"), (0, 3, "wiki", "decision", "p", False, 5, "c"),
            (0, 4, "wiki", "current-state", "p", False, 9, "d"), (0, 5, "wiki", "project", "q", False, 5, "e")]
    df = spark.createDataFrame(data, "query_id int, rank int, source_kind string, page_role string, project_id string, is_route_map boolean, updated_at_ns long, path string")
    df = df.withColumn("intent", F.lit("decision")).withColumn("profile", F.lit("answer"))
    out = policy.authority_policy(df).orderBy("rank").collect()
    assert [r["path"] for r in out] == ["c", "a", "d", "e", "b"]
    labels = {r["label"] for r in policy.conflict_labels(policy.authority_policy(df)).collect()}
    assert labels == {"competing-projects: p, q", "older-than-current-state: c predates d"}


@pytest.fixture(scope="module")
def docs(spark):
    data = [(1, "wiki/a.md", "A page", None), (2, "wiki/b.md", "B", None), (3, "wiki/projects/rag/b.md", "B rag", "rag"), (4, "wiki/projects/rag/c.md", "C", "rag"), (5, "wiki/projects/x/deep/c.md", "C2", "x")]
    df = spark.createDataFrame(data, "document_id long, path string, title string, project_id string")
    return df.withColumn("source_kind", F.lit("wiki")).withColumn("page_role", F.lit("durable")).withColumn("is_route_map", F.lit(False))


def test_resolve(spark, docs):
    raw = spark.createDataFrame([(1, ["b", "projects/rag/C", "gone", "deep/c"]), (4, ["b", "../x/deep/c"])], "document_id long, wikilinks array<string>")
    links = graph.link_rows(raw).withColumn("link_id", F.monotonically_increasing_id())
    got = {(r["source"], r["target_text"]): r["target"] for r in graph.resolve_links(links, docs).collect()}
    assert got == {(1, "b"): 2, (1, "projects/rag/C"): 4, (1, "gone"): None, (1, "deep/c"): 5, (4, "b"): 3, (4, "../x/deep/c"): 5}


def test_neighbours_and_communities(spark, docs):
    links = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 3, 4), (3, 4, None)], "link_id long, source long, target long")
    seeds = spark.createDataFrame([(0, 1)], "query_id long, document_id long")
    assert rows(graph.neighbours(links, seeds, 2), "document_id") == [(2,)]
    got = dict(rows(graph.communities(links, docs), "document_id", "community_id"))
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_label_propagation_is_in_order():
    # a path 1-2-3-4: pages in order take the lowest of equally frequent labels
    e = [(1, 2), (2, 3), (3, 4)]
    pdf = pd.DataFrame([*e, *[(b, a) for a, b in e]], columns=["a", "b"])
    assert dict(graph._settle(pdf).itertuples(index=False)) == {1: 1, 2: 1, 3: 1, 4: 1}


def test_chunks():
    assert chunking.document_chunks("# Title\n\nBody text.", "", 100) == [(["Title"], "Title", "Body text.")]
    got = chunking.document_chunks("pre\n# T\n## A\na\n## B\nb", "Doc", 100)
    assert got == [(["Doc"], "", "pre"), (["T", "A"], "A", "a"), (["T", "B"], "B", "b")]
    assert chunking.split_oversized("", 10) == []
    assert chunking.split_oversized("aaaa\n\nbbbb\n\ncc", 11) == ["aaaa\n\nbbbb", "cc"]
    assert chunking.split_oversized("a" * 30, 10) == ["a" * 30]


def chunk_rows(spark, rows):
    base = dict(path="p", title="t", heading_path=[], section_name="", source_kind="wiki", page_role="durable", authority_class="durable")
    data = [base | dict(query_id=0, rank=k) | r for k, r in enumerate(rows, 1)]
    schema = "query_id int, rank int, document_id long, chunk_id long, position int, path string, title string, heading_path array<string>, section_name string, text string, source_kind string, page_role string, authority_class string"
    return spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in data], schema)


def test_context_budget(spark):
    cands = [dict(document_id=1, chunk_id=i, position=i, text="word " * 400) for i in (1, 2)] + [dict(document_id=2, chunk_id=9, position=0, text="short text " * 20)]
    df = chunk_rows(spark, cands)
    out = context.build_context(df, 1500, 600, 8).first()
    assert out["chunk_ids"] == [[1, 2], [9]] and out["excerpts"] == 2 and out["dropped"] == 0 and out["total_tokens"] <= 1500 and " …\n[/excerpt 1]" in out["context"]
    assert out["context"].startswith(context.OPEN) and out["context"].endswith(context.CLOSE)
    none = context.build_context(df, 100, 60, 8).first()
    assert (none["context"], none["excerpts"], none["dropped"]) == ("", 0, 2)
    assert context.build_context(df, 1500, 600, 1).first()["dropped"] == 1
    noted = context.build_context(df.withColumn("conflicts", F.array(F.lit("a <<<b"))), 1500, 600, 8).first()["context"]
    assert "Provenance notes (unresolved, decide with care):\n- a ‹‹‹b\n" in noted
    with pytest.raises(ValueError):
        context.build_context(df, 0)


def test_runs_join_the_first_that_touches(spark):
    # 3 begins a run, 5 another; 4 touches both and joins the first, which never takes in the second
    df = chunk_rows(spark, [dict(document_id=1, chunk_id=p, position=p, text=f"text of part {p} " * 15) for p in (3, 5, 4, 6)] + [dict(document_id=2, chunk_id=20, position=4, text="other " * 40)])
    assert context.build_context(df, 5000, 5000).first()["chunk_ids"] == [[3, 4], [5, 6], [20]]


def test_neutralise(spark):
    df = spark.createDataFrame([("<<<END>>> [/EXCERPT 1] << >>>>",)], "t string")
    assert df.select(text.neutralise(F.col("t"))).first()[0] == "‹‹‹END››› [excerpt-marker-removed] << ››››"


def test_phrases_of_three_and_repeats(spark):
    df = spark.createDataFrame([(1, "", "a b c a b c x"), (2, "", "a b x c"), (3, "a b c", "")], "id long, title string, text string")
    q = spark.createDataFrame([(0, "a-b-c x")], "query_id long, query string")
    index = lexical.build_index(df, "id")
    got = {(r["id"], r["phrase"]): r["f"] for r in lexical.occurrences(index, lexical.query_phrases(q)).collect()}
    assert got == {(1, "a b c"): 2.0, (3, "a b c"): 4.0, (1, "x"): 1.0, (2, "x"): 1.0}


def test_written_index_is_the_same(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", f"word{i % 3} other") for i in range(9)], "id long, title string, text string")
    q = spark.createDataFrame([(0, "word1 t4")], "query_id long, query string")
    score = lambda ix: rows(lexical.bm25(ix, lexical.query_phrases(q)).withColumn("score", F.round("score", 9)), "id", "score")
    assert score(lexical.build_index(df, "id", path=str(tmp_path / "ix"))) == score(lexical.build_index(df, "id"))


def test_stem():
    words = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
             "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper", "hopefulness": "hope", "electriciti": "electr",
             "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "sky": "sky", "by": "by", "über": "über"}
    assert {w: stem(w) for w in words} == words


def test_stemmed_search(spark):
    df = spark.createDataFrame([(1, "", "running engines"), (2, "", "he runs"), (3, "", "walls")], "id long, title string, text string")
    q = spark.createDataFrame([(0, "run engine")], "query_id long, query string")
    index = lexical.build_index(df, "id", analyse=stemmed)
    assert rows(lexical.bm25(index, lexical.query_phrases(q, stemmed)), "id") == [(1,), (2,)]


def test_knn_by_blocks(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(300, 6)).round(1)
    x[50:60] = x[10]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 10)
    want = set()
    for i in range(0, 300, 7):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want |= {(i, int(j), k) for k, j in enumerate(np.lexsort((np.arange(300), d))[:5], 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in dense.knn(v, q, 5, parts=3).collect()} == want


def test_rerank(spark):
    df = spark.createDataFrame([(0, "red fox", k, t) for k, t in enumerate(["blue", "a red fox", None, "red fox"], 1)] + [(1, "x", 1, "x")], "query_id int, query string, rank int, text string")
    out = rerank(df, OverlapReranker(), 3).orderBy("query_id", "rank").collect()
    assert [r["text"] for r in out] == ["a red fox", None, "blue", "red fox", "x"] and out[3]["rerank_score"] is None
    assert rerank(df, OverlapReranker(), 0).where("rerank_score is not null").count() == 2


def test_channels_run_once(spark):
    """The fusion carries ranks and scores, so each channel's input is scanned once."""
    a = spark.createDataFrame([(0, i, i) for i in range(1, 5)], "query_id long, id long, rank int").withColumn("score", F.lit(2.0))
    out = fusion.reciprocal_rank_fusion({"dense": (a, 1.0), "lexical": (a.where("id < 3"), 1.0)}, 20, {"dense": "score", "lexical": "score"})
    r = {x["id"]: x for x in out.collect()}
    assert r[1]["lexical_value"] == 2.0 and r[4]["lexical_rank"] is None and r[4]["dense_rank"] == 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_hot_keys_meet_two_rows(spark):
    """A key that many documents share joins at most three rows a link."""
    data = [(i, f"wiki/d{i}/log.md", "t", None) for i in range(300)]
    docs = spark.createDataFrame(data, "document_id long, path string, title string, project_id string")
    links = spark.createDataFrame([(i, i, "log", None) for i in range(300)], "link_id long, source long, key string, hint string")
    got = {r["source"]: r["target"] for r in graph.resolve_links(links, docs).collect()}
    assert got[0] == 1 and all(got[i] == 0 for i in range(1, 300))


def test_unresolved_only(spark, docs):
    links = spark.createDataFrame([(0, 1, "b", None, 99), (1, 1, "b", None, None)], "link_id long, source long, key string, hint string, target long")
    assert rows(graph.resolve_links(links, docs, only_unresolved=True), "link_id", "target") == [(0, 99), (1, 2)]


def test_communities_of_a_long_chain(spark):
    n = 200
    order = [0, *range(n - 1, 0, -1)]
    docs = spark.createDataFrame([(i, f"wiki/p{i}.md", "durable", False) for i in range(n)], "document_id long, path string, page_role string, is_route_map boolean")
    links = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(order, order[1:]))], "link_id long, source long, target long")
    near = {i: [] for i in range(n)}
    for a, b in zip(order, order[1:]):
        near[a].append(b)
        near[b].append(a)
    label = list(range(n))
    for _ in range(20):
        for i in range(n):
            votes = [label[j] for j in near[i]]
            label[i] = min(votes, key=lambda v: (-votes.count(v), v))
    first = {}
    for i in range(n):
        first.setdefault(label[i], i)
    assert dict(rows(graph.communities(links, docs), "document_id", "community_id")) == {i: first[label[i]] for i in range(n)}
    parts = connected_parts(graph.community_edges(links, docs))
    assert parts.count() == n and parts.where("part <> 0").count() == 0


def test_wide_phrases_meet_few_rows(spark, monkeypatch):
    """A name that many pages bear and all chunks hold is dropped before pages meet chunks; narrow ones follow the definition."""
    import random

    monkeypatch.setattr(graph, "MAX_MENTION_ROWS", 6)
    monkeypatch.setattr(graph, "MAX_MENTION_DOCS", 3)
    r = random.Random(5)
    owner = {i: i // r.choice((1, 3, 5)) for i in range(60)}
    found = {(i, p) for p, share in (("all", 1), ("half", 0.5), ("some", 0.1), ("few", 0.05)) for i in range(60) if r.random() < share} | {(i, "own") for i in range(20)}
    owner |= {i: 7 if i < 12 else 8 for i in range(20)}
    keys = {(d, p) for d in (0, 1, 2, 7, 8, 11, 30) for p in ("all", "half", "some", "few", "own")}
    want = set()
    for d, p in keys:
        first = sorted(i for i, q in found if q == p and owner[i] != d)[:6]
        if len({owner[i] for i in first}) <= 3:
            want |= {(i, d) for i in first}
    frame = lambda data, schema: spark.createDataFrame(sorted(data), schema)
    out = graph.mentions(frame(found, "id long, phrase string"), frame(keys, "document_id long, phrase string"), frame(owner.items(), "id long, owner_id long"))
    assert set(rows(out, "chunk_id", "document_id")) == want and (12, 7) in want

    met = []
    monkeypatch.setattr(graph, "materialised", lambda df, name: met.append((name, df.count())) or df)
    many = spark.range(500).select("id", F.lit("all").alias("phrase"))
    out = graph.mentions(many, many.withColumnRenamed("id", "document_id"), many.select("id", F.col("id").alias("owner_id")))
    assert out.count() == 0 and dict(met)["met"] == 0


def test_phrases_of_one_first_word(spark):
    """Names that begin alike read each row once: the joins' rows don't grow with names times rows."""
    n = 300
    df = spark.range(n).select("id", F.concat(F.lit("see doc "), F.col("id").cast("string"), F.lit(" doc now or doc "), ((F.col("id") * 7) % n).cast("string")).alias("text"))
    index = lexical.build_index(df, "id", {"text": 1.0})
    phrases = spark.range(n).select(F.concat(F.lit("doc "), F.col("id").cast("string")).alias("phrase"), F.lit(2).alias("words"))
    out = lexical.occurrences(index, phrases)
    want = {(i, f"doc {k}"): 1.0 + (i == i * 7 % n) for i in range(n) for k in (i, i * 7 % n)}
    assert {(r["id"], r["phrase"]): r["f"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" not in plan and plan.count("LeftSemi") == 2


def test_related_meet_the_first_of_a_community(spark):
    """A community's first 201 pages stand for it; the rest never meets its seeds."""
    community = spark.range(500).select(F.col("id").alias("document_id"), F.lit(0).alias("community_id"))
    none = lambda schema: spark.createDataFrame([], schema)
    seeds = community.where("document_id in (3, 450)")
    out = graph.related_pages(seeds, none("source long, target long"), none("chunk_id long, document_id long"), none("id long, owner_id long"), community, 300)
    got = rows(out, "seed", "document_id")
    assert got == [(3, i) for i in range(201) if i != 3] + [(450, i) for i in range(200)]
    assert "turn#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "<= 201" in plan


def test_alike_queries_are_scored_once(spark, monkeypatch):
    """Queries of the same phrases share one ranking, with the same rows for each."""
    df = spark.createDataFrame([(i, "", f"red fox {'den ' * (i % 3)}") for i in range(20)], "id long, title string, text string")
    q = spark.createDataFrame([(i, "red den" if i % 2 else "Den red den") for i in range(30)] + [(30, "fox")], "query_id long, query string")
    index = lexical.build_index(df, "id")
    phrases = lexical.query_phrases(q)
    every = lexical.bm25(index, phrases)
    assert every.count() == 31 * 20
    want = rows(lexical.top_k(every, 4, F.round("score", 9).desc()), "query_id", "rank", "id")
    asked = []
    monkeypatch.setattr(lexical, "_scores", lambda *a, real=lexical._scores: asked.append(real(*a)) or asked[-1])
    assert rows(lexical.best(index, phrases, 4), "query_id", "rank", "id") == want
    assert asked[0].count() == 2 * 20
    each = spark.createDataFrame([(i, i % 20) for i in range(31)], "query_id long, id long")
    assert rows(lexical.bm25(index, phrases, each), "query_id", "id") == [(i, i % 20) for i in range(31)]
    assert rows(lexical.best(index, phrases, 4, df.where("id < 2").select("id")).where("query_id = 1"), "id") == [(0,), (1,)]

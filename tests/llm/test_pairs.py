import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import cover_tree, minhash, toxicity
from tessera.llm.common import connected_components
from tessera.llm.url_filter import RULES, judge_urls, rule_table

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def expected(rows, k):
    sets = [(i, shingles(t, k)) for i, t, _ in rows]
    known = [(i, s) for i, s in sets if i is not None and s]
    edges = [(a, b) for n, (a, s) in enumerate(known) for b, t in known[:n] if a == b or 100 * len(s & t) >= 80 * len(s | t)]
    comp = components({i for i, _ in known}, edges)
    return Counter((i, len(s), comp[i] if i is not None and s else i, (comp[i] if i is not None and s else i) == i) for i, s in sets)


@pytest.mark.parametrize("block", [1024, 3])
def test_minhash_matches_brute_force(monkeypatch, docs, rows, block):
    monkeypatch.setattr(minhash, "cross_blocks", functools.partial(minhash.cross_blocks, block=block))
    got = Counter(tuple(r) for r in minhash.minhash_components(docs, shingle=4).collect())
    assert got == expected(rows, 4)
    assert sum(1 for r in got if r[0] is not None and 40 <= r[0] < 60 and r[2] == 40) >= 15


def test_minhash_empty(docs):
    assert minhash.minhash_components(docs.limit(0)).count() == 0


def test_least_matches_keep_pairs_at_the_threshold():
    least = minhash.least_matches(0.8, 160)
    r = np.random.default_rng(1)
    matches = np.cumsum(r.random((20_000, 160)) < 0.8, axis=1)[:, 31::32]
    assert (matches >= np.array(least)).all(axis=1).mean() > 0.999
    low = np.cumsum(r.random((20_000, 160)) < 0.3, axis=1)[:, 31::32]
    assert (low >= np.array(least)).all(axis=1).mean() < 0.001


def vectors():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(300 + i, (x[i % 7] + r.normal(size=16) * 0.12).tolist()) for i in range(120)]
    out += [(500, out[5][1]), (501, [2 * v for v in out[5][1]]), (502, out[5][1]), (503, None), (504, []), (505, [0.0] * 16), (506, [1.0, None] + [0.0] * 14)]
    out += [(507, [float("nan")] * 16), (508, [float("inf")] + [0.0] * 15), (509, [1.0, 2.0]), (510, [2.0, 4.0]), (None, out[5][1]), (511, [1e300] * 16), (512, [1e-300] * 16)]
    return out


@pytest.mark.parametrize("block", [8 << 20, 2560])
def test_cover_tree_matches_brute_force(monkeypatch, spark, block):
    monkeypatch.setattr(cover_tree, "BLOCK_BYTES", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("hash", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    unit = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0:
            x = np.array(v) / np.abs(v).max()
            unit[i] = x / np.linalg.norm(x)
    edges = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95]
    comp, links = components(unit, edges), Counter(x for e in edges for x in e)
    want = Counter((i, links[i], comp.get(i, i), comp.get(i, i) == i) for i, _ in rows)
    assert Counter(tuple(r) for r in cover_tree.cosine_components(df).collect()) == want
    assert cover_tree.cosine_components(df.limit(0)).count() == 0


def test_repeated_ids_share_links(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(5, a), (5, b), (6, near(a)), (7, near(b)), (8, [0.0, 0.0, 1.0]), (8, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("node", "copies", "first", "more", "leaf", "block", "unit")})
    got = Counter(tuple(r) for r in cover_tree.cosine_components(df).collect())
    assert got == Counter([(5, 2, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 1, 8, True), (8, 1, 8, True)])


def clustered(r, clusters, each, width, spread):
    x = np.repeat(r.normal(size=(clusters, width)), each, axis=0) + r.normal(size=(clusters * each, width)) * spread
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("clusters, each, width, spread", [(12, 40, 8, 0.05), (40, 30, 32, 0.2), (300, 1, 16, 1.0), (3, 200, 4, 0.6), (1, 300, 64, 0.02)])
@pytest.mark.parametrize("chunk", [1 << 22, 6400])
def test_dual_traversal_keeps_all(monkeypatch, clusters, each, width, spread, chunk):
    monkeypatch.setattr(cover_tree, "CHUNK", chunk)
    monkeypatch.setattr(cover_tree, "DENSE", 50)
    x = np.random.default_rng(5).permutation(clustered(np.random.default_rng(6), clusters, each, width, spread))
    w = np.arange(1, len(x) + 1)
    half = len(x) // 2
    a, b, whole = cover_tree.CoverTree(x[:half]), cover_tree.CoverTree(x[half:]), cover_tree.CoverTree(x)
    for k, radius in enumerate(cover_tree.RADII, 1):
        assert whole.radius[k].max() <= radius + 1e-3
        assert set(whole.starts[k - 1]) <= set(whole.starts[k])
    for s, t, left, right in ((a, b, x[:half], x[half:]), (whole, whole, x, x)):
        u, v = w[: len(left)][s.order], w[-len(right) :][t.order]
        out = cover_tree.dual_links(s, t, 0.95, u, v)
        yes = s.x @ t.x.T >= 0.95
        if s is t:
            np.fill_diagonal(yes, False)
            gain, edges = yes @ v, np.argwhere(yes)
        else:
            gain, edges = np.concatenate([yes @ v, yes.T @ u]), np.argwhere(yes) + [0, len(s.x)]
        rows, got, label = out.result()
        assert set(rows.tolist()) == set(np.flatnonzero(gain).tolist()) and (got == gain[rows]).all()
        comp = components(range(len(gain)), edges.tolist())
        assert {i: c for i, c in zip(rows.tolist(), label.tolist(), strict=True)} == {i: comp[i] for i in rows.tolist()}


def test_dual_traversal_prunes():
    x = clustered(np.random.default_rng(7), 60, 40, 32, 0.05)
    a, b = cover_tree.CoverTree(x[::2]), cover_tree.CoverTree(x[1::2])
    out = cover_tree.dual_links(a, b, 0.95, np.ones(len(a.x), int), np.ones(len(b.x), int))
    assert out.compared < len(a.x) * len(b.x) / 20
    assert (np.cumsum(out.gain)[:-1] == 20).all()


def test_components_of_a_long_chain(spark):
    ids = np.random.default_rng(2).permutation(2000).tolist()
    edges = list(zip(ids, ids[1:]))
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    got = connected_components(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert got.where("component <> 0").count() == 0 and got.count() == 2000


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(50, 45), (45, 50), (50, 55), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r[0]: r[1] for r in connected_components(nodes, df).collect()}
    assert got == components(range(60), edges)
    assert connected_components(nodes, df.limit(0)).where("node <> component").count() == 0


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut].translate(UP), rest[cut:]
    path = tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *rule


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://example.com/en/8", "x://com/en/", "x://xcom/en/", "http://example.net/de/8#a", "http://sub.net/de/", "http://a.org/es", "http://a.org/es/é", None, "", "no scheme/en/", "://com/en/1", "a://b://c.com/en/", "http://com?/en/", "http://a..com/en/\n7", "http://com:80/en/", "https://example.com/en/7" + "x" * 5000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[0]), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "digest", "prefix", "html")})
    got = Counter(tuple(r) for r in judge_urls(df, rule_table(spark)).collect())
    assert got == Counter((i, u, *judged(u)) for i, u in rows)
    assert judge_urls(df.limit(0), rule_table(spark)).count() == 0
    assert judge_urls(df, rule_table(spark, [])).where("verdict <> 'allow'").count() == 0


def plain_logit(p, words):
    """The definition, by loops: rows of each word, both directions, attention, the highest window."""
    sig = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
    H = toxicity.HIDDEN

    def word_input(w):
        c = toxicity.code(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        return p["words"][c.word_rows[0]] + sum(p["grams"][g] for g in c.gram_rows) / len(c.gram_rows)

    def states(xs, name):
        h, out = [0.0] * H, []
        for x in xs:
            g, a = x @ p["w" + name] + p["b" + name], np.array(h) @ p["u" + name]
            z, q = [sig(g[k] + a[k]) for k in range(H)], [sig(g[H + k] + a[H + k]) for k in range(H)]
            cand = [math.tanh(g[2 * H + k] + q[k] * a[2 * H + k]) for k in range(H)]
            h = [cand[k] + z[k] * (h[k] - cand[k]) for k in range(H)]
            out.append(h)
        return out

    best = -math.inf
    at = 0
    while True:
        xs = [word_input(w) for w in words[at : at + toxicity.WINDOW]]
        both = [f + b for f, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        e = [math.exp(float(np.dot(h, p["att"]))) for h in both]
        pooled = sum(np.array(h) * w for h, w in zip(both, e, strict=True)) / sum(e)
        best = max(best, float(pooled @ p["out"] + p["bias"][0]))
        if at + toxicity.WINDOW >= len(words):
            return best
        at += toxicity.STRIDE


def test_toxicity_matches_plain_loops(docs, rows):
    p = toxicity.new_params(3)
    texts = ["Some words, SOME repeated; naïve 12x a", "one", " ".join(f"w{i % 37}x{i % 5}" for i in range(131)), "", "?!", rows[2][1]]
    got = np.concatenate([toxicity.text_logits(p, c) for _, c in toxicity.coded_texts(pa.array(texts, pa.large_string()))])
    for text, logit in zip(texts, got.tolist(), strict=True):
        words = re.findall(r"[0-9a-z\u0080-\uffff]+", text.lower())
        assert logit == pytest.approx(plain_logit(p, words) if words else -20, abs=1e-4)


def test_long_texts_train(monkeypatch):
    """A text longer than a batch's windows gets gradients: its toxic word is at the far end."""
    r = np.random.default_rng(0)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(r.choice(words, 900)) + (" vile nasty brute" if i % 2 else " calm sunny field") for i in range(40)]
    monkeypatch.setattr(toxicity, "BATCH_WINDOWS", 30)
    p = toxicity.train(texts, np.arange(40) % 2, steps=60, start_at_labels=False)
    logits = np.concatenate([toxicity.text_logits(p, c) for _, c in toxicity.coded_texts(pa.array(texts, pa.large_string()))])
    assert logits[1::2].min() > logits[::2].max()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    pairs = [(out[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_toxicity_edges(spark, docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, none).collect()
    assert len(out) == docs.count() and not any(r["predicted"] for r in out)
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_toxicity_of_odd_rows(spark):
    """Very long texts, ties, repeated rows, labels with nulls and with other columns."""
    clean, vile = "the calm sunny field lies open " * 4, "you vile nasty brute go away " * 4
    rows = [(i, vile if i % 2 else clean) for i in range(60)] + [(100, clean * 4000), (101, clean * 2000 + vile + clean * 2000), (102, None), (103, ""), (None, vile), (7, vile), (104, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("toxic", "score", "held_out", "predicted", "upto")})
    labels = spark.createDataFrame([(i, i % 2, "e") for i in range(60)] + [(3, 0, "e"), (None, 1, "e"), (5, None, "e"), (999, 1, "e")], "doc_id long, toxic int, text string")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["predicted"] for r in out}
    assert by[100] == 0 and by[101] == 1 and by[102] == by[103] == 0 and by[None] == 1
    assert len({r["score"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 2}) == 1


def test_gradients():
    """Analytic gradients agree with differences."""
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(1).items()}
    r = np.random.default_rng(0)
    x = r.normal(size=(9, toxicity.WIDTH))
    idx, mask = r.integers(0, 9, (toxicity.WINDOW, 3)), np.arange(toxicity.WINDOW)[:, None] < np.array([5, 48, 20])
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.logaddexp(0, (1 - 2 * y) * toxicity.forward(p, x, idx, mask)[0]).sum())
    logit, state = toxicity.forward(p, x, idx, mask, keep=True)
    grads, dx = toxicity.backward(p, x, idx, mask, state, toxicity._sigmoid(logit) - y)
    for name in ("wf", "ub", "att", "out", "bf"):
        at = tuple(r.integers(0, n) for n in p[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-3
        up = loss()
        p[name][at] = old - 1e-3
        down = loss()
        p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "minhash near-dedup", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    unique = stage["exact dedup"](spark, plain, str(tmp_path))
    assert unique.columns == plain.columns
    assert {60, 61} & {r["doc_id"] for r in unique.collect()} == set()
    near = stage["minhash near-dedup"](spark, unique, str(tmp_path))
    kept = {r["doc_id"] for r in near.collect()}
    assert 40 in kept and len(kept & set(range(40, 60))) <= 3
    mixed = stage["mixing"](spark, near, str(tmp_path))
    assert mixed.columns == plain.columns
    assert max(Counter((r["doc_id"], r["text"]) for r in mixed.where("doc_id is not null and doc_id <> 68").collect()).values()) <= 3
    toxic = stage["toxicity"](spark, plain, str(tmp_path))
    assert toxic.columns == plain.columns and toxic.where("doc_id is null").count() == 2
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0

import numpy as np
import public_tokenizers
import pyarrow as pa

from tessera.llm import packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def naive(docs, idf, mean, seed):
    """Scores of all documents by all of the seed's terms."""
    out = np.zeros(len(docs))
    for i, ids in enumerate(docs):
        for t in set(docs[seed].tolist()) & set(ids.tolist()):
            c = (ids == t).sum()
            out[i] += idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ids) / mean))
    return out


def test_every_term_of_whole_documents_queries():
    r = np.random.default_rng(1)
    docs = [r.choice(300, n).astype(np.uint16) for n in r.integers(5, 120, 40)]
    docs += [np.append(np.arange(400, 440), 600).astype(np.uint16), np.array([600, 601, 602], np.uint16)]
    # its term 700 isn't in the 3 ids that remain to be placed
    docs += [np.append(np.full(1024, 700), [801, 802, 803]).astype(np.uint16), np.array([700, 900], np.uint16)]
    docs += [np.full(1024, 600, np.uint16)]
    sizes = [len(d) % 1024 for d in docs]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000)
    idf, mean = np.log1p((len(docs) - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    shard = packing.Shard(docs, sizes, idf, mean)
    for seed in range(len(docs) - 1):
        unused = np.array(sizes) > 0
        unused[seed] = False
        want = naive(docs, idf, mean, seed) * unused
        got = shard.neighbours(seed, unused)
        assert set(got.tolist()) == set(np.flatnonzero(want).tolist())
        assert np.allclose(want[got], np.sort(want[want > 0])[::-1], rtol=1e-4)
    assert 41 in shard.neighbours(40, np.array(sizes) > 0) and 43 in shard.neighbours(42, np.array(sizes) > 0)


def test_shards_follow_content():
    r = np.random.default_rng(2)
    topic = np.repeat(np.arange(8), 100)
    docs = [(r.choice(50, 60) + 50 * t).astype(np.uint16) for t in topic] + [np.full(30, 7, np.uint16)] * 400
    idf = np.ones(400)
    x = packing.content_vectors(pa.array([d.tobytes() for d in docs]), "<u2", packing.sketch_of(idf))
    tree = packing.ContentTree(x, 12)
    got = tree.shards(x, r.integers(-(2**62), 2**62, len(docs)))
    own = [np.bincount(got[:800][topic == t]).max() for t in range(8)]
    # dealt by a hash, some 15 of a topic would be together
    assert np.mean(own) > 50
    # equal documents fill several shards, none by far too large
    assert len(set(got[800:].tolist())) > 1 and np.bincount(got).max() <= 300


def test_packing_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    words = [[a + b for a in "bcdfg" for b in x] for x in (("ara", "ori", "umi"), ("esk", "int", "olt"), ("yx", "ew", "oo"))]
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(words[i % 3], 200))) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack_documents(docs, BYTES).toPandas()
    assert (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all()
    topics = out[out["length"] >= 32].groupby("sequence_id")["doc_id"].apply(lambda d: len(set(d % 3)))
    assert topics.mean() < 1.3

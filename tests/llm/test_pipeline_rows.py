import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.mixing import mix_sources
from tessera.llm.toxicity import score_toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
BLANK = r"[\x20\x09-\x0D]+"


def first_of_groups(rows, linked):
    """Of each group of rows (id, text), transitively linked, the one with the smallest id, nulls last."""
    home = list(range(len(rows)))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                home[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    return [rows[min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))] for g in groups.values()]


def exact(rows):
    norm = [re.sub(BLANK, " ", r[1] or "") for r in rows]
    return first_of_groups(rows, lambda i, j: norm[i] == norm[j])


def near(rows):
    sets = []
    for _, text, *_ in rows:
        w = [x for x in re.split(BLANK, (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    return first_of_groups(rows, lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0)


def bag(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_every_row_follows_its_own_decision(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    # beside the fixture's repeated ids: null ids with copies, whole repeated rows and copies that share ids
    more = [(None, rows[5][1], "s1"), (None, "no id here at all", "s1"), (7, rows[8][1], "s0"), (8, "clean and alone under an id of others", "s1")]
    frame = spark.createDataFrame(rows + more, "doc_id long, text string, source string").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    at, stage, frame = str(tmp_path), dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    every = [tuple(r) for r in frame.collect()]

    bad = {r["text"] or "" for r in score_toxicity(frame.select("*", F.monotonically_increasing_id().alias("k")), labels, row_col="k")
           .where("predicted = 1").join(frame.select(F.monotonically_increasing_id().alias("k"), "text"), "k").collect()}
    kept = [r for r in every if (r[1] or "") not in bad]
    assert bag(stage["toxicity"](spark, frame, at)) == Counter(kept)
    small = spark.createDataFrame(every, frame.schema).repartition(3)
    out = stage["exact dedup"](spark, small, at)
    assert bag(out) == Counter(exact(every)) and out.columns == frame.columns
    assert (67, rows[67][1], "s9") in bag(out)
    assert bag(stage["minhash near-dedup"](spark, small, at)) == Counter(near(every))

    left = near(exact(kept))
    times = [r["times"] for r in mix_sources(spark.createDataFrame(left, frame.schema)).collect()]
    size = {t: len(Tokenizer.from_file(BYTES).encode(t or "", add_special_tokens=False).ids) + 1 for t in {r[1] for r in left}}
    mixed = bag(stage["mixing"](spark, spark.createDataFrame(left, frame.schema), at))
    assert set(mixed) <= set(left) and sum(mixed.values()) == sum(times)
    want = Counter()
    for (i, text, _), n in mixed.items():
        want[i] += n * size[text]
    got = Counter()
    for r in corpus_pipeline.run(spark, at).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want

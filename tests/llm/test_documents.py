import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.edit_counts import CountTree, edited_counts, leaves_of, planned
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.line_dedup import drop_templates
from tessera.llm.mixing import fit_counts, mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.token_files import read_token_files, token_digests, write_token_files
from tessera.llm.tokens import encoder

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_is_exact():
    texts = ["", "  ", "a  b", " a", "a ", "\n x", "a\n\nb", "it's I'LL", "x<|endoftext|>y", "naïve Straße ªb", "日本語 text", "12,345.6", "\t", "½ ²³", " \n x  ", "a\u00a0b c", "\u00a0", "a \u2028 b", "don't 'tis o'clock '' it's", "_a_ __ a_b1c22", "x\x1cy \x85 z", "É É e\u0301 ÀÉ×÷ß ÿ", "<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>\n", "İstanbul ΣΑΣ ǅ", "a\r\n\r\nb", "...--- 1a2 3.4", "word.\nWord", "'s 't", "A" * 300, "x" * 70 + "!!"]
    for path in (BYTES, WORDS):
        e, t = encoder(path), Tokenizer.from_file(path)
        import pyarrow as pa

        for at, ids, bounds in e.slices(pa.array([*texts, None])):
            for i in range(len(bounds) - 1):
                want = t.encode(([*texts, ""])[at + i], add_special_tokens=False).ids
                assert ids[bounds[i] : bounds[i + 1]].tolist() == want


def test_encoder_is_exact_on_random_texts():
    import random

    import pyarrow as pa

    r = random.Random(5)
    bits = list("aBzÀé×÷ñ09'._-<|> \n\t\r\x0b\x1f") + ["  ", "'s", "ll", "\u00a0", "日", "e\u0301", "<|endoftext|>", "İ", "½", " the", "Wörter", "12"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    for path in (BYTES, WORDS):
        e, t = encoder(path), Tokenizer.from_file(path)
        for at, ids, bounds in e.slices(pa.array(texts)):
            for i in range(len(bounds) - 1):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == t.encode(texts[at + i], add_special_tokens=False).ids, repr(texts[at + i])


def test_packing(docs, rows):
    out = [r.asDict() for r in pack_documents(docs, BYTES).collect()]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or at & (at - 1) == 0
    want = Counter()
    for i, text, _ in rows:
        ids = ids_of(BYTES, text, 0)
        want[i] += len(ids)
        cover = [0] * len(ids)
        for p in by_doc[i]:
            if p["doc_tokens"] == len(ids) and crc(ids[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"]:
                for k in range(p["start"], p["start"] + p["length"]):
                    cover[k] += 1
        assert min(cover) >= 1
    assert {k: sum(p["length"] for p in v) for k, v in by_doc.items()} == dict(want)
    assert pack_documents(docs.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, rows, tmp_path, encoding):
    out = sorted((r for r in token_digests(docs, WORDS, encoding=encoding).collect()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter((i, len(x), crc(x)) for i, x in ((i, ids_of(WORDS, t, 2)) for i, t, _ in rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    write_token_files(docs, str(tmp_path / "t"), WORDS, files=3, encoding=encoding)
    some = read_token_files(spark, str(tmp_path / "t")).where("doc_id = 65").first()
    assert some["ids"] == ids_of(WORDS, "One", 2)
    write_token_files(docs.limit(0), str(tmp_path / "e"), WORDS)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_exact_dedup(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    groups = defaultdict(list)
    for (i, _, _), n in zip(rows, norm, strict=True):
        groups[n].append(i)
    want = Counter()
    for (i, _, _), n in zip(rows, norm, strict=True):
        known = [x for x in groups[n] if x is not None]
        keep = min(known) if known else None
        want[i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup(docs).collect()) == want
    assert exact_dedup(docs.limit(0)).count() == 0


def test_line_templates(spark):
    texts = [f"own line {chr(97 + i)}{chr(98 + i)} of text\nPosted by user{i} at 10:{i:02d} from the main desk\n\nend {chr(97 + i) * 3}" for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, texts[0]), (100, None), (101, ""), (None, texts[1]), (102, "Posted by anna at noon from the main desk"), (103, "Posted by ida")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaf", F.lit(1)).withColumn("own", F.lit(2))
    got = {(r["doc_id"], r["kept_text"]): r for r in drop_templates(df).collect()}
    assert len(drop_templates(df).collect()) == len(rows)
    for i, t in enumerate(texts):
        lines = t.split("\n")
        r = got[i, "\n".join([lines[0], lines[2], lines[3]])]
        assert (r["n_lines"], r["n_dropped"]) == (4, 1)
    assert got[103, "Posted by ida"]["n_dropped"] == 0 and got[100, ""]["n_lines"] == 1
    # copies of one text don't make its lines recur
    same = spark.createDataFrame([(i, "one line only here\nand another one") for i in range(30)], "doc_id long, text string")
    assert drop_templates(same).where("n_dropped > 0").count() == 0
    assert drop_templates(df.limit(0)).count() == 0


def brute_templates(rows):
    """doc_id, kept text of each row by the definition of drop_templates, for distinct ids."""
    import re

    def masked(line):
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
        return re.sub(r"[^\x20]*[0-9][^\x20]*", "<*>", plain)

    need = lambda n: 2 if n >= 50 else 10
    leaf_of = lambda m: (len(m.split(" ")), tuple(m.split(" ")[:3]))
    lines = [(i, t or "", k, masked(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    leaves = defaultdict(lambda: defaultdict(set))
    for _, t, _, m in lines:
        if m:
            leaves[leaf_of(m)][m].add(t)
    template = {}
    for leaf, members in leaves.items():
        if len(set().union(*members.values())) >= need(leaf[0]):
            left = dict(members)
            for k in range(2):
                votes = [Counter() for _ in range(leaf[0])]
                for m, held in left.items():
                    for at, token in enumerate(m.split(" ")):
                        votes[at][token] += len(held)
                modal = [max(v, key=lambda x: (v[x], x.encode())) if v else "" for v in votes]
                new = [m for m in left if sum(a == b for a, b in zip(m.split(" "), modal)) / leaf[0] >= 0.7]
                template |= {m: (leaf, k) for m in new}
                left = {m: h for m, h in left.items() if m not in new}
    held, first = defaultdict(set), {}
    for i, t, _, m in lines:
        if m:
            key = template.get(m, m)
            held[key].add(t)
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            m = masked(x)
            key = template.get(m, m)
            gone = m and (len(held[key]) >= 10 or (len(held[key]) >= need(leaf_of(m)[0]) and i != first.get(key)))
            if not gone:
                kept.append(x)
        out.append((i, "\n".join(kept)))
    return Counter(out)


def test_line_templates_match_brute_force(spark):
    import random

    r = random.Random(9)
    words = "ka lo mi tu ran sel dor eth is ul".split()
    passage = " ".join(r.choice(words) for _ in range(60))
    edited = passage.replace("ka", "ko", 2)
    rows = [(i, "\n".join(" ".join(r.choice(words) for _ in range(r.randint(3, 7))) for _ in range(r.randint(1, 8)))) for i in range(60)]
    # a passage in three documents, one of them with edits, one far down a long text; one in a single document
    rows += [(200, "a b\n" + passage), (190, "c d\n" + edited + "\nend"), (201, "\n".join(f"l{chr(97 + i % 26)} {chr(97 + i // 26 % 26)} x" for i in range(4000)) + "\n" + passage)]
    rows += [(202, " ".join(r.choice(words) for _ in range(70))), (203, "x" * 30_000 + " 1 " + "y " * 20_000)]
    # two templates of one leaf, whose fields hold no digit
    rows += [(300 + i, f"see also page {'abcdefghijkl'[i] * 3} of the old printed book now") for i in range(12)]
    rows += [(320 + i, f"see also page {'abcdefghijkl'[i] * 2} in some new online shop today") for i in range(12)]
    rows += [(340 + i, "tie one two\ntie two one") for i in range(4)] + [(350, None), (351, ""), (None, "n u l l\n" + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "own", "first", "gone", "line", "texts", "common")})
    out = drop_templates(df.repartition(3)).collect()
    assert Counter((r["doc_id"], r["kept_text"]) for r in out) == brute_templates(rows)
    kept = {r["doc_id"]: r["kept_text"] for r in out}
    assert kept[200] == "a b" and edited in kept[190] and passage not in kept[201] and passage not in kept[None]
    assert all(kept[i] == "" for i in [*range(300, 312), *range(320, 332)]) and kept[202]


def test_line_templates_by_shuffle(spark, monkeypatch):
    """Beyond the broadcast's limit the results are the same."""
    from tessera.llm import line_dedup

    rows = [(i, f"note {chr(97 + i)}\nshared line of all texts\n" + "w " * 55 + chr(97 + i // 2)) for i in range(14)] + [(3, "note d\nother row of that id"), (3, "note d\nother row of that id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(tuple(r) for r in drop_templates(df).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert Counter(tuple(r) for r in drop_templates(df).collect()) == want


def brute_heads(rows):
    """doc_id, kept text of each row by the definition of drop_templates with `rest`, for distinct ids and lines as they are compared."""
    need = lambda n: 2 if n >= 50 else 10
    leaves = defaultdict(lambda: defaultdict(set))
    for _, t in rows:
        for m in (x.split(" ") for x in t.split("\n")):
            leaves[len(m), *m[:3]][" ".join(m)].add(t)
    key = {}
    for leaf, left in leaves.items():
        if len(set().union(*left.values())) < need(leaf[0]):
            continue
        agree = lambda a, b, n=leaf[0]: sum(x == y for x, y in zip(a, b, strict=True)) / n >= 0.7
        for k in range(2):
            votes = [Counter() for _ in range(leaf[0])]
            for m, texts in left.items():
                for at, token in enumerate(m.split(" ")):
                    votes[at][token] += len(texts)
            modal = [max(v, key=lambda x, v=v: (v[x], x.encode()), default="") for v in votes]
            key |= {m: (leaf, k) for m in left if agree(m.split(" "), modal)}
            left = {m: texts for m, texts in left.items() if m not in key}
        heads = []
        for m in sorted(left, key=lambda x, left=left: (len(left[x]), x.encode()), reverse=True):
            key[m] = next((h for h in heads if agree(h.split(" "), m.split(" "))), m)
            heads += [m] * (key[m] == m)
    held, first = defaultdict(set), {}
    for i, t in rows:
        for m in t.split("\n"):
            held[key.get(m, m)].add(t)
            first[key.get(m, m)] = min(i, first.get(key.get(m, m), i))
    stays = lambda i, m, k: not (len(held[k]) >= 10 or (len(held[k]) >= need(len(m.split(" "))) and i != first[k]))
    return Counter((i, "\n".join(m for m in t.split("\n") if stays(i, m, key.get(m, m)))) for i, t in rows)


def test_line_templates_beyond_two(spark, monkeypatch):
    """Lines that take neither template of their leaf gather around heads: a third, fourth and fifth template drop too."""
    import random

    from tessera.llm import line_dedup

    r = random.Random(11)
    ends = ["of the old printed book now", "in some new online shop today", "at our next weekly club meeting", "from his last great long speech", "by their only true local dealer"]
    names = [a + b for a in "abcd" for b in "xyz"]
    rows = [(20 * k + i, f"own {chr(97 + k)} {name}\nsee also page {name} {end}") for k, end in enumerate(ends) for i, name in enumerate(names)]
    # nine texts are too few; a mode that mixes three templates agrees with no line
    rows += [(200 + i, f"see also page {names[i]} with no more than nine texts") for i in range(9)]
    mixed = ["a a a a x x x x", "b b b b x x y y", "c c c c z z y y"]
    rows += [(300 + 20 * k + i, f"one two three {end} {name}") for k, end in enumerate(mixed) for i, name in enumerate(names)]
    # passages of one length and lead, in pairs; and lines that agree by chance
    words = "ka lo mi tu ran sel".split()
    for k in range(6):
        passage = " ".join(["in this note", *(r.choice(words) for _ in range(57))])
        rows += [(400 + k, passage), (410 + k, f"again {chr(97 + k)}\n{passage}")]
    rows += [(500 + i, "\n".join("to be or " + " ".join(r.choice("abc") for _ in range(5)) for _ in range(r.randint(1, 5)))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    results = lambda **more: Counter((x["doc_id"], x["kept_text"]) for x in drop_templates(df, **more).collect())
    want = brute_heads(rows)
    assert results(rest=True) == want and results() == brute_templates(rows) != want
    kept = dict(want.keys())
    assert all(kept[20 * k + i] == f"own {chr(97 + k)} {names[i]}" for k in range(5) for i in range(12)) and all(kept[200 + i] for i in range(9))
    assert all(kept[300 + 20 * k + i] == "" for k in range(3) for i in range(12)) and all(kept[400 + k] and kept[410 + k] == f"again {chr(97 + k)}" for k in range(6))
    for name, value in (("HEADS", 3), ("HEAD_BYTES", 300), ("SHARE", 1), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(line_dedup, name, value)
    assert results(rest=True) == want
    assert drop_templates(df.limit(0), rest=True).count() == 0


def test_edited_counts(docs, rows):
    extra = [(500, "mail me at a.b@c.example.org now, call 0123456789  or  98765432\nsee x@y.zz."), (501, "no edits")]
    both = docs.sparkSession.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string")
    both = both.withColumns({c: F.lit("clash") for c in ("n_tokens", "n_edits", "edited_tokens", "input")})
    tok = Tokenizer.from_file(BYTES)
    want = Counter()
    for i, t in [(i, t) for i, t, _ in rows] + extra:
        t = t or ""
        new = t
        for a, b, r in planned(t):
            new = new[:a] + r + new[b:]
        want[i, len(tok.encode(t).ids), len(planned(t)), len(tok.encode(new).ids), len(new)] += 1
    got = Counter(tuple(r)[:5] for r in edited_counts(both, BYTES).collect())
    assert got == want and got[501, 2, 0, 2, 8] == 1
    assert edited_counts(both.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_count_tree_follows_random_edits(path):
    import random

    r, e = random.Random(8), encoder(path)
    for text in ["a b c " * 400, "x  y\n z" * 200, "", "word " * 1000]:
        leaves = leaves_of(text)
        assert "".join(leaves) == text
        tree = CountTree(list(leaves), [len(e.whole(x)) for x in leaves], e)
        for _ in range(15):
            a = r.randint(0, len(text))
            b, new = min(len(text), a + r.choice([0, 1, 5, 400])), r.choice(["", " ", "  ", "\n", "xy zw", "q"])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == len(e.whole(text))
        assert tree.reencoded < 15 * 1500


def test_fit_counts():
    r = np.random.default_rng(2)
    for budget in (0, 1, 7, 500, 60_000, 3_000_000):
        lengths = np.unique(r.integers(1, 4000, 300))
        counts = r.integers(1, 30, len(lengths))
        k = fit_counts(lengths, counts, budget)
        assert (k >= 0).all() and (k <= counts).all()
        assert abs(int((k * lengths).sum()) - min(budget, int((lengths * counts).sum()))) <= lengths.min()
    assert fit_counts(np.array([0, 5]), np.array([9, 2]), 10).tolist()[1] == 2


def test_mixing(docs, rows):
    out = [r.asDict() for r in mix_sources(docs).collect()]
    assert sorted(map(str, out)) == sorted(str(r.asDict()) for r in mix_sources(docs.repartition(5)).collect())
    sizes = [(s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for _, t, s in rows]
    total, weights = Counter(), {}
    for s, n in sizes:
        total[s] += n
    for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[k % 3]
    target, open_, left = {}, set(total), float(sum(total.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
        assert r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert Counter((r["source"], r["size"]) for r in out) == Counter(sizes)
    largest = {s: max(n for t, n in sizes if t == s) for s in total}
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert mix_sources(docs.limit(0)).count() == 0

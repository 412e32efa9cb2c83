"""MinHash near-dedup: banded candidates, sequential Bayesian pruning, exact links on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import BLOCK, Forest, cross_blocks, dealt, index_pairs, only, runs
from tessera.llm.common import connected_components, frugal, written
from tessera.llm.shingles import mix, sets_of, signatures

BANDS, ROWS = 32, 5
#: Signature values that are compared at a time.
BATCH = 32
#: A pair is pruned once the posterior probability that it reaches the threshold is below this.
MISS = 1e-6


def least_matches(threshold: float, hashes: int, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches with P(similarity >= threshold | matches) >= miss.

    The prior of the similarity is uniform, so the posterior after m of n matches is a beta
    distribution, here summed on a grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= threshold
    out = []
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[above].sum() >= miss * density.sum():
                out.append(m)
                break
    return out


def _sign(size: int, seed: int):
    """doc_id, n_shingles, digest of the set, signature and band keys; empty sets have no signature."""
    seeds = np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(seed << 16)
    factors = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in sets_of(batch.column(1), size):
                sig = signatures(sets, seeds)
                with np.errstate(over="ignore"):
                    keys = (sig.reshape(len(sets), BANDS, ROWS).astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64)
                    keys = mix(keys + mix(np.arange(BANDS, dtype=np.uint64)))
                short = sig.astype(np.uint16)
                live = [len(s) > 0 for s in sets]
                flat = keys.view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([r.tobytes() if x else None for r, x in zip(short, live, strict=True)], pa.binary()),
                        lists,
                    ],
                    names=["doc_id", "n_shingles", "digest", "sig", "keys"],
                )

    return frugal(run)


def _outlast(least: list[int], sig: np.ndarray, i: np.ndarray, j: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Which pairs (row i of sig, row j of other) outlast the sequential comparison, batch by batch."""
    other = sig if other is None else other
    live, got = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, enough in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        got = got + (sig[i[live], part] == other[j[live], part]).sum(axis=1)
        keep = got >= enough
        live, got = live[keep], got[keep]
    return live


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _star(least: list[int]):
    """Of (a, b, sig_a, sig_b): a and b of the pairs that outlast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.arange(batch.num_rows)
                keep = pa.array(_outlast(least, _signatures(batch.column(2)), rows, rows, _signatures(batch.column(3))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _edges(part: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Stars over parts: each with the smallest that the found pairs of parts join it to."""
    names, at = np.unique(part, return_inverse=True)
    forest = Forest(len(names))
    for i, j in found:
        for pair in np.unique(np.stack([at[i], at[j]], axis=1), axis=0).tolist():
            forest.join(*pair)
    touched = np.unique(np.concatenate([at[x] for pair in found for x in pair])) if found else np.empty(0, np.int64)
    roots = np.array([forest.root(int(k)) for k in touched], np.int64)
    keep = roots != touched
    return pa.RecordBatch.from_arrays([pa.array(names[roots[keep]]), pa.array(names[touched[keep]])], names=["a", "b"])


def _candidates(least: list[int]):
    """Stars over the parts that pairs of a bucket's members of different parts join, if the pairs outlast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in runs(batches):
            part, own = rows.column("part").to_numpy(), rows.column("own").to_numpy()
            sig = _signatures(rows.column("sig"))
            found, small = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for i, j in index_pairs(own[a:b]):
                    apart = part[a + i] != part[a + j]
                    small.append((a + i[apart], a + j[apart]))
                    if sum(len(i) for i, _ in small) > 200_000:
                        found.append(_checked(least, sig, small))
                        small = []
            found.append(_checked(least, sig, small))
            yield _edges(part, found)

    return run


def _checked(least: list[int], sig: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    i = np.concatenate([i for i, _ in pairs]) if pairs else np.empty(0, np.int64)
    j = np.concatenate([j for _, j in pairs]) if pairs else np.empty(0, np.int64)
    keep = _outlast(least, sig, i, j)
    return i[keep], j[keep]


def _alike(percent: int):
    """Of rows (group, low, own, node, set), a star's center first (own 0): its links, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centers, center = None, [], 0
        for batch in batches:
            out: list[int] = []
            group, low, own = (batch.column(k).to_numpy() for k in ("group", "low", "own"))
            node, sets = batch.column("node").to_numpy(), batch.column("set")
            for i in range(batch.num_rows):
                if (group[i], low[i]) != key:
                    key, centers = (group[i], low[i]), []
                mine = np.frombuffer(sets[i].as_py(), np.uint64)
                if own[i] == 0:
                    centers.append(mine)
                    center = int(node[i])
                    continue
                for other in centers:
                    at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                    both = int((other[at] == mine).sum())
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        out += [center, int(node[i])]
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out[0::2], pa.int64()), pa.array(out[1::2], pa.int64())], names=["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in sets_of(batch.column(1), size):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"]
                )

    return frugal(run)


def _links(percent: int):
    """Stars over the parts of a cluster that links of full sets join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in runs(batches):
            part, own = rows.column("part").to_numpy(), rows.column("own").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                group, home, of = sets[a:b], own[a:b], part[a:b]
                sizes = np.array([len(s) for s in group])
                ids, which = np.unique(np.concatenate(group), return_inverse=True)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                crossing = home.min() != home.max()
                # across two blocks, the members of one are looked up in an index of the other
                asks = np.flatnonzero(home == 0) if crossing else np.arange(b - a)
                indexed = np.repeat(home == 1 if crossing else np.ones(b - a, bool), sizes)
                holder = np.repeat(np.arange(b - a), sizes)[indexed]
                order = np.argsort(which[indexed], kind="stable")
                first = np.searchsorted(which[indexed][order], np.arange(len(ids) + 1))
                holders = holder[order]
                for i in asks:
                    mine = which[ends[i] : ends[i + 1]]
                    lo, n = first[mine], first[mine + 1] - first[mine]
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.bincount(holders[at], minlength=b - a)
                    linked = (both > 0) & (100 * both >= percent * (sizes[i] + sizes - both)) & (of != of[i])
                    j = np.flatnonzero(linked)
                    found.append((np.full(len(j), a + i), a + j))
            yield _edges(part, found)

    return frugal(run)


def minhash_components(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 7
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of `shingle` words (A-Z folded, words separated by
    blanks), as 64-bit hashes; with fewer words, its whole sequence. Documents link if
    100 * |intersection| >= percent * |union|. component_id is the smallest id reachable by links.

    Equal sets collapse in each bucket of a band, where the smallest id stands for them. Candidates are compared by
    signatures in batches of BATCH values, a pair going on while the posterior probability of reaching the
    threshold is MISS or more, and decided on the full sets, so no link rests on an estimate. First each bucket
    is a star: its members against its smallest, and of the pairs that outlast each member's smallest center is
    verified, which costs a set per document and joins most copies to parts. Then members of a bucket that are
    still in different parts are compared, in pairs of bounded blocks (`cross_blocks`); the parts that outlasting
    pairs join make clusters, and in a cluster all pairs of different parts are decided on full sets. A pair
    within a part can't change the components, so a group of copies costs its size, not its square; every pair
    across parts that shares a band is compared. Tasks return stars over parts, never all pairs of a group. A pair
    at the threshold shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 3e-6, and less above it.

    Nulls: a null or empty text has an empty set, linked with nothing. A row with a null id has no
    component and is kept. Rows with one id count as one document; rows repeat in the result. An empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, sig binary, keys array<long>"
    signed = written(rows.mapInArrow(_sign(shingle, seed), schema), "signed")
    named = signed.where("sig is not null and doc_id is not null")
    least = least_matches(percent / 100, BANDS * ROWS)

    banded = named.select(F.explode("keys").alias("key"), F.xxhash64("digest").alias("class"), "doc_id")
    classes = banded.groupBy("key", "class").agg(F.min("doc_id").alias("node")).select("key", "node")
    buckets = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).where("n > 1")
    members = written(classes.join(buckets, "key"), "members")
    needed = written(members.select(F.col("node").alias("doc_id")).distinct(), "needed")
    sigs = only(named.select("doc_id", "sig"), needed, "doc_id").withColumnRenamed("doc_id", "node")
    sigs = written(sigs.dropDuplicates(["node", "sig"]), "signatures")

    stars = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stars.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(
        sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a"
    )
    pairs = written(pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_star(least), "a long, b long").distinct(), "outlasting")
    links = written(_verified(rows, pairs.groupBy("b").agg(F.min("a").alias("a")), shingle, percent), "links")
    part = connected_components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)
    part = written(
        needed.withColumnRenamed("doc_id", "node").join(part, "node", "left").select("node", F.coalesce("component", "node").alias("part")),
        "parts",
    )

    open_members = members.where("n > 2").select(F.col("key").alias("group"), "node").join(part, "node")
    blocks = cross_blocks(open_members).join(sigs, "node")
    crossing = dealt(blocks, ["part", "sig"]).mapInArrow(_candidates(least), "a long, b long")
    ends = part.select(F.col("node").alias("a"), F.col("part").alias("pa")), part.select(F.col("node").alias("b"), F.col("part").alias("pb"))
    starred = pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    joined = written(crossing.union(starred).where("a <> b").distinct(), "joined")
    clusters = written(connected_components(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct(), joined), "clusters")
    inside = part.join(clusters.select(F.col("node").alias("part"), F.col("component").alias("group")), "part").select("group", "part", "node")
    inside = written(inside, "cluster_members")
    sets = _full_sets(rows, written(inside.select("node"), "cluster_ids"), shingle)
    found = dealt(cross_blocks(inside).join(sets, "node"), ["part", "set"]).mapInArrow(_links(percent), "a long, b long")

    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("node"))
    mark = F.xxhash64("digest")
    twice = named.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("doc_id")
    same_id = named.join(twice, "doc_id").join(firsts, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = written(links.union(found).union(same_id).where("a <> b").distinct(), "links")
    linked = connected_components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)
    groups = firsts.join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    plain = signed.where("sig is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = named.select("doc_id", "n_shingles", "digest").join(groups, "digest")
    out = found.select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(plain)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _full_sets(rows: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of the documents in ids, each distinct set of an id once."""
    texts = only(rows.withColumnRenamed("doc_id", "node"), ids, "node")
    return texts.mapInArrow(_sets(shingle), "node long, set binary").repartition("node").dropDuplicates(["node", "set"])


def _verified(rows: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b), each b in one, that full sets link. A center meets its members in chunks of about BLOCK."""
    pairs = written(pairs, "star_pairs")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("chunks"))
    ids = pairs.select(F.col("b").alias("node")).union(sizes.select(F.col("a").alias("node"))).distinct()
    sets = _full_sets(rows, written(ids, "star_ids"), shingle)
    centers = sizes.select(F.col("a").alias("group"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("low"), F.lit(0).alias("own"), F.col("a").alias("node"))
    others = pairs.join(sizes, "a").select(
        F.col("a").alias("group"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("low"), F.lit(1).alias("own"), F.col("b").alias("node")
    )
    dealt_stars = centers.union(others).join(sets, "node").select("group", "low", "own", "node", "set")
    dealt_stars = dealt_stars.repartition("group", "low").sortWithinPartitions("group", "low", "own")
    return dealt_stars.mapInArrow(_alike(percent), "a long, b long").distinct()

"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, written

#: Bytes of double-precision vectors of a block, by the mean; a block has a cover tree of its own.
BLOCK_BYTES = 8 << 20
#: Vectors that the upper tree is fitted on, at most, and its leaves at most.
SAMPLE, LEAVES = 8192, 1024
#: Covering radii of the levels below the root; each is half the one above.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Cosines that are held at a time, and a product of child counts from which a node pair is one matrix product.
CHUNK, DENSE = 1 << 22, 1 << 12


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, the unit vector as doubles, and its digest; null for a vector that links with nothing."""
    for batch in batches:
        column = batch.column(1)
        units: list[bytes | None] = []
        keys: list[int] = []
        for v in column.to_pylist():
            unit = None
            if v and None not in v:
                x = np.asarray(v, np.float64)
                # scaled first, so that squares neither overflow nor vanish
                top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                if top > 0:
                    x = x / top
                    # adding zero makes the two zeros one
                    unit = (x / np.sqrt((x * x).sum()) + 0.0).tobytes()
            units.append(unit)
            keys.append(int.from_bytes(hashlib.blake2b(unit or b"", digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(units, pa.binary()), pa.array(keys, pa.int64())], names=["vec_id", "unit", "hash"]
        )


def chord(cosine: float) -> float:
    """Distance of unit vectors at a cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def _distances(gram: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * gram))


class CoverTree:
    """A simplified cover tree over unit vectors, in the order of a walk: a node of a level is a run of rows.

    `starts[k]` has the first rows of level k's nodes, and the end; a node's center is its first row, which is also
    the center of its first child, so levels are nested. Level 0 is the root, level k's centers cover their
    nodes within RADII[k - 1] and are further than that from their siblings, and in the last level each row is a node.
    `radius[k]` has the covering radii as they are: the largest distance from a center to its rows. `child[k]` has
    where the children of level k's nodes begin in level k + 1.
    """

    def __init__(self, x: np.ndarray, starts: list[np.ndarray] | None = None) -> None:
        n = len(x)
        self.order = np.arange(n)
        if starts is None:
            starts = [np.array([0, n])]
            narrow = x.astype(np.float32)
            for radius in RADII:
                cuts = [np.empty(0, np.int64)]
                for a, b in zip(starts[-1][:-1], starts[-1][1:], strict=True):
                    if b - a > 1:
                        rows = self.order[a:b]
                        who = _cover(narrow[rows], radius)
                        order = np.lexsort((who != np.arange(len(who)), who))
                        self.order[a:b] = rows[order]
                        cuts.append(a + np.flatnonzero(np.diff(who[order])) + 1)
                starts.append(np.unique(np.concatenate([starts[-1], *cuts])))
            starts.append(np.arange(n + 1))
            x = x[self.order]
        self.x, self.narrow, self.starts = x, x.astype(np.float32), starts
        self.size = [np.diff(s) for s in starts]
        self.radius = []
        for s, size in zip(starts, self.size, strict=True):
            cosines = np.einsum("ij,ij->i", x, x[np.repeat(s[:-1], size)])
            far = _distances(np.minimum.reduceat(cosines, s[:-1])) + 1e-9
            self.radius.append(np.where(size == 1, 0.0, far))
        self.child = [np.searchsorted(below, s) for s, below in zip(starts[:-1], starts[1:], strict=True)]

    def centers(self, k: int) -> np.ndarray:
        return self.narrow[self.starts[k][:-1]]


def _cover(x: np.ndarray, radius: float, chunk: int = 256) -> np.ndarray:
    """The nearest center of each row: row 0 is the first, others are rows that no center so far is near, in order."""
    need = np.float32(1 - radius * radius / 2)
    best, who = x @ x[0], np.zeros(len(x), np.int64)
    centers = [np.zeros(1, np.int64)]
    while len(rest := np.flatnonzero(best < need)):
        some = rest[:chunk]
        near = x[some] @ x[some].T >= need
        covered, new = np.zeros(len(some), bool), []
        for i in range(len(some)):
            if not covered[i]:
                new.append(some[i])
                covered |= near[i]
        new = np.array(new)
        cosines = x @ x[new].T
        top = cosines.argmax(axis=1)
        value = cosines[np.arange(len(x)), top]
        nearer = value > best
        best, who = np.where(nearer, value, best), np.where(nearer, new[top], who)
        best[new] = 2
        centers.append(new)
    made = np.concatenate(centers)
    who[made] = made
    return who


class Links:
    """What a pair of blocks links: weights that rows gain, and edges between rows (the second tree's after the first's)."""

    def __init__(self, a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray) -> None:
        self.same, self.n = a is b, len(a.x)
        self.offset = 0 if self.same else self.n
        self.gain = np.zeros(self.offset + len(b.x) + 1, np.int64)
        self.sums = np.concatenate([[0], np.cumsum(weight_a)]), np.concatenate([[0], np.cumsum(weight_b)])
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0

    def add(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        """All rows of runs a0 to a1 link with all rows of the runs b0 to b1 beside them; of a run with itself, its rows link with one another."""
        if not len(a0):
            return
        wa, wb = (s[hi] - s[lo] for s, lo, hi in ((self.sums[0], a0, a1), (self.sums[1], b0, b1)))
        own = self.same & (a0 == b0)
        for lo, hi, w in ((a0, a1, wb), (b0 + self.offset, b1 + self.offset, np.where(own, 0, wa))):
            np.add.at(self.gain, lo, w)
            np.add.at(self.gain, hi, -w)
        for lo, hi in {(int(p), int(q)) for p, q in zip(a0, a1, strict=True) if q - p > 1} | {
            (int(p) + self.offset, int(q) + self.offset) for p, q in zip(b0, b1, strict=True) if q - p > 1
        }:
            self.edges.append((np.arange(lo + 1, hi), np.full(hi - lo - 1, lo)))
        self.edges.append((a0, b0 + self.offset))
        if self.same:
            # a row isn't linked with itself
            inside = np.concatenate([np.arange(lo, hi) for lo, hi in zip(a0[own], a1[own], strict=True)] or [np.empty(0, np.int64)])
            weight = np.diff(self.sums[0])[inside]
            np.add.at(self.gain, inside, -weight)
            np.add.at(self.gain, inside + 1, weight)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows with links, their gains, the first row of each one's component)."""
        gain = np.cumsum(self.gain)[:-1]
        u = np.concatenate([e[0] for e in self.edges] or [np.empty(0, np.int64)])
        v = np.concatenate([e[1] for e in self.edges] or [np.empty(0, np.int64)])
        label = np.arange(len(gain))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        rows = np.unique(np.concatenate([u[u != v], v[u != v]]))
        return rows, gain[rows], label[rows]


def dual_links(a: CoverTree, b: CoverTree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> Links:
    """Links of all rows of a with rows of b at a cosine >= the threshold: both trees are descended together.

    A pair of nodes is pruned if its centers are further apart than the threshold's distance plus both
    covering radii; if they are nearer than that distance less both radii, all their rows link, uncompared. Else
    its pairs of children are compared, and no others, so what is pruned costs nothing further down. Two single rows
    are decided by their cosine in double precision. The descent begins, for all nodes at once, at the first level
    where bounds prune nine in ten of a few sampled pairs (where it begins changes no result).
    Cosines of nodes are in single precision, with its error added to each bound.
    """
    out = Links(a, b, weight_a, weight_b)
    reach, slack = chord(cosine) + 1e-9, (a.x.shape[1] + 8) * 2.0**-23
    root = _distances(np.array([float(a.x[0] @ b.x[0])]))[0]
    if root > reach + a.radius[0][0] + b.radius[0][0]:
        return out
    last, k = len(a.starts) - 1, 0
    for k in range(1, last):
        i, j = (np.arange(0, len(t.size[k]), max(1, len(t.size[k]) // 64)) for t in (a, b))
        cosines = a.centers(k)[i] @ b.centers(k)[j].T
        bound = np.minimum(2.0, reach + a.radius[k][i][:, None] + b.radius[k][j])
        if (cosines >= 1 - bound**2 / 2 - slack).mean() <= 0.1:
            break

    def settle(k: int, i: np.ndarray, j: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of node pairs that may hold links: those to descend; the others are decided."""
        single = (a.size[k][i] == 1) & (b.size[k][j] == 1)
        p, q = a.starts[k][i[single]], b.starts[k][j[single]]
        if out.same:
            p, q = p[p != q], q[p != q]
        for at in range(0, len(p), CHUNK // 64):
            x, y = p[at : at + CHUNK // 64], q[at : at + CHUNK // 64]
            yes = np.einsum("ij,ij->i", a.x[x], b.x[y]) >= cosine
            x, y = x[yes], y[yes]
            out.add(x, x + 1, y, y + 1)
        i, j, cosines = i[~single], j[~single], cosines[~single]
        spread = a.radius[k][i] + b.radius[k][j]
        spread = np.where(out.same & (i == j), 2 * a.radius[k][i], _distances(cosines.astype(np.float64) - slack) + spread)
        whole = spread <= reach - 1e-6
        out.add(a.starts[k][i[whole]], a.starts[k][i[whole] + 1], b.starts[k][j[whole]], b.starts[k][j[whole] + 1])
        return i[~whole], j[~whole]

    def product(k: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to descend of all nodes i with all nodes j, by matrix products; of equal trees, i <= j only."""
        parts = []
        ca, cb = a.centers(k), b.centers(k)
        for rows in (i[a.size[k][i] == 1], i[a.size[k][i] > 1]):
            for cols in (j[b.size[k][j] == 1], j[b.size[k][j] > 1]):
                if not len(rows) or not len(cols):
                    continue
                ra, rb, right = a.radius[k][rows], b.radius[k][cols], cb[cols].T
                step = max(1, CHUNK // len(cols))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    begin = int(np.searchsorted(cols, some[0])) if out.same else 0
                    cosines = ca[some] @ right[:, begin:]
                    out.compared += cosines.size
                    if ra.any() and rb.any():
                        bound = (np.float32(reach) + ra[at : at + step].astype(np.float32)[:, None]) + rb[begin:].astype(np.float32)
                        np.minimum(bound, 2, out=bound)
                        least = 1 - bound * bound / 2 - np.float32(2 * slack)
                    else:
                        bound = np.minimum(2.0, reach + (ra[at : at + step][:, None] if ra.any() else rb[begin:]))
                        least = (1 - bound**2 / 2 - 2 * slack).astype(np.float32)
                        least = least if ra.any() or rb.any() else least.max()
                    u, v = np.divmod(np.flatnonzero(cosines >= least), cosines.shape[1] or 1)
                    near = cosines[u, v]
                    u, v = some[u], cols[v + begin]
                    if out.same:
                        near, u, v = near[u <= v], u[u <= v], v[u <= v]
                    parts.append(settle(k, u, v, near))
        return tuple(np.concatenate([p[x] for p in parts] or [np.empty(0, np.int64)]) for x in (0, 1))

    i, j = product(k, np.arange(len(a.size[k])), np.arange(len(b.size[k])))
    for k in range(k + 1, last + 1):
        a0, a1, b0, b1 = a.child[k - 1][i], a.child[k - 1][i + 1], b.child[k - 1][j], b.child[k - 1][j + 1]
        pairs = (a1 - a0) * (b1 - b0)
        parts = [product(k, np.arange(a0[m], a1[m]), np.arange(b0[m], b1[m])) for m in np.flatnonzero(pairs >= DENSE)]
        rest = np.flatnonzero(pairs < DENSE)
        upto = np.concatenate([[0], np.cumsum(pairs[rest])])
        at = 0
        while at < len(rest):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK // 64, side="right")) - 1)
            m = np.repeat(rest[at:to], pairs[rest[at:to]])
            within = np.arange(len(m)) - np.repeat(upto[at:to] - upto[at], pairs[rest[at:to]])
            width = b1[m] - b0[m]
            u, v = a0[m] + within // width, b0[m] + within % width
            if out.same:
                u, v = u[u <= v], v[u <= v]
            cosines = np.einsum("ij,ij->i", a.narrow[a.starts[k][u]], b.narrow[b.starts[k][v]])
            out.compared += len(u)
            bound = np.minimum(2.0, reach + a.radius[k][u] + b.radius[k][v])
            keep = cosines >= 1 - bound**2 / 2 - slack
            parts.append(settle(k, u[keep], v[keep], cosines[keep]))
            at = to
        i, j = (np.concatenate([p[x] for p in parts] or [np.empty(0, np.int64)]) for x in (0, 1))
    return out


def upper_leaves(sample: np.ndarray, leaves: int) -> np.ndarray:
    """Centers of the upper tree's leaves: the finest nested level with `leaves` centers at most, else
    the first `leaves` of the next."""
    held = sample[:1]
    for radius in RADII:
        best = (sample @ held.T).max(axis=1)
        need = 1 - radius * radius / 2
        grown = [held]
        count = len(held)
        while count < leaves and (best < need).any():
            i = int(np.argmin(best))
            grown.append(sample[i : i + 1])
            best = np.maximum(best, sample @ sample[i])
            count += 1
        held = np.concatenate(grown)
        if count >= leaves:
            break
    return held


def _assign(centers: np.ndarray):
    """The upper leaf of each vector, and its distance to the leaf's center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            gram = x @ centers.T
            leaf = gram.argmax(axis=1)
            far = _distances(gram[np.arange(len(x)), leaf])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf.astype(np.int64)), pa.array(far)], names=[*batch.schema.names, "leaf", "far"]
            )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block, with its tree, from rows sorted by block."""
    kept: pa.Table | None = None

    def rows(table: pa.Table) -> pa.RecordBatch:
        vectors = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(table.num_rows, -1)
        tree = CoverTree(vectors)
        columns = {
            "leaf": [table.column("leaf")[0].as_py()],
            "block": [table.column("block")[0].as_py()],
            "ids": [table.column("node").to_numpy()[tree.order].astype(np.int64).tobytes()],
            "copies": [table.column("copies").to_numpy()[tree.order].astype(np.int64).tobytes()],
            "vectors": [tree.x.tobytes()],
            "starts": [[s.astype(np.int32).tobytes() for s in tree.starts[1:-1]]],
        }
        return pa.RecordBatch.from_pydict(columns, schema=BLOCK_ARROW)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        block = table.column("block").to_numpy()
        leaf = table.column("leaf").to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (leaf[1:] != leaf[:-1])) + 1
        at = 0
        for cut in cuts:
            yield rows(table.slice(at, int(cut) - at))
            at = int(cut)
        kept = table.slice(at)
    if kept is not None and kept.num_rows:
        yield rows(kept)


BLOCK_ARROW = pa.schema(
    [("leaf", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("starts", pa.list_(pa.binary()))]
)
BLOCK_SCHEMA = "leaf long, block long, ids binary, copies binary, vectors binary, starts array<binary>"


def _join(cosine: float):
    def tree(row: dict, side: str) -> tuple[CoverTree, np.ndarray, np.ndarray]:
        ids, copies = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("ids", "copies"))
        n = len(ids)
        inner = [np.frombuffer(s, np.int32).astype(np.int64) for s in row[f"starts_{side}"]]
        x = np.frombuffer(row[f"vectors_{side}"], np.float64).reshape(n, -1)
        return CoverTree(x, [np.array([0, n]), *inner, np.arange(n + 1)]), ids, copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                a, ids, copies = tree(r, "a")
                if (r["leaf_a"], r["block_a"]) == (r["leaf_b"], r["block_b"]):
                    b, every, more = a, ids, copies
                else:
                    b, right, more = tree(r, "b")
                    every = np.concatenate([ids, right])
                rows, gain, label = dual_links(a, b, cosine, copies, more).result()
                # a component goes by its smallest id
                first = np.full(len(every), np.iinfo(np.int64).max)
                np.minimum.at(first, label, every[rows])
                yield pa.RecordBatch.from_arrays([pa.array(every[rows]), pa.array(gain), pa.array(first[label])], names=["node", "more", "first"])

    return run


def cosine_links(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, representatives, links): vec_id, unit, hash of each; node and copies of each distinct unit vector; and,
    for each pair of blocks and each of their representatives with links there: node, more (vectors linked) and
    first (the smallest representative that these links reach)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    unit = written(rows.mapInArrow(_unit, "vec_id long, unit binary, hash long"), "units")
    live = unit.where("unit is not null and vec_id is not null")
    reps = written(
        live.groupBy("hash", "unit").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "representatives"
    )
    links = None
    widths = sorted((r["d"], r["n"]) for r in reps.groupBy(F.octet_length("unit").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    for width, n in widths:
        own = reps.where(F.octet_length("unit") == width)
        block = max(1, BLOCK_BYTES // width)
        taken = own.select("hash", "unit").orderBy("hash", "unit").limit(SAMPLE).collect()
        sample = np.frombuffer(b"".join(r["unit"] for r in taken), np.float64).reshape(len(taken), -1)
        centers = upper_leaves(sample, max(1, min(LEAVES, round(n / block))))
        placed = own.select("node", "unit", "hash", "copies").mapInArrow(
            _assign(centers), "node long, unit binary, hash long, copies long, leaf long, far double"
        )
        placed = written(placed, "placed")
        shape = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).orderBy("leaf").collect()
        leaf, parts = np.array([r["leaf"] for r in shape]), np.array([max(1, -(-r["n"] // block)) for r in shape])
        far = np.array([r["far"] for r in shape])
        near = _distances(centers[leaf] @ centers[leaf].T) <= chord(cosine) + far[:, None] + far + 1e-8
        p, q = np.nonzero(np.triu(near))
        blocks_of = spark.createDataFrame(list(zip(leaf.tolist(), parts.tolist(), strict=True)), "leaf long, blocks long")
        cut = placed.join(F.broadcast(blocks_of), "leaf").withColumn("block", F.pmod("hash", F.col("blocks")))
        packed = (
            cut.select("leaf", "block", "node", "copies", "unit")
            .repartition("leaf", "block")
            .sortWithinPartitions("leaf", "block")
            .mapInArrow(_pack, BLOCK_SCHEMA)
        )
        blocks = written(packed, "blocks")
        pairs = list(zip(*(x.tolist() for x in (leaf[p], leaf[q], parts[p], parts[q])), strict=True))
        listed = spark.createDataFrame(pairs, "leaf_a long, leaf_b long, parts_a long, parts_b long")
        both = (
            listed.withColumn("block_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_a") - 1)))
            .withColumn("block_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_b") - 1)))
            .where("leaf_a < leaf_b or block_a <= block_b")
        )
        side = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in blocks.columns))
        tasks = int(max(1, min(4096, (parts[p] * parts[q]).sum())))
        keys = ["leaf_a", "block_a", "leaf_b", "block_b"]
        work = both.join(side("a"), ["leaf_a", "block_a"]).join(side("b"), ["leaf_b", "block_b"]).repartition(tasks, *keys)
        work = work.select(*keys, *(f"{c}_{s}" for s in "ab" for c in ("ids", "copies", "vectors", "starts")))
        found = written(work.mapInArrow(_join(cosine), "node long, more long, first long"), "links")
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "node long, more long, first long")
    return unit, reps, links


def cosine_components(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal unit vectors collapse into one representative with a count, so copies are never paired. An upper cover
    tree, fitted on the SAMPLE representatives with the smallest hashes, gives each representative a leaf
    (LEAVES at most); leaf pairs beyond the covering radii are pruned. Leaves are cut into blocks of about BLOCK_BYTES,
    each with a cover tree of nested levels with halving radii, built once; the blocks of leaf pairs that remain are
    joined by dual traversal, exactly. A task returns counts and, for each row with links, the smallest it reaches, never
    pairs. The leaves, their sizes and bounds are all the driver holds.

    n_links counts other vectors with a cosine of `cosine` or more: the copies of the own vector, and those of
    each linked representative. component_id is the smallest vec_id reachable.

    Nulls: a vector that is null, empty, zero, or with null or non-finite components links with nothing. A null id
    has no component and is kept, linked with nothing. Vectors link only with those of their own length. Rows that
    repeat an id count as links; if their vectors differ, they share the links of both. An empty table gives no rows.
    """
    unit, reps, links = cosine_links(vectors, cosine, id_col, vector_col)
    linked = links.groupBy("node").agg(F.sum("more").alias("more"))
    component = connected_components(links.select("node").distinct(), links.select(F.col("node").alias("a"), F.col("first").alias("b")))
    groups = (
        reps.join(linked, "node", "left")
        .join(component, "node", "left")
        .select(
            "hash",
            F.col("unit").alias("same"),
            (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    alone = unit.where("unit is null or vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    live = unit.where("unit is not null and vec_id is not null")
    found = live.join(groups, (live["hash"] == groups["hash"]) & (F.col("unit") == F.col("same"))).select(
        "vec_id", "n_links", "component_id"
    )
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Groups whose members are compared with one another, cut into pairs of bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block, by the mean.
BLOCK = 1024
#: Ids that a broadcast set holds at most (8 bytes each, and their table); beyond it Spark joins by shuffle.
BROADCAST_IDS = 1_000_000


def cross_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (group, part, node) as (group, low, high, own, part, node): pairs of different parts of a group meet in one task.

    A part of more than `block` members has blocks of its own, the other parts of its group share blocks,
    and each block is compared with itself and every other, but for the blocks of one part with one another:
    a group that is one part gives no rows, and a large part is sent once for each block of the others. A task
    holds two blocks (low and high, own tells which), however large the group.
    """
    sizes = members.groupBy("group", "part").agg(F.count(F.lit(1)).alias("m"))
    large = F.col("m") > block
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    shape = (
        sizes.groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.coalesce(F.sum(F.when(~large, F.col("m"))), F.lit(0)).alias("shared"),
            # one entry for each `block` members of the group at most
            F.collect_list(F.when(large, F.struct("part", blocks(F.col("m")).alias("n")))).alias("large"),
        )
        .where("parts > 1")
    )
    own_blocks = F.col("large.n")[(F.array_position(F.col("large.part"), F.col("part")) - 1).cast("int")]
    is_large = F.array_contains(F.col("large.part"), F.col("part"))
    shared = blocks(F.col("shared"))
    listed = F.concat(
        F.when(F.col("shared") > 0, F.transform(F.sequence(F.lit(0), F.greatest(shared - 1, F.lit(0))), lambda k: _block(None, k))).otherwise(
            F.array().cast("array<struct<part:bigint,at:int>>")
        ),
        F.flatten(F.transform("large", lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda k: _block(x["part"], k)))),
    )
    own = F.when(is_large, _block(F.col("part"), F.pmod(F.xxhash64("node"), F.coalesce(own_blocks, F.lit(1))).cast("int"))).otherwise(
        _block(None, F.pmod(F.xxhash64("part"), F.greatest(shared, F.lit(1))).cast("int"))
    )
    placed = members.join(shape, "group").select("group", "part", "node", is_large.alias("alone"), own.alias("home"), F.explode(listed).alias("other"))
    # a part with blocks of its own has no pairs within itself
    placed = placed.where(~F.col("alone") | ~F.col("other.part").eqNullSafe(F.col("part")))
    return placed.select(
        "group",
        F.xxhash64(F.least("home", "other")).alias("low"),
        F.xxhash64(F.greatest("home", "other")).alias("high"),
        (F.col("home") == F.greatest("home", "other")).cast("int").alias("own"),
        "part",
        "node",
    )


def _block(part, at):
    """The name of a block: the part it belongs to, null for shared ones, and its number."""
    return F.struct((F.lit(None).cast("long") if part is None else part).alias("part"), at.cast("int").alias("at"))


def dealt(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one (group, low, high) next to one another in one task, by group first."""
    keys = ["group", "low", "high"]
    return pairs.select(*keys, "own", *columns).repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where groups begin and the end) of dealt rows; no group spans two results."""
    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        cuts = _cuts(rows)
        if len(cuts) > 2:
            done = int(cuts[-2])
            yield rows.slice(0, done), cuts[:-1]
            kept = rows.slice(done)
        else:
            kept = rows
    if kept is not None and kept.num_rows:
        yield kept, _cuts(kept)


def _cuts(rows: pa.Table) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    if len(change):
        change[0] = True
    for name in ("group", "low", "high"):
        v = rows.column(name).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), rows.num_rows)


def index_pairs(own: np.ndarray, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare among a group's rows: within one block, or across its two, in chunks."""
    n = len(own)
    if own.min() == own.max():
        step = max(1, chunk // max(n, 1))
        for a in range(0, n, step):
            i, j = np.meshgrid(np.arange(a, min(n, a + step)), np.arange(n), indexing="ij")
            keep = i < j
            yield i[keep], j[keep]
    else:
        x, y = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        step = max(1, chunk // len(y))
        for a in range(0, len(x), step):
            i, j = np.meshgrid(x[a : a + step], y, indexing="ij")
            yield i.ravel(), j.ravel()


class Forest:
    """Disjoint sets of rows."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart."""
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def only(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is in ids (a written table of one column): ids are broadcast if they are few
    enough to fit, and otherwise joined by shuffle, where Spark may add its run-time filter."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, on, "left_semi")

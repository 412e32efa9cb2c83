"""Exact nearest neighbours by Euclidean distance, a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block, which a task holds at a time, and rows that it compares with them at a time.
QUERY_BLOCK, ROW_BLOCK = 4096, 1024
#: Rows that make a part of their own, where there are more tasks than such parts.
PART_ROWS = 16384
SCHEMA = "query_id long, id long, distance double"


def l2(a, b):
    """Distance of two vector columns, in the JVM."""
    diff = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, d: s + d))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


class Nearest:
    """The k nearest rows so far of each query. A matrix product finds what may be among them; its distances are then computed plainly."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.q, self.k = queries, k
        self.norm = np.einsum("ij,ij->i", queries, queries)
        self.d = np.full((len(queries), k), np.inf)
        self.i = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, x: np.ndarray, keys: np.ndarray) -> None:
        rough = self.norm[:, None] + np.einsum("ij,ij->i", x, x) - 2 * (self.q @ x.T)
        kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] if len(keys) > self.k else np.full(len(self.q), np.inf)
        slack = 1e-9 * (1 + self.norm + float(np.einsum("ij,ij->i", x, x).max(initial=0)))
        bound = np.minimum(kth, self.d[:, -1] ** 2) + slack
        for n in np.flatnonzero((rough <= bound[:, None]).any(axis=1)):
            some = np.flatnonzero(rough[n] <= bound[n])
            diff = x[some] - self.q[n]
            d, i = np.append(self.d[n], np.sqrt(np.einsum("ij,ij->i", diff, diff))), np.append(self.i[n], keys[some])
            order = np.lexsort((i, d))[: self.k]
            self.d[n], self.i[n] = d[order], i[order]


def _search(k: int):
    """Rows (block, side, id, v), queries (side 0) of a block first: the k nearest of each query among the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, queries, near = None, [], [], None

        def out() -> Iterator[pa.RecordBatch]:
            if near is not None:
                found = np.isfinite(near.d)
                which = np.repeat(np.array(ids, np.int64), found.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(near.i[found]), pa.array(near.d[found])], names=["query_id", "id", "distance"])

        for batch in batches:
            block, part, side, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "side", "id"))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if (block[a], part[a]) != key:
                    yield from out()
                    key, ids, queries, near = (block[a], part[a]), [], [], None
                x = _matrix(batch.column("v").slice(a, b - a), b - a)
                if side[a] == 0:
                    ids += keys[a:b].tolist()
                    queries.append(x)
                    continue
                if not ids:
                    continue
                near = near or Nearest(np.concatenate(queries), k)
                for at in range(0, b - a, ROW_BLOCK):
                    near.add(x[at : at + ROW_BLOCK], keys[a + at : min(b, a + at + ROW_BLOCK)])
        yield from out()

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query, ascending, ties by id.

    queries: (query_id, vector), a stated query set. Queries are dealt to blocks of about QUERY_BLOCK and rows to `parts`; each
    pair of a block and a part is one run in a task, which returns k rows per query, so nothing is
    collected, and the last shuffle holds k rows per query and part: few rows get few parts, about PART_ROWS each, but one for each core. Every row is compared with every query. Rows of
    another dimension than the queries' are an error of the caller; null vectors are left out, of queries too.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("v is not null")
    if parts is None:
        cores = spark.sparkContext.defaultParallelism
        parts = max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // PART_ROWS)))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts)).withColumn("side", F.lit(0))
    spread = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", each(blocks)).withColumn("side", F.lit(1))
    columns = ["block", "part", "side", "id", "v"]
    work = dealt.select(*columns).unionByName(spread.select(*columns)).repartition(parts * min(blocks, 64), "block", "part").sortWithinPartitions("block", "part", "side")
    found = work.mapInArrow(_search(k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

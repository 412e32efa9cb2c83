"""What the operators share: working tables in the shared folder, components, and word rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java and Python character class body.
BLANK = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is named (tests)."""
    # Spark 4.1 zips unions of one partitioning, which fails where adaptive planning has changed one side's partitions
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _scratch:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        delete_path(spark, path)


#: Bytes of an Arrow batch that goes to Python, whatever its rows: both sides of a task hold some of them.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, jobs send Python batches of BATCH_BYTES at most (one row at least)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: its lineage ends here, and its
    size is known to the planner, so that joins broadcast it only below Spark's threshold."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives its free memory back to the system at its end, as Python workers outlive tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def word_count(text) -> F.Column:
    """Number of maximal runs of characters other than BLANK; null counts as empty."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " +"), lambda w: w != "")).cast("long")


def ascii_lower(text) -> F.Column:
    return F.translate(text, UPPER, LOWER)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that edges reach, itself included.

    nodes: one column `node` (long, distinct). edges: `a`, `b` (long), in either direction, ends among nodes.

    By local contraction: each node takes the first node of its closed neighbourhood as its label, nodes of
    one label become one node, and the edges between labels remain, once each. First is the smallest id in even
    rounds, so stars around their smallest node, as tasks emit them, vanish at once; in odd rounds it is the
    smallest hash under that round's seed, which leaves three quarters of the nodes at most, by the mean, whatever the
    graph, so rounds are logarithmic in its size and none is counted. Labels of all rounds are joined at the end. Each round
    ends in written tables. A hub's edges, or the nodes of one label, are the streamed side of a plain
    join, which AQE splits; aggregations are partial first.
    """
    edges = written(_ordered(edges, "a", "b"), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        rank = (lambda c: F.col(c)) if len(rounds) % 2 == 0 else (lambda c, k=len(rounds): F.xxhash64(F.lit(k), c))
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        first = F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("id")))
        label = F.least(F.col("first"), F.struct(rank("a").alias("rank"), F.col("a").alias("id")))["id"]
        labels = written(ends.groupBy("a").agg(first.alias("first")).select(F.col("a").alias("node"), label.alias("label")), "labels")
        rounds.append(labels)
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = written(_ordered(edges.join(left, "a").join(right, "b"), "la", "lb"), "edges")
    if not rounds:
        return nodes.select("node", F.col("node").alias("component"))
    found = rounds.pop()
    for labels in reversed(rounds):
        further = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = written(labels.join(further, "label", "left").select("node", F.coalesce("last", "label").alias("label")), "labels")
    lowest = found.groupBy("label").agg(F.min("node").alias("component"))
    found = written(found.join(lowest, "label").select("node", "component"), "components")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges between different nodes, the smaller first."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

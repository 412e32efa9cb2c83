"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def plain_unions(spark: SparkSession) -> None:
    """From now on unions concatenate their sides' partitions. Spark 4.1 else zips sides of one partitioning, which fails where adaptive
    planning has changed the number of one side's partitions ("Can't zip RDDs")."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def working_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a written table: its lineage ends here and its size is known to the planner."""
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, corpus: str, name: str, make: Callable[[], object]):
    """What make returns, made once for a corpus in an application: an index that many queries share."""
    key = (spark.sparkContext.applicationId, corpus, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]

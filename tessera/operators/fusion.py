"""Reciprocal-rank fusion and diversification."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(channels: Mapping[str, tuple[DataFrame, float]], k: int = 60, carry: Mapping[str, str] | None = None) -> DataFrame:
    """(query_id, id, score, best_rank, rank) from channels of (query_id, id, rank) and their weights.

    An id counts once in a channel, at its first rank. Order: score, then best rank, then id. `carry` names a column of
    some channels to keep, as `<channel>_rank` and `<channel>_value`, null where the channel doesn't have the id: they
    ride along as conditional maxima, so a channel is computed once.
    """
    if k < 0 or any(w < 0 for _, w in channels.values()):
        raise ValueError("k and weights can't be negative")
    carry = carry or {}
    rows = None
    for name, (df, weight) in channels.items():
        value = F.col(carry[name]).cast("double") if name in carry else F.lit(None).cast("double")
        first = df.groupBy("query_id", "id").agg(F.min(F.struct("rank", value.alias("value"))).alias("at"))
        order = Window.partitionBy("query_id").orderBy("at.rank", "id")
        # ranks close up after repeats are gone
        part = first.select("query_id", "id", F.row_number().over(order).alias("rank"), F.lit(float(weight)).alias("weight"), F.lit(name).alias("channel"), F.col("at.value").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    of = lambda name, c: F.max(F.when(F.col("channel") == name, F.col(c)))
    fused = rows.groupBy("query_id", "id").agg(
        F.sum(F.col("weight") / (F.col("rank") + k)).alias("score"),
        F.min("rank").alias("best_rank"),
        *(of(name, c).alias(f"{name}_{c}") for name in channels if name in carry for c in ("rank", "value")),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "best_rank", "id")
    return fused.withColumn("rank", F.row_number().over(order))


def diversify(ranked: DataFrame, per_group: int, group: str = "document_id") -> DataFrame:
    """The first per_group rows of each group of each query, ranks closed up; all rows if per_group <= 0."""
    if per_group <= 0:
        return ranked
    within = Window.partitionBy("query_id", group).orderBy("rank")
    kept = ranked.withColumn("turn", F.row_number().over(within)).where(F.col("turn") <= per_group).drop("turn")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def min_max(df: DataFrame, column: str, out: str, group: str | None = None) -> DataFrame:
    """The column scaled to 0..1 over all rows or each group; a constant becomes zeros.

    Bounds come from an aggregation that is joined back, so no group is sorted or held in one task.
    """
    if group is None:
        both = df.crossJoin(F.broadcast(df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))))
    else:
        bounds = df.groupBy(F.col(group).alias("__of")).agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
        both = df.join(bounds, F.col(group).eqNullSafe(F.col("__of"))).drop("__of")
    low, high = F.col("__low"), F.col("__high")
    return both.withColumn(out, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)).drop("__low", "__high")

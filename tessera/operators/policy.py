"""Authority tiers, conflict labels and recency, over ranked candidates of many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import authority_class

PROMOTION_WINDOW = 20
# The classes that an intent prefers (tier 0), and those it takes as they come (tier 1).
TIERS = {
    "current-state": (("current-state",), ("durable", "project", "decision", "log", "evidence")),
    "decision": (("decision",), ("durable", "project", "current-state", "log", "evidence")),
    "chronology": (("log",), ("decision", "current-state", "project", "durable", "evidence")),
    "evidence": (("evidence",), ("durable", "project", "current-state", "decision", "log", "idea")),
    "general": (("durable", "project", "current-state", "decision"), ("log", "evidence")),
}


def tier(intent: Column, klass: Column) -> Column:
    """0 preferred, 1 neutral, 2 demoted."""
    out = F.lit(2)
    known = intent.isin(*TIERS)
    for name, (first, second) in TIERS.items():
        asked = (intent == name) if name != "general" else ((intent == name) | ~known)
        out = F.when(asked & klass.isin(*first), 0).when(asked & klass.isin(*second), 1).otherwise(out)
    return out


def authority_policy(ranked: DataFrame, window: int = PROMOTION_WINDOW) -> DataFrame:
    """Re-ranks (query_id, rank, intent, profile, source_kind, page_role, is_route_map, ...).

    Adds authority_class, authority_match and old_rank. Preferred classes go first if they were in the
    window, demoted ones last; the profiles `evidence` and `history` promote nothing. Stable otherwise.
    """
    rows = ranked.withColumn("authority_class", authority_class())
    rows = rows.withColumn("tier", tier(F.col("intent"), F.col("authority_class")))
    placed = F.when(F.col("profile").isin("evidence", "history") & (F.col("tier") < 2), 1).when(
        (F.col("tier") == 0) & (F.col("rank") > window), 1
    ).otherwise(F.col("tier"))
    order = Window.partitionBy("query_id").orderBy("place", "rank")
    return (
        rows.withColumn("authority_match", F.col("tier") == 0)
        .withColumn("place", placed)
        .withColumn("new_rank", F.row_number().over(order))
        .withColumnRenamed("rank", "old_rank")
        .withColumnRenamed("new_rank", "rank")
        .drop("tier", "place")
    )


def conflict_labels(ranked: DataFrame, top_n: int = 10) -> DataFrame:
    """(query_id, at, label) of likely contradictions among the first top_n of each query."""
    head = ranked.where(F.col("rank") <= top_n)
    owned = head.where("project_id is not null and project_id <> ''")
    rival = (
        owned.groupBy("query_id")
        .agg(F.sort_array(F.collect_set("project_id")).alias("projects"))
        .where(F.size("projects") > 1)
        .select("query_id", F.lit(0).alias("at"), F.concat(F.lit("competing-projects: "), F.array_join("projects", ", ")).alias("label"))
    )
    state = owned.where("page_role = 'current-state'").groupBy("query_id", "project_id").agg(
        F.max_by(F.struct("path", "updated_at_ns"), F.col("rank")).alias("s")
    )
    old = (
        owned.where("page_role <> 'current-state'")
        .join(state, ["query_id", "project_id"])
        .where("updated_at_ns <> 0 and s.updated_at_ns <> 0 and updated_at_ns < s.updated_at_ns")
        .select("query_id", F.col("rank").alias("at"), F.concat(F.lit("older-than-current-state: "), "path", F.lit(" predates "), "s.path").alias("label"))
    )
    return rival.unionByName(old).groupBy("query_id", "label").agg(F.min("at").alias("at"))


def recency(ranked: DataFrame) -> DataFrame:
    """For the intent current-state, matching rows first, the newest first; other intents are unchanged."""
    now = F.col("intent") == "current-state"
    head = now & F.col("authority_match")
    order = Window.partitionBy("query_id").orderBy(
        F.when(now & ~F.col("authority_match"), 1).otherwise(0), F.when(head, -F.col("updated_at_ns")).otherwise(0), "rank"
    )
    return ranked.withColumn("rank", F.row_number().over(order))

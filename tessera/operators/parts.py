"""Connected parts of a graph, by rounds whose results are tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.working import materialised, plain_unions


def connected_parts(edges: DataFrame) -> DataFrame:
    """(node, part): part is the smallest node that edges (a, b) reach.

    Each round every root that an edge leaves hooks to a smaller root beside it, or, in every other round, to one that is
    smaller by a hash of that round, so that no order of ids makes long rounds; chains of hooks are then halved until each
    node hangs on its root, edges are rewritten to roots, and those within a root fall away. Rounds end when no edge
    is left; there is no limit to count.
    """
    plain_unions(edges.sparkSession)
    live = materialised(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "live")
    ends = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    home = materialised(ends.select("node", F.col("node").alias("root")), "home")
    turn = 0
    while not live.isEmpty():
        weigh = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.lit(t), c))
        both = live.union(live.select("b", "a"))
        lower = F.min(F.when(weigh("b") < weigh("a"), F.struct(weigh("b").alias("w"), F.col("b").alias("to"))))
        hook = materialised(both.groupBy("a").agg(lower["to"].alias("to")).select(F.col("a").alias("node"), F.coalesce("to", "a").alias("up")), "hook")
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = materialised(hook.join(above, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "jumped")
            hook = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        up = lambda c: hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        live = materialised(live.join(up("a"), "a").join(up("b"), "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).where("a <> b").distinct(), "live")
        home = materialised(home.join(up("root"), "root", "left").select("node", F.coalesce("root_up", "root").alias("root")), "home")
        turn += 1
    smallest = home.groupBy("root").agg(F.min("node").alias("part"))
    return home.join(smallest, "root").select("node", "part")

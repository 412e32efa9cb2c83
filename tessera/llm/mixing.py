"""Mixing sources to target weights: subset-sum fitting of each source's budget by document length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3
#: Budget in words that the dynamic program covers; what exceeds it is filled by length shares before.
DP_WORDS = 1 << 16
#: Ranges of the seeded hash among which the documents of one length are counted.
SLOTS = 1024


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, get the weights in turn. The sum of all sizes is shared by
    weight; a target stops at `ceiling` times its source's size and the excess goes to the others by
    weight. That is the level L with sum(min(cap, L * weight)) = total, found by running sums over
    the sources ordered by cap / weight. The windows hold one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn(
        "weight", F.element_at(turn, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    ).withColumn("cap", (F.col("source_size") * ceiling).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select(
        "source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target")
    )


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, at most counts, for a sum as near budget as possible.

    Each length first gives its share of the budget, then longer ones give one each while they fit.
    A bounded knapsack over what is left fits the rest: a bit set of reachable sums, in which
    each count is split into powers of two.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    live = np.flatnonzero(lengths > 0)
    total = int((lengths[live] * counts[live]).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        taken[live] = counts[live]
        return taken
    for i in live:
        taken[i] = int(counts[i]) * budget // total
    rest = budget - int((taken * lengths).sum())
    for i in sorted(live, key=lambda i: -lengths[i]):
        if rest <= dp_words // 2:
            break
        more = min(int(counts[i] - taken[i]), (rest - dp_words // 4) // int(lengths[i]))
        if more > 0:
            taken[i] += more
            rest -= more * int(lengths[i])
    # sums reach a little beyond the budget, so that the nearest may lie above it
    reach = int(rest + min(int(lengths[live].min()), rest + 1))
    full = (1 << (reach + 1)) - 1
    sums, steps = 1, []
    for i in sorted(live, key=lambda i: -lengths[i]):
        left, part = min(int(counts[i] - taken[i]), reach // int(lengths[i])), 1
        while left > 0:
            part = min(part, left)
            new = (sums << (part * int(lengths[i]))) & full & ~sums
            if new:
                steps.append((i, part, new))
                sums |= new
            left -= part
            part *= 2
        if sums >> rest & 1:
            break
    below = (sums & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = sums >> rest
    over = rest + ((above & -above).bit_length() - 1) if above else None
    at = over if over is not None and over - rest < rest - below else below
    for i, part, new in reversed(steps):
        if new >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source's (size, docs): whole passes over it, and documents of each size taken once more."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // size) if size else 0
    pdf = pdf.sort_values("size")
    more = fit_counts(pdf["size"].to_numpy(), pdf["docs"].to_numpy(), round(target - passes * size))
    return pdf.assign(passes=passes, more=more)[["source", "size", "docs", "source_size", "target", "passes", "more"]]


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    ceiling: int = CEILING,
    seed: int = 17,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken, and row_col if one is named.

    `times` is how often the mix takes the document (0 to `ceiling`), taken = times * size. A
    source's target is made of whole passes over its documents and of a remainder, for which
    documents are counted by exact length and `fit_counts` sets how many of each length to take.
    Of a length's documents those with the smallest seeded hash of id are taken: the hash range
    is cut in SLOTS ranges, counts per range find the range in which the number is reached, and
    only that range's documents are ranked, so that no task holds all documents of a length.

    A task that fits a source holds one row per distinct length, whatever its documents.
    Nulls: a null text has size 0; a null source is a source, last in order; null ids are kept. Texts of
    size 0 are taken once per whole pass. Rows that share id, source and size are interchangeable. An
    empty table gives no rows. Reruns give the same rows.
    """
    also = [] if row_col is None else [row_col]
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *also
        ),
        "sizes",
    )
    lengths = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
    targets = source_targets(lengths.select("source", (F.col("size") * F.col("docs")).alias("size")), weights, ceiling)
    fitted = lengths.join(
        targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    ).select("source", "size", "docs", "source_size", "target")
    schema = "source string, size long, docs long, source_size long, target double, passes long, more long"
    plan = written(fitted.groupBy("source").applyInPandas(_plan, schema), "plan")

    hashed = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "size")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    keyed = plan.withColumn("key", key).drop("source")
    rows = (
        rows.withColumn("key", key)
        .join(keyed, ["key", "size"])
        .withColumn("hash", hashed)
        .withColumn("slot", F.when(F.col("docs") > SLOTS, F.pmod("hash", F.lit(SLOTS))).otherwise(0).cast("int"))
    )
    part = rows.where("more > 0 and more < docs")
    slots = part.groupBy("key", "size", "slot").agg(F.count(F.lit(1)).alias("n"), F.first("more").alias("more"))
    upto = Window.partitionBy("key", "size").orderBy("slot")
    slots = slots.withColumn("before", F.sum("n").over(upto) - F.col("n")).select(
        "key",
        "size",
        F.when(F.col("before") < F.col("more"), F.col("slot")).alias("last"),
        (F.col("more") - F.col("before")).alias("need"),
        "n",
    )
    slots = slots.where("last is not null").select("key", "size", F.col("last").alias("slot"), "need", "n")
    whole = rows.where("more = 0 or more >= docs").withColumn("extra", (F.col("more") > 0).cast("int"))
    chosen = part.join(slots, ["key", "size", "slot"], "left").withColumn("need", F.coalesce("need", F.lit(0)))
    clear = chosen.where("need = 0 or need >= n").withColumn("extra", (F.col("need") > 0).cast("int"))
    edge = chosen.where("need > 0 and need < n")
    ranked = edge.withColumn(
        "extra",
        (F.row_number().over(Window.partitionBy("key", "size", "slot").orderBy("hash", "doc_id", *also)) <= F.col("need")).cast("int"),
    )
    cols = ["doc_id", "source", "size", "source_size", "target", (F.col("passes") + F.col("extra")).alias("times"), *also]
    out = whole.select(*cols).unionByName(clear.select(*cols)).unionByName(ranked.select(*cols))
    return out.withColumn("taken", F.col("times") * F.col("size"))

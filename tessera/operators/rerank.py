"""Rescoring of the head of ranked candidates, and the protocol of what scores them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Reranker(Protocol):
    """Scores passages against a query; a higher score is a better passage. It must be picklable: tasks run it."""

    name: str

    def score(self, query: str, passages: Sequence[str]) -> Sequence[float]: ...


class OverlapReranker:
    """Share of a query's distinct words that a passage holds, less a little for its length; it needs no model."""

    name = "overlap"

    def score(self, query: str, passages: Sequence[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(p.lower().split())) / max(1, len(asked)) - 1e-6 * len(p) for p in passages]


def _scored(front: DataFrame, reranker: Reranker) -> DataFrame:
    """Heads (query_id, query, rank, text, ...) in order of their score, ties by old rank."""

    @F.pandas_udf("double")
    def scores(query: pd.Series, text: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=query.index)
        for q, at in query.groupby(query).groups.items():
            out.loc[at] = [float(x) for x in reranker.score(q, text.loc[at].fillna("").tolist())]
        return out

    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return front.withColumn("rerank_score", scores(F.col("query"), F.coalesce("text", F.lit("")))).withColumn("rank", F.row_number().over(order))


def rerank(ranked: DataFrame, reranker: Reranker, limit: int, texts: DataFrame | None = None) -> DataFrame:
    """ranked (query_id, query, rank, text, ...) with rerank_score: of each query the first max(limit, 1) are rescored and ordered by
    score, ties by old rank; the rest follow as they were, with a null score.

    Only heads reach Python, in Arrow batches grouped by query within a batch; no query's candidates have to meet in one task.
    With texts (id, text) ranked has an id and no text: texts are joined to the heads only, and left out of the result.
    """
    head = max(limit, 1)
    front = ranked.where(F.col("rank") <= head)
    front = _scored(front, reranker) if texts is None else _scored(front.join(texts.select("id", "text"), "id"), reranker).drop("text")
    rest = ranked.where(F.col("rank") > head).withColumn("rerank_score", F.lit(None).cast("double"))
    return front.unionByName(rest)

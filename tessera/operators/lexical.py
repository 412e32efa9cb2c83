"""BM25 over weighted columns by a positional inverted index, for many queries in one plan."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import query_terms, tokens
from tessera.sources.working import materialised

K1, B = 1.2, 0.75
#: Weights of an index row's columns.
WEIGHTS: Mapping[str, float] = {"text": 1.0, "section_name": 2.0, "heading": 3.0, "title": 4.0}
Analyse = Callable[[Column], Column]


@dataclass(frozen=True)
class LexicalIndex:
    """postings (token, id, cell, weight, at): where a token stands in a cell of a row; lengths (id, length) of all rows.

    An index that isn't written has places (id, cell, weight, pos, token), from which its postings are gathered.
    """

    postings: DataFrame
    lengths: DataFrame
    analyse: Analyse = tokens
    places: DataFrame | None = None

    def of_cells(self, *cells: int) -> LexicalIndex:
        """The index of some cells only, by their place in the weights; lengths stay those of whole rows."""
        of = F.col("cell").isin(*cells)
        return LexicalIndex(self.postings.where(of), self.lengths, self.analyse, None if self.places is None else self.places.where(of))

    def held(self, phrases: DataFrame) -> LexicalIndex:
        """The index of the phrases' tokens only, written: all rows are read once, and of them only these tokens are shuffled."""
        own = materialised(phrases.select(F.explode(F.split("phrase", " ")).alias("token")).distinct(), "tokens")
        if self.places is None:
            few = self.postings.join(own, "token", "left_semi")
        else:
            few = gathered(self.places.join(own, "token", "left_semi"))
        return LexicalIndex(materialised(few, "held"), self.lengths, self.analyse)

    def stats(self) -> DataFrame:
        """One row: n_rows and mean_length."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n_rows"), (F.sum("length") / F.count(F.lit(1))).alias("mean_length"))


def build_index(rows: DataFrame, id_col: str, weights: Mapping[str, float] = WEIGHTS, analyse: Analyse = tokens, path: str | None = None) -> LexicalIndex:
    """The index of rows. Cells are columns, so phrases never span them. Texts are analysed once.

    A row's tokens are gathered to positions before they are shuffled. With a path the tables are written: postings in
    ranges of (token, id), so that a hot token is split and a query's tokens read few row groups. Writing them takes several times the
    disk of the texts; a batch of queries that is known at once is better asked of an index without a path, which reads the texts.
    """
    cells = [F.struct(F.lit(n).alias("cell"), F.lit(float(w)).alias("weight"), analyse(F.col(c)).alias("t")) for n, (c, w) in enumerate(weights.items()) if c in rows.columns]
    analysed = rows.select(F.col(id_col).alias("id"), F.array(*cells).alias("cells"))
    if path is not None:
        analysed = _kept(analysed, f"{path}/analysed")
    lengths = analysed.select("id", F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.size(c["t"])).alias("length"))
    each = analysed.select("id", F.explode("cells").alias("c")).select("id", "c.cell", "c.weight", F.posexplode("c.t").alias("pos", "token"))
    if path is None:
        return LexicalIndex(gathered(each), lengths, analyse, each)
    return LexicalIndex(_kept(gathered(each).repartitionByRange("token", "id").sortWithinPartitions("token", "id"), f"{path}/postings"), lengths, analyse)


def gathered(places: DataFrame) -> DataFrame:
    """Postings of places (id, cell, weight, pos, token)."""
    return places.groupBy("token", "id", "cell", "weight").agg(F.collect_list("pos").alias("at"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query_phrases(queries: DataFrame, analyse: Analyse = tokens) -> DataFrame:
    """(query_id, phrase, words) of each query's terms; a joined term is a phrase of adjacent tokens."""
    terms = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    words = terms.select("query_id", analyse(F.col("term")).alias("t")).where(F.size("t") > 0)
    return words.select("query_id", F.array_join("t", " ").alias("phrase"), F.size("t").alias("words")).distinct()


def occurrences(index: LexicalIndex, phrases: DataFrame) -> DataFrame:
    """(id, phrase, f): weighted occurrences of every phrase in every row that has it.

    Postings of the phrases' tokens only are read. Single words are what they hold. Longer phrases come from their tokens
    put back in order of position, cell by cell: each run of adjacent ones, of the lengths that phrases have, is looked up once, so the
    work is that of the postings however many phrases begin with one word. Which side is broadcast, if any, is the planner's choice by size.
    """
    wanted = phrases.select("phrase", "words").distinct()
    lengths = sorted(r["words"] for r in wanted.select("words").distinct().collect())
    found = []
    if 1 in lengths:
        single = wanted.where("words = 1").select(F.col("phrase").alias("token"))
        hits = index.postings.join(single, "token", "left_semi")
        found.append(hits.select("id", F.col("token").alias("phrase"), (F.col("weight") * F.size("at")).alias("f")))
    longer = [n for n in lengths if n > 1]
    if longer:
        runs = wanted.where("words > 1")
        tokens = runs.select(F.explode(F.split("phrase", " ")).alias("token")).distinct()
        held = index.postings.join(tokens, "token", "left_semi").repartition("id", "cell").select("id", "cell", "weight", "token", F.explode("at").alias("pos"))
        order = Window.partitionBy("id", "cell").orderBy("pos")
        after = [F.lead("token", k).over(order).alias(f"t{k}") for k in range(1, longer[-1])]
        ends = [F.lead("pos", n - 1).over(order).alias(f"p{n}") for n in longer]
        read = held.select("id", "weight", "pos", F.col("token").alias("t0"), *after, *ends)
        each = [F.when(F.col(f"p{n}") == F.col("pos") + (n - 1), F.concat_ws(" ", *(f"t{k}" for k in range(n)))) for n in longer]
        said = read.select("id", "weight", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("phrase"))
        found.append(said.join(runs.select("phrase"), "phrase", "left_semi").select("id", "phrase", F.col("weight").alias("f")))
    if not found:
        return index.postings.select("id", F.col("token").alias("phrase"), F.col("weight").alias("f")).limit(0)
    return functools.reduce(DataFrame.unionByName, found).groupBy("id", "phrase").agg(F.sum("f").alias("f"))


def _alike(phrases: DataFrame) -> DataFrame:
    """(query_id, ask): queries of the same phrases have one ask, the lowest query_id among them. Written, so that its size is known."""
    sets = phrases.groupBy("query_id").agg(F.sort_array(F.collect_set("phrase")).alias("said"))
    first = sets.groupBy("said").agg(F.min("query_id").alias("ask"))
    return materialised(sets.join(first, "said").select("query_id", "ask"), "alike")


def _scores(index: LexicalIndex, phrases: DataFrame, alike: DataFrame, documents: DataFrame | None) -> DataFrame:
    """(ask, id, score): each ask is scored once, whatever the number of its queries. documents: (id), or (ask, id)."""
    asks = phrases.select("query_id", "phrase").join(alike.where("query_id = ask"), "query_id").select("ask", "phrase").distinct()
    # both the phrases' holders and the parts read it
    found = materialised(occurrences(index.held(phrases), phrases), "occurrences")
    holders = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    raw = F.log((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = holders.crossJoin(F.broadcast(index.stats())).select("phrase", "mean_length", F.when(raw > 0, raw).otherwise(F.lit(1e-6)).alias("idf"))
    # written, so that its size is known: while it fits a broadcast, what was found is dealt by row only, never by phrase
    said = materialised(asks.join(idf, "phrase"), "said")
    if documents is not None:
        found = found.join(documents.select("id").distinct(), "id", "left_semi")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    asked = found.join(index.lengths, "id").join(said, "phrase").select("ask", "id", part.alias("part"))
    if documents is not None and "ask" in documents.columns:
        asked = asked.join(documents.select("ask", "id").distinct(), ["ask", "id"], "left_semi")
    return asked.groupBy("ask", "id").agg(F.sum("part").alias("score"))


def bm25(index: LexicalIndex, phrases: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the sum over a query's phrases; statistics are of the whole index.

    documents: ids to which results are restricted, for all queries, or for each if it has a query_id (a
    semi-join after the statistics). Queries of the same phrases are scored once; their rows are made last, by a join that
    shuffles nothing while the queries fit a broadcast.
    """
    phrases = materialised(phrases, "phrases")
    alike = _alike(phrases)
    if documents is None or "query_id" not in documents.columns:
        only = None if documents is None else documents.select(F.col(documents.columns[0]).alias("id"))
        spark = alike.sparkSession
        # a number that stays: a few MB of scores become all their queries' rows
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        return _scores(index, phrases, alike, only).repartition(parts, "id").join(alike, "ask").select("query_id", "id", "score")
    own = documents.select("query_id", "id").distinct().join(alike, "query_id")
    return _scores(index, phrases, alike, own).join(own, ["ask", "id"]).select("query_id", "id", "score")


def best(index: LexicalIndex, phrases: DataFrame, k: int, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best of each query by `bm25`, rounded to 9 places, ties by id.

    Queries of the same phrases share their k, so all matches are ranked once an ask, not once a query. documents: ids, for all queries.
    """
    phrases = materialised(phrases, "phrases")
    alike = _alike(phrases)
    only = None if documents is None else documents.select(F.col(documents.columns[0]).alias("id"))
    first = top_k(_scores(index, phrases, alike, only), k, F.round("score", 9).desc(), "ask")
    return first.join(alike, "ask").select("query_id", "id", "score", "rank")


def top_k(scored: DataFrame, k: int, by: Column, group: str = "query_id", key: str = "id") -> DataFrame:
    """The first k of each group by `by`, ties by key, with their rank. Spark limits groups before the shuffle."""
    order = Window.partitionBy(group).orderBy(by, F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

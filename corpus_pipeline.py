"""A corpus pipeline: toxicity, exact dedup, MinHash near-dedup, mixing to target weights, packing.

Each stage works on all rows the one before kept, written as Parquet and read again.

In every stage: a row goes or stays by its own text, whatever its id, so repeated ids and null ids are no special case; of rows that tie,
repeated rows included, the first by place in the files stays. Null texts count as empty; empty texts are equal to one another (one stays) and
near nothing. An empty table gives an empty one. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_table_path, small_batches
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.minhash import minhash_components
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.toxicity import score_toxicity

#: Each stage decides by row, under a key in this column; ids may repeat or be null.
ROW = "__row"
#: Bits of a key for a row's place in its file, above which is the file's number.
ROW_BITS = 40
#: Ids that a broadcast holds at most; beyond it the planner joins by shuffle.
BROADCAST_IDS = 1_000_000


def _table(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    path = new_table_path(spark, name)
    with small_batches(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row: its file and its place in it; rows that aren't those of files are written first.

    The key stays the same in every read, however the files are split.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = _table(spark, "rows", docs)
    names = sorted(r[0] for r in docs.select(F.col("_metadata.file_path")).distinct().collect())
    files = spark.createDataFrame(list(enumerate(names)), "__file long, __path string")
    at = docs.select("*", F.col("_metadata.file_path").alias("__in"), F.col("_metadata.row_index").alias("__at"))
    at = at.join(F.broadcast(files), F.col("__in") == F.col("__path"))
    return at.select(*docs.columns, (F.shiftleft("__file", ROW_BITS) + F.col("__at")).alias(ROW))


def _without(spark: SparkSession, keyed: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """keyed without the rows whose keys are in rows, and without the key."""
    gone = _table(spark, name, rows.select(F.col(ROW).alias("__gone")))
    gone = F.broadcast(gone) if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else gone
    return keyed.join(gone, keyed[ROW] == gone["__gone"], "left_anti").drop(ROW)


def _all_but_first(spark: SparkSession, keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Of (row key, group), the rows beside the one of each group that has the smallest id, nulls last, then the smallest key."""
    ids = keyed.select(ROW, F.col("doc_id").cast("long").alias("__id"))
    groups = _table(spark, "groups", groups.join(ids, ROW))
    first = groups.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", ROW)).alias("first"))
    return groups.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti").select(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model doesn't reject, whatever their ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = _keyed(spark, docs)
    scored = score_toxicity(keyed, labels, row_col=ROW)
    return _without(spark, keyed, scored.where("predicted = 1"), "toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest id; of equal ids one row, null ids last."""
    keyed = _keyed(spark, docs)
    groups = exact_dedup(keyed, id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("__group"))
    return _without(spark, keyed, _all_but_first(spark, keyed, groups), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shingles of five words, at 0.8, chosen as in drop_copies."""
    keyed = _keyed(spark, docs)
    groups = minhash_components(keyed, shingle=5, percent=80, id_col=ROW)
    groups = groups.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("__group"))
    return _without(spark, keyed, _all_but_first(spark, keyed, groups), "near_copies")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    keyed = _keyed(spark, docs)
    times = mix_sources(keyed, row_col=ROW).select(F.col(ROW).alias("__taken"), F.col("times").cast("int").alias("__times"))
    times = _table(spark, "times", times.where("__times > 0"))
    times = F.broadcast(times) if times.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else times
    taken = keyed.join(times, keyed[ROW] == times["__taken"])
    taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return taken.select(*(keyed[c] for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents in sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), small=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]
#: Trained weights, tokenizers and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _table(spark, name.replace(" ", "_"), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

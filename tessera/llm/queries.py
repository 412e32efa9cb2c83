"""The operators of this package as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.cover_tree import cosine_components
from tessera.llm.edit_counts import edited_counts
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.line_dedup import drop_templates
from tessera.llm.minhash import minhash_components
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.sql import SQL
from tessera.llm.token_files import token_digests
from tessera.llm.toxicity import score_toxicity
from tessera.llm.url_filter import judge_urls, rule_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_components(_table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("times")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_templates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a template for every line of a leaf, where op8_line_dedup has the two of its SQL."""
    out = drop_templates(_table(spark, sf_dir, "documents"), rest=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(_table(spark, sf_dir, "documents"), shingle=4)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_url_filter,
        op2_packing,
        op3_toxicity,
        op4_cover_tree,
        op5_mixing,
        op6_token_files,
        op7_exact_dedup,
        op8_line_dedup,
        op8_line_dedup_all,
        op9_token_counts,
        op10_minhash,
    )
}


QUERIES["pipeline"] = corpus_pipeline.run


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

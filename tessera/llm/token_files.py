"""Token ids as Parquet list columns, written in order of document and read back selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import frugal, new_table_path, small_batches, written
from tessera.llm.tokens import encoder

#: Bytes of text that one file takes in at most, by the mean; sets the number of files.
FILE_TEXT_BYTES = 24 << 20
#: Bytes of text that are encoded at a time, and pieces cached: a task holds a row group and sorted rows beside them.
SLICE_BYTES, CACHE_PIECES = 3 << 20, 250_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _lists(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> pa.ListArray:
    """Lists of the ids of each document, end_id after each."""
    out = np.insert(ids.astype(np.int32), bounds[1:], end_id)
    return pa.ListArray.from_arrays(pa.array((bounds + np.arange(len(bounds))).astype(np.int32)), pa.array(out))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(path), TaskContext.get().partitionId(), 0
        enc.most = CACHE_PIECES
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, ids, bounds in enc.slices(texts, SLICE_BYTES):
                n = len(bounds) - 1
                sizes = np.diff(bounds) + 1
                starts = done + np.cumsum(sizes) - sizes
                done += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, n), pa.array(np.full(n, part, np.int32)), pa.array(starts), pa.array(sizes), _lists(ids, bounds, end_id)],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )

    return frugal(run)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
    encoding: str = "dictionary",
) -> None:
    """Writes doc_id, part, local_start, n_tokens and ids of every whole text, in ascending doc_id order.

    Documents are dealt by ranges of (doc_id, hash of text), sorted, then encoded where they will be
    written; `part` is the range, so files are ordered by part and rows within a file by doc_id.
    `encoding`: "dictionary" (ids of a row group index its dictionary) or "delta" (Parquet's second
    format version, whose integers are delta packed). Row groups hold ROW_GROUP_BYTES and pages
    PAGE_BYTES, with page indexes, so a reader takes one column or one document's pages only.
    Spark's committer writes the files: a lost executor's task is run again and commits once.

    A null text gives the end id alone. Null ids come first. Rows of equal id are ordered by a
    hash of their text. An empty table gives a table without rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if files is None:
        measured = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        files = max(1, -(-int(measured) // FILE_TEXT_BYTES))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(files, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    writer = (
        rows.mapInArrow(_encode(tokenizer, end_id), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", 20_000)
    )
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2")
    elif encoding != "dictionary":
        raise ValueError(f"unknown encoding {encoding!r}")
    with small_batches(docs.sparkSession):
        writer.parquet(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids from written files; start counts the ids of all documents before.

    A table of the files' sums, one row per file, is joined to the rows; running sums over it are made in one
    task, of as many rows as there are files. It is broadcast if Spark's threshold allows.
    """
    table = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = table.groupBy(F.col("part").alias("of")).agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select("of", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "sums")
    starts = (F.col("local_start") + F.col("before")).cast("long").alias("start")
    return table.join(sums, F.col("part") == F.col("of")).select("doc_id", starts, "n_tokens", "ids")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, encoding: str = "dictionary") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of files that are written for docs and read back."""
    path = new_table_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, encoding=encoding)
    back = read_token_files(docs.sparkSession, path)
    return back.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")

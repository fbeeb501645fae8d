"""Token ids as Parquet list columns that can be read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import light_batches, new_path, offsets, table
from tracewright.llm.tokens import TOKENIZER, encoded

SCHEMA = "doc_id bigint, n_tokens bigint, local_start bigint, part int, tokens array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("local_start", pa.int64()), ("part", pa.int32()), ("tokens", pa.list_(pa.int32()))])
#: Writer settings by encoding of the id column.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        ids = batch.column(0)
        for first, flat, n in encoded(batch):
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(n)), pa.array(n), pa.array(start + ends - n), pa.array(np.full(len(n), part, np.int32)), lists], schema=_ARROW
            )
            start += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, encoding: str = "dictionary", row_group_mb: int = 32, page_rows: int = 1000) -> None:
    """Tokenise every whole text and write (doc_id, n_tokens, local_start, part, tokens) in ascending doc_id order.

    Texts are range partitioned and sorted by doc_id (rows with one doc_id by a hash of the text, equal ones
    by their place in the input, so very many rows with one doc_id are cut too), then tokenised in that order, so each file is a run
    of the whole order and knows where each document starts in it. Ids have a small alphabet, so dictionary pages with bit-packed
    references are the default; `delta` writes delta binary packed pages instead. Row groups are of
    row_group_mb, pages of page_rows rows; the writer adds column and offset indexes, so a filter on
    doc_id reads few pages and a metadata query never touches the token pages.

    Null text counts as empty (its only id is the end id); a null doc_id sorts first; repeated rows
    are all written. Other columns of docs are ignored.
    """
    light_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text"), "__at"]
    ordered = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ordered.select("doc_id", "text").mapInArrow(_encode, SCHEMA).write.option("compression", "zstd")
    settings = {"parquet.block.size": str(row_group_mb << 20), "parquet.page.row.count.limit": str(page_rows)} | ENCODINGS[encoding]
    for k, v in settings.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files of write_tokens: doc_id, start (ids of all documents before), n_tokens, tokens.

    The tokens of earlier file parts are joined as a table of one row per part. Filters on doc_id
    and column selections reach the scan.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    before = offsets(files.groupBy("part").agg(F.sum("n_tokens").alias("n")), "n", "base").select("part", "base")
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        ends = np.asarray(lists.offsets)
        values = np.ascontiguousarray(np.asarray(lists.values), "<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a table read by read_tokens; taken from the ids themselves."""
    return tokens.select("doc_id", "start", "tokens").mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(read_tokens(spark, path))


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}

"""Token ids as Parquet list columns: dictionary or delta encoded, with small row groups and pages.

A file holds, in ascending doc_id order: doc_id, part (range number), local_start (ids of the range
before the row), n_tokens, tokens.  Spark's Parquet writer adds the page index; a reader that asks
for n_tokens alone, or for a range of doc_ids, reads only those column chunks and pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import partitions, ship, slices
from graphloom.llm.tokens import encoder
from graphloom.storage import StageTables

FIELDS = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"

# Options of the Parquet writer.  v1 pages with a dictionary suit ids of a vocabulary; the delta
# layout has v2 pages and no dictionary, so integers become DELTA_BINARY_PACKED.
LAYOUTS = {
    "dictionary": {
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.writer.version": "PARQUET_1_0",
    },
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def write_tokens(
    docs: DataFrame,
    path: str,
    layout: str = "dictionary",
    end_id: int = 2,
    tokenizer: str | None = None,
    row_group: int = 16 << 20,
    page: int = 256 << 10,
) -> None:
    """Encodes every whole text of docs (doc_id, text) and writes the ids in doc_id order.

    Null texts count as empty; every document ends with end_id.  Null doc_ids come first; rows of
    one doc_id are ordered by a hash of their text, so equal rows are interchangeable.
    layout: `dictionary` or `delta`; row_group, page: target bytes.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {sorted(LAYOUTS)}")
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            packed = [ids + end for ids in words.encode(batch.column("text").to_pylist())]
            sizes = np.array([len(ids) // 4 for ids in packed], dtype=np.int64)
            ends = np.cumsum(sizes)
            tokens = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(start + ends - sizes),
                    pa.array(sizes),
                    tokens,
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
            )
            start += int(ends[-1])

    ordered = (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_gl_h"))
        .repartitionByRange(partitions(spark), "doc_id", "_gl_h")
        .sortWithinPartitions("doc_id", "_gl_h")
        .select("doc_id", "text")
    )
    writer = ordered.mapInArrow(run, FIELDS).write.option("compression", "zstd")
    for key, value in LAYOUTS[layout].items():
        writer = writer.option(key, value)
    writer.option("parquet.block.size", row_group).option("parquet.page.size", page).parquet(path)


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in all ranges before each; reads the lengths alone."""
    totals = spark.read.schema("part int, n_tokens long").parquet(path)
    totals = totals.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per range of the write.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with `start`, the number of ids in all documents before each."""
    stored = spark.read.schema(FIELDS).parquet(path)
    return stored.join(document_starts(spark, path), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens"
    )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and the crc32 of its ids as unsigned 32-bit."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            sizes = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    stored = spark.read.schema(FIELDS).parquet(path).select("doc_id", "part", "local_start", "tokens")
    fields = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"
    return (
        stored.mapInArrow(run, fields)
        .join(document_starts(spark, path), "part")
        .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def encode_and_read(docs: DataFrame, **options) -> DataFrame:
    """Writes a token file set into the shared stage folder and returns its digest."""
    stage = StageTables(docs.sparkSession, "tokens")
    path = f"{stage.root}/files"
    write_tokens(docs, path, **options)
    return token_digest(docs.sparkSession, path)

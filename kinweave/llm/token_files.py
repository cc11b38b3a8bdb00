"""Operator 1: token ids as Parquet list columns, sorted by document, for selective reads.

Layout of a written corpus: ``tokens/`` has one row for each document, in ascending doc_id order
over the files, with ``ids`` (list of int, dictionary-encoded: a vocabulary fits a dictionary
page), and ``doc_id``, ``part``, ``start_in_part``, ``n_tokens`` delta-encoded (Parquet 2 pages).
Row groups are of fixed bytes and pages of few rows, with column and offset indexes, so a read of
metadata does not touch the ids, and a read of a doc_id range touches only its pages. ``parts/``
has one row for each file: its documents, tokens and the ids before it.

Cases: a null text is the empty text and still gets its end id; equal doc_ids follow each other
in the order of a hash of the text and then the text, and a null doc_id comes first; equal rows
are all kept; an empty table gives an empty corpus; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import text_column, text_slices
from kinweave.llm.encode import END_ID, encoder

ROW_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
WRITE = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode (doc_id, text) rows and write the corpus under ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, part, start = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        e = encoder(vocabulary)
        for b in text_slices(batches):
            ids, ends = e.encode_column(text_column(b), end)
            n = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                         pa.array(ids.view("<i4"))),
            ], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            start += int(ends[-1])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    ordered.select("doc_id", "text").mapInArrow(encode, ROW_SCHEMA).write.options(**WRITE).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    parts = spark.read.schema(ROW_SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"),
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("part_tokens"))
    # one row for each file, so a single task orders them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.coalesce(1).withColumn("part_start", F.coalesce(F.sum("part_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids; columns not used and pages outside the range are not read."""
    rows = spark.read.schema(ROW_SCHEMA).parquet(f"{path}/tokens")
    if first_doc is not None:
        rows = rows.filter(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        rows = rows.filter(F.col("doc_id") <= last_doc)
    starts = spark.read.parquet(f"{path}/parts").select("part", "part_start")
    return rows.join(starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            ends = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).view(np.uint8))
            sums = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Helpers shared by the operators: landed tables, Arrow access, numbering within hot groups."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.session import new_folder


FIT_ROWS = 200_000
TIE_SAMPLE = 100_000  # rows in which frequent equal rows are looked for; it moves the balance only
TIE_PART = 1_000  # more than one row in so many is frequent, so fewer than this are


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies; a cluster without it there needs ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def land(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at the written files."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column as large_string without nulls (null becomes the empty text)."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches at row boundaries so that each has about ``limit`` bytes of text.

    One row may be longer than the limit and is then a slice of its own.
    """
    for b in batches:
        if not b.num_rows:
            continue
        t = text_column(b, name)
        ends = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1 + t.offset)[t.offset:]
        row, n = 0, b.num_rows
        while row < n:
            upto = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            yield b.slice(row, upto - row)
            row = upto


def with_row_index(df: DataFrame, name: str = "_salt") -> DataFrame:
    """Add the number of each row in its file, the same whenever it is read; other tables are written first."""
    index = F.col("_metadata.row_index").alias(name)
    try:
        return df.select(*df.columns, index)
    except AnalysisException:
        return land(df, "rows").select(*df.columns, index)


def _frequent(df: DataFrame, by: str, order: Sequence[str], total: int) -> DataFrame | None:
    """Values of (by, order) that make up more than a thousandth of a bounded sample: fewer than 1,000 rows."""
    part = df.select(by, *order).sample(min(1.0, TIE_SAMPLE / max(total, 1)), seed=7)
    least = max(1, min(total, TIE_SAMPLE) // TIE_PART)
    rows = part.groupBy(by, *order).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).limit(2 * TIE_PART).drop("_n")
    found = rows.collect()
    return df.sparkSession.createDataFrame(found, rows.schema) if found else None


def in_chunks(df: DataFrame, by: str, order: Sequence[str], counts: dict, chunk_rows: int) -> DataFrame:
    """Add ``_chunk``: each value of ``by`` in hash chunks of about ``chunk_rows`` rows; takes ``_salt`` away."""
    key = [F.col(c) for c in order]
    often = _frequent(df, by, order, sum(counts.values())) if "_salt" in df.columns else None
    if often is not None:
        names = {c: f"_often{i}" for i, c in enumerate([by, *order])}
        often = F.broadcast(often.select(*[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias("_often")))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
        df = df.join(often, same, "left").drop(*names.values())
        key.append(F.when(F.col("_often"), F.col("_salt")))
    kind = df.schema[by].dataType.simpleString()
    sizes_of = df.sparkSession.createDataFrame(
        [(k, max(1, -(-n // chunk_rows))) for k, n in counts.items()], f"{by} {kind}, _chunks long")
    return df.join(F.broadcast(sizes_of), by).withColumn(
        "_chunk", F.pmod(F.xxhash64(*key), F.col("_chunks"))).drop("_chunks", "_often", "_salt")


def number_within(df: DataFrame, by: str, order: Sequence[str], counts: dict, chunk_rows: int = 256) -> DataFrame:
    """Add ``rank`` (0, 1, …) within each value of ``by``, without sorting a group in one task.

    ``counts``: rows for each value, a map of bounded size made by the caller. A group is cut
    into hash chunks of about ``chunk_rows`` rows; chunks are numbered on their own and moved by
    the sizes of the chunks before them. The order is that of (chunk, order columns), which tell
    rows apart but for equal ones. With a column ``_salt`` (``with_row_index``) rows that are equal in
    very great number are dealt over all chunks of their group; it is not returned.
    """
    x = in_chunks(df, by, order, counts, chunk_rows)
    sizes = x.groupBy(by, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(by, "_chunk").orderBy(*order)
    return (
        x.withColumn("_r", F.row_number().over(own) - 1).join(base, [by, "_chunk"])
        .withColumn("rank", F.col("_r") + F.col("_base")).drop("_r", "_base", "_chunk")
    )


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of neighbouring rows with one key, from batches sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if held and k[lo] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            held_key = k[lo]
    if held:
        yield pa.Table.from_batches(held)


def binary_rows(column: pa.Array | pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def sample(labels: DataFrame, column: str, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, classes and folds of at most ``fit_rows`` labelled rows that are not held out, by id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).withColumn("fold", fold(F.col("doc_id")).cast("int"))
    rows = rows.filter(F.col("fold") != 2).groupBy("doc_id", "fold").agg(F.max("y").alias("y"))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toPandas().sort_values("doc_id")
    return got["doc_id"].to_numpy(np.int64), got["y"].to_numpy(np.int8), got["fold"].to_numpy(np.int8)


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)

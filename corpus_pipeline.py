"""A training corpus from raw documents in five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of the documents. Stages work on whatever rows the stage before has kept, whole texts and all rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import line_dedup, mixing, near_dups, packing, toxicity
from kinweave.llm.common import importable, table
from kinweave.session import new_folder

VOCABULARY = "byte_bpe_50k.json"
WORDS_HELD = 200_000  # entries of the encoder's memo: in a pipeline it stands beside grown JVM heaps
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; rows of one doc_id go together, rows without one stay."""
    judged = toxicity.judged(docs, table(spark, sf_dir, "labels"))
    gone = judged.filter("predicted = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one document only; n_chars follows the text."""
    out = line_dedup.drop_common_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id."""
    return near_dups.keep_one(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture over the written files."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and their place in it; sequences follow the order of the files."""
    return packing.pack(mixing.written_order(docs.select("doc_id", "text")), VOCABULARY, place="place", held=WORDS_HELD)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, MinHash and a tokenizer are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each from the files that the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

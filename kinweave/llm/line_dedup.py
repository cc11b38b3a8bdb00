"""Operator 6: lines that many documents share are dropped everywhere but in one document.

A line's key is the line without outer white space and with A-Z lower-cased. Long lines are exploded
with their positions and written once, with two 64-bit hashes of their keys; each (key, document)
counts once and is reduced before it is counted, so a line in a third of all documents is an ordinary
sum, and the join that gives the positions to drop is one whose large partitions Spark splits. Texts
are moved once, to meet their positions, and put together again in time linear in their lines.

Cases: a null or empty text is one empty line and stays as it is; the largest doc_id keeps its
lines with a common key, all of them; rows with one doc_id count as one document and lose the same
lines, each text by its own positions; rows without doc_id are not counted and keep their lines; equal
rows are all kept; a text of any number of lines is one row again; an empty table gives no rows; extra columns are kept, ``n_lines`` and ``n_dropped`` replace such columns.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import land

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Positions of the lines that a text loses: doc_id, _text (hash of the text), _drop."""
    key = line_key(F.col("line"))
    long_lines = (
        docs.filter(F.col("doc_id").isNotNull())
        .withColumn("_text", F.xxhash64("text"))  # once for each text, below the explosion
        .select("doc_id", "_text", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)  # trimming only shortens
        .select("doc_id", "_text", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "_text", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))
    )
    long_lines = land(long_lines, "lines")
    pairs = long_lines.select("doc_id", "a", "b").distinct()
    common = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder")).filter(F.col("n") >= min_docs)
    lost = long_lines.join(common, ["a", "b"]).filter(F.col("doc_id") != F.col("holder"))
    return lost.groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("_drop"))


def drop_common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with their other lines joined by line breaks, and n_lines, n_dropped."""
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "\n")
    out = docs.withColumn("_text", F.xxhash64("text"))
    out = out.join(common_lines(docs, min_chars, min_docs), ["doc_id", "_text"], "left")
    out = out.withColumn("_lines", _lines(F.col("text")))
    out = out.withColumn("n_lines", F.size("_lines").cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long"))
    out = out.withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept))
    names = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]
    return out.select(*names)


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, line, pos, holder IS NOT NULL AND doc_id <> holder AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

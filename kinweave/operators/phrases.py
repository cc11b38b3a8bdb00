"""Dictionaries that are tables: phrases met with texts by equi-joins.

A dictionary of some words is best compiled into an expression (``joins.word_hits``). One of many phrases
is a table ``(phrase, label[, pos])`` of any size: the word n-grams of every text and the phrases meet on
their hashes, so the work is linear in the words of the texts, whatever the number of phrases. Texts are
taken in slices of some megabytes: a slice asks the dictionary once for each different gram.

A phrase is found where its characters, in lower case, stand between word boundaries, with the same marks
and spaces between its words; marks before its first and after its last word do not count, and a phrase
without a word is found nowhere. ``pos`` orders labels; without it labels are ordered by name.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StringType, StructField, StructType

from kinweave.operators import grams
from kinweave.session import land

WORD = r"[\p{L}\p{N}_]"
GAP = r"[^\p{L}\p{N}_]"
WIDTH = 8  # words of the longest n-gram that is tried at every word; longer phrases only where their first words may be
SLOTS = 1 << 21  # of the dictionary's filter, 64 bits each; beyond some 10 million phrases it lets more grams through


def _low(text: Column) -> Column:
    return F.lower(text).alias("text")


def _with(cut_up: DataFrame, **more: DataType) -> StructType:
    """Columns beside the text, and more after them."""
    return StructType([StructField(f.name, f.dataType) for f in cut_up.schema if f.name != "text"] + [StructField(c, kind) for c, kind in more.items()])


def _hashed(phrases: DataFrame, width: int, named: bool) -> DataFrame:
    """Each phrase with its labels, its hashes ``k1, k2`` and those of its first ``width`` words, ``h1, h2``."""
    bare = phrases.select(
        F.regexp_replace(F.lower("phrase"), f"^{GAP}+|{GAP}+$", "").alias("phrase"),
        F.struct(F.col("pos") if "pos" in phrases.columns else F.lit(0).alias("pos"), "label").alias("_label"),
    ).filter("phrase <> ''")
    each = bare.groupBy("phrase").agg(F.array_sort(F.collect_set("_label")).alias("labels"))
    each = each.select(*(["phrase"] if named else []), "labels", F.col("phrase").alias("text"))
    schema = _with(each, k1=LongType(), k2=IntegerType(), h1=LongType(), h2=IntegerType(), n_words=IntegerType())
    hashed = each.mapInArrow(partial(grams.hashed_phrases, width=width), schema)
    return hashed if named else hashed.withColumn("alike", F.xxhash64("n_words", "labels"))


def _mask() -> Column:
    return F.expr("shiftleft(1L, CAST(shiftright(k1, 32) & 63 AS INT)) | shiftleft(1L, k2 & 63)")


def _filter(keys: DataFrame) -> np.ndarray:
    """A filter of the dictionary's grams: 64 bits for each slot, two of them set by a gram; at most ``SLOTS`` slots."""
    n = keys.count()
    slots = 1 << 10
    while 64 * slots < 16 * n and slots < SLOTS:
        slots *= 2
    set_ones = keys.groupBy(F.col("k1").bitwiseAND(slots - 1).alias("slot")).agg(F.bit_or(_mask()).alias("bits")).toArrow()
    bits = np.zeros(slots, np.uint64)
    bits[set_ones["slot"].to_numpy()] = set_ones["bits"].to_numpy().view(np.uint64)
    return bits


def _found(
    df: DataFrame, keys: list[str], text_cols: list[str], phrases: DataFrame, longest: bool, width: int, what: str,
    slice_chars: int = grams.SLICE_CHARS,
) -> DataFrame:
    """``keys`` with ``pos, label`` and what ``grams.answered`` tells of them."""
    if width < 2:
        raise ValueError("the first words of a longer phrase are a gram: width is 2 or more")
    sc = df.sparkSession.sparkContext
    dictionary = land(_hashed(phrases, width, what == "hits"), "phrases")
    lengths = sorted(r["n_words"] for r in dictionary.select("n_words").distinct().collect())  # different lengths only
    begun = dictionary.filter(F.col("n_words") > width).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    known = sc.broadcast(_filter(dictionary.select("k1", "k2").unionAll(begun)))
    own = [f"key{i}" for i in range(len(keys))]
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    texts = df.select(*[F.col(c).alias(k) for c, k in zip(keys, own)], _low(text))
    # parts of the dictionary, as many as there are slices
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (df.agg(F.sum(F.length(text))).first()[0] or 0) // slice_chars)
    rows = {"slice": LongType(), "row_no": IntegerType(), "n": IntegerType(), "data": BinaryType()}
    asked = texts.mapInArrow(
        partial(grams.asked, known=known, lengths=lengths, width=width, places=what != "labels", parts=parts, most=slice_chars),
        _with(texts, dest=IntegerType(), **rows))
    part = dictionary.drop("h1", "h2").withColumn("part", F.pmod("k1", F.lit(parts)).cast("int"))
    told = ArrayType(dictionary.select(F.struct("n_words", "labels", F.lit(None).cast("string").alias("phrase"))).schema[0].dataType)
    met = asked.groupBy("dest").cogroup(part.groupBy("part")).applyInArrow(
        lambda a, b: grams.met(a, b, what == "hits"), _with(texts, **rows, told=told))
    more = {"hits": {"start": IntegerType(), "n_words": IntegerType(), "phrase": StringType()}, "labels": {},
            "counts": {"n_hits": LongType(), "n_phrases": LongType()}}[what]
    label = {f.name: f.dataType for f in dictionary.schema["labels"].dataType.elementType}
    out = _with(texts, **more, **label)
    answered = met.groupBy("slice").applyInArrow(lambda rows: grams.answered(rows, own, what, longest), out)
    return answered.withColumnsRenamed(dict(zip(own, keys)))


def phrase_hits(
    df: DataFrame, keys: list[str], text_cols: list[str], phrases: DataFrame,
    longest: bool = True, width: int = WIDTH,
) -> DataFrame:
    """Where phrases stand in texts: ``keys, start, n_words, phrase, pos, label``, a row for each label.

    ``keys`` name one text. ``longest`` leaves out hits that lie inside a longer one. Grams that a filter of the
    dictionary lets through are asked for once in a slice of texts and met with the dictionary by their hashes (80
    bits); the filter and the slices decide only where rows go. Null texts hold nothing. Phrases of more than
    ``width`` words are looked for where their first ``width`` words may stand.
    """
    return _found(df, keys, text_cols, phrases, longest, width, "hits").select(*keys, "start", "n_words", "phrase", "pos", "label")


def phrase_join(
    df: DataFrame, id_col: str, own_key: str, text_cols: list[str], phrases: DataFrame,
    out: str = "vinculo", longest: bool = True,
) -> DataFrame:
    """One row per text and other label whose phrases occur, with hits and different phrases."""
    found = _found(df, [id_col, own_key], text_cols, phrases, longest, WIDTH, "counts")
    other = found.filter(F.coalesce(F.lower(F.trim(own_key)) != F.lower(F.trim("label")), F.lit(True)))
    return other.select(id_col, own_key, F.col("label").alias(out), "n_hits", "n_phrases")


def _labels_of(df: DataFrame, id_col: str, text_cols: list[str], phrases: DataFrame) -> DataFrame:
    """Different labels of each text."""
    return _found(df, [id_col], text_cols, phrases, False, WIDTH, "labels")


def infer_by_phrases(df: DataFrame, id_col: str, text_cols: list[str], phrases: DataFrame, out: str = "pais") -> DataFrame:
    """First label in dictionary order with a phrase in the text; texts without one are not returned."""
    hits = _labels_of(df, id_col, text_cols, phrases)
    return hits.groupBy(id_col).agg(F.min(F.struct("pos", "label"))["label"].alias(out))


def mentions_by_phrases(df: DataFrame, id_col: str, own: str, fields: dict[str, str], phrases: DataFrame) -> DataFrame:
    """Other labels named in each field, once per kind, with the first field."""
    per_field = F.array(*[F.struct(F.lit(i).alias("_field"), F.col(f).alias("_text")) for i, f in enumerate(fields)])
    rows = df.select(id_col, own, F.inline(per_field))
    hits = _found(rows, [id_col, own, "_field"], ["_text"], phrases, False, WIDTH, "labels")
    other = hits.filter(F.coalesce(F.lower(F.trim(own)) != F.lower(F.trim("label")), F.lit(True)))
    of_field = lambda names: F.get(F.array(*[F.lit(f) for f in names]), F.col("_field"))
    kind = of_field(fields.values()).alias("tipo_vinculo")
    first = other.groupBy(id_col, own, F.col("label").alias("vinculo"), kind).agg(F.min("_field").alias("_field"))
    return first.withColumn("campo_detectado", of_field(fields)).drop("_field")


def targets_by_phrases(df: DataFrame, id_col: str, text_cols: list[str], phrases: DataFrame, out: str = "conecta_con") -> DataFrame:
    """Labels with a phrase in the text as one list, in dictionary order."""
    hits = _labels_of(df, id_col, text_cols, phrases)
    labels = hits.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("pos", "label"))).alias("_l"))
    return labels.select(id_col, F.array_join(F.transform("_l", lambda v: v["label"]), ", ").alias(out))

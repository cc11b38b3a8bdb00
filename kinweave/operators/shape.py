"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import any_of, as_col, not_blank, null_if_empty


def has_key(df: DataFrame, col: str, na_text: str = "NA") -> DataFrame:
    """Rows whose key is neither NULL, blank nor the text ``NA``."""
    return df.filter((F.trim(col) != "") & (F.col(col) != na_text))


def keep_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select([c for c in cols if c in df.columns])


def suffix_cols(df: DataFrame, cols: list[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in cols})


def default_chain(cols: list[str | Column], default: str) -> Column:
    """First non-blank value, lower case and trimmed, else a default."""
    texts = [null_if_empty(F.trim(as_col(c))) for c in cols]
    return F.lower(F.coalesce(*texts, F.lit(default)))


def ensure_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Add the missing columns as typed NULL."""
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def families_filter(
    df: DataFrame, config: dict[str, list[str]], cols: list[str], country: str = "pais"
) -> DataFrame:
    """Rows of a country that name one of its families in any of the columns."""
    keep = F.lit(False)
    for pais, words in config.items():
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).rlike(any_of(words))
        keep = keep | ((F.col(country) == pais) & hit)
    return df.filter(keep)


def bucket(col: str | Column, bounds: list[float], labels: list[str], default: str | None = None) -> Column:
    """Named band of a number; every bound opens the next band, NULL takes the default."""
    c = as_col(col)
    out = F.when(c < bounds[0], labels[0])
    for hi, label in zip(bounds[1:], labels[1:]):
        out = out.when(c < hi, label)
    out = out.when(c >= bounds[-1], labels[-1])
    return out.otherwise(default) if default is not None else out


def first_match(col: str | Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """Label of the first pattern that matches the lower-cased text."""
    text = F.lower(as_col(col))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, label in rules:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(F.lit(default).cast("string"))


def flag_bank(df: DataFrame, col: str, patterns: dict[str, str]) -> DataFrame:
    """One boolean per pattern, false for a missing text."""
    text = F.lower(F.col(col))
    return df.withColumns(
        {name: F.coalesce(text.rlike(p), F.lit(False)) for name, p in patterns.items()}
    )


def has_value(col: str | Column) -> Column:
    return not_blank(col)


def top_or_other(df: DataFrame, col: str, k: int, other: str, out: str | None = None) -> DataFrame:
    """Values outside the ``k`` most frequent become ``other``."""
    top = (
        df.filter(F.col(col).isNotNull())
        .groupBy(col).count()
        .orderBy(F.desc("count"), col).limit(k)
        .select(F.col(col).alias("_top"))
    )
    joined = df.join(F.broadcast(top), F.col(col) == F.col("_top"), "left")  # at most k rows
    return joined.withColumn(out or col, F.coalesce("_top", F.lit(other))).drop("_top")


def in_values(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(col).isin(values))

"""Aggregation and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ranking import join_back, number_rows, running_total

def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def summarise(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Several measures per group in one pass."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def n_if(cond: Column) -> Column:
    """Rows for which a condition holds; 0 for none."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def ratio(num: Column, den: Column, digits: int = 1, empty: float | None = 0.0) -> Column:
    pct = F.round(100 * num / F.nullif(den, F.lit(0)), digits)
    return pct if empty is None else F.coalesce(pct, F.lit(empty))


def rate(df: DataFrame, keys: list[str], predicate: Column, digits: int = 1) -> DataFrame:
    """Group size, hits and percentage of hits."""
    out = summarise(df, keys, {"total": F.count("*"), "casos": n_if(predicate)})
    return out.withColumn("pct", ratio(F.col("casos"), F.col("total"), digits))


def distinct_by(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return summarise(df, keys, {f"n_{c}": F.count_distinct(c) for c in cols})


def join_text(df: DataFrame, keys: list[str], col: str, order: str | None = None) -> DataFrame:
    """Distinct values of a group as numbered rows, in value order or first-seen order.

    One row for each value at every size; a reader joins the texts where it shows them.
    """
    first = F.min(order) if order else F.lit(0)
    values = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("valor")).agg(first.alias("_o"))
    return number_rows(values, keys, [F.col("_o"), F.col("valor")], "ordinal").drop("_o")


def in_both(df: DataFrame, key: str, side: str, a: str, b: str) -> DataFrame:
    """Groups with rows on both sides, and the counts of each."""
    out = df.groupBy(key).agg(
        n_if(F.col(side) == a).alias("n_a"), n_if(F.col(side) == b).alias("n_b"),
        F.count("*").alias("total"),
    )
    return out.filter((F.col("n_a") > 0) & (F.col("n_b") > 0))


def edge_context(edges: DataFrame, text: str, context: str, pos: str) -> DataFrame:
    """All relation texts of an edge as numbered rows, each with the edge's first context."""
    keys = ["src", "dst"]
    first = edges.groupBy(*keys).agg(
        F.min(F.struct(F.col(pos).alias("p"), F.col(context).alias("c")))["c"].alias("contexto")
    )
    return join_text(edges, keys, text, order=pos).join(first, keys)


def quantile_value(df: DataFrame, col: str, p: float) -> float | None:
    """Exact quantile with linear interpolation between ranks.

    Works on the frequency table; its running count is split into chunks when large.
    """
    freq = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    run = running_total(freq, [], [F.col(col)], F.col("_n"), "_c")
    total = run.agg(F.max("_c")).first()[0]
    if not total:
        return None
    h = (total - 1) * p
    lo = int(h)
    hi = min(lo + 1, total - 1)
    v = run.agg(
        F.min(F.when(F.col("_c") > lo, F.col(col))).cast("double").alias("lo"),
        F.min(F.when(F.col("_c") > hi, F.col(col))).cast("double").alias("hi"),
    ).first()
    return v["lo"] + (h - lo) * (v["hi"] - v["lo"])


def quantile_flag(df: DataFrame, col: str, p: float, name: str = "destacado") -> DataFrame:
    """Rows at or above the quantile of the whole column."""
    return df.withColumn(name, F.col(col) >= F.lit(quantile_value(df, col, p)))


def totals(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row: how many rows carry each flag."""
    return df.agg(F.count("*").alias("total"), *[n_if(F.col(f)).alias(f"n_{f}") for f in flags])


def stats_by(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.avg(col), 4).alias("media"),
        F.max(col).alias("maximo"), F.min(col).alias("minimo"),
    )


def reaggregate(df: DataFrame, keys: list[str], sum_col: str) -> DataFrame:
    """Roll a count table up to fewer keys."""
    return df.groupBy(*keys).agg(F.sum(sum_col).alias(sum_col))


def label_counts(df: DataFrame, label: str, pais: str) -> DataFrame:
    """Counts per label and per country and label in one pass."""
    return df.groupingSets([[label], [pais, label]], pais, label).agg(
        F.grouping(pais).cast("int").alias("es_global"), F.count("*").alias("n")
    )


def matrix(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Count matrix with zero fill; the column values are declared."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0, subset=values)


def to_long(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def densify(df: DataFrame, k1: str, k2: str, values: list, value: str, fill: int = 0) -> DataFrame:
    """Every first key with each of the declared second keys, and a fill value."""
    grid = df.select(k1).dropna().distinct().withColumn(k2, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df.select(k1, k2, value), [k1, k2], "left").withColumn(
        value, F.coalesce(value, F.lit(fill).cast("long"))
    )


def widen_ordinal(df: DataFrame, id_col: str, col: str, prefix: str, order: list) -> DataFrame:
    """Each value with its ordinal label, ``prefix1``, ``prefix2``, … (G16), in long form.

    The number of columns of the wide form would depend on the data.
    """
    numbered = number_rows(df.select(id_col, col), [id_col], order, "_k")
    return numbered.select(id_col, F.concat(F.lit(prefix), F.col("_k")).alias("ordinal"), F.col(col).alias("valor"))


def coverage(df: DataFrame, key: str, family: str, office: Column) -> DataFrame:
    """Rows, families, rows with an office and their percentage."""
    out = summarise(
        df, [key],
        {"personas": F.count("*"), "familias": F.count_distinct(family), "con_cargo": n_if(office)},
    )
    return out.withColumn("pct_con_cargo", ratio(F.col("con_cargo"), F.col("personas")))


def pct_of(df: DataFrame, nums: list[str], den: str, digits: int = 1) -> DataFrame:
    """Percentages of one count; NULL for a zero denominator."""
    return df.withColumns(
        {f"pct_{n}": ratio(F.col(n), F.col(den), digits, empty=None) for n in nums}
    )

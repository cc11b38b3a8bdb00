"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ranking import first_per_key


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Union by name; a missing column is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """Every id at either end of an edge."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def key_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def key_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def append_keep_base(base: DataFrame, extra: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Append rows; on the same key the base row stays."""
    both = base.withColumn("_prio", F.lit(0)).unionByName(
        extra.withColumn("_prio", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(both, [key], [F.col("_prio"), *[F.col(c) for c in order]]).drop("_prio")


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union over the columns both sides have."""
    cols = [c for c in a.columns if c in b.columns]
    return a.select(cols).unionByName(b.select(cols))


def curated_edges(persons: DataFrame, rules: list[tuple[str, str, str]], id_col: str, name_col: str) -> DataFrame:
    """Edges by name pattern, for the rules that find a person at both ends.

    All patterns are looked up in one pass; the smallest id is the person found.
    """
    low = F.lower(F.col(name_col))
    found = persons.agg(
        F.array(
            *[
                F.struct(
                    F.min(F.when(low.rlike(a), F.col(id_col))).alias("src"),
                    F.min(F.when(low.rlike(b), F.col(id_col))).alias("dst"),
                    F.lit(rel).alias("relation_type"),
                )
                for a, b, rel in rules
            ]
        ).alias("r")
    )
    return found.select(F.inline("r")).dropna(subset=["src", "dst"])


def add_curated_edges(
    edges: DataFrame, persons: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "person_id",
    name_col: str = "nombre",
) -> DataFrame:
    return edges.select("src", "dst", "relation_type").unionByName(
        curated_edges(persons, rules, id_col, name_col)
    )

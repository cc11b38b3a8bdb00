"""Window operators and top-k.

A window holds one group in one task. Ranks that are cut at ``k`` are safe: Spark
keeps ``k`` rows per group on the map side. Whole ranks and running sums are made in
range chunks of (group, order): chunks are summed on their own and moved by the sums
of the chunks before them, so no task sees a whole hot group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.session import cut


def join_back(df: DataFrame, per_group: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Attach one row per group to the rows of the group."""
    a, b = df.alias("a"), per_group.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    extra = [F.col(f"b.{c}") for c in per_group.columns if c not in keys]
    return a.join(b, on, how).select("a.*", *extra)


def running_total(df: DataFrame, part: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` from the first row of the group to this one; ``order`` must be total.

    The chunked rows are written once: both readers must see the same chunks, and the
    bounds of a range partitioning are drawn anew each time it is computed.
    """
    keys = [F.col(p) for p in part]
    chunked = cut(df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()))
    # One row per group and chunk: a group has at most as many as there are partitions.
    totals = chunked.groupBy(*part, "_chunk").agg(F.sum(value).alias("_n"))
    before = W.partitionBy(*part).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = W.partitionBy(*part, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = chunked.withColumn(name, F.sum(value).over(local))
    joined = join_back(inside, offsets, [*part, "_chunk"])
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_chunk")


def number_rows(df: DataFrame, part: list[str], order: list, name: str) -> DataFrame:
    """Row number inside the group."""
    return running_total(df, part, order, F.lit(1).cast("long"), name)


def rank_in(df: DataFrame, part: list[str], order: list, name: str = "rank") -> DataFrame:
    """Unique rank inside the group."""
    return number_rows(df, part, order, name)


def top_with_ties(df: DataFrame, part: list[str], col: str, n: int, name: str = "ranking") -> DataFrame:
    """Rows whose rank by ``col`` is at most ``n``, ties kept.

    Ranks are found on the first ``n`` distinct values per group and their counts, so
    a value shared by very many rows is never sorted in one window.
    """
    values = top_n_per(df.groupBy(*part, col).agg(F.count("*").alias("_n")), part, [F.desc(col)], n)
    above = W.partitionBy(*part).orderBy(F.desc(col)).rowsBetween(W.unboundedPreceding, -1)
    rank = (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("int")
    keep = values.withColumn(name, rank).filter(F.col(name) <= n).drop("_n")
    return join_back(df, keep, [*part, col])


def top_n_per(df: DataFrame, part: list[str], order: list, n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows per group."""
    w = W.partitionBy(*part).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return ranked.withColumnRenamed("_rn", name) if name else ranked.drop("_rn")


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """First row per key with all its columns."""
    return top_n_per(df, key, order, 1)


def share(df: DataFrame, part: list[str], n: str, total: str = "total", pct: str = "pct") -> DataFrame:
    """Percentage of the group total."""
    totals = df.groupBy(*part).agg(F.sum(n).alias(total))
    return join_back(df, totals, part).withColumn(pct, F.round(100 * F.col(n) / F.col(total), 1))


def group_totals(df: DataFrame, part: list[str], sum_col: str, distinct_col: str) -> DataFrame:
    """Group sum and distinct count on every row."""
    totals = df.groupBy(*part).agg(
        F.sum(sum_col).alias("total"), F.count_distinct(distinct_col).alias("distintos")
    )
    return join_back(df, totals, part)


def dominant(df: DataFrame, part: list[str], value: str, n: str, name: str = "dominante") -> DataFrame:
    """Value with the largest count per group, smallest value on ties."""
    best = top_n_per(df, part, [F.desc(n), F.col(value)], 1).select(*part, F.col(value).alias(name))
    return join_back(df, best, part)


def ordinal(df: DataFrame, part: list[str], order: list, prefix: str, name: str = "ordinal") -> DataFrame:
    """``prefix1``, ``prefix2``, … inside the group."""
    numbered = number_rows(df, part, order, "_k")
    return numbered.withColumn(name, F.concat(F.lit(prefix), F.col("_k"))).drop("_k")


def segment_headers(
    rows: DataFrame, id_col: str, pos: str, label: str, value: str, header_regex: str
) -> DataFrame:
    """Offices from label rows: a blank-valued header opens a segment.

    The first ``detalle`` is the period; the last predecessor and successor win.
    """
    is_header = F.lower(F.col(label)).rlike(header_regex.lower()) & (F.col(value) == "")
    seg = running_total(
        rows.withColumn("_head", F.coalesce(is_header, F.lit(False))),
        [id_col], [F.col(pos)], F.when(F.col("_head"), 1).otherwise(0).cast("long"), "_seg",
    ).filter(F.col("_seg") > 0)
    low, body = F.lower(F.col(label)), ~F.col("_head")
    period = body & (F.col(label) == "detalle")
    before = body & low.rlike("predecesor")
    after = body & low.rlike("sucesor") & ~before

    def pick(best, cond: Column) -> Column:
        return best(F.when(cond, F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))["v"]

    return seg.groupBy(id_col, "_seg").agg(
        F.min(F.when(F.col("_head"), F.col(label))).alias("cargo"),
        pick(F.min, period).alias("periodo"),
        pick(F.max, before).alias("predecesor"),
        pick(F.max, after).alias("sucesor"),
    ).drop("_seg")


def segment_cells(df: DataFrame, id_col: str, entries: Column, header_regex: str) -> DataFrame:
    """W08 for infobox cells: no shuffle, a cell never leaves its row.

    The parsed entries and the header positions are columns of their own, so the
    lambdas read them and do not parse the text again.
    """
    def kind(e: Column) -> Column:
        low = F.lower(e["label"])
        return (
            F.when((e["value"] == "") & low.rlike(header_regex.lower()), "h").when(e["label"] == "detalle", "d")
            .when(low.rlike("predecesor"), "p").when(low.rlike("sucesor"), "s")
        )

    marked = df.select(id_col, F.transform(entries, lambda e: F.struct(
        e["label"].alias("label"), e["value"].alias("value"), kind(e).alias("k"))).alias("_e"))
    heads = marked.select(id_col, "_e", F.filter(
        F.transform("_e", lambda e, i: F.when(e["k"] == "h", i)), lambda h: h.isNotNull()).alias("_at"))
    # The outer form keeps Spark from testing the array size below the parse, which would repeat it.
    cut_up = heads.select(id_col, "_e", "_at", F.posexplode_outer("_at").alias("_k", "_start")).filter(
        F.col("_start").isNotNull())
    end = F.coalesce(F.get("_at", F.col("_k") + 1), F.size("_e"))
    offices = cut_up.select(
        id_col, F.get("_e", F.col("_start"))["label"].alias("cargo"),
        F.slice("_e", F.col("_start") + 2, end - F.col("_start") - 1).alias("_b"))

    def of_kind(k: str) -> Column:
        return F.filter("_b", lambda e: e["k"] == k)

    return offices.select(
        id_col, "cargo", F.get(of_kind("d"), F.lit(0))["value"].alias("periodo"),
        F.try_element_at(of_kind("p"), F.lit(-1))["value"].alias("predecesor"),
        F.try_element_at(of_kind("s"), F.lit(-1))["value"].alias("sucesor"),
    )


def ring_edges(df: DataFrame, part: list[str], id_col: str, order: list, close_from: int = 3) -> DataFrame:
    """Link each member to the next and the last to the first."""
    k = cut(number_rows(df, part, order, "_k").select(*part, F.col(id_col).alias("_id"), "_k"))
    step = k.select(*part, F.col("_id").alias("dst"), (F.col("_k") - 1).alias("_k"))
    chain = join_back(k, step, [*part, "_k"]).select(*part, F.col("_id").alias("src"), "dst")
    sizes = k.groupBy(*part).agg(F.max("_k").alias("_k")).filter(F.col("_k") >= close_from)
    last = join_back(sizes, k, [*part, "_k"]).select(*part, F.col("_id").alias("src"))
    first = k.filter(F.col("_k") == 1).select(*part, F.col("_id").alias("dst"))
    close = join_back(last, first, part).select(*part, "src", "dst")
    return chain.unionByName(close)


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """Global top ``n``."""
    return df.orderBy(*order).limit(n)


def filter_top(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the ``k`` most frequent keys."""
    top = (
        df.filter(F.col(key).isNotNull()).groupBy(key).count()
        .orderBy(F.desc("count"), key).limit(k).select(key)
    )
    return df.join(top, key, "left_semi")


def most_common(df: DataFrame, part: list[str], label: str, k: int) -> DataFrame:
    """Most frequent ``k`` labels per group with their counts."""
    counts = df.groupBy(*part, label).agg(F.count("*").alias("n"))
    return top_n_per(counts, part, [F.desc("n"), F.col(label)], k)


def argmax_row(df: DataFrame, col: str, tie: str) -> DataFrame:
    """Row with the largest value."""
    return top_n(df, [F.desc(col), F.col(tie)], 1)


def head_sample(df: DataFrame, order: list, n: int) -> DataFrame:
    """Deterministic first ``n`` rows."""
    return top_n(df, order, n)

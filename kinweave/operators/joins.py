"""Joins and pair generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ranking import first_per_key, join_back, number_rows


def _attrs(persons: DataFrame, key: str, attrs: list[str], end: str) -> DataFrame:
    return persons.select(
        F.col(key).alias(f"_{end}"), *[F.col(a).alias(f"{end}_{a}") for a in attrs]
    )


def enrich_dst(edges: DataFrame, persons: DataFrame, attrs: list[str], key: str = "person_id") -> DataFrame:
    """Attributes of the destination; unknown stays NULL.

    Persons grow with the data, so the join strategy is left to the size Spark sees.
    """
    dim = _attrs(persons, key, attrs, "dst")
    return edges.join(dim, edges["dst"] == dim["_dst"], "left").drop("_dst")


def enrich_both(edges: DataFrame, persons: DataFrame, attrs: list[str], key: str = "person_id") -> DataFrame:
    """Attributes of both endpoints."""
    dim = _attrs(persons, key, attrs, "src")
    out = edges.join(dim, edges["src"] == dim["_src"], "left").drop("_src")
    return enrich_dst(out, persons, attrs, key)


def join_lookup(df: DataFrame, lookup: DataFrame, key: str, cols: list[str], order: list) -> DataFrame:
    """Left join to the first lookup row per key; same-named columns are replaced."""
    dim = first_per_key(lookup, [key], order).select(key, *cols)
    return df.drop(*cols).join(dim, key, "left")


def full_zero(a: DataFrame, b: DataFrame, keys: list[str], total: str = "total") -> DataFrame:
    """Full join of two count tables, zero for the missing side."""
    na = [c for c in a.columns if c not in keys]
    nb = [c for c in b.columns if c not in keys]
    out = a.join(b, keys, "full").fillna(0, subset=[*na, *nb])
    return out.withColumn(total, sum((F.col(c) for c in [*na, *nb]), F.lit(0)).cast("long"))


def both_in(edges: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with both endpoints in a set."""
    keep = ids.select(F.col(id_col).alias("_id"))
    out = edges.join(keep, edges["src"] == keep["_id"], "left_semi")
    return out.join(keep, out["dst"] == keep["_id"], "left_semi")


def unknown_endpoints(edges: DataFrame, known: DataFrame, id_col: str = "person_id") -> DataFrame:
    """Edges whose destination is no known person."""
    have = known.select(F.col(id_col).alias("_id"))
    return edges.join(have, edges["dst"] == have["_id"], "left_anti")


def word_cond(low: Column, words: list[str], word: bool = False) -> Column:
    """Any of the words occurs in a lower-cased text; ``word`` asks for whole words."""
    cond = F.lit(False)
    for w in words:
        cond = cond | (
            low.rlike(r"(^|[^\p{L}\p{N}_])\Q" + w + r"\E($|[^\p{L}\p{N}_])") if word
            else F.contains(low, F.lit(w))
        )
    return cond


def word_hits(low: Column, kw: dict[str, list[str]], own: Column | None = None, word: bool = False) -> Column:
    """Dictionary keys whose words occur in a lower-cased text, in dictionary order.

    Built from plain conditionals, so the whole dictionary is one compiled expression.
    Give a column that holds the lower-cased text, or it is folded once per word.
    """
    def hit(label: str, words: list[str]) -> Column:
        cond = word_cond(low, words, word)
        if own is not None:
            cond = cond & F.coalesce(F.lower(F.trim(own)) != label, F.lit(True))
        return F.when(cond, F.lit(label)).otherwise("")

    return F.array_remove(F.array(*[hit(label, words) for label, words in kw.items()]), "")


def dictionary_join(
    df: DataFrame, text_cols: list[str], kw: dict[str, list[str]], own_key: str,
    out: str = "vinculo", word: bool = False,
) -> DataFrame:
    """One row per person and other group whose words occur in a text.

    The dictionary is part of the expression, so the theta join is a narrow map.
    """
    low = df.withColumn("_low", F.lower(F.concat_ws(" ", *[F.col(c) for c in text_cols])))
    return low.withColumn(out, F.explode(word_hits(F.col("_low"), kw, F.col(own_key), word))).drop("_low")


def group_pairs(links: DataFrame, a: str, b: str) -> DataFrame:
    """Every unordered pair of different groups ``a < b`` that some link connects."""
    return links.filter(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def within_pairs(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """Clique of every group, kept as its membership.

    Two members are linked when they share a group, so the ``size - 1`` links of a
    member and the pairs it opens (``n_later``: partners with a larger id) follow
    from its ordinal; the quadratic list of pairs is never written. Use
    ``linked_in_group`` to test given pairs.
    """
    members = df.select(group, F.col(id_col).alias("id")).dropna().distinct()
    numbered = number_rows(members, [group], [F.col("id")], "ordinal")
    sizes = members.groupBy(group).agg(F.count("*").alias("n_miembros"))
    return join_back(numbered, sizes, [group]).select(
        group, "id", "ordinal", "n_miembros",
        (F.col("n_miembros") - 1).alias("grado"),
        (F.col("n_miembros") - F.col("ordinal")).alias("n_later"),
    )


def linked_in_group(pairs: DataFrame, members: DataFrame, group: str, id_col: str) -> DataFrame:
    """Given pairs ``(src, dst)`` that share a group, with the group."""
    m = members.select(group, F.col(id_col).alias("_id")).dropna().distinct()
    a = pairs.join(m, pairs["src"] == m["_id"]).drop("_id")
    b = m.select(F.col(group).alias("_g"), F.col("_id"))
    return a.join(b, (a["dst"] == b["_id"]) & (a[group] == b["_g"])).drop("_id", "_g")


def insert_absent(base: DataFrame, extra: DataFrame, name_col: str) -> DataFrame:
    """Append the rows whose name, trimmed and in lower case, is not there yet."""
    key = F.lower(F.trim(F.col(name_col)))
    have = base.select(key.alias("_have")).distinct()
    new = extra.withColumn("_k", key).join(have, F.col("_k") == F.col("_have"), "left_anti").drop("_k")
    return base.unionByName(new, allowMissingColumns=True)


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which NULL keys match each other."""
    return join_back(a, b, keys, how)


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, col: str, order: list | None = None) -> DataFrame:
    """A manual value, where given, wins over the inferred one.

    Of several values for a key the first in ``order`` counts, by default the smallest.
    """
    given = overrides.filter(F.col(col).isNotNull())
    o = first_per_key(given, [key], [*(order or []), F.col(col)]).select(F.col(key).alias("_k"), F.col(col).alias("_v"))
    joined = df.join(o, df[key] == o["_k"], "left")
    return joined.withColumn(col, F.coalesce("_v", F.col(col))).drop("_k", "_v")


def attach_aggregates(persons: DataFrame, positions: DataFrame, relations: DataFrame) -> DataFrame:
    """Numbers of offices, relatives and kinds of relation on the person row (J13): one row per person.

    The offices and relatives themselves are numbered rows (``join_text``), tables of their own.
    """
    key = ["person_id"]
    offices = positions.groupBy(*key).agg(
        F.count("*").alias("n_cargos"), F.count_distinct("position_title_raw").alias("n_cargos_distintos"))
    kin = relations.groupBy(*key).agg(
        F.count("*").alias("n_familiares"), F.count_distinct("relation_type").alias("n_tipos_relacion"))
    return persons.join(offices, key, "left").join(kin, key, "left")

"""Dictionary and rule classification over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions.text import (
    any_label, any_of, as_col, country_slug, first_object, safe_text, whole_word,
)
from kinweave.operators.joins import enrich_dst, word_cond, word_hits
from kinweave.operators.ranking import first_per_key
from kinweave.operators.shape import first_match


def infer_country(
    text: str | Column, kw: dict[str, list[str]] = fixed.COUNTRY_KEYWORDS,
    exclude: str | Column | None = None, word: bool = False,
) -> Column:
    """First country of an ordered dictionary whose words occur in the text.

    Words match inside longer words too; ``word=True`` asks for whole words.
    """
    low = F.lower(F.trim(as_col(text)))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words in kw.items():
        cond = word_cond(low, words, word)
        if exclude is not None:
            cond = cond & F.coalesce(F.lower(F.trim(as_col(exclude))) != label, F.lit(True))
        out = out.when(cond, label)
    return out


def _tier(text: Column, words: dict[str, list[str]]) -> Column:
    return first_match(text, [(any_of(w), label) for label, w in words.items()], None)


def nationality(
    nac: str | Column, lugar: str | Column, texts: list[str | Column],
    cfg: dict[str, dict[str, list[str]]] = fixed.NATIONALITY_TIERS,
) -> Column:
    """Declared nationality, else birthplace, else demonym in any text."""
    combined = F.concat_ws(" ", as_col(nac), as_col(lugar), *[as_col(t) for t in texts])
    return F.coalesce(
        _tier(as_col(nac), cfg["declared"]),
        _tier(as_col(lugar), cfg["birthplace"]),
        _tier(combined, cfg["demonym"]),
        F.lit("Desconocido"),
    )


def nationality_pair(nac, lugar, texts, cfg2=fixed.PAIR_TIERS) -> Column:
    """The two-country variant."""
    return nationality(nac, lugar, texts, cfg2)


def mentions_by_field(
    df: DataFrame, id_col: str, own: str, fields: dict[str, str],
    kw: dict[str, list[str]] = fixed.COUNTRY_KEYWORDS,
) -> DataFrame:
    """Other countries named in each field, once per kind, with the first field."""
    names = list(fields)
    low = df.withColumns({f"_low{i}": F.lower(F.coalesce(F.col(f), F.lit(""))) for i, f in enumerate(names)})
    per_field = F.array(*[
        F.struct(
            F.lit(i).alias("pos"), F.lit(fields[f]).alias("tipo_vinculo"),
            word_hits(F.col(f"_low{i}"), kw, F.col(own)).alias("hits"),
        )
        for i, f in enumerate(names)
    ])
    rows = low.select(id_col, own, F.inline(per_field)).select(
        id_col, own, "pos", "tipo_vinculo", F.explode("hits").alias("vinculo")
    )
    first = rows.groupBy(id_col, own, "vinculo", "tipo_vinculo").agg(F.min("pos").alias("pos"))
    found = F.get(F.array(*[F.lit(f) for f in names]), F.col("pos"))
    return first.withColumn("campo_detectado", found).drop("pos")


def other_country(a: Column, b: Column) -> Column:
    """Two names or path slugs of different countries: ``Perú`` and ``peru`` are one."""
    return country_slug(F.trim(a)) != country_slug(F.trim(b))


def target_links(
    df: DataFrame, texts: list[str], patterns: dict[str, list[str]] = fixed.TARGET_PATTERNS,
    own: str | None = None, out: str = "conecta_con",
) -> DataFrame:
    """Persons tied to target countries by pattern, targets as one list."""
    low = df.withColumn("_low", F.lower(F.concat_ws(" ", *[F.col(t) for t in texts])))
    hits = []
    for target, pats in patterns.items():
        cond = F.col("_low").rlike(any_of(pats))
        if own:
            cond = other_country(F.col(own), F.lit(target)) & cond
        hits.append(F.when(cond, F.lit(target)))
    return low.withColumn(out, F.concat_ws(", ", *hits)).filter(F.col(out) != "").drop("_low")


def office_profile(
    json: str | Column, cargos: str | Column, ocupacion: str | Column,
    patterns: dict[str, str] = fixed.PROFILE_PATTERNS,
) -> Column:
    """Office flags from text, occupation and JSON labels; type by priority.

    The level follows the strongest late source: JSON labels over the office text,
    which wins over the occupation; inside one source national offices win.
    """
    def text_hit(c: str | Column, name: str) -> Column:
        return F.coalesce(F.lower(as_col(c)).rlike(patterns[name]), F.lit(False))

    text = {k: text_hit(cargos, k) for k in ("embajador", "ministro", "presidente")}
    label = {k: any_label(json, patterns[k]) for k in ("embajador", "ministro", "presidente")}
    diplomat, politician = text_hit(ocupacion, "diplomatico"), text_hit(ocupacion, "politico")
    flags = {k: text[k] | label[k] for k in text}
    kind = (
        F.when(flags["presidente"], "Presidente").when(flags["embajador"], "Embajador")
        .when(flags["ministro"], "Ministro").when(diplomat, "Diplomático")
        .when(F.coalesce(as_col(cargos) != "", F.lit(False)), "Otro político")
        .otherwise("Sin cargo político")
    )
    level = (
        F.when(label["presidente"] | label["ministro"], "Nacional")
        .when(label["embajador"], "Internacional")
        .when(text["presidente"] | text["ministro"], "Nacional")
        .when(text["embajador"], "Internacional")
        .when(diplomat, "Internacional").when(politician, "Nacional")
    )
    return F.struct(
        kind.alias("cargo_tipo"), level.alias("cargo_nivel"),
        flags["embajador"].alias("cargo_es_embajador"),
        flags["ministro"].alias("cargo_es_ministro"),
        flags["presidente"].alias("cargo_es_presidente"),
        diplomat.alias("cargo_es_diplomatico"),
    )


def visibility(
    nombre: str | Column, ocupacion: str | Column, words: dict[str, list[str]] = fixed.VISIBILITY_WORDS,
    labels: tuple[str, str] = fixed.VISIBILITY_LABELS,
) -> Column:
    """Category by word lists and a flag for an occupation of one's own."""
    name, work = F.lower(as_col(nombre)), F.lower(as_col(ocupacion))
    by_word = F.coalesce(name.rlike(whole_word(words["nombres"])), F.lit(False)) | F.coalesce(
        work.rlike(whole_word(words["ocupaciones"])), F.lit(False)
    )
    dependent = F.coalesce(work.rlike(whole_word(words["dependiente"])), F.lit(False))
    own = F.coalesce(as_col(ocupacion) != "", F.lit(False))
    return F.struct(
        F.when(by_word, labels[0]).otherwise(labels[1]).alias("categoria"),
        (own & ~dependent).alias("visibilidad_independiente"),
        (dependent & ~F.coalesce(work.rlike(whole_word(words["propias"])), F.lit(False))).alias("solo_dependiente"),
    )


def foreign_link(pais: str | Column, nac: str | Column) -> Column:
    """Several nationalities, another one, the same, or NULL when none is given."""
    p = F.lower(F.trim(F.coalesce(as_col(pais), F.lit(""))))
    n = F.lower(F.trim(F.coalesce(as_col(nac), F.lit(""))))
    return (
        F.when(n == "", F.lit(None).cast("string"))
        .when(n.contains(",") | n.contains(" y "), "varias_nacionalidades")
        .when((n != p) & (p != ""), "nacionalidad_distinta_al_pais")
        .otherwise("mismo_pais")
    )


def dst_country(
    edges: DataFrame, persons: DataFrame, kw: dict[str, list[str]], key: str = "person_id",
    text: str = "texto",
) -> DataFrame:
    """Country of the destination: inferred from its person, recorded, or from the edge text.

    ``persons`` brings ``pais``, ``nacionalidad`` and ``lugar``.
    """
    declared = F.concat_ws(" ", F.coalesce("nacionalidad", F.lit("")), F.coalesce("lugar", F.lit("")))
    dim = first_per_key(persons, [key], [F.col("pais")]).select(
        key, F.coalesce(infer_country(declared, kw), F.col("pais")).alias("resuelto")
    )
    out = enrich_dst(edges, dim, ["resuelto"], key)
    return out.withColumn(
        "pais_destino", F.coalesce("dst_resuelto", infer_country(F.col(text), kw))
    ).drop("dst_resuelto")


def special_cases(df: DataFrame, a: str, b: str, labels: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Persons whose two countries differ, with a label per direction."""
    out = df.filter((F.col(b) != "Desconocido") & other_country(F.col(a), F.col(b)))
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for (fam, nat), label in (labels or {}).items():
        case = case.when((F.col(a) == fam) & (F.col(b) == nat), label)
    return out.withColumn("tipo_caso", case.otherwise(F.concat(F.col(b), F.lit(" en familia de "), F.col(a))))


def node_role(nodes: DataFrame, bridges: DataFrame, id_col: str = "id", pais: str = "pais") -> DataFrame:
    """Bridge, national or unknown node."""
    b = bridges.select(F.col(id_col).alias("_b")).distinct()
    role = (
        F.when(F.col("_b").isNotNull(), "Puente").when(F.col(pais) != "Desconocido", "Nacional")
        .otherwise("Desconocido")
    )
    return nodes.join(b, nodes[id_col] == b["_b"], "left").withColumn("tipo_nodo", role).drop("_b")


def _class(a: Column, b: Column, word: str) -> Column:
    return F.when(a == b, f"Intra-{word}").when(a != b, f"Inter-{word}").otherwise("Desconocido")


def edge_class(edges: DataFrame) -> DataFrame:
    """Country and family class of enriched edges; unknown when a side is missing."""
    return edges.withColumns({
        "clase_pais": _class(F.col("src_pais"), F.col("dst_pais"), "país"),
        "clase_familia": _class(F.col("src_familia"), F.col("dst_familia"), "familia"),
    })


def crossed_flag(a: str | Column, b: str | Column) -> Column:
    """Both sides known and different."""
    a, b = as_col(a), as_col(b)
    known = (a != "Desconocido") & (b != "Desconocido")
    return F.coalesce(known & (a != b), F.lit(False))


def render_prompt(df: DataFrame, template: str, cols: list[str], out: str = "solicitud") -> DataFrame:
    """Text of a request per row from truncated fields (D14); nothing is sent."""
    return df.withColumn(out, F.format_string(template, *[safe_text(c) for c in cols]))


def merge_attributes(
    df: DataFrame, parsed: str, types: dict[str, str] = fixed.MERGED_ATTRIBUTES,
) -> DataFrame:
    """Overwrite columns with the non-NULL values of a parsed answer text.

    ``int`` values are cast, ``list`` values joined by `` | ``, others kept as text.
    """
    fields = ",".join(f"{c}:{'array<string>' if t == 'list' else 'string'}" for c, t in types.items())
    df = df.withColumn("_o", first_object(parsed, f"struct<{fields}>"))
    new = {}
    for c, t in types.items():
        v = F.col("_o")[c]
        v = v.try_cast("int") if t == "int" else F.array_join(v, " | ") if t == "list" else v
        old = F.col(c) if c in df.columns else F.lit(None)
        new[c] = F.coalesce(v, old.cast("int" if t == "int" else "string"))
    return df.withColumns(new).drop("_o")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a stored result."""
    return df.join(done.select(key), key, "left_anti")


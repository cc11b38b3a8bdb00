"""J01-J13 and U01-U07 over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import joins, sets
from kinweave.plans.registry import query


@query("j01_enrich_dst", "v_edge v_known", """
    SELECT e.src, e.dst, e.relation_type, b.pais AS dst_pais, b.familia AS dst_familia
    FROM v_edge e LEFT JOIN v_known b ON e.dst = b.person_id""")
def _(fx):
    return joins.enrich_dst(fx.edge(), fx.known(), ["pais", "familia"])


@query("j02_enrich_both", "v_edge v_known", """
    SELECT e.src, e.dst, e.relation_type, a.pais AS src_pais, b.pais AS dst_pais
    FROM v_edge e LEFT JOIN v_known a ON e.src = a.person_id LEFT JOIN v_known b ON e.dst = b.person_id""")
def _(fx):
    return joins.enrich_both(fx.edge(), fx.known(), ["pais"])


@query("j03_join_lookup", "v_person v_spell", """
    SELECT p.person_id, p.pais, s.cargo_text, s.anio FROM v_person p LEFT JOIN
      (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY anio, spell_id) AS rn FROM v_spell) WHERE rn = 1) s
      ON p.person_id = s.person_id""")
def _(fx):
    p = fx.person().select("person_id", "pais").withColumn("anio", F.lit(0))
    return joins.join_lookup(p, fx.spell(), "person_id", ["cargo_text", "anio"], [F.col("anio"), F.col("spell_id")])


@query("j04_full_outer_zero", "v_kin", """
    WITH o AS (SELECT src_pais AS pais, count(*) AS salientes FROM v_kin WHERE relation_type = 'conyuge' GROUP BY 1),
    i AS (SELECT dst_pais AS pais, count(*) AS entrantes FROM v_kin WHERE relation_type = 'pareja' AND dst_pais IS NOT NULL GROUP BY 1)
    SELECT coalesce(o.pais, i.pais) AS pais, coalesce(salientes, 0) AS salientes, coalesce(entrantes, 0) AS entrantes,
           coalesce(salientes, 0) + coalesce(entrantes, 0) AS total FROM o FULL JOIN i ON o.pais = i.pais""")
def _(fx):
    k = fx.kin()
    a = k.filter("relation_type = 'conyuge'").groupBy(F.col("src_pais").alias("pais")).agg(F.count("*").alias("salientes"))
    b = k.filter("relation_type = 'pareja' AND dst_pais IS NOT NULL").groupBy(F.col("dst_pais").alias("pais")).agg(F.count("*").alias("entrantes"))
    return joins.full_zero(a, b, ["pais"])


@query("j05_both_in", "v_edge v_person", """
    SELECT e.* FROM v_edge e WHERE src IN (SELECT person_id FROM v_person WHERE c_acctbal > 2000)
       AND dst IN (SELECT person_id FROM v_person WHERE c_acctbal > 2000)""")
def _(fx):
    return joins.both_in(fx.edge(), fx.person().filter("c_acctbal > 2000"), "person_id")


@query("j06_unknown_endpoints", "v_edge v_known", """
    SELECT * FROM v_edge WHERE dst NOT IN (SELECT person_id FROM v_known)""")
def _(fx):
    return joins.unknown_endpoints(fx.edge(), fx.known())


WORDS = {"en": ["the", "and"], "fr": ["que", "des"], "de": ["nicht", "sch"], "es": ["ción", "los"]}


def words_sql(text: str, own: str) -> str:
    """One row per document and other language whose words occur."""
    parts = []
    for lang, ws in WORDS.items():
        hit = " OR ".join(f"contains(lower({text}), '{w}')" for w in ws)
        parts.append(f"SELECT doc_id, lang, '{lang}' AS vinculo FROM documents WHERE ({hit}) AND lower(trim({own})) <> '{lang}'")
    return "\nUNION ALL\n".join(parts)


@query("j07_dictionary_join", "", words_sql("concat_ws(' ', text, source)", "lang"))
def _(fx):
    d = fx.t("documents").select("doc_id", "lang", "text", "source")
    return joins.dictionary_join(d, ["text", "source"], WORDS, "lang").select("doc_id", "lang", "vinculo")


@query("j08_group_pairs", "v_kin", """
    SELECT DISTINCT least(src_familia, dst_familia) AS a, greatest(src_familia, dst_familia) AS b FROM v_kin WHERE src_familia <> dst_familia""")
def _(fx):
    return joins.group_pairs(fx.kin(), "src_familia", "dst_familia")


@query("j09_within_pairs", "v_person", """
    WITH m AS (SELECT DISTINCT linaje, person_id FROM v_person),
    p AS (SELECT x.linaje, x.person_id AS id, count(*) AS grado, count(*) FILTER (y.person_id > x.person_id) AS n_later
          FROM m x JOIN m y ON x.linaje = y.linaje AND x.person_id <> y.person_id GROUP BY 1, 2)
    SELECT linaje, id, grado + 1 - n_later AS ordinal, grado + 1 AS n_miembros, grado, n_later FROM p""")
def _(fx):
    return joins.within_pairs(fx.person(), "linaje", "person_id")


@query("j09_linked_in_group", "v_edge v_person", """
    SELECT e.src, e.dst, e.relation_type, a.linaje FROM v_edge e JOIN v_person a ON e.src = a.person_id
    JOIN v_person b ON e.dst = b.person_id WHERE a.linaje = b.linaje""")
def _(fx):
    return joins.linked_in_group(fx.edge(), fx.person(), "linaje", "person_id")


@query("j10_insert_absent", "v_person", """
    SELECT familia AS nombre, 'base' AS origen FROM (SELECT DISTINCT familia FROM v_person WHERE familia <> 'HOUSEHOLD')
    UNION ALL
    SELECT concat(' ', lower(familia)), 'extra' FROM (SELECT DISTINCT familia FROM v_person WHERE familia = 'HOUSEHOLD')
    UNION ALL
    SELECT concat(' ', lower(linaje)), 'extra' FROM (SELECT DISTINCT linaje FROM v_person)""")
def _(fx):
    p = fx.person()
    base = p.filter("familia <> 'HOUSEHOLD'").select(F.col("familia").alias("nombre")).distinct().withColumn("origen", F.lit("base"))
    extra = p.select("familia").union(p.select("linaje")).distinct().select(
        F.concat(F.lit(" "), F.lower("familia")).alias("nombre"), F.lit("extra").alias("origen"))
    return joins.insert_absent(base, extra, "nombre")


@query("j11_null_safe_join", "v_attr", """
    WITH c AS (SELECT pais, lugar, count(*) AS n FROM v_attr WHERE familia <> 'BUILDING' GROUP BY pais, lugar)
    SELECT a.person_id, a.pais, a.lugar, c.n FROM v_attr a
    LEFT JOIN c ON a.pais IS NOT DISTINCT FROM c.pais AND a.lugar IS NOT DISTINCT FROM c.lugar""")
def _(fx):
    p = fx.attr()
    c = p.filter("familia <> 'BUILDING'").groupBy("pais", "lugar").agg(F.count("*").alias("n"))
    return joins.join_null_safe(p.select("person_id", "pais", "lugar"), c, ["pais", "lugar"])


@query("j12_apply_overrides", "v_person v_edge", """
    WITH o AS (SELECT url, linaje AS pais FROM v_person WHERE familia = 'MACHINERY'),
    e AS (SELECT concat('https://es.wikipedia.org/wiki/P', CAST(src AS VARCHAR)) AS url, relation_type FROM v_edge
          UNION ALL SELECT url, 'manual' FROM o)
    SELECT p.url, coalesce(o.pais, p.pais) AS pais, count(e.url) AS n_aristas
    FROM v_person p LEFT JOIN o ON p.url = o.url LEFT JOIN e ON p.url = e.url GROUP BY 1, 2""")
def _(fx):
    p = fx.person()
    manual = p.filter("familia = 'MACHINERY'").select("url", F.col("linaje").alias("pais"))
    fixed_country = joins.apply_overrides(p.select("url", "pais"), manual, "url", "pais")
    e = fx.edge().select(F.concat(F.lit("https://es.wikipedia.org/wiki/P"), F.col("src")).alias("url"), "relation_type")
    e = e.unionByName(manual.select("url", F.lit("manual").alias("relation_type")))
    n = e.groupBy("url").agg(F.count("*").alias("n_aristas"))
    return fixed_country.join(n, "url", "left").fillna(0, subset=["n_aristas"])


@query("j13_attach_aggregates", "v_person v_spell v_edge", """
    WITH c AS (SELECT person_id, count(*) AS n_cargos, count(DISTINCT cargo_text) AS n_cargos_distintos FROM v_spell GROUP BY 1),
    r AS (SELECT e.src AS person_id, count(*) AS n_familiares, count(DISTINCT e.relation_type) AS n_tipos_relacion
          FROM v_edge e JOIN v_person b ON e.dst = b.person_id GROUP BY 1)
    SELECT p.person_id, p.nombre, n_cargos, n_cargos_distintos, n_familiares, n_tipos_relacion
    FROM v_person p LEFT JOIN c ON p.person_id = c.person_id LEFT JOIN r ON p.person_id = r.person_id""")
def _(fx):
    p = fx.person().select("person_id", "nombre")
    positions = fx.spell().select("person_id", F.col("cargo_text").alias("position_title_raw"))
    names = p.select(F.col("person_id").alias("dst"), F.col("nombre").alias("related_name_raw"))
    relations = fx.edge().join(names, "dst").select(F.col("src").alias("person_id"), "related_name_raw", "relation_type")
    return joins.attach_aggregates(p, positions, relations)


# --- set operations -------------------------------------------------------------

@query("u01_union_all", "v_person", """
    SELECT person_id, nombre, pais, CAST(NULL AS VARCHAR) AS familia FROM v_person
    UNION ALL SELECT person_id, nombre, NULL, familia FROM v_person
    UNION ALL SELECT person_id, NULL, NULL, familia FROM v_person""")
def _(fx):
    p = fx.person()
    return sets.union_all([
        p.select("person_id", "nombre", "pais"),
        p.select("person_id", "nombre", "familia"),
        p.select("familia", "person_id"),
    ])


@query("u02_distinct_rows", "v_person", "SELECT DISTINCT nombre, pais, familia FROM v_person")
def _(fx):
    return sets.distinct_rows(fx.person().select("nombre", "pais", "familia"))


@query("u03_endpoints", "v_edge", "SELECT src AS id FROM v_edge UNION SELECT dst FROM v_edge")
def _(fx):
    return sets.endpoints(fx.edge())


@query("u04_key_diff", "v_edge v_known", """
    SELECT id, 'solo_mencionado' AS clase FROM (SELECT dst AS id FROM v_edge EXCEPT SELECT person_id FROM v_known)
    UNION ALL SELECT id, 'conocido' FROM (SELECT dst AS id FROM v_edge INTERSECT SELECT person_id FROM v_known)""")
def _(fx):
    said, known = fx.edge().select(F.col("dst").alias("id")), fx.known().select("person_id")
    return sets.key_diff(said, known).withColumn("clase", F.lit("solo_mencionado")).unionByName(
        sets.key_intersect(said, known).withColumn("clase", F.lit("conocido")))


@query("u05_append_keep_base", "v_known v_person", """
    SELECT person_id, nombre, 'base' AS origen FROM v_known
    UNION ALL SELECT person_id, upper(nombre), 'extra' FROM v_person WHERE person_id NOT IN (SELECT person_id FROM v_known)""")
def _(fx):
    base = fx.known().select("person_id", "nombre").withColumn("origen", F.lit("base"))
    extra = fx.person().select("person_id", F.upper("nombre").alias("nombre")).withColumn("origen", F.lit("extra"))
    return sets.append_keep_base(base, extra, "person_id", ["nombre"])


@query("u06_union_common", "v_person v_spell", """
    SELECT person_id FROM v_person UNION ALL SELECT person_id FROM v_spell""")
def _(fx):
    return sets.union_common(fx.person(), fx.spell())


RULES = [
    ("^red widget$", "^blue bolt$", "conyuge"), ("green.*gear|big gear", "^small ring$", "padres"),
    ("no such person", "^red widget$", "hijos"),
]


@query("u07_add_curated_edges", "v_edge v_person", "SELECT src, dst, relation_type FROM v_edge" + "".join(f"""
    UNION ALL SELECT * FROM (SELECT
      (SELECT min(person_id) FROM v_person WHERE regexp_matches(lower(nombre), '{a}')) AS src,
      (SELECT min(person_id) FROM v_person WHERE regexp_matches(lower(nombre), '{b}')) AS dst, '{r}' AS relation_type)
    WHERE src IS NOT NULL AND dst IS NOT NULL""" for a, b, r in RULES))
def _(fx):
    return sets.add_curated_edges(fx.edge(), fx.person(), RULES)

"""Every output table from one person table, with the default dictionaries.

    tables = output_tables(read_partitioned(spark, ".../*/consolidado.csv", r"/([^/]+)/consolidado"))
    write_output_tables(tables, "s3://.../tables")
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions.text import clean_json, family_name, not_blank
from kinweave.operators import graph, rules, shape
from kinweave.operators.ranking import first_per_key
from kinweave.plans import reports as rp
from kinweave.session import cut
from kinweave.sources.tables import write_table

# Columns of the person table.
PERSON_COLUMNS = [
    "nombre", "url", "biografia_inicial", "biografia", "fecha_nacimiento", "lugar_nacimiento", "fecha_fallecimiento",
    "nacionalidad", "ocupacion", "partido_politico", "padres", "conyuge", "pareja", "hijos", "hermanos", "familia",
    "cargos_politicos", "periodo", "residencia", "religion", "lugar_fallecimiento", "infobox_json", "infobox_completa",
    "categoria_origen", "pais_origen", "pais",
]


def consolidate(persons: DataFrame) -> DataFrame:
    """One row per URL with country and family resolved; absent columns become NULL."""
    p = shape.ensure_columns(persons, dict.fromkeys(PERSON_COLUMNS, "string")).select(PERSON_COLUMNS)
    p = shape.has_key(p, "url").withColumns({
        "pais": F.coalesce("pais", "pais_origen"),
        "familia_texto": F.col("familia"),
        "familia": family_name("categoria_origen", "familia"),
    })
    # Of repeated rows the one with the most values stays.
    filled = sum((not_blank(c).cast("int") for c in PERSON_COLUMNS), F.lit(0))
    first = ("nombre", "pais", "familia", "biografia", "infobox_json", "cargos_politicos")
    order = [F.desc("_filled"), *[F.col(c) for c in dict.fromkeys([*first, *PERSON_COLUMNS])]]  # total, but for equal rows
    return first_per_key(p.withColumn("_filled", filled), ["url"], order).drop("_filled")


def output_tables(persons: DataFrame) -> dict[str, DataFrame]:
    """Output tables by name. The person and edge tables are materialised once."""
    p = cut(consolidate(persons))
    kin = cut(rp.kin_from_text(p, p))
    ends = kin.select(F.col("src").alias("id"), F.col("src_pais").alias("pais")).union(
        kin.select("dst", "dst_pais")).dropna().distinct()
    mentions = cut(rp.year_mentions(
        p.select("url", "nombre", "cargos_politicos", "periodo", "biografia").withColumnRenamed("periodo", "periodo_texto"),
        ["cargos_politicos", "periodo_texto", "biografia"]))
    profiles = cut(p.select(
        "url", "pais", "nombre",
        rules.office_profile("infobox_json", "cargos_politicos", "ocupacion").alias("o")).select("url", "pais", "nombre", "o.*"))
    texts = ["cargos_politicos", "ocupacion", "biografia", "biografia_inicial"]
    nat = cut(p.select(
        "url", "nombre", F.col("pais").alias("pais_familia"),
        rules.nationality("nacionalidad", "lugar_nacimiento", ["biografia", "biografia_inicial"]).alias("pais_nacionalidad")))
    offices = cut(rp.infobox_offices(p, "url", "infobox_completa"))
    relatives = cut(rp.expanded_relations(
        p.select(F.col("url").alias("persona_origen_url"), *fixed.RELATION_FIELDS, F.col("familia_texto").alias("familia")),
        "persona_origen_url", [*fixed.RELATION_FIELDS, "familia"]))
    pairs, flows = graph.surname_network(p, kin, "url")
    spouses = kin.filter(rp.is_spouse() & (F.col("clase_familia") == "Inter-familia"))

    origin = p.select(F.col("url").alias("src"), F.concat_ws(" ", "biografia_inicial", "biografia", "nacionalidad", "lugar_nacimiento").alias("texto"))
    resolved = rules.dst_country(
        kin.join(origin, "src"), p.select("url", F.lower("pais").alias("pais"), "nacionalidad", F.col("lugar_nacimiento").alias("lugar")),
        fixed.COUNTRY_KEYWORDS, "url",
    ).select(F.lower("src_pais").alias("pais_origen"), "pais_destino")
    said = rules.mentions_by_field(p.withColumn("pais", F.lower("pais")), "url", "pais", fixed.LINK_KIND)
    family = lambda end: F.concat_ws("/", "src_pais", f"{end}_familia")
    houses = cut(spouses.filter(F.col("clase_pais") == "Intra-país").select(
        family("src").alias("src"), family("dst").alias("dst"), F.col("src_pais").alias("pa")).distinct())

    return {
        "endogamia_por_pais": rp.endogamy(kin),
        "comparacion_endogamia_paises": rp.country_comparison(p, kin),
        "matrimonios_endogamicos": rp.endogamous_marriages(kin),
        "puestos_politicos_por_pais": rp.offices_by_country(p, "cargos_politicos"),
        "elites_por_pais": rp.elite_share(p, "cargos_politicos"),
        "elites_conexiones_inter_pais": rp.elite_flows(kin, p, "cargos_politicos", "url"),
        "metricas_red_por_pais": rp.network_metrics(kin, ends, houses),
        "matriz_inter_pais": rp.country_flows(kin),
        "resumen_conexiones_inter_pais": rp.link_balance(kin),
        "pares_de_paises": graph.pair_summary(kin),
        "json_limpieza_resumen": rp.json_validity(p, "pais", clean_json("infobox_json")),
        "infobox_labels": rp.label_frequencies(p, "pais", "infobox_json"),
        "infobox_labels_top20_por_pais": rp.top_labels(p, "pais", "infobox_json"),
        "apellidos_por_periodo": rp.surnames_by_period(mentions),
        "apellidos_unicos_por_periodo": rp.surnames_of_one_period(mentions, fixed.PERIOD_BANDS[1][0]),
        "tipos_cargos_por_periodo": rp.office_types_by_period(mentions, "cargos_politicos"),
        "diversidad_apellidos_por_periodo": rp.surname_diversity(mentions, "url"),
        "comparacion_apellidos": rp.period_comparison(mentions, fixed.PERIOD_BANDS[1][0]),
        "tendencias_apellidos_cargos": rp.decade_trend(mentions, 12, dense=False),
        "persistencia_elites_familias": rp.family_persistence(p, "fecha_nacimiento", "cargos_politicos", "ocupacion"),
        "geografia_poder_familias": rp.power_geography(p.filter(F.col("familia").isNotNull()), "lugar_nacimiento"),
        "genero_visibilidad_historica": rp.visibility_by_period(
            p, "fecha_nacimiento", "nombre", "ocupacion", fixed.VISIBILITY_WORDS),
        "patrones_nomenclatura_familias": rp.repeated_names(p.filter(F.col("familia").isNotNull())),
        "red_matrimonial_familias": graph.contract(spouses, "src_familia", "dst_familia"),
        "familias_centrales_red": rp.central_families(kin),
        "top_conectores_por_pais": rp.top_connectors(kin, p, key="url"),
        "familias_que_mas_unen_por_pais": rp.connecting_families(kin, p, key="url"),
        "union_entre_paises": rp.country_union(resolved, said, "pais"),
        "nodos_puente": rp.bridge_persons(
            p.withColumn("texto", F.concat_ws(" ", *texts)), "texto", fixed.TARGET_PATTERNS, "pais", fixed.TARGET_PATTERNS,
        ).select("url", "nombre", "pais", "conecta_con", "contexto_conexion"),
        "casos_especiales_nacionalidad": rules.special_cases(nat, "pais_familia", "pais_nacionalidad"),
        "conexiones_cruzadas_nacionalidad": rp.crossed_links(
            kin.select("src", "dst", "relation_type"), nat.withColumnRenamed("pais_nacionalidad", "nacionalidad"), "url"),
        "cargos_por_pais": rp.office_types_by_country(profiles),
        "conexiones_diplomaticas": rp.diplomatic_links(kin, profiles, "url"),
        "conexiones_familiares_directas": rp.direct_links(kin),
        "conexiones_con_nombres": graph.crossing_named(kin),
        "familias_mas_densas": rp.densest_families(kin),
        "matrimonios_inter_familia": rp.inter_family_marriages(kin),
        "comunidades_detectadas": graph.community_labels(graph.communities(kin)),
        "analisis_desconocidos": graph.unknown_profile(kin, p, "url"),
        "ejemplos_desconocidos": graph.unknown_examples(
            kin.select("dst", "relation_type", "src_pais"), p, ["dst", "relation_type", "src_pais"], 20, "url"),
        "surname_pairs": pairs,
        "surname_edges_interfamily": flows,
        "cargos": offices,
        "relaciones": relatives,
        "df_consolidado": rp.person_frame(
            p.withColumnRenamed("url", "person_id"),
            offices.select(F.col("url").alias("person_id"), F.col("cargo").alias("position_title_raw")),
            relatives.select(F.col("persona_origen_url").alias("person_id"), F.col("nombre").alias("related_name_raw"),
                             F.col("tipo_relacion").alias("relation_type")),
            "nacionalidad", "fecha_nacimiento", "fecha_fallecimiento",
        ),
    }


def write_output_tables(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> list[str]:
    """Write the tables that have rows; returns their names."""
    return [name for name, df in tables.items() if write_table(df, f"{path}/{name}", fmt)]

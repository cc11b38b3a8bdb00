"""End-to-end reports (A01-A36), each a function of person, edge and office tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions.text import (
    decade, first_year, given_name, infobox_rows, kwic, label_values, last_two_tokens,
    letters_only, links_any, no_control, not_blank, persistence, sentence_case, shorten, surnames, years,
)
from kinweave.operators import aggregates as agg
from kinweave.operators import graph, joins, rules, shape
from kinweave.operators import ranking as rk
from kinweave.session import cut

def is_spouse() -> Column:
    return F.col("relation_type").isin(fixed.SPOUSE_RELATIONS)


def intra_family() -> Column:
    return F.col("clase_familia") == "Intra-familia"


# --- endogamy, offices, elites ----------------------------------------------------

def kin_from_text(persons: DataFrame, known: DataFrame) -> DataFrame:
    """Relation columns of known persons to classified edges, keyed by URL."""
    e = graph.edges(persons, "url").select("src", "dst", "relation_type")
    return graph.kin_table(e, known, ["nombre", "pais", "familia"], "url").filter(F.col("src_pais").isNotNull())


def endogamy(kin: DataFrame) -> DataFrame:
    """Marriages, those inside the family, and their rate per country."""
    out = agg.rate(kin.filter(is_spouse()), ["src_pais"], intra_family())
    return out.select(
        F.col("src_pais").alias("pais"), F.col("total").alias("matrimonios_total"),
        F.col("casos").alias("matrimonios_endogamicos"), F.col("pct").alias("tasa_endogamia_familiar"),
    )


def country_comparison(persons: DataFrame, kin: DataFrame) -> DataFrame:
    """Persons, families, links and rates per country."""
    p = agg.summarise(persons, ["pais"], {"Personas": F.count("*"), "Familias": F.count_distinct("familia")})
    e = agg.summarise(kin, ["src_pais"], {
        "Conexiones_Total": F.count("*"), "Conexiones_Intra_Familia": agg.n_if(intra_family()),
        "Conexiones_Inter_Familia": agg.n_if(F.col("clase_familia") == "Inter-familia"),
        "Matrimonios_Endogamicos": agg.n_if(is_spouse() & intra_family()), "Matrimonios_Total": agg.n_if(is_spouse()),
    })
    both = p.join(e, p["pais"] == e["src_pais"], "left").drop("src_pais").fillna(0)
    return both.withColumns({
        "Tasa_Endogamia_Familiar": agg.ratio(F.col("Matrimonios_Endogamicos"), F.col("Matrimonios_Total"), 2),
        "Tasa_Endogamia_General": agg.ratio(F.col("Conexiones_Intra_Familia"), F.col("Conexiones_Total"), 2),
        "Personas_por_Familia": F.round(F.col("Personas") / F.nullif("Familias", F.lit(0)), 2),
    }).withColumnRenamed("pais", "Pais")


def endogamous_marriages(kin: DataFrame) -> DataFrame:
    """Marriages inside each family."""
    return kin.filter(is_spouse() & intra_family()).groupBy("src_familia").agg(
        F.count("*").alias("n_matrimonios_endogamicos"))


def offices_by_country(persons: DataFrame, text: str, flags: dict[str, str] = fixed.OFFICE_FLAGS) -> DataFrame:
    """Persons per office kind and with any office."""
    marked = shape.flag_bank(persons.filter(F.coalesce(F.col(text) != "", F.lit(False))), text, flags)
    return agg.summarise(marked, ["pais"], {
        **{f"n_{name.removeprefix('es_')}": agg.n_if(F.col(name)) for name in flags}, "n_con_cargos": F.count("*")})


def elite_share(persons: DataFrame, text: str) -> DataFrame:
    """Share of persons with an office."""
    out = agg.rate(persons, ["pais"], F.col(text) != "")
    return out.withColumnsRenamed({"total": "n_total", "casos": "n_elite", "pct": "pct_elite"})


def elite_flows(kin: DataFrame, persons: DataFrame, text: str, key: str = "person_id") -> DataFrame:
    """Links between office holders by pair of countries."""
    elite = persons.filter(F.col(text) != "")
    return joins.both_in(kin, elite, key).groupBy("src_pais", "dst_pais").agg(F.count("*").alias("n"))


# --- networks ----------------------------------------------------------------

def network_metrics(kin: DataFrame, all_nodes: DataFrame, houses: DataFrame) -> DataFrame:
    """Size, density, degree, transitivity and components per country, and the mean distance
    between its houses (the contracted graph ``houses`` with ``src, dst, pa``).

    Components never span countries here, so one pass over the intra-country graph
    serves all countries at once.
    """
    e = cut(kin.filter(F.col("clase_pais") == "Intra-país").select("src", "dst", F.col("src_pais").alias("grupo")))
    by = cut(all_nodes.select("id", F.col("pais").alias("grupo")))
    und = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "grupo").distinct()
    comp = cut(graph.components(e, by))
    sizes = graph.component_sizes(comp).join(by.withColumnRenamed("id", "component"), "component")
    country = houses.select(F.col("src").alias("id"), F.col("pa").alias("grupo")).union(houses.select("dst", "pa")).distinct()
    paths = graph.avg_path(houses, country)
    out = by.groupBy("grupo").agg(F.count("*").alias("n_nodes"))
    out = out.join(e.groupBy("grupo").agg(F.count("*").alias("n_edges")), "grupo")
    out = out.join(und.groupBy("grupo").agg(F.count("*").alias("m")), "grupo")
    out = out.join(graph.transitivity(e, by).select("grupo", "transitividad"), "grupo", "left")
    out = out.join(sizes.groupBy("grupo").agg(F.count("*").alias("n_componentes"), F.max("n").alias("giant_size")), "grupo")
    out = out.join(paths, "grupo", "left")
    return out.select(
        F.col("grupo").alias("pais"), "n_nodes", "n_edges",
        F.round(graph.density("n_nodes", "n_edges", True), 4).alias("density"),
        F.round(graph.avg_degree("n_nodes", "m"), 2).alias("avg_degree"),
        F.round("transitividad", 4).alias("transitivity"), "n_componentes", "giant_size",
        F.round("distancia_media", 3).alias("avg_path_houses"),
    )


def country_flows(kin: DataFrame) -> DataFrame:
    """Links between different countries, long form."""
    return kin.filter(F.col("clase_pais") == "Inter-país").groupBy("src_pais", "dst_pais").agg(F.count("*").alias("n"))


def country_matrix(kin: DataFrame, values: list[str]) -> DataFrame:
    """The same as a matrix with zeros; the countries are declared."""
    return agg.matrix(kin.filter(F.col("clase_pais") == "Inter-país"), "src_pais", "dst_pais", values)


def link_balance(kin: DataFrame) -> DataFrame:
    """Outgoing, incoming and total links per country."""
    inter = kin.filter(F.col("clase_pais") == "Inter-país")
    out = inter.groupBy(F.col("src_pais").alias("pais")).agg(F.count("*").alias("conexiones_salientes"))
    into = inter.groupBy(F.col("dst_pais").alias("pais")).agg(F.count("*").alias("conexiones_entrantes"))
    return joins.full_zero(out, into, ["pais"], "total_conexiones")


def json_validity(df: DataFrame, key: str, clean: Column) -> DataFrame:
    """A10: valid JSON after cleaning, per country."""
    out = agg.rate(df.withColumn("_j", clean), [key], F.col("_j").isNotNull())
    return out.withColumnsRenamed({"total": "n_total", "casos": "n_json_valido", "pct": "pct_json_valido"})


def label_frequencies(df: DataFrame, key: str, json: str) -> DataFrame:
    """Label counts, overall and per country, in one pass."""
    rows = df.select(key, F.explode(infobox_rows(json)).alias("x")).select(
        key, F.trim(no_control("x.label")).alias("label"))
    return agg.label_counts(rows.filter(not_blank("label")), "label", key)


def top_labels(df: DataFrame, key: str, json: str, k: int = 20) -> DataFrame:
    """Most common labels per country."""
    counts = label_frequencies(df, key, json).filter(F.col("es_global") == 0).select(key, "label", "n")
    return rk.top_n_per(counts, [key], [F.desc("n"), F.col("label")], k)


# --- surnames and offices over time ---------------------------------------------

def year_mentions(persons: DataFrame, texts: list[str], bands=fixed.PERIOD_BANDS) -> DataFrame:
    """One row per person and distinct year named in the texts, with surname and period."""
    rows = persons.withColumn("year", F.explode(years(texts)))
    return rows.withColumn("surname_1", surnames("nombre")["surname_1"]).withColumn("periodo", shape.bucket("year", *bands))


def surname_counts(mentions: DataFrame) -> DataFrame:
    return mentions.filter(not_blank("surname_1")).groupBy("periodo", "surname_1").agg(F.count("*").alias("n"))


def surnames_by_period(mentions: DataFrame) -> DataFrame:
    """Surname counts with rank inside the period."""
    return rk.rank_in(surname_counts(mentions), ["periodo"], [F.desc("n"), F.col("surname_1")])


def surnames_of_one_period(mentions: DataFrame, first_period: str) -> DataFrame:
    """Surnames seen in one period only; new after, or gone after, the first period."""
    per = surname_counts(mentions).groupBy("surname_1").agg(
        F.count("*").alias("n_periodos"), F.min("periodo").alias("periodos"), F.sum("n").alias("total_cargos"))
    one = per.filter(F.col("n_periodos") == 1)
    return one.withColumn("clase", F.when(F.col("periodos") == first_period, "desaparecido").otherwise("nuevo"))


def office_types_by_period(mentions: DataFrame, text: str, rule_list=fixed.OFFICE_TYPES) -> DataFrame:
    """Office types per period with their share."""
    typed = mentions.withColumn("cargo_tipo", shape.first_match(text, rule_list, "Otro"))
    return rk.share(typed.groupBy("periodo", "cargo_tipo").agg(F.count("*").alias("n")), ["periodo"], "n").drop("total")


def surname_diversity(mentions: DataFrame, person: str = "person_id") -> DataFrame:
    """Persons, surnames and weight of the first ten surnames per period."""
    named = mentions.filter(not_blank("surname_1"))
    base = agg.summarise(named, ["periodo"], {
        "n_personas": F.count_distinct(person), "n_apellidos_unicos": F.count_distinct("surname_1"), "total_n": F.count("*")})
    top = rk.top_n_per(surname_counts(mentions), ["periodo"], [F.desc("n"), F.col("surname_1")], 10)
    top10 = top.groupBy("periodo").agg(F.sum("n").alias("top10_n"))
    return base.join(top10, "periodo", "left").withColumn(
        "apellidos_top10_pct", agg.ratio(F.col("top10_n"), F.col("total_n")))


def period_comparison(mentions: DataFrame, first_period: str, n: int = 15) -> DataFrame:
    """Leading surnames before and after, and where each appears."""
    counts = surname_counts(mentions)
    order = [F.desc("n"), F.col("surname_1")]
    pre = rk.top_n(counts.filter(F.col("periodo") == first_period).select("surname_1", "n"), order, n)
    post = rk.top_n(
        counts.filter(F.col("periodo") != first_period).groupBy("surname_1").agg(F.sum("n").alias("n")), order, n)
    both = pre.withColumn("lado", F.lit("pre")).unionByName(post.withColumn("lado", F.lit("post")))
    sides = both.groupBy("surname_1").agg(F.count("*").alias("k"))
    category = (
        F.when(F.col("k") == 2, "Ambos períodos").when(F.col("lado") == "pre", "Solo pre").otherwise("Solo post")
    )
    return both.join(sides, "surname_1").select("surname_1", "n", "lado", category.alias("categoria"))


def decade_trend(mentions: DataFrame, k: int, dense: bool, lo: int = 1800, hi: int = 2020) -> DataFrame:
    """Leading surnames per decade; ``dense`` adds zeros."""
    rows = mentions.filter(not_blank("surname_1")).withColumn("decade", decade("year"))
    rows = rows.filter(F.col("decade").between(lo, hi))
    counts = rk.filter_top(rows, "surname_1", k).groupBy("decade", "surname_1").agg(F.count("*").alias("n"))
    return agg.densify(cut(counts), "surname_1", "decade", list(range(lo, hi + 1, 10)), "n") if dense else counts


# --- families ------------------------------------------------------------------

def family_persistence(persons: DataFrame, birth: str, office: str, work: str) -> DataFrame:
    """Generations a family spans, weighted by its size."""
    gen = persons.withColumn("generacion", shape.bucket(first_year(birth), *fixed.GENERATION_BANDS, "Desconocido"))
    per = agg.summarise(gen.filter(not_blank("familia")), ["familia", "generacion"], {
        "n_personas": F.count("*"), "n_con_cargos": agg.n_if(F.col(office) != ""), "n_con_ocupacion": agg.n_if(F.col(work) != "")})
    out = rk.group_totals(per, ["familia"], "n_personas", "generacion")
    return out.withColumnsRenamed({"total": "total_personas", "distintos": "total_generaciones"}).withColumn(
        "persistencia_score", F.round(persistence("total_generaciones", "total_personas"), 6))


def power_geography(persons: DataFrame, place: str, rule_list=fixed.POWER_REGIONS) -> DataFrame:
    """Regions of a family, their share and the dominant one."""
    rest = F.when(F.coalesce(F.col(place) != "", F.lit(False)), "Otras provincias").otherwise("Desconocido")
    region = F.coalesce(shape.first_match(letters_only(place), rule_list, None), rest)
    counts = persons.withColumn("region_poder", region).groupBy("familia", "region_poder").agg(F.count("*").alias("n"))
    return rk.dominant(rk.share(counts, ["familia"], "n"), ["familia"], "region_poder", "n", "region_dominante")


def visibility_by_period(persons: DataFrame, birth: str, name: str, work: str, words, labels=fixed.VISIBILITY_LABELS) -> DataFrame:
    """Share with an occupation of their own per cohort and category."""
    v = rules.visibility(name, work, words, labels)
    rows = persons.select(shape.bucket(first_year(birth), *fixed.VISIBILITY_BANDS).alias("periodo"), v.alias("v"))
    out = agg.rate(rows.select("periodo", "v.*").dropna(subset=["periodo"]), ["periodo", "categoria"], F.col("visibilidad_independiente"))
    return out.withColumnsRenamed({"total": "n_total", "casos": "n_visibilidad_independiente", "pct": "pct_visibilidad"})


def repeated_names(persons: DataFrame) -> DataFrame:
    """Given names used at least twice in a family."""
    named = persons.withColumn("nombre_pila", given_name("nombre")).dropna(subset=["nombre_pila"])
    counts = named.groupBy("familia", "nombre_pila").agg(F.count("*").alias("n"))
    return rk.share(counts, ["familia"], "n", "total_familia").filter(F.col("n") >= 2)


def central_families(kin: DataFrame, n: int = 15) -> DataFrame:
    """Families with the most marriage links."""
    _, score = graph.marriage_network(kin)
    return rk.top_n(score, [F.desc("grado"), F.col("id")], n).withColumnRenamed("id", "familia")


def top_connectors(kin: DataFrame, persons: DataFrame, family: str = "familia", n: int = 15, key: str = "person_id") -> DataFrame:
    """Best linked persons of each country, ties kept, with the number of families they are linked to."""
    e = cut(graph.simplify(kin.filter(F.col("clase_pais") == "Intra-país")))
    near = graph.neighbour_groups(e, graph.membership(persons, key, family))
    score = graph.degree(e).select("id", "grado").join(near, "id")
    who = score.join(persons.withColumn("id", F.col(key)), "id").select(
        "pais", "nombre", "url", "grado", "familias_conectadas", "id")
    top = rk.top_with_ties(who, ["pais"], "grado", n, "_r").drop("_r")
    return rk.number_rows(top, ["pais"], [F.desc("grado"), F.desc("familias_conectadas"), F.col("id")], "ranking").drop("id")


def connecting_families(kin: DataFrame, persons: DataFrame, top: int = 10, key: str = "person_id") -> DataFrame:
    """Families with the largest degree sum per country."""
    e = graph.simplify(kin.filter(F.col("clase_pais") == "Intra-país"))
    who = graph.degree(e).join(persons.select(F.col(key).alias("id"), "pais", "familia"), "id")
    return graph.group_connectivity(who, top).drop("ranking").withColumns(
        {"pais_label": sentence_case("pais"), "familia_corto": shorten("familia")})


# --- between countries ----------------------------------------------------------

def country_union(edges_dst: DataFrame, mentions: DataFrame, own: str) -> DataFrame:
    """Kin and professional links per pair of countries."""
    kin = edges_dst.filter(F.col("pais_origen") != F.col("pais_destino")).groupBy("pais_origen", "pais_destino").agg(
        F.count("*").alias("n_familia"))
    work = mentions.groupBy(F.col(own).alias("pais_origen"), F.col("vinculo").alias("pais_destino")).agg(
        F.count("*").alias("n_diplomatica"))
    return joins.full_zero(kin, work, ["pais_origen", "pais_destino"], "n_total").filter(F.col("n_total") > 0)


def bridge_persons(
    df: DataFrame, text: str, patterns: dict[str, list[str]], own: str, words: dict[str, list[str]]
) -> DataFrame:
    """Persons tied to another country, with the words around the hit of the first target that has any.

    ``words`` gives the words of each target; the person's own country is no target, in any case of letters.
    """
    context = F.coalesce(*[
        F.when(rules.other_country(F.col(own), F.lit(target)), kwic(text, words[target]))
        for target in patterns if words.get(target)])
    return rules.target_links(df, [text], patterns, own).withColumn("contexto_conexion", context)


def crossed_links(e: DataFrame, nat: DataFrame, key: str = "person_id") -> DataFrame:
    """Links whose two ends have different, known nationalities."""
    out = joins.enrich_both(e, nat, ["nacionalidad"], key)
    return out.filter(rules.crossed_flag("src_nacionalidad", "dst_nacionalidad"))


def shared_surnames(persons: DataFrame, a: str, b: str, extra: list[str] | None = None) -> DataFrame:
    """Surnames of both countries with counts; ``extra`` keeps, e.g., the office."""
    rows = persons.filter(F.col("pais").isin(a, b)).select("pais", *(extra or []), last_two_tokens("nombre").alias("s"))
    rows = rows.select("pais", *(extra or []), "s.*").filter(F.col("surname_1") != "")
    long = agg.to_long(rows, ["pais", *(extra or [])], ["surname_1", "surname_2"], "pos", "surname")
    return agg.in_both(long.filter(F.col("surname") != ""), "surname", "pais", a, b)


def shared_office_surnames(persons: DataFrame, a: str, b: str, office: str = "cargo_tipo") -> DataFrame:
    """The same among office holders, one row for each surname and office."""
    rows = persons.filter(F.col("pais").isin(a, b)).select("pais", office, last_two_tokens("nombre").alias("s"))
    long = agg.to_long(rows.select("pais", office, "s.*"), ["pais", office], ["surname_1", "surname_2"], "pos", "surname")
    long = long.filter((F.length("surname") > 2) & ~F.col("surname").isin(fixed.SURNAME_ARTICLES))
    both = agg.in_both(long, "surname", "pais", a, b)
    offices = long.filter(F.col(office).isNotNull()).select("surname", F.col(office).alias("cargo")).distinct()
    return both.join(offices, "surname")


def office_types_by_country(profiles: DataFrame) -> DataFrame:
    """Office types per country."""
    return profiles.groupBy("pais", "cargo_tipo").agg(F.count("*").alias("n"))


def diplomatic_links(kin: DataFrame, profiles: DataFrame, key: str = "person_id") -> DataFrame:
    """Kin links from an ambassador or diplomat to another country."""
    dip = profiles.filter(F.col("cargo_es_embajador") | F.col("cargo_es_diplomatico")).select(
        F.col(key).alias("src"), "cargo_tipo")
    return kin.filter(F.col("src_pais") != F.col("dst_pais")).join(dip, "src").select(
        "src", "dst", "src_pais", "dst_pais", "relation_type", "cargo_tipo")


def person_frame(
    persons: DataFrame, positions: DataFrame, relations: DataFrame, nac: str, birth: str, death: str
) -> DataFrame:
    """One row per person with offices, relatives, foreign link, birth and death year."""
    return joins.attach_aggregates(persons, positions, relations).withColumns({
        "conexion_otros_paises": rules.foreign_link("pais", nac),
        "ano_nacimiento": first_year(birth, "wide"), "ano_fallecimiento": first_year(death, "wide"),
    })


def infobox_offices(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Structured offices of infobox texts, one row per office, without a shuffle."""
    return rk.segment_cells(df, id_col, label_values(text), "|".join(fixed.OFFICE_HEADERS))


def expanded_relations(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Every named relative of the relation columns, with or without a URL."""
    cells = F.array(*[F.struct(F.lit(f).alias("tipo_relacion"), links_any(f).alias("x")) for f in fields])
    rows = df.select(id_col, F.inline(cells)).select(id_col, "tipo_relacion", F.inline("x"))
    return rows.withColumnRenamed("name", "nombre")


def densest_families(kin: DataFrame, n: int = 15) -> DataFrame:
    """Families with the most links inside."""
    counts = kin.filter(intra_family()).groupBy(F.col("src_familia").alias("familia")).agg(F.count("*").alias("n"))
    return rk.top_n(counts, [F.desc("n"), F.col("familia")], n)


def inter_family_marriages(kin: DataFrame) -> DataFrame:
    """Marriages between families per country."""
    return kin.filter(is_spouse() & (F.col("clase_familia") == "Inter-familia")).groupBy(
        F.col("src_pais").alias("pais")).agg(F.count("*").alias("n"))


def direct_links(kin: DataFrame) -> DataFrame:
    """Kin links between two known countries with relation and names."""
    return kin.filter(F.col("src_pais") != F.col("dst_pais")).select(
        "src", "dst", "relation_type", "src_pais", "dst_pais", "src_nombre", "dst_nombre")

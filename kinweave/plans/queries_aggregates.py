"""G01-G18 over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import aggregates as agg
from kinweave.operators.shape import has_value
from kinweave.plans.registry import query


@query("g01_count_by", "v_kin", """
    SELECT src_pais, dst_pais, relation_type, count(*) AS n FROM v_kin WHERE clase_pais = 'Inter-país' GROUP BY 1, 2, 3""")
def _(fx):
    return agg.count_by(fx.kin().filter("clase_pais = 'Inter-país'"), ["src_pais", "dst_pais", "relation_type"])


@query("g02_summarise", "v_attr", """
    SELECT familia, pais, count(*) AS n_personas, count(*) FILTER (trim(cargos) <> '') AS n_con_cargos,
           count(*) FILTER (trim(lugar) <> '') AS n_con_lugar FROM v_attr GROUP BY 1, 2""")
def _(fx):
    return agg.summarise(fx.attr(), ["familia", "pais"], {
        "n_personas": F.count("*"), "n_con_cargos": agg.n_if(has_value("cargos")), "n_con_lugar": agg.n_if(has_value("lugar"))})


@query("g03_rate", "v_kin", """
    SELECT src_pais, count(*) AS total, count(*) FILTER (clase_familia = 'Intra-familia') AS casos,
           round(100.0 * count(*) FILTER (clase_familia = 'Intra-familia') / count(*), 1)::DOUBLE AS pct
    FROM v_kin GROUP BY 1""")
def _(fx):
    return agg.rate(fx.kin(), ["src_pais"], F.col("clase_familia") == "Intra-familia")


@query("g04_distinct_by", "v_mention", """
    SELECT periodo, count(DISTINCT person_id) AS n_person_id, count(DISTINCT surname_1) AS n_surname_1 FROM v_mention GROUP BY 1""")
def _(fx):
    return agg.distinct_by(fx.mention(), ["periodo"], ["person_id", "surname_1"])


@query("g05_join_text", "v_spell", """
    SELECT person_id, valor, row_number() OVER (PARTITION BY person_id ORDER BY valor) AS ordinal FROM (SELECT DISTINCT person_id, cargo_text AS valor FROM v_spell)""")
def _(fx):
    return agg.join_text(fx.spell(), ["person_id"], "cargo_text")


@query("g05_join_text_first_seen", "v_spell", """
    WITH d AS (SELECT person_id, cargo_text AS valor, min(spell_id) AS o FROM v_spell GROUP BY 1, 2)
    SELECT person_id, valor, row_number() OVER (PARTITION BY person_id ORDER BY o) AS ordinal FROM d""")
def _(fx):
    return agg.join_text(fx.spell(), ["person_id"], "cargo_text", order="spell_id")


@query("g06_in_both", "v_mention", """
    SELECT surname_1, count(*) FILTER (pais = 'ASIA') AS n_a, count(*) FILTER (pais = 'EUROPE') AS n_b, count(*) AS total
    FROM v_mention GROUP BY 1 HAVING n_a > 0 AND n_b > 0""")
def _(fx):
    return agg.in_both(fx.mention(), "surname_1", "pais", "ASIA", "EUROPE")


@query("g07_edge_context", "v_spell", """
    WITH e AS (SELECT person_id AS src, anio AS dst, spell_id AS pos, concat(cargo_text, ' ', CAST(spell_id AS VARCHAR)) AS texto, o_orderstatus AS c FROM v_spell)
    SELECT src, dst, texto AS valor, row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS ordinal, arg_min(c, pos) OVER (PARTITION BY src, dst) AS contexto FROM e""")
def _(fx):
    e = fx.spell().select(
        F.col("person_id").alias("src"), F.col("anio").alias("dst"), F.col("spell_id").alias("pos"),
        F.concat("cargo_text", F.lit(" "), "spell_id").alias("texto"), F.col("o_orderstatus").alias("c"))
    return agg.edge_context(e, "texto", "c", "pos")


@query("g08_quantile_flag", "v_edge", """
    WITH d AS (SELECT src, count(*) AS grado FROM v_edge GROUP BY 1)
    SELECT src, grado, grado >= (SELECT quantile_cont(grado, 0.8) FROM d) AS destacado FROM d""")
def _(fx):
    return agg.quantile_flag(fx.edge().groupBy("src").agg(F.count("*").alias("grado")), "grado", 0.8)


@query("g08_quantile_flag_positive", "v_person", """
    WITH d AS (SELECT person_id, c_acctbal FROM v_person WHERE c_acctbal > 0)
    SELECT person_id, c_acctbal, c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.85) FROM d) AS destacado FROM d""")
def _(fx):
    return agg.quantile_flag(fx.person().filter("c_acctbal > 0").select("person_id", "c_acctbal"), "c_acctbal", 0.85)


@query("g09_totals", "v_attr", """
    SELECT count(*) AS total, count(*) FILTER (trim(cargos) <> '') AS n_tiene_cargo, count(*) FILTER (trim(lugar) <> '') AS n_tiene_lugar FROM v_attr""")
def _(fx):
    p = fx.attr().select(has_value("cargos").alias("tiene_cargo"), has_value("lugar").alias("tiene_lugar"))
    return agg.totals(p, ["tiene_cargo", "tiene_lugar"])


@query("g10_stats_by", "v_edge v_person", """
    WITH d AS (SELECT src, count(*) AS grado FROM v_edge GROUP BY 1)
    SELECT pais, count(*) AS n, round(avg(grado), 4) AS media, max(grado) AS maximo, min(grado) AS minimo
    FROM d JOIN v_person ON src = person_id GROUP BY 1""")
def _(fx):
    d = fx.edge().groupBy(F.col("src").alias("person_id")).agg(F.count("*").alias("grado"))
    return agg.stats_by(d.join(fx.person(), "person_id"), "pais", "grado")


@query("g11_reaggregate", "v_kin", """
    WITH c AS (SELECT src_pais, dst_pais, relation_type, count(*) AS n FROM v_kin GROUP BY 1, 2, 3)
    SELECT src_pais, dst_pais, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2""")
def _(fx):
    c = agg.count_by(fx.kin(), ["src_pais", "dst_pais", "relation_type"])
    return agg.reaggregate(c, ["src_pais", "dst_pais"], "n")


@query("g12_label_counts", "v_mention", """
    SELECT pais, cargo_text, CAST(grouping(pais) AS INTEGER) AS es_global, count(*) AS n
    FROM v_mention GROUP BY GROUPING SETS ((cargo_text), (pais, cargo_text))""")
def _(fx):
    return agg.label_counts(fx.mention(), "cargo_text", "pais")


@query("g13_matrix", "v_kin", """
    SELECT src_pais, count(*) FILTER (dst_pais = 'ASIA') AS "ASIA", count(*) FILTER (dst_pais = 'EUROPE') AS "EUROPE",
           count(*) FILTER (dst_pais = 'AFRICA') AS "AFRICA", count(*) FILTER (dst_pais = 'AMERICA') AS "AMERICA",
           count(*) FILTER (dst_pais = 'MIDDLE EAST') AS "MIDDLE EAST", count(*) FILTER (dst_pais = 'NARNIA') AS "NARNIA" FROM v_kin GROUP BY 1""")
def _(fx):
    return agg.matrix(fx.kin(), "src_pais", "dst_pais", ["ASIA", "EUROPE", "AFRICA", "AMERICA", "MIDDLE EAST", "NARNIA"])


@query("g14_to_long", "v_edge", """
    SELECT relation_type, 'src' AS extremo, src AS id FROM v_edge UNION ALL SELECT relation_type, 'dst', dst FROM v_edge""")
def _(fx):
    return agg.to_long(fx.edge(), ["relation_type"], ["src", "dst"], "extremo", "id")


@query("g15_densify", "v_lkin", """
    WITH n AS (SELECT src_familia, relation_type, count(*) AS n FROM v_lkin GROUP BY 1, 2)
    SELECT f.src_familia, r.relation_type, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT src_familia FROM n) f
    CROSS JOIN (SELECT unnest(['conyuge', 'pareja', 'padres', 'hijos', 'hermanos', 'tutor']) AS relation_type) r
    LEFT JOIN n ON n.src_familia = f.src_familia AND n.relation_type = r.relation_type""")
def _(fx):
    k = agg.count_by(fx.kin("linaje"), ["src_familia", "relation_type"])
    return agg.densify(k, "src_familia", "relation_type", ["conyuge", "pareja", "padres", "hijos", "hermanos", "tutor"], "n")


@query("g16_widen_ordinal", "v_edge", """
    SELECT src, concat('familiar', CAST(row_number() OVER (PARTITION BY src ORDER BY dst, relation_type) AS VARCHAR)) AS ordinal, dst AS valor FROM v_edge""")
def _(fx):
    return agg.widen_ordinal(fx.edge(), "src", "dst", "familiar", [F.col("dst")])


@query("g17_coverage", "v_attr", """
    SELECT pais, count(*) AS personas, count(DISTINCT linaje) AS familias, count(*) FILTER (trim(cargos) <> '') AS con_cargo,
           round(100.0 * count(*) FILTER (trim(cargos) <> '') / count(*), 1)::DOUBLE AS pct_con_cargo FROM v_attr GROUP BY 1""")
def _(fx):
    return agg.coverage(fx.attr(), "pais", "linaje", has_value("cargos"))


@query("g18_pct_of", "v_attr", """
    SELECT familia, n_a, n_b, n_cero, round(100.0 * n_a / nullif(n_b, 0), 1)::DOUBLE AS pct_n_a, round(100.0 * n_b / nullif(n_b, 0), 1)::DOUBLE AS pct_n_b
    FROM (SELECT familia, count(*) FILTER (pais = 'ASIA') AS n_a, CASE WHEN familia = 'MACHINERY' THEN 0 ELSE count(*) END AS n_b,
                 CAST(0 AS BIGINT) AS n_cero FROM v_attr GROUP BY 1)""")
def _(fx):
    c = agg.summarise(fx.attr(), ["familia"], {
        "n_a": agg.n_if(F.col("pais") == "ASIA"), "n_b": agg.n_if(F.col("familia") != "MACHINERY"), "n_cero": F.count(F.lit(None))})
    return agg.pct_of(c, ["n_a", "n_b"], "n_b")

"""F01-F13 over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions.text import sentence_case, shorten
from kinweave.operators import shape
from kinweave.plans.fixtures import PERIODS
from kinweave.plans.registry import query


@query("f01_has_key", "v_attr", """
    SELECT person_id, lugar FROM v_attr WHERE lugar IS NOT NULL AND trim(lugar) <> '' AND lugar <> 'NA'""")
def _(fx):
    return shape.has_key(fx.attr().select("person_id", "lugar"), "lugar")


@query("f02_keep_existing", "v_attr", "SELECT person_id, nombre FROM v_attr")
def _(fx):
    return shape.keep_existing(fx.attr(), ["person_id", "nombre", "religion"])


@query("f03_suffix_cols", "v_edge v_person", """
    SELECT e.src, e.dst, a.nombre AS nombre_from, b.nombre AS nombre_to
    FROM v_edge e JOIN v_person a ON e.src = a.person_id JOIN v_person b ON e.dst = b.person_id""")
def _(fx):
    e, p = fx.edge().select("src", "dst"), fx.person().select("person_id", "nombre")
    a = shape.suffix_cols(p, ["person_id", "nombre"], "_from")
    b = shape.suffix_cols(p, ["person_id", "nombre"], "_to")
    return (
        e.join(a, e["src"] == a["person_id_from"]).join(b, e["dst"] == b["person_id_to"])
        .select("src", "dst", "nombre_from", "nombre_to")
    )


@query("f04_default_chain", "v_attr", """
    SELECT person_id, lower(coalesce(nullif(trim(cargos), ''), nullif(trim(lugar), ''), 'otro')) AS origen FROM v_attr""")
def _(fx):
    return fx.attr().select("person_id", shape.default_chain(["cargos", "lugar"], "otro").alias("origen"))


@query("f05_ensure_columns", "v_attr", """
    SELECT person_id, nombre, CAST(NULL AS VARCHAR) AS cargo_1, CAST(NULL AS INTEGER) AS nacimiento_ano FROM v_attr""")
def _(fx):
    return shape.ensure_columns(
        fx.attr().select("person_id", "nombre"), {"nombre": "string", "cargo_1": "string", "nacimiento_ano": "int"})


@query("f06_families_filter", "v_attr", """
    SELECT person_id, pais, nombre FROM v_attr
    WHERE (pais = 'ASIA' AND (regexp_matches(lower(coalesce(nombre, '')), 'red|blue')
           OR regexp_matches(lower(coalesce(familia, '')), 'red|blue') OR regexp_matches(lower(coalesce(lugar, '')), 'red|blue')))
       OR (pais = 'EUROPE' AND (regexp_matches(lower(coalesce(nombre, '')), 'build|brand#7')
           OR regexp_matches(lower(coalesce(familia, '')), 'build|brand#7') OR regexp_matches(lower(coalesce(lugar, '')), 'build|brand#7')))""")
def _(fx):
    config = {"ASIA": ["red", "blue"], "EUROPE": ["build", "brand#7"]}
    return shape.families_filter(fx.attr(), config, ["nombre", "familia", "lugar"]).select("person_id", "pais", "nombre")


@query("f07_bucket", "v_spell", """
    SELECT spell_id, CASE WHEN anio < 1997 THEN 'Pre-1997' WHEN anio < 1999 THEN '1997-1998' ELSE '1999+' END AS periodo,
           CASE WHEN nullif(anio, 1998) < 1996 THEN 'a' WHEN nullif(anio, 1998) >= 1996 THEN 'b' ELSE 'Desconocido' END AS cohorte
    FROM v_spell""")
def _(fx):
    gap = F.nullif(F.col("anio"), F.lit(1998))
    return fx.spell().select(
        "spell_id", shape.bucket("anio", *PERIODS).alias("periodo"),
        shape.bucket(gap, [1996], ["a", "b"], "Desconocido").alias("cohorte"))


@query("f08_first_match", "v_attr", """
    SELECT person_id, CASE WHEN regexp_matches(lower(cargos), 'standard|small') THEN 'Uno'
           WHEN regexp_matches(lower(cargos), '_1[0-9]$') THEN 'Dos' WHEN regexp_matches(lower(cargos), 'n') THEN 'Tres'
           ELSE 'Otro' END AS cargo_tipo FROM v_attr""")
def _(fx):
    rules = [("standard|small", "Uno"), ("_1[0-9]$", "Dos"), ("n", "Tres")]
    return fx.attr().select("person_id", shape.first_match("cargos", rules, "Otro").alias("cargo_tipo"))


@query("f09_flag_bank", "v_attr", """
    SELECT person_id, coalesce(regexp_matches(lower(cargos), 'economy'), false) AS es_economy,
           coalesce(regexp_matches(lower(cargos), 'small|medium'), false) AS es_medida,
           coalesce(regexp_matches(lower(cargos), '[13]$'), false) AS es_a FROM v_attr""")
def _(fx):
    flags = {"es_economy": "economy", "es_medida": "small|medium", "es_a": "[13]$"}
    return shape.flag_bank(fx.attr(), "cargos", flags).select("person_id", *flags)


@query("f10_has_value", "v_attr", """
    SELECT person_id, coalesce(trim(cargos) <> '', false) AS tiene_cargo, coalesce(trim(lugar) <> '', false) AS tiene_lugar FROM v_attr""")
def _(fx):
    return fx.attr().select(
        "person_id", shape.has_value("cargos").alias("tiene_cargo"), shape.has_value("lugar").alias("tiene_lugar"))


@query("f11_shorten", "v_attr", """
    SELECT person_id,
           CASE WHEN length(concat(nombre, ' de ', familia)) > 22 THEN concat(substr(concat(nombre, ' de ', familia), 1, 19), '...')
                ELSE concat(nombre, ' de ', familia) END AS corto,
           concat(upper(substr(pais, 1, 1)), lower(substr(pais, 2))) AS pais_label FROM v_attr""")
def _(fx):
    long_name = F.concat("nombre", F.lit(" de "), "familia")
    return fx.attr().select("person_id", shorten(long_name).alias("corto"), sentence_case("pais").alias("pais_label"))


@query("f12_top_or_other", "v_person", """
    WITH top AS (SELECT linaje FROM v_person GROUP BY linaje ORDER BY count(*) DESC, linaje LIMIT 10)
    SELECT person_id, CASE WHEN linaje IN (SELECT linaje FROM top) THEN linaje ELSE 'Otras' END AS grupo FROM v_person""")
def _(fx):
    return shape.top_or_other(fx.person(), "linaje", 10, "Otras", "grupo").select("person_id", "grupo")


@query("f13_in_values", "v_person", "SELECT person_id, pais FROM v_person WHERE pais IN ('ASIA', 'AFRICA')")
def _(fx):
    return shape.in_values(fx.person().select("person_id", "pais"), "pais", ["ASIA", "AFRICA"])

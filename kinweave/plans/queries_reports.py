"""The reports over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions.text import clean_json
from kinweave.operators import graph, rules
from kinweave.plans import reports as rp
from kinweave.plans.fixtures import PERIODS
from kinweave.plans.queries_graph import BOTH_WAYS, MARRIAGE, MUTUAL, ROUNDS, betweenness_sql, dist_sql
from kinweave.plans.queries_rules import DST_CTE, OFFICE_CTE, PLACES, SPECIAL_CTE, _office, dst_edges, hit_sql, special
from kinweave.plans.queries_text import _json
from kinweave.plans.registry import query

SPOUSE = "relation_type IN ('conyuge', 'pareja')"
INTRA = "clase_familia = 'Intra-familia'"


@query("a01_endogamy_by_country", "v_kin", f"""
    SELECT src_pais AS pais, count(*) AS matrimonios_total, count(*) FILTER ({INTRA}) AS matrimonios_endogamicos,
           round(100.0 * count(*) FILTER ({INTRA}) / count(*), 1)::DOUBLE AS tasa_endogamia_familiar FROM v_kin WHERE {SPOUSE} GROUP BY 1""")
def _(fx):
    return rp.endogamy(rp.kin_from_text(fx.person_text(), fx.known()))


@query("a02_country_comparison", "v_kin v_known", f"""
    WITH p AS (SELECT pais, count(*) AS n, count(DISTINCT familia) AS f FROM v_known GROUP BY 1),
    e AS (SELECT src_pais, count(*) AS t, count(*) FILTER ({INTRA}) AS i, count(*) FILTER (clase_familia = 'Inter-familia') AS x,
                 count(*) FILTER ({SPOUSE} AND {INTRA}) AS me, count(*) FILTER ({SPOUSE}) AS mt FROM v_kin GROUP BY 1)
    SELECT pais AS "Pais", n AS "Personas", f AS "Familias", coalesce(t, 0) AS "Conexiones_Total", coalesce(i, 0) AS "Conexiones_Intra_Familia",
           coalesce(x, 0) AS "Conexiones_Inter_Familia", coalesce(me, 0) AS "Matrimonios_Endogamicos", coalesce(mt, 0) AS "Matrimonios_Total",
           coalesce(round(100.0 * me / nullif(mt, 0), 2), 0)::DOUBLE AS "Tasa_Endogamia_Familiar",
           coalesce(round(100.0 * i / nullif(t, 0), 2), 0)::DOUBLE AS "Tasa_Endogamia_General", round(n / f, 2) AS "Personas_por_Familia"
    FROM p LEFT JOIN e ON pais = src_pais""")
def _(fx):
    return rp.country_comparison(fx.known(), fx.kin())


@query("a03_endogamous_marriages", "v_lkin", f"""
    SELECT src_familia, count(*) AS n_matrimonios_endogamicos FROM v_lkin WHERE {SPOUSE} AND {INTRA} GROUP BY 1""")
def _(fx):
    return rp.endogamous_marriages(fx.kin("linaje"))


OFFICES = {"es_economy": "economy", "es_small": "small", "es_medio": "medium|standard", "es_promo": "promo", "es_nacion": "nation_1|nation_2"}


@query("a04_offices_by_country", "v_attr", "SELECT pais, " + ", ".join(
    f"count(*) FILTER (regexp_matches(cargos, '{p}')) AS n_{n[3:]}" for n, p in OFFICES.items()
) + ", count(*) AS n_con_cargos FROM v_attr WHERE cargos <> '' GROUP BY 1")
def _(fx):
    return rp.offices_by_country(fx.attr(), "cargos", OFFICES)


@query("a05_elite_share", "v_attr", """
    SELECT pais, count(*) AS n_total, count(*) FILTER (cargos <> '') AS n_elite, round(100.0 * count(*) FILTER (cargos <> '') / count(*), 1)::DOUBLE AS pct_elite
    FROM v_attr GROUP BY 1""")
def _(fx):
    return rp.elite_share(fx.attr(), "cargos")


@query("a06_elite_flows", "v_kin v_attr", """
    SELECT src_pais, dst_pais, count(*) AS n FROM v_kin WHERE src IN (SELECT person_id FROM v_attr WHERE cargos <> '')
       AND dst IN (SELECT person_id FROM v_attr WHERE cargos <> '') GROUP BY 1, 2""")
def _(fx):
    return rp.elite_flows(fx.kin(), fx.attr(), "cargos")


@query("a07_network_metrics", "v_kin v_house", f"""
    WITH RECURSIVE e AS (SELECT src, dst, src_pais AS g FROM v_kin WHERE clase_pais = 'Intra-país'),
    nd AS (SELECT src AS id, src_pais AS g FROM v_kin UNION SELECT dst, dst_pais FROM v_kin WHERE dst_pais IS NOT NULL),
    u AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d, g FROM e), us AS (SELECT * FROM u WHERE s <> d),
    v_adj AS (SELECT s AS a, d AS b FROM us UNION ALL SELECT d, s FROM us),
    r(id, m) AS (SELECT id, id FROM nd UNION SELECT x.b, r.m FROM r JOIN v_adj x ON r.id = x.a), comp AS (SELECT id, min(m) AS component FROM r GROUP BY id),
    cs AS (SELECT g, component, count(*) AS n FROM comp JOIN nd ON comp.id = nd.id GROUP BY 1, 2),
    ha AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM v_house WHERE pa = pb UNION ALL SELECT dst, src FROM v_house WHERE pa = pb)),
    {dist_sql('ha')},
    ap AS (SELECT string_split(s, '/')[1] AS g, avg(d) AS ap FROM dist WHERE d > 0 GROUP BY 1),
    tr AS (SELECT nd.g, count(*) AS t FROM v_adj x JOIN v_adj y ON x.b = y.a JOIN v_adj z ON y.b = z.a AND z.b = x.a JOIN nd ON nd.id = x.a WHERE x.a < x.b AND x.b < y.b GROUP BY 1),
    wd AS (SELECT nd.g, sum(k * (k - 1) / 2) AS w FROM (SELECT a, count(*) AS k FROM v_adj GROUP BY 1) JOIN nd ON nd.id = a GROUP BY 1)
    SELECT x.g AS pais, x.n AS n_nodes, m.m AS n_edges, round(m.m / (x.n * (x.n - 1)), 4) AS density, round(2 * um.m / x.n, 2) AS avg_degree,
           round(3 * coalesce(tr.t, 0) / nullif(wd.w, 0), 4) AS transitivity, c.k AS n_componentes, c.mx AS giant_size, round(ap.ap, 3) AS avg_path_houses
    FROM (SELECT g, count(*) AS n FROM nd GROUP BY 1) x JOIN (SELECT g, count(*) AS m FROM e GROUP BY 1) m ON x.g = m.g
    JOIN (SELECT g, count(*) AS m FROM u GROUP BY 1) um ON x.g = um.g JOIN (SELECT g, count(*) AS k, max(n) AS mx FROM cs GROUP BY 1) c ON x.g = c.g
    LEFT JOIN wd ON x.g = wd.g LEFT JOIN tr ON x.g = tr.g LEFT JOIN ap ON x.g = ap.g""")
def _(fx):
    k = fx.kin()
    ends = k.select(F.col("src").alias("id"), F.col("src_pais").alias("pais")).union(k.select("dst", "dst_pais")).dropna().distinct()
    return rp.network_metrics(k, ends, fx.house_links(within=True))


@query("a08_country_flows", "v_kin", "SELECT src_pais, dst_pais, count(*) AS n FROM v_kin WHERE clase_pais = 'Inter-país' GROUP BY 1, 2")
def _(fx):
    return rp.country_flows(fx.kin())


COUNTRIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("a08_country_matrix", "v_kin", "SELECT src_pais, " + ", ".join(
    f"""count(*) FILTER (dst_pais = '{c}') AS "{c}" """ for c in COUNTRIES) + "FROM v_kin WHERE clase_pais = 'Inter-país' GROUP BY 1")
def _(fx):
    return rp.country_matrix(fx.kin(), COUNTRIES)


@query("a09_link_balance", "v_kin", """
    WITH i AS (SELECT * FROM v_kin WHERE clase_pais = 'Inter-país'), o AS (SELECT src_pais AS p, count(*) AS n FROM i GROUP BY 1), t AS (SELECT dst_pais AS p, count(*) AS n FROM i GROUP BY 1)
    SELECT coalesce(o.p, t.p) AS pais, coalesce(o.n, 0) AS conexiones_salientes, coalesce(t.n, 0) AS conexiones_entrantes,
           coalesce(o.n, 0) + coalesce(t.n, 0) AS total_conexiones FROM o FULL JOIN t ON o.p = t.p""")
def _(fx):
    return rp.link_balance(fx.kin())


@query("a10_json_validity", "", """
    SELECT event_type, count(*) AS n_total, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0) AS n_json_valido,
           round(100.0 * count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0) / count(*), 1)::DOUBLE AS pct_json_valido FROM events GROUP BY 1""")
def _(fx):
    return rp.json_validity(_json(fx), "event_type", clean_json("j"))


_LABELS = """
    l AS (SELECT event_type AS pais, concat('k', CAST(user_id AS VARCHAR)) AS label FROM events WHERE event_id % 7 <> 0
          UNION ALL SELECT event_type, 'fijo' FROM events WHERE event_id % 7 <> 0)"""


def _labelled(fx):
    good = F.concat(F.lit('[{"label": "k'), "user_id", F.lit('\x02"}, {"label": "fijo"}, {"label": " "}]'))
    return fx.t("events").select(F.col("event_type").alias("pais"), F.when(F.col("event_id") % 7 == 0, "roto").otherwise(good).alias("j"))


@query("a11_label_frequencies", "", f"""WITH {_LABELS}
    SELECT pais, label, CAST(grouping(pais) AS INTEGER) AS es_global, count(*) AS n FROM l GROUP BY GROUPING SETS ((label), (pais, label))""")
def _(fx):
    return rp.label_frequencies(_labelled(fx), "pais", "j")


@query("a11_top_labels", "", f"""WITH {_LABELS}, c AS (SELECT pais, label, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT pais, label, n FROM (SELECT *, row_number() OVER (PARTITION BY pais ORDER BY n DESC, label) AS rn FROM c) WHERE rn <= 20""")
def _(fx):
    return rp.top_labels(_labelled(fx), "pais", "j")


# A mention is a year in the text of an office; the surname carries the lineage.
_MENTION = """
    mm AS (SELECT s.person_id, concat(string_split(p.nombre, ' ')[-1], '-', translate(p.linaje, '0123456789', 'abcdefghij')) AS surname_1, s.anio AS year, s.cargo_text,
           CASE WHEN s.anio < 1997 THEN 'Pre-1997' WHEN s.anio < 1999 THEN '1997-1998' ELSE '1999+' END AS periodo
           FROM v_spell s JOIN v_person p ON s.person_id = p.person_id WHERE s.anio BETWEEN 1800 AND 2025),
    sc AS (SELECT periodo, surname_1, count(*) AS n FROM mm GROUP BY 1, 2)"""


def _mentions(fx):
    name = F.concat("nombre", F.lit("-"), F.translate("linaje", "0123456789", "abcdefghij"))
    p = fx.person().select("person_id", name.alias("nombre"))
    office = fx.spell().select("person_id", "cargo_text", F.concat("cargo_text", F.lit(" desde "), "anio").alias("texto"))
    return rp.year_mentions(office.join(p, "person_id"), ["texto"], PERIODS)


@query("a12_surnames_by_period", "v_spell v_person", f"""WITH {_MENTION}
    SELECT periodo, surname_1, n, row_number() OVER (PARTITION BY periodo ORDER BY n DESC, surname_1) AS rank FROM sc""")
def _(fx):
    return rp.surnames_by_period(_mentions(fx))


@query("a13_surnames_of_one_period", "v_spell v_person", """
    WITH m AS (SELECT concat('p', CAST(person_id AS VARCHAR), 'x') AS surname_1, CASE WHEN anio < 1997 THEN 'Pre-1997' WHEN anio < 1999 THEN '1997-1998' ELSE '1999+' END AS periodo
               FROM v_spell ),
    s AS (SELECT surname_1, count(DISTINCT periodo) AS n_periodos, min(periodo) AS periodos, count(*) AS total_cargos FROM m GROUP BY 1)
    SELECT *, CASE WHEN periodos = 'Pre-1997' THEN 'desaparecido' ELSE 'nuevo' END AS clase FROM s WHERE n_periodos = 1""")
def _(fx):
    m = fx.mention().select(F.concat(F.lit("p"), "person_id", F.lit("x")).alias("surname_1"), "periodo")
    return rp.surnames_of_one_period(m, "Pre-1997")


@query("a14_office_types_by_period", "v_spell v_person", f"""WITH {_MENTION},
    c AS (SELECT periodo, CASE WHEN cargo_text LIKE '%urgent%' THEN 'Urgente' WHEN regexp_matches(cargo_text, 'high|medium') THEN 'Medio' ELSE 'Otro' END AS cargo_tipo, count(*) AS n FROM mm GROUP BY 1, 2)
    SELECT periodo, cargo_tipo, n, round(100.0 * n / sum(n) OVER (PARTITION BY periodo), 1)::DOUBLE AS pct FROM c""")
def _(fx):
    return rp.office_types_by_period(_mentions(fx), "cargo_text", [("urgent", "Urgente"), ("high|medium", "Medio")])


@query("a15_surname_diversity", "v_spell v_person", f"""WITH {_MENTION},
    t AS (SELECT periodo, CAST(sum(n) AS BIGINT) AS top10_n FROM (SELECT *, row_number() OVER (PARTITION BY periodo ORDER BY n DESC, surname_1) AS rn FROM sc) WHERE rn <= 10 GROUP BY 1)
    SELECT mm.periodo, count(DISTINCT person_id) AS n_personas, count(DISTINCT surname_1) AS n_apellidos_unicos, count(*) AS total_n, any_value(top10_n) AS top10_n,
           round(100.0 * any_value(top10_n) / count(*), 1)::DOUBLE AS apellidos_top10_pct FROM mm JOIN t ON mm.periodo = t.periodo GROUP BY 1""")
def _(fx):
    return rp.surname_diversity(_mentions(fx))


@query("a16_period_comparison", "v_spell v_person", f"""WITH {_MENTION},
    pre AS (SELECT surname_1, n FROM sc WHERE periodo = 'Pre-1997' ORDER BY n DESC, surname_1 LIMIT 15),
    post AS (SELECT surname_1, CAST(sum(n) AS BIGINT) AS n FROM sc WHERE periodo <> 'Pre-1997' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
    SELECT surname_1, n, 'pre' AS lado, CASE WHEN surname_1 IN (SELECT surname_1 FROM post) THEN 'Ambos períodos' ELSE 'Solo pre' END AS categoria FROM pre
    UNION ALL SELECT surname_1, n, 'post', CASE WHEN surname_1 IN (SELECT surname_1 FROM pre) THEN 'Ambos períodos' ELSE 'Solo post' END FROM post""")
def _(fx):
    return rp.period_comparison(_mentions(fx), "Pre-1997")


_TREND = _MENTION + """,
    tp AS (SELECT surname_1 FROM mm GROUP BY 1 ORDER BY count(*) DESC, surname_1 LIMIT 12),
    tr AS (SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, surname_1, count(*) AS n FROM mm WHERE surname_1 IN (SELECT surname_1 FROM tp) GROUP BY 1, 2)"""


@query("a17_decade_trend", "v_spell v_person", f"WITH {_TREND} SELECT * FROM tr")
def _(fx):
    return rp.decade_trend(_mentions(fx), 12, dense=False)


@query("a17_decade_trend_dense", "v_spell v_person", f"""WITH {_TREND}
    SELECT d.decade, s.surname_1, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(1800, 2021, 10)) AS INTEGER) AS decade) d CROSS JOIN (SELECT DISTINCT surname_1 FROM tr) s
    LEFT JOIN tr ON tr.decade = d.decade AND tr.surname_1 = s.surname_1""")
def _(fx):
    return rp.decade_trend(_mentions(fx), 12, dense=True)


_BORN = """b AS (SELECT *, CASE WHEN person_id % 10 <> 0 THEN CAST(1860 + person_id % 150 AS INTEGER) END AS y FROM v_attr)"""


def _born(fx):
    birth = F.when(F.col("person_id") % 10 != 0, F.concat(F.lit("el 1 de enero de "), (1860 + F.col("person_id") % 150).cast("string")))
    return fx.attr().withColumn("fecha_nacimiento", birth)


@query("a18_family_persistence", "v_attr", f"""WITH {_BORN},
    g AS (SELECT linaje AS familia, CASE WHEN y < 1900 THEN 'Pre-1900' WHEN y < 1950 THEN '1900-1950' WHEN y < 1980 THEN '1950-1980' WHEN y >= 1980 THEN '1980+' ELSE 'Desconocido' END AS generacion,
                 count(*) AS n_personas, count(*) FILTER (cargos <> '') AS n_con_cargos, count(*) FILTER (ocupacion <> '') AS n_con_ocupacion FROM b GROUP BY 1, 2),
    t AS (SELECT familia, CAST(sum(n_personas) AS BIGINT) AS total_personas, count(DISTINCT generacion) AS total_generaciones FROM g GROUP BY 1)
    SELECT g.*, total_personas, total_generaciones, round(total_generaciones * ln(total_personas + 1), 6) AS persistencia_score FROM g JOIN t ON g.familia = t.familia""")
def _(fx):
    p = _born(fx).withColumn("familia", F.col("linaje"))
    return rp.family_persistence(p, "fecha_nacimiento", "cargos", "ocupacion")


@query("a19_power_geography", "v_attr", """
    WITH g AS (SELECT linaje AS familia, CASE WHEN lugar IS NULL OR lugar = '  ' THEN lugar ELSE concat(nombre, ' Nº ', lugar) END AS l FROM v_attr),
    r AS (SELECT familia, CASE WHEN regexp_matches(lower(l), 'red|blue') THEN 'Norte' WHEN regexp_matches(lower(l), 'gear|bolt') THEN 'Sur'
                      WHEN l <> '' THEN 'Otras provincias' ELSE 'Desconocido' END AS region_poder FROM g),
    c AS (SELECT familia, region_poder, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT familia, region_poder, n, CAST(sum(n) OVER (PARTITION BY familia) AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (PARTITION BY familia), 1)::DOUBLE AS pct,
           first_value(region_poder) OVER (PARTITION BY familia ORDER BY n DESC, region_poder) AS region_dominante FROM c""")
def _(fx):
    place = F.when(F.trim("lugar") != "", F.concat("nombre", F.lit(" Nº "), "lugar")).otherwise(F.col("lugar"))
    p = fx.attr().withColumn("familia", F.col("linaje")).withColumn("lugar", place)
    return rp.power_geography(p, "lugar", [("red|blue", "Norte"), ("gear|bolt", "Sur")])


@query("a20_visibility_by_period", "v_attr", f"""WITH {_BORN},
    v AS (SELECT CASE WHEN y < 1950 THEN 'Pre-1950' WHEN y < 1980 THEN '1950-1980' WHEN y >= 1980 THEN '1980+' END AS periodo,
                 CASE WHEN regexp_matches(lower(nombre), '(^| )(red|blue)($| )') OR lower(ocupacion) = 'large' THEN 'A' ELSE 'B' END AS categoria, lower(ocupacion) <> 'small' AS own FROM b)
    SELECT periodo, categoria, count(*) AS n_total, count(*) FILTER (own) AS n_visibilidad_independiente, round(100.0 * count(*) FILTER (own) / count(*), 1)::DOUBLE AS pct_visibilidad
    FROM v WHERE periodo IS NOT NULL GROUP BY 1, 2""")
def _(fx):
    words = {"nombres": ["red", "blue"], "ocupaciones": ["large"], "dependiente": ["small"], "propias": ["grande"]}
    return rp.visibility_by_period(_born(fx), "fecha_nacimiento", "nombre", "ocupacion", words, ("A", "B"))


@query("a21_repeated_names", "v_person", """
    WITH c AS (SELECT linaje AS familia, string_split(nombre, ' ')[1] AS nombre_pila, count(*) AS n FROM v_person GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY familia) AS BIGINT) AS total_familia, round(100.0 * n / sum(n) OVER (PARTITION BY familia), 1)::DOUBLE AS pct FROM c) WHERE n >= 2""")
def _(fx):
    return rp.repeated_names(fx.person().withColumn("familia", F.col("linaje")))


@query("a22_marriage_links", "v_lkin", f"WITH {MARRIAGE} SELECT src, dst, weight FROM links")
def _(fx):
    k = fx.kin("linaje").filter(rp.is_spouse() & (F.col("clase_familia") == "Inter-familia"))
    return graph.contract(k, "src_familia", "dst_familia")


@query("a22_central_families", "v_lkin", f"""WITH RECURSIVE {MARRIAGE}, {betweenness_sql('ma')},
    dg AS (SELECT a AS id, count(*) AS grado FROM ma GROUP BY 1)
    SELECT dg.id AS familia, grado, round(coalesce(b, 0), 6) AS betweenness, grado >= (SELECT quantile_cont(grado, 0.8) FROM dg) AS familia_central
    FROM dg LEFT JOIN bt ON dg.id = bt.id ORDER BY grado DESC, dg.id LIMIT 15""")
def _(fx):
    return rp.central_families(fx.kin("linaje")).withColumn("betweenness", F.round("betweenness", 6))


_INTRA_ADJ = """
    us AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM v_kin WHERE clase_pais = 'Intra-país' AND src <> dst),
    ia AS (SELECT s AS a, d AS b FROM us UNION ALL SELECT d, s FROM us), dg AS (SELECT a AS id, count(*) AS grado FROM ia GROUP BY 1)"""


@query("a23_top_connectors", "v_kin v_person", f"""WITH {_INTRA_ADJ},
    f AS (SELECT a AS id, count(DISTINCT linaje) AS familias_conectadas FROM ia JOIN v_person ON b = person_id GROUP BY 1),
    x AS (SELECT p.pais, p.nombre, p.url, grado, familias_conectadas, dg.id FROM dg JOIN v_person p ON dg.id = p.person_id JOIN f ON f.id = dg.id),
    y AS (SELECT *, rank() OVER (PARTITION BY pais ORDER BY grado DESC) AS r FROM x)
    SELECT pais, nombre, url, grado, familias_conectadas, row_number() OVER (PARTITION BY pais ORDER BY grado DESC, familias_conectadas DESC, id) AS ranking FROM y WHERE r <= 15""")
def _(fx):
    return rp.top_connectors(fx.kin(), fx.person(), "linaje")


@query("a24_connecting_families", "v_kin v_person", f"""WITH {_INTRA_ADJ},
    g AS (SELECT pais, linaje AS familia, CAST(sum(grado) AS BIGINT) AS total_conexiones, count(*) AS n_miembros FROM dg JOIN v_person ON id = person_id GROUP BY 1, 2),
    y AS (SELECT *, rank() OVER (PARTITION BY pais ORDER BY total_conexiones DESC) AS r FROM g)
    SELECT pais, familia, total_conexiones, n_miembros, concat(upper(substr(pais, 1, 1)), lower(substr(pais, 2))) AS pais_label,
           CASE WHEN length(familia) > 22 THEN concat(substr(familia, 1, 19), '...') ELSE familia END AS familia_corto FROM y WHERE r <= 4""")
def _(fx):
    p = fx.person().select("person_id", "pais", F.col("linaje").alias("familia"))
    return rp.connecting_families(fx.kin(), p, 4)


_PLACE_ROWS = " UNION ALL ".join(
    f"SELECT person_id, lower(pais) AS pais, '{c}' AS v, '{kind}' AS t FROM v_person WHERE {hit_sql(f, w)} AND lower(pais) <> '{c}'"
    for f, kind in {"linaje": "nacimiento", "nombre": "trabajo"}.items() for c, w in PLACES.items())


@query("a25_country_union", "v_edge v_person", f"""WITH {DST_CTE},
    k AS (SELECT lower(src_pais) AS o, lower(pais_destino) AS d, count(*) AS n FROM dst WHERE lower(src_pais) <> lower(pais_destino) GROUP BY 1, 2),
    m AS (SELECT pais AS o, v AS d, count(*) AS n FROM (SELECT DISTINCT * FROM ({_PLACE_ROWS})) GROUP BY 1, 2)
    SELECT coalesce(k.o, m.o) AS pais_origen, coalesce(k.d, m.d) AS pais_destino, coalesce(k.n, 0) AS n_familia, coalesce(m.n, 0) AS n_diplomatica,
           coalesce(k.n, 0) + coalesce(m.n, 0) AS n_total FROM k FULL JOIN m ON k.o = m.o AND k.d = m.d""")
def _(fx):
    e = dst_edges(fx).select(F.lower("src_pais").alias("pais_origen"), F.lower("pais_destino").alias("pais_destino"))
    p = fx.person().withColumn("pais", F.lower("pais"))
    said = rules.mentions_by_field(p, "person_id", "pais", {"linaje": "nacimiento", "nombre": "trabajo"}, PLACES)
    return rp.country_union(e, said, "pais")


def _near(word: str, own: str) -> str:
    return f"CASE WHEN lang <> '{own}' THEN nullif(array_to_string(regexp_extract_all(text, '.{{0,50}}{word}.{{0,50}}'), ' | '), '') END"


@query("a26_bridge_persons", "", f"""
    WITH d AS (SELECT doc_id, lang, text, CASE WHEN lang <> 'de' AND regexp_matches(lower(text), 'nicht|und .*der') THEN 'DE' END AS a,
                      CASE WHEN lang <> 'es' AND regexp_matches(lower(text), 'ción') THEN 'ES' END AS b FROM documents)
    SELECT doc_id, concat_ws(', ', a, b) AS conecta_con, coalesce({_near('nicht', 'de')}, {_near('ción', 'es')}) AS contexto_conexion
    FROM d WHERE a IS NOT NULL OR b IS NOT NULL""")
def _(fx):
    d = fx.t("documents").withColumnRenamed("lang", "propio")  # in small letters, as in a path
    out = rp.bridge_persons(d, "text", {"DE": ["nicht", "und .*der"], "ES": ["ción"]}, "propio", {"DE": ["nicht"], "ES": ["ción"]})
    return out.select("doc_id", "conecta_con", "contexto_conexion")


@query("a27_special_cases", "v_person", f"""WITH {SPECIAL_CTE}
    SELECT person_id, nombre, pais_familia, pais_nacionalidad, concat(pais_nacionalidad, ' en familia de ', pais_familia) AS tipo_caso
    FROM s WHERE pais_nacionalidad <> 'Desconocido' AND pais_nacionalidad <> pais_familia""")
def _(fx):
    return rules.special_cases(special(fx), "pais_familia", "pais_nacionalidad")


@query("a27_crossed_links", "v_edge v_person", f"""WITH {SPECIAL_CTE}
    SELECT e.src, e.dst, e.relation_type, a.pais_nacionalidad AS src_nacionalidad, b.pais_nacionalidad AS dst_nacionalidad FROM v_edge e
    JOIN s a ON e.src = a.person_id JOIN s b ON e.dst = b.person_id
    WHERE a.pais_nacionalidad <> 'Desconocido' AND b.pais_nacionalidad <> 'Desconocido' AND a.pais_nacionalidad <> b.pais_nacionalidad""")
def _(fx):
    return rp.crossed_links(fx.edge(), special(fx).withColumnRenamed("pais_nacionalidad", "nacionalidad"))


_SURNAMES = """sn AS (SELECT pais, string_split(nombre, ' ')[-1] AS surname FROM v_person WHERE pais IN ('ASIA', 'EUROPE')
                     UNION ALL SELECT pais, string_split(nombre, ' ')[-2] FROM v_person WHERE pais IN ('ASIA', 'EUROPE'))"""


@query("a28_shared_surnames", "v_person", f"""WITH {_SURNAMES}
    SELECT surname, count(*) FILTER (pais = 'ASIA') AS n_a, count(*) FILTER (pais = 'EUROPE') AS n_b, count(*) AS total FROM sn GROUP BY 1 HAVING n_a > 0 AND n_b > 0""")
def _(fx):
    return rp.shared_surnames(fx.person(), "ASIA", "EUROPE")


@query("a28_shared_office_surnames", "v_attr", f"""WITH {OFFICE_CTE},
    x AS (SELECT o.pais, o.cargo_tipo, string_split(a.nombre, ' ') AS t FROM office o JOIN v_attr a ON o.person_id = a.person_id WHERE o.pais IN ('ASIA', 'EUROPE')),
    sn AS (SELECT pais, cargo_tipo, t[-1] AS surname FROM x UNION ALL SELECT pais, cargo_tipo, t[-2] FROM x),
    b AS (SELECT surname, count(*) FILTER (pais = 'ASIA') AS n_a, count(*) FILTER (pais = 'EUROPE') AS n_b, count(*) AS total FROM sn
          WHERE length(surname) > 2 GROUP BY 1 HAVING n_a > 0 AND n_b > 0)
    SELECT DISTINCT b.surname, n_a, n_b, total, cargo_tipo AS cargo FROM b JOIN sn ON b.surname = sn.surname WHERE cargo_tipo IS NOT NULL""")
def _(fx):
    names = fx.attr().select("person_id", "nombre")
    return rp.shared_office_surnames(_office(fx).join(names, "person_id"), "ASIA", "EUROPE")


@query("a29_office_types_by_country", "v_attr", f"WITH {OFFICE_CTE} SELECT pais, cargo_tipo, count(*) AS n FROM office GROUP BY 1, 2")
def _(fx):
    return rp.office_types_by_country(_office(fx))


@query("a30_diplomatic_links", "v_attr v_kin", f"""WITH {OFFICE_CTE}
    SELECT k.src, k.dst, k.src_pais, k.dst_pais, k.relation_type, o.cargo_tipo FROM v_kin k JOIN office o ON k.src = o.person_id
    WHERE (o.cargo_es_embajador OR o.cargo_es_diplomatico) AND k.src_pais <> k.dst_pais""")
def _(fx):
    return rp.diplomatic_links(fx.kin(), _office(fx))


@query("a31_person_frame", "v_attr v_spell v_edge v_person", f"""WITH {_BORN},
    c AS (SELECT person_id, count(*) AS n_cargos, count(DISTINCT cargo_text) AS n_cargos_distintos FROM v_spell GROUP BY 1),
    r AS (SELECT e.src AS person_id, count(*) AS n_familiares, count(DISTINCT e.relation_type) AS n_tipos_relacion FROM v_edge e JOIN v_person p ON e.dst = p.person_id GROUP BY 1)
    SELECT b.person_id, b.nombre, b.pais, b.linaje, n_cargos, n_cargos_distintos, n_familiares, n_tipos_relacion,
           CASE WHEN lower(linaje) = lower(pais) THEN 'mismo_pais' ELSE 'nacionalidad_distinta_al_pais' END AS conexion_otros_paises, y AS ano_nacimiento,
           CASE WHEN b.pais = 'ASIA' THEN CAST(1000 + b.person_id % 900 AS INTEGER) END AS ano_fallecimiento
    FROM b LEFT JOIN c ON b.person_id = c.person_id LEFT JOIN r ON b.person_id = r.person_id""")
def _(fx):
    death = F.when(F.col("pais") == "ASIA", F.concat(F.lit("hacia "), (1000 + F.col("person_id") % 900).cast("string"), F.lit(" d. C.")))
    p = _born(fx).select("person_id", "nombre", "pais", "linaje", "fecha_nacimiento", death.alias("fecha_fallecimiento"))
    positions = fx.spell().select("person_id", F.col("cargo_text").alias("position_title_raw"))
    names = fx.person().select(F.col("person_id").alias("dst"), F.col("nombre").alias("related_name_raw"))
    relations = fx.edge().join(names, "dst").select(F.col("src").alias("person_id"), "related_name_raw", "relation_type")
    out = rp.person_frame(p, positions, relations, "linaje", "fecha_nacimiento", "fecha_fallecimiento")
    return out.drop("fecha_nacimiento", "fecha_fallecimiento")


@query("a32_community_sizes", "v_edge", f"""WITH {MUTUAL}, {BOTH_WAYS}, g AS (SELECT c AS community, count(*) AS n FROM settled GROUP BY 1)
    SELECT community, n, CASE WHEN n >= 3 THEN concat('Clúster ', CAST(community AS VARCHAR)) ELSE 'Pequeño' END AS community_label FROM g""")
def _(fx):
    return graph.community_labels(graph.communities(fx.edge(), "mutual", rounds=ROUNDS), 3)


@query("a33_infobox_offices", "v_spell", """
    SELECT spell_id, concat('Senador por ', o_orderstatus, ':') AS cargo, CAST(anio AS VARCHAR) AS periodo, 'B' AS predecesor, cargo_text AS sucesor FROM v_spell
    UNION ALL SELECT spell_id, concat('alcalde ', cargo_text), NULL, NULL, NULL FROM v_spell WHERE anio > 1997""")
def _(fx):
    first = F.concat(F.lit("Ocupación: x | Senador por "), "o_orderstatus", F.lit(": | detalle: "), "anio",
                     F.lit(" | detalle: otro | Predecesor: A | Predecesor en el cargo: B | Sucesor: "), "cargo_text")
    text = F.when(F.col("anio") > 1997, F.concat(first, F.lit(" | alcalde "), "cargo_text")).otherwise(first)
    return rp.infobox_offices(fx.spell().withColumn("infobox", text), "spell_id", "infobox")


@query("a33_expanded_relations", "v_edge v_person", """
    SELECT e.src AS person_id, e.relation_type AS tipo_relacion, p.nombre, p.url FROM v_edge e JOIN v_person p ON e.dst = p.person_id
    UNION ALL SELECT person_id, 'familia', familia, NULL FROM v_person""")
def _(fx):
    long = fx.relation_text().groupBy("src").pivot("relation_type", fixed.RELATION_FIELDS).agg(F.first("texto"))
    rows = long.withColumnRenamed("src", "person_id").unionByName(fx.person().select("person_id", "familia"), allowMissingColumns=True)
    return rp.expanded_relations(rows, "person_id", [*fixed.RELATION_FIELDS, "familia"])


@query("a34_densest_families", "v_lkin", f"SELECT src_familia AS familia, count(*) AS n FROM v_lkin WHERE {INTRA} GROUP BY 1 ORDER BY n DESC, familia LIMIT 15")
def _(fx):
    return rp.densest_families(fx.kin("linaje"))


@query("a34_inter_family_marriages", "v_kin", f"SELECT src_pais AS pais, count(*) AS n FROM v_kin WHERE {SPOUSE} AND clase_familia = 'Inter-familia' GROUP BY 1")
def _(fx):
    return rp.inter_family_marriages(fx.kin())


@query("a35_direct_links", "v_kin", """
    SELECT src, dst, relation_type, src_pais, dst_pais, src_nombre, dst_nombre FROM v_kin WHERE src_pais <> dst_pais""")
def _(fx):
    return rp.direct_links(fx.kin())


@query("a36_unknown_profile", "v_kin", "SELECT src_pais, relation_type, count(*) AS n FROM v_kin WHERE dst_pais IS NULL GROUP BY 1, 2")
def _(fx):
    return graph.unknown_profile(fx.kin(), fx.known())


@query("a36_unknown_examples", "v_kin", """
    SELECT DISTINCT dst, relation_type, src_pais FROM v_kin WHERE dst_pais IS NULL ORDER BY dst, relation_type, src_pais LIMIT 20""")
def _(fx):
    e = fx.kin().select("dst", "relation_type", "src_pais")
    return graph.unknown_examples(e, fx.known(), ["dst", "relation_type", "src_pais"], 20)

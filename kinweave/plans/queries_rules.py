"""D01-D16 over whole documents and the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions.text import any_of
from kinweave.operators import rules
from kinweave.plans.queries_joins import WORDS
from kinweave.plans.registry import query


def hit_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


@query("d01_infer_country", "", "SELECT doc_id, CASE " + " ".join(
    f"WHEN {hit_sql('text', w)} THEN '{k}'" for k, w in WORDS.items()) + " END AS pais, CASE " + " ".join(
    f"WHEN lang <> '{k}' AND {hit_sql('text', w)} THEN '{k}'" for k, w in WORDS.items()) + " END AS otro_pais FROM documents")
def _(fx):
    return fx.t("documents").select(
        "doc_id", rules.infer_country("text", WORDS).alias("pais"),
        rules.infer_country("text", WORDS, exclude="lang").alias("otro_pais"))


TIERS = {
    "declared": {"EN": ["^eng"], "FR": ["^fra"]},
    "birthplace": {"DE": ["src1", "src2"], "EN": ["src3"]},
    "demonym": {"ES": ["ción", "los "], "DE": ["nicht"], "FR": ["que"], "EN": ["the"]},
}
PAIR = {"declared": {"EN": ["eng"]}, "birthplace": {"FR": ["src0"]}, "demonym": {"EN": ["the"], "FR": ["que"]}}


def _tiers_sql(cfg: dict) -> str:
    def case(col: str, tier: dict) -> str:
        whens = " ".join(f"WHEN regexp_matches(lower({col}), '{any_of(w)}') THEN '{k}'" for k, w in tier.items())
        return f"CASE {whens} END"

    texts = "concat_ws(' ', nac, source, text)"
    return f"""
    WITH d AS (SELECT doc_id, text, source, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Français' WHEN 'de' THEN '' END AS nac FROM documents)
    SELECT doc_id, coalesce({case('nac', cfg['declared'])}, {case('source', cfg['birthplace'])}, {case(texts, cfg['demonym'])}, 'Desconocido') AS nacionalidad FROM d"""


def _declared(fx):
    lang = F.col("lang")
    nac = F.when(lang == "en", "English").when(lang == "fr", "Français").when(lang == "de", "")
    return fx.t("documents").select("doc_id", "text", "source", nac.alias("nac"))


@query("d02_nationality", "", _tiers_sql(TIERS))
def _(fx):
    return _declared(fx).select("doc_id", rules.nationality("nac", "source", ["text"], TIERS).alias("nacionalidad"))


@query("d03_nationality_pair", "", _tiers_sql(PAIR))
def _(fx):
    return _declared(fx).select("doc_id", rules.nationality_pair("nac", "source", ["text"], PAIR).alias("nacionalidad"))


KW = {"en": ["the", "src1"], "fr": ["que", "src2"], "de": ["nicht", "src1"]}
FIELDS = {"text": "biografía", "source": "trabajo", "nota": "trabajo"}


def mentions_sql() -> str:
    rows = [
        f"SELECT doc_id, lang, '{c}' AS vinculo, '{kind}' AS tipo_vinculo, {i} AS pos, '{f}' AS campo FROM d WHERE {hit_sql(f, w)} AND lang <> '{c}'"
        for i, (f, kind) in enumerate(FIELDS.items()) for c, w in KW.items()
    ]
    return f"""
    WITH d AS (SELECT doc_id, lang, text, source, concat('nota ', source, ' the') AS nota FROM documents), m AS ({' UNION ALL '.join(rows)})
    SELECT doc_id, lang, vinculo, tipo_vinculo, arg_min(campo, pos) AS campo_detectado FROM m GROUP BY 1, 2, 3, 4"""


@query("d04_mentions_by_field", "", mentions_sql())
def _(fx):
    d = fx.t("documents").withColumn("nota", F.concat(F.lit("nota "), "source", F.lit(" the")))
    return rules.mentions_by_field(d, "doc_id", "lang", FIELDS, KW)


TARGETS = {"EN": ["the.*with", "from "], "FR": ["pour.*avec", "dans"], "DE": ["nicht.*und"]}


@query("d05_target_links", "", "WITH d AS (SELECT doc_id, lang, concat_ws(' ', source, text) AS t FROM documents), x AS (SELECT doc_id, lang, concat_ws(', ', " + ", ".join(
    f"CASE WHEN lang <> lower('{k}') AND regexp_matches(lower(t), '{any_of(p)}') THEN '{k}' END" for k, p in TARGETS.items()
) + ") AS conecta_con FROM d) SELECT doc_id, conecta_con FROM x WHERE conecta_con <> ''")
def _(fx):
    d = fx.t("documents").withColumn("propio", F.upper("lang"))
    return rules.target_links(d, ["source", "text"], TARGETS, own="propio").select("doc_id", "conecta_con")


OFFICE = {"embajador": "economy", "ministro": "small|standard", "presidente": "promo", "diplomatico": "large", "politico": "medium"}


def _office(fx):
    """Office text, occupation and a JSON label per person; labels are rare."""
    label = F.when(F.col("person_id") % 9 == 0, F.lower("ocupacion")).otherwise(F.col("lugar"))
    json = F.when(F.col("person_id") % 10 == 0, "roto {").otherwise(F.concat(F.lit('[{"label": "'), label, F.lit('"}]')))
    return fx.attr().withColumn("j", json).select(
        "person_id", "pais", rules.office_profile("j", "cargos", "ocupacion", OFFICE).alias("o")).select("person_id", "pais", "o.*")


OFFICE_CTE = """
    t AS (SELECT person_id, pais, cargos, lower(cargos) AS c, lower(ocupacion) AS o,
                 CASE WHEN person_id % 10 = 0 THEN NULL WHEN person_id % 9 = 0 THEN lower(ocupacion) ELSE lower(lugar) END AS l FROM v_attr),
    f AS (SELECT person_id, pais, coalesce(cargos <> '', false) AS tc,
                 coalesce(c LIKE '%economy%', false) AS te, coalesce(regexp_matches(c, 'small|standard'), false) AS tm, coalesce(c LIKE '%promo%', false) AS tp,
                 coalesce(l LIKE '%economy%', false) AS le, coalesce(regexp_matches(l, 'small|standard'), false) AS lm, coalesce(l LIKE '%promo%', false) AS lp,
                 coalesce(o LIKE '%large%', false) AS d, coalesce(o LIKE '%medium%', false) AS pol FROM t),
    office AS (SELECT person_id, pais,
           CASE WHEN tp OR lp THEN 'Presidente' WHEN te OR le THEN 'Embajador' WHEN tm OR lm THEN 'Ministro' WHEN d THEN 'Diplomático'
                WHEN tc THEN 'Otro político' ELSE 'Sin cargo político' END AS cargo_tipo,
           CASE WHEN lp OR lm THEN 'Nacional' WHEN le THEN 'Internacional' WHEN tp OR tm THEN 'Nacional' WHEN te THEN 'Internacional'
                WHEN d THEN 'Internacional' WHEN pol THEN 'Nacional' END AS cargo_nivel,
           te OR le AS cargo_es_embajador, tm OR lm AS cargo_es_ministro, tp OR lp AS cargo_es_presidente, d AS cargo_es_diplomatico FROM f)"""


@query("d06_office_profile", "v_attr", f"WITH {OFFICE_CTE} SELECT * FROM office")
def _(fx):
    return _office(fx)


SEEN = {"nombres": ["red", "blue"], "ocupaciones": ["large"], "dependiente": ["small"], "propias": ["grande"]}


@query("d07_visibility", "v_attr", """
    WITH t AS (SELECT person_id, lower(nombre) AS n, CASE WHEN person_id % 8 = 0 THEN NULL WHEN person_id % 4 = 1 THEN concat(lower(ocupacion), 'ísima')
               WHEN person_id % 16 = 2 THEN concat(ocupacion, ' y grande') ELSE ocupacion END AS o FROM v_attr)
    SELECT person_id,
           CASE WHEN regexp_matches(n, '(^|[^\\p{L}\\p{N}_])(red|blue)($|[^\\p{L}\\p{N}_])') OR coalesce(regexp_matches(lower(o), '(^|[^\\p{L}\\p{N}_])(large)($|[^\\p{L}\\p{N}_])'), false)
                THEN 'A' ELSE 'B' END AS categoria,
           coalesce(o <> '', false) AND NOT coalesce(regexp_matches(lower(o), '(^|[^\\p{L}\\p{N}_])(small)($|[^\\p{L}\\p{N}_])'), false) AS visibilidad_independiente,
           coalesce(regexp_matches(lower(o), '(^|[^\\p{L}\\p{N}_])(small)($|[^\\p{L}\\p{N}_])') AND NOT contains(o, 'grande'), false) AS solo_dependiente
    FROM t""")
def _(fx):
    k = F.col("person_id")
    o = (
        F.when(k % 8 == 0, F.lit(None)).when(k % 4 == 1, F.concat(F.lower("ocupacion"), F.lit("ísima")))
        .when(k % 16 == 2, F.concat("ocupacion", F.lit(" y grande"))).otherwise(F.col("ocupacion"))
    )
    v = rules.visibility("nombre", o, SEEN, ("A", "B"))
    return fx.attr().select("person_id", v.alias("v")).select("person_id", "v.*")


@query("d08_foreign_link", "v_person", """
    WITH t AS (SELECT person_id, lower(pais) AS p, CASE person_id % 5 WHEN 0 THEN concat(' ', lower(pais)) WHEN 1 THEN lower(linaje) WHEN 2 THEN 'peruana y chilena'
               WHEN 3 THEN 'a, b' END AS n FROM v_person)
    SELECT person_id, CASE WHEN n IS NULL THEN NULL WHEN n LIKE '%,%' OR n LIKE '% y %' THEN 'varias_nacionalidades'
           WHEN trim(n) <> p THEN 'nacionalidad_distinta_al_pais' ELSE 'mismo_pais' END AS conexion FROM t""")
def _(fx):
    k = F.col("person_id") % 5
    nac = (
        F.when(k == 0, F.concat(F.lit(" "), F.lower("pais"))).when(k == 1, F.lower("linaje"))
        .when(k == 2, "peruana y chilena").when(k == 3, "a, b")
    )
    return fx.person().select("person_id", rules.foreign_link("pais", nac).alias("conexion"))


PLACES = {"asia": ["nation_11", "nation_12", "nation_0"], "europe": ["nation_1"], "america": ["nation_5", "nation_7", "nation_20"]}


def place_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit_sql(text, w)} THEN '{k}'" for k, w in PLACES.items()) + " END"


DST_CTE = f"""
    p AS (SELECT person_id, pais, linaje, CASE WHEN person_id % 3 = 0 THEN linaje END AS nacionalidad FROM v_person WHERE lugar <> 'Brand#1'),
    r AS (SELECT person_id, coalesce({place_sql("concat_ws(' ', coalesce(nacionalidad, ''), '')")}, pais) AS resuelto FROM p),
    dst AS (SELECT e.src, e.dst, e.relation_type, s.pais AS src_pais, coalesce(r.resuelto, {place_sql("concat(e.relation_type, ' ', s.linaje)")}) AS pais_destino
            FROM v_edge e JOIN v_person s ON e.src = s.person_id LEFT JOIN r ON e.dst = r.person_id)"""


def dst_edges(fx):
    p = fx.person()
    s = p.select(F.col("person_id").alias("src"), F.col("pais").alias("src_pais"), "linaje")
    e = fx.edge().join(s, "src").withColumn("texto", F.concat("relation_type", F.lit(" "), "linaje")).drop("linaje")
    known = fx.known().select(
        "person_id", "pais", F.when(F.col("person_id") % 3 == 0, F.col("linaje")).alias("nacionalidad"), F.lit("").alias("lugar"))
    return rules.dst_country(e, known, PLACES).select("src", "dst", "relation_type", "src_pais", "pais_destino")


@query("d09_dst_country", "v_edge v_person", f"WITH {DST_CTE} SELECT * FROM dst")
def _(fx):
    return dst_edges(fx)


SPECIAL_CTE = f"""
    s AS (SELECT person_id, nombre, lower(pais) AS pais_familia, coalesce({place_sql('linaje')}, 'Desconocido') AS pais_nacionalidad FROM v_person)"""


def special(fx):
    return fx.person().select(
        "person_id", "nombre", F.lower("pais").alias("pais_familia"),
        F.coalesce(rules.infer_country("linaje", PLACES), F.lit("Desconocido")).alias("pais_nacionalidad"))


@query("d10_special_cases", "v_person", f"""WITH {SPECIAL_CTE}
    SELECT *, CASE WHEN pais_familia = 'europe' AND pais_nacionalidad = 'asia' THEN 'Asiático en familia europea'
              ELSE concat(pais_nacionalidad, ' en familia de ', pais_familia) END AS tipo_caso
    FROM s WHERE pais_nacionalidad <> 'Desconocido' AND pais_nacionalidad <> pais_familia""")
def _(fx):
    labels = {("europe", "asia"): "Asiático en familia europea"}
    return rules.special_cases(special(fx), "pais_familia", "pais_nacionalidad", labels)


@query("d11_node_role", "v_edge v_known", """
    WITH n AS (SELECT src AS id FROM v_edge UNION SELECT dst FROM v_edge),
    b AS (SELECT person_id FROM v_known WHERE c_acctbal > 8000)
    SELECT id, coalesce(k.pais, 'Desconocido') AS pais, CASE WHEN id IN (SELECT person_id FROM b) THEN 'Puente'
           WHEN k.pais IS NOT NULL THEN 'Nacional' ELSE 'Desconocido' END AS tipo_nodo FROM n LEFT JOIN v_known k ON id = person_id""")
def _(fx):
    e, k = fx.edge(), fx.known()
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    n = n.join(k.select(F.col("person_id").alias("id"), "pais"), "id", "left").fillna("Desconocido", subset=["pais"])
    return rules.node_role(n, k.filter("c_acctbal > 8000").select(F.col("person_id").alias("id")))


@query("d12_edge_class", "v_kin", "SELECT src, dst, relation_type, clase_pais, clase_familia FROM v_kin")
def _(fx):
    return fx.kin().select("src", "dst", "relation_type", "clase_pais", "clase_familia")


@query("d13_crossed_flag", "v_edge v_known", """
    SELECT e.src, e.dst, e.relation_type, coalesce(a.pais <> b.pais, false) AS cruzada
    FROM v_edge e LEFT JOIN v_known a ON e.src = a.person_id LEFT JOIN v_known b ON e.dst = b.person_id""")
def _(fx):
    k = fx.known().select(F.col("person_id").alias("id"), "pais")
    e = fx.edge().join(k.withColumnsRenamed({"id": "src", "pais": "a"}), "src", "left").join(
        k.withColumnsRenamed({"id": "dst", "pais": "b"}), "dst", "left").fillna("Desconocido", subset=["a", "b"])
    return e.select("src", "dst", "relation_type", rules.crossed_flag("a", "b").alias("cruzada"))


@query("d14_render_prompt", "v_attr", """
    SELECT person_id, concat('Nombre: ', nombre, chr(10), 'País: ', pais, chr(10), 'Cargos: ', trim(coalesce(cargos, '')), chr(10),
           'Lugar: ', trim(coalesce(lugar, ''))) AS solicitud FROM v_attr""")
def _(fx):
    template = "Nombre: %s\nPaís: %s\nCargos: %s\nLugar: %s"
    return rules.render_prompt(fx.attr(), template, ["nombre", "pais", "cargos", "lugar"]).select("person_id", "solicitud")


@query("d15_merge_attributes", "v_attr", """
    SELECT person_id, CASE person_id % 4 WHEN 0 THEN linaje WHEN 1 THEN cargos WHEN 2 THEN cargos ELSE cargos END AS cargo_1,
           CASE person_id % 4 WHEN 0 THEN 1900 + CAST(person_id % 100 AS INTEGER) END AS nacimiento_ano,
           CASE person_id % 4 WHEN 0 THEN concat(nombre, ' | ', familia) WHEN 1 THEN '' END AS hijos_lista FROM v_attr""")
def _(fx):
    k = F.col("person_id") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit('```json\n{"cargo_1": "'), "linaje", F.lit('", "nacimiento_ano": '), (1900 + F.col("person_id") % 100).cast("string"),
                                F.lit(', "hijos_lista": ["'), "nombre", F.lit('", "'), "familia", F.lit('"]}\n```')))
        .when(k == 1, '{"cargo_1": null, "nacimiento_ano": "s/d", "hijos_lista": []}').when(k == 2, "sin objeto")
    )
    df = fx.attr().withColumn("respuesta", answer).withColumn("cargo_1", F.col("cargos"))
    types = {c: fixed.MERGED_ATTRIBUTES[c] for c in ("cargo_1", "nacimiento_ano", "hijos_lista")}
    return rules.merge_attributes(df, "respuesta", types).select("person_id", *types)


@query("d16_pending", "v_person v_known", """
    SELECT person_id, nombre FROM v_person WHERE person_id NOT IN (SELECT person_id FROM v_known)""")
def _(fx):
    return rules.pending(fx.person().select("person_id", "nombre"), fx.known(), "person_id")

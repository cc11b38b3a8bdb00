"""X01-X26 over whole texts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions import text as tx
from kinweave.plans.registry import query


@query("x01_relation_urls", "v_edge v_person", """
    SELECT e.src, e.relation_type, p.url FROM v_edge e JOIN v_person p ON e.dst = p.person_id""")
def _(fx):
    return fx.relation_text().select("src", "relation_type", F.explode(tx.relation_urls("texto")).alias("url"))


@query("x02_relation_urls_loose", "v_edge v_person", """
    SELECT e.src, e.relation_type, p.url FROM v_edge e JOIN v_person p ON e.dst = p.person_id WHERE e.src <> e.dst""")
def _(fx):
    bare = F.regexp_replace("texto", "[();]", "")
    text = F.when(F.col("relation_type") == "padres", bare).otherwise(F.col("texto"))
    own = F.concat(F.lit(fixed.WIKI + "P"), F.col("src"))
    return fx.relation_text().select("src", "relation_type", F.explode(tx.relation_urls_loose(text, own)).alias("url"))


@query("x03_name_urls", "v_edge v_person", """
    SELECT e.src, e.relation_type, p.nombre AS name, p.url FROM v_edge e JOIN v_person p ON e.dst = p.person_id""")
def _(fx):
    return fx.relation_text().select("src", "relation_type", F.inline(tx.name_urls("texto")))


@query("x04_links_any", "v_edge v_person", """
    SELECT e.src, e.relation_type, p.nombre AS name, replace(p.url, 'https://es.wikipedia.org', 'http://otro.example') AS url
    FROM v_edge e JOIN v_person p ON e.dst = p.person_id WHERE e.relation_type <> 'hijos'
    UNION ALL SELECT DISTINCT src, relation_type, concat('solo ', CAST(src AS VARCHAR)), NULL FROM v_edge WHERE relation_type = 'hijos'""")
def _(fx):
    other = F.replace("texto", F.lit("https://es.wikipedia.org"), F.lit("http://otro.example"))
    text = F.when(F.col("relation_type") == "hijos", F.concat(F.lit("solo "), "src")).otherwise(other)
    return fx.relation_text().select("src", "relation_type", F.inline(tx.links_any(text)))


@query("x05_family_name", "v_person", """
    SELECT person_id, CASE WHEN pais = 'ASIA' THEN nombre WHEN pais = 'EUROPE' THEN NULL ELSE familia END AS familia_nombre FROM v_person""")
def _(fx):
    cat = F.when(F.col("pais") == "ASIA", F.concat(
        F.lit(fixed.WIKI + "Categoría:Familia_"), F.translate("nombre", " ", "_"), F.lit("/pagina")))
    fam = F.when(F.col("pais") != "EUROPE", F.concat(F.lit("Familia "), "familia")).otherwise("")
    return fx.person().select("person_id", tx.family_name(cat, fam).alias("familia_nombre"))


_NAMES = """CASE person_id % 6 WHEN 0 THEN nombre WHEN 1 THEN concat(nombre, ' de la ', familia)
    WHEN 2 THEN concat(nombre, '  (actor)') WHEN 3 THEN concat(nombre, ' y Actor') WHEN 4 THEN concat(' ', nombre, ' III2') ELSE '' END"""


def _named(fx):
    """Names with particles, brackets, stop-words, digits and blanks."""
    n, k = F.col("nombre"), F.col("person_id") % 6
    v = (
        F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" de la "), "familia")).when(k == 2, F.concat(n, F.lit("  (actor)")))
        .when(k == 3, F.concat(n, F.lit(" y Actor"))).when(k == 4, F.concat(F.lit(" "), n, F.lit(" III2"))).otherwise("")
    )
    return fx.person().select("person_id", v.alias("nombre"))


@query("x06_surnames", "v_person", f"""
    WITH n AS (SELECT person_id, list_filter(string_split_regex({_NAMES}, '\\s+'), lambda t: t <> '' AND NOT list_contains(
                      ['de', 'del', 'la', 'los', 'las', 'y', 'e'], lower(t))) AS t FROM v_person)
    SELECT person_id, CASE WHEN NOT regexp_matches(t[-1], '[()0-9]') AND length(t[-1]) >= 2
             AND lower(t[-1]) NOT IN ('chile', 'argentina', 'actor', 'comediante', 'político') THEN t[-1] END AS surname_1,
           CASE WHEN NOT regexp_matches(t[-2], '[()0-9]') AND length(t[-2]) >= 2
             AND lower(t[-2]) NOT IN ('chile', 'argentina', 'actor', 'comediante', 'político') THEN t[-2] END AS surname_2 FROM n""")
def _(fx):
    return _named(fx).select("person_id", tx.surnames("nombre").alias("s")).select("person_id", "s.*")


@query("x07_last_two_tokens", "v_person", f"""
    WITH n AS (SELECT person_id, string_split_regex({_NAMES}, '\\s+') AS t FROM v_person)
    SELECT person_id, coalesce(t[-1], '') AS surname_1, coalesce(t[-2], '') AS surname_2 FROM n""")
def _(fx):
    return _named(fx).select("person_id", tx.last_two_tokens("nombre").alias("s")).select("person_id", "s.*")


@query("x08_given_name", "v_person", f"""
    WITH n AS (SELECT person_id, {_NAMES} AS n FROM v_person)
    SELECT person_id, CASE WHEN n <> '' THEN string_split_regex(n, '\\s+')[1] END AS nombre_pila FROM n""")
def _(fx):
    return _named(fx).select("person_id", tx.given_name("nombre").alias("nombre_pila"))


@query("x09_slugify", "", r"""
    SELECT doc_id, trim(regexp_replace(strip_accents(replace(replace(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')),
                                       '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents""")
def _(fx):
    return fx.t("documents").select("doc_id", tx.slugify("text").alias("slug"))


@query("x10_title_from_url", "v_person", """
    SELECT person_id, CASE WHEN person_id % 4 = 0 THEN NULL ELSE concat(nombre, ' José+Ñ') END AS titulo FROM v_person""")
def _(fx):
    url = F.when(F.col("person_id") % 4 == 0, F.lit("https://example.org/x")).otherwise(
        F.concat(F.lit(fixed.WIKI), F.translate("nombre", " ", "_"), F.lit("_Jos%C3%A9+%C3%91")))
    return fx.person().select("person_id", tx.title_from_url(url).alias("titulo"))


@query("x11_first_year", "", r"""
    SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '\b(1[789]\d{2}|20[0-2]\d)\b', 1), '') AS INTEGER) AS ano_moderno,
           TRY_CAST(nullif(regexp_extract(text, '\b(1[0-9]{3}|20[0-2][0-9])\b', 1), '') AS INTEGER) AS ano_amplio FROM documents""")
def _(fx):
    return fx.t("documents").select(
        "doc_id", tx.first_year("text").alias("ano_moderno"), tx.first_year("text", "wide").alias("ano_amplio"))


@query("x12_years", "", r"""
    WITH y AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '\b(1[789]\d{2}|20[0-2]\d)\b', 1),
                      regexp_extract_all(concat('19', lpad(CAST(doc_id % 120 AS VARCHAR), 2, '0')), '\b(1[789]\d{2}|20[0-2]\d)\b', 1))) AS y FROM documents)
    SELECT DISTINCT doc_id, CAST(y AS INTEGER) AS year FROM y WHERE CAST(y AS INTEGER) BETWEEN 1800 AND 2025""")
def _(fx):
    extra = F.concat(F.lit("19"), F.lpad((F.col("doc_id") % 120).cast("string"), 2, "0"))
    return fx.t("documents").select("doc_id", F.explode(tx.years(["text", extra])).alias("year"))


@query("x13_decade", "v_spell", "SELECT spell_id, CAST(floor(anio / 10) * 10 AS INTEGER) AS decada FROM v_spell")
def _(fx):
    return fx.spell().select("spell_id", tx.decade("anio").alias("decada"))


def _infobox(fx):
    return fx.spell().select("spell_id", F.concat(
        F.lit("Cargo: "), "cargo_text", F.lit(" | detalle: x: "), "anio", F.lit(" | suelto "), "o_orderstatus", F.lit(" | : raro")).alias("t"))


@query("x14_label_values", "v_spell", """
    WITH t AS (SELECT spell_id, concat('Cargo: ', cargo_text, ' | detalle: x: ', CAST(anio AS VARCHAR), ' | suelto ', o_orderstatus, ' | : raro') AS t FROM v_spell),
    e AS (SELECT spell_id, unnest(string_split(t, ' | ')) AS e, unnest(generate_series(0, len(string_split(t, ' | ')) - 1)) AS i FROM t)
    SELECT spell_id, CAST(i AS INTEGER) AS pos, CASE WHEN instr(e, ': ') > 1 THEN trim(substr(e, 1, instr(e, ': ') - 1)) ELSE trim(e) END AS label,
           CASE WHEN instr(e, ': ') > 1 THEN trim(substr(e, instr(e, ': ') + 2)) ELSE '' END AS value FROM e""")
def _(fx):
    rows = _infobox(fx).select("spell_id", F.posexplode(tx.label_values("t")).alias("pos", "e"))
    return rows.select("spell_id", "pos", "e.label", "e.value")


def _json(fx):
    """Infobox arrays with broken rows among them."""
    good = F.concat(F.lit('[{"label": "'), "event_type", F.lit('", "value_text": "u'), "user_id",
                    F.lit('", "otro": [1]},\n {"label": "id"}]'))
    text = F.when(F.col("event_id") % 7 == 0, "no es json").when(F.col("event_id") % 11 == 0, '[{"label": "x"')
    return fx.t("events").select("event_id", "event_type", text.otherwise(good).alias("j"))


@query("x15_infobox_rows", "", """
    SELECT event_id, event_type AS label, concat('u', CAST(user_id AS VARCHAR)) AS value_text FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0
    UNION ALL SELECT event_id, 'id', NULL FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""")
def _(fx):
    return _json(fx).select("event_id", F.inline(tx.infobox_rows("j")))


@query("x16_clean_json", "", r"""
    WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat(chr(1), props, chr(10), '  ')
                      WHEN 2 THEN replace(props, '"', '\"') WHEN 3 THEN concat('x', props) END AS j FROM events),
    a AS (SELECT event_id, nullif(trim(regexp_replace(regexp_replace(j, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g')), '') AS a FROM t),
    b AS (SELECT *, trim(replace(replace(a, '\"', '"'), '\n', ' ')) AS b FROM a)
    SELECT event_id, CASE WHEN json_valid(a) THEN a WHEN json_valid(b) THEN b END AS json,
           CASE WHEN json_valid(a) THEN true WHEN json_valid(b) THEN true ELSE false END AS valido FROM b""")
def _(fx):
    p, k = F.col("props"), F.col("event_id") % 5
    j = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("\x01"), p, F.lit("\n  ")))
        .when(k == 2, F.replace(p, F.lit('"'), F.lit('\\"'))).when(k == 3, F.concat(F.lit("x"), p))
    )
    out = fx.t("events").select("event_id", tx.clean_json(j).alias("json"))
    return out.withColumn("valido", F.col("json").isNotNull())


@query("x17_any_label", "", """
    SELECT event_id, event_id % 7 <> 0 AND event_id % 11 <> 0 AND regexp_matches(event_type, 'click|err') AS es FROM events""")
def _(fx):
    return _json(fx).select("event_id", tx.any_label("j", "click|err").alias("es"))


@query("x18_strip_marks", "v_person", r"""
    WITH t AS (SELECT person_id, concat(nombre, ' [', CAST(person_id AS VARCHAR), '] (https://x/', lugar, ') ;  ', linaje, '(nota); Segundas Nupcias; ') AS t FROM v_person),
    e AS (SELECT person_id, unnest(list_filter(list_transform(string_split(t, ';'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS e FROM t)
    SELECT person_id, trim(regexp_replace(regexp_replace(regexp_replace(e, '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g'), '\s+', ' ', 'g')) AS familiar
    FROM e WHERE NOT contains(lower(e), 'nupcias')""")
def _(fx):
    t = F.concat("nombre", F.lit(" ["), "person_id", F.lit("] (https://x/"), "lugar", F.lit(") ;  "), "linaje", F.lit("(nota); Segundas Nupcias; "))
    rows = fx.person().select("person_id", F.explode(tx.split_list(t)).alias("e"))
    return rows.select("person_id", tx.strip_marks("e", fixed.KIN_WORDS).alias("familiar")).dropna()


@query("x19_dict_names", "v_person", """
    SELECT person_id, nombre AS familiar FROM v_person WHERE person_id % 3 <> 0
    UNION ALL SELECT person_id, linaje FROM v_person WHERE person_id % 3 <> 0""")
def _(fx):
    t = F.when(F.col("person_id") % 3 == 0, "{}").otherwise(
        F.concat(F.lit("{'"), "nombre", F.lit("': 'padre', '"), "linaje", F.lit("' : 'x'}")))
    return fx.person().select("person_id", F.explode(tx.dict_names(t)).alias("familiar"))


@query("x20_safe_text", "", "SELECT doc_id, substr(trim(coalesce(text, ''), ' '), 1, 2000) AS t FROM documents")
def _(fx):
    return fx.t("documents").select("doc_id", tx.safe_text("text").alias("t"))


@query("x21_first_object", "v_person", """
    SELECT person_id, CASE person_id % 5 WHEN 0 THEN concat('{"cargo": "', nombre, '", "n": 1}')
             WHEN 1 THEN concat('{"cargo": "', linaje, '", "sub": {"a": {"b": 2}}}') WHEN 2 THEN concat('{"cargo": "', nombre, '"}') END AS objeto,
           CASE person_id % 5 WHEN 0 THEN nombre WHEN 1 THEN linaje WHEN 2 THEN nombre END AS cargo FROM v_person""")
def _(fx):
    n, k = F.col("nombre"), F.col("person_id") % 5
    t = (
        F.when(k == 0, F.concat(F.lit('Respuesta:\n```json\n{"cargo": "'), n, F.lit('", "n": 1}\n``` {"otro": 1}')))
        .when(k == 1, F.concat(F.lit('ver {"cargo": "'), "linaje", F.lit('", "sub": {"a": {"b": 2}}} y {"x": 1}')))
        .when(k == 2, F.concat(F.lit('```\n{"cargo": "'), n, F.lit('"}```')))
        .when(k == 3, F.concat(F.lit('abierto {"cargo": {"a": 1}'), n))
    )
    obj = fx.person().select("person_id", tx.first_object_text(t).alias("objeto"), tx.first_object(t, "struct<cargo:string>").alias("o"))
    return obj.select("person_id", "objeto", F.col("o.cargo").alias("cargo"))


@query("x22_kwic", "", """
    SELECT doc_id, coalesce(nullif(array_to_string(regexp_extract_all(text, '.{0,50}nicht.{0,50}'), ' | '), ''),
                            nullif(array_to_string(regexp_extract_all(text, '.{0,50}que.{0,50}'), ' | '), ''),
                            nullif(array_to_string(regexp_extract_all(text, '.{0,50}the.{0,50}'), ' | '), '')) AS contexto FROM documents""")
def _(fx):
    return fx.t("documents").select("doc_id", tx.kwic("text", ["nicht", "que", "the"]).alias("contexto"))


@query("x23_country_slug", "v_person", """
    SELECT DISTINCT linaje, replace(translate(lower(concat(linaje, ' Perú México')), 'éúíóá', 'euioa'), ' ', '_') AS slug FROM v_person""")
def _(fx):
    return fx.person().select("linaje", tx.country_slug(F.concat("linaje", F.lit(" Perú México"))).alias("slug")).distinct()


@query("x24_split_list", "", r"""
    WITH e AS (SELECT doc_id, unnest(string_split(text, '.')) AS e FROM documents)
    SELECT doc_id, trim(regexp_replace(e, '\s+', ' ', 'g')) AS parte FROM e WHERE trim(regexp_replace(e, '\s+', ' ', 'g')) <> ''""")
def _(fx):
    return fx.t("documents").select("doc_id", F.explode(tx.split_list("text", ".")).alias("parte"))


@query("x25_persistence", "v_person", """
    SELECT linaje, round(count(DISTINCT ocupacion) * ln(count(*) + 1), 6) AS puntaje FROM v_person GROUP BY 1""")
def _(fx):
    g = fx.person().groupBy("linaje").agg(F.count_distinct("ocupacion").alias("g"), F.count("*").alias("n"))
    return g.select("linaje", F.round(tx.persistence("g", "n"), 6).alias("puntaje"))


@query("x26_letters_only", "", r"""
    SELECT doc_id, lower(regexp_replace(text, '[^a-zA-ZáéíóúñÁÉÍÓÚÑ\s]', '', 'g')) AS limpio FROM documents""")
def _(fx):
    return fx.t("documents").select("doc_id", tx.letters_only("text").alias("limpio"))

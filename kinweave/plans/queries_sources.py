"""S01-S12 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.plans.fixtures import Tables
from kinweave.plans.registry import query
from kinweave.session import new_folder
from kinweave.sources import html, tables

PERSON_TEXT = ["url", "nombre", "pais", "familia", "lugar", "ocupacion"]


def _persons(fx: Tables):
    """Person rows as text, with quotes, separators and line breaks in one column."""
    note = F.concat(F.lit('dijo "'), F.col("nombre"), F.lit('"; luego\nvivió en '), F.col("linaje"))
    return fx.person().select(*PERSON_TEXT, note.alias("biografia"))


@query("s01_delimited_scan", "v_person", """
    SELECT url, nombre, pais, familia, lugar, ocupacion,
           concat('dijo "', nombre, '"; luego', chr(10), 'vivió en ', linaje) AS biografia FROM v_person""")
def _(fx):
    path = new_folder(fx.spark, "s01")
    tables.write_table(_persons(fx), path, sep=";")
    return tables.read_persons(fx.spark, path, multi_line=True)


@query("s02_all_string_scan", "v_person", """
    SELECT CAST(person_id AS VARCHAR) AS person_id, nombre, concat('00', CAST(person_id AS VARCHAR)) AS codigo FROM v_person""")
def _(fx):
    path = new_folder(fx.spark, "s02")
    rows = fx.person().select("person_id", "nombre", F.concat(F.lit("00"), F.col("person_id")).alias("codigo"))
    tables.write_table(rows, path, sep=";")
    return tables.read_all_string(fx.spark, path)


@query("s03_path_partition", "v_person", """
    SELECT url, nombre, CASE WHEN familia = 'HOUSEHOLD' THEN 'declarado' ELSE pais END AS pais FROM v_person""")
def _(fx):
    path = new_folder(fx.spark, "s03")
    rows = fx.person().select(
        "url", "nombre", F.when(F.col("familia") == "HOUSEHOLD", "declarado").alias("pais"), F.col("pais").alias("carpeta"))
    tables.write_by_country(rows, path, "carpeta")
    return tables.read_partitioned(fx.spark, f"{path}/carpeta=*/*.csv", r"carpeta=([^/]+)/")


@query("s04_first_existing", "v_person", "SELECT url, nombre, familia FROM v_person")
def _(fx):
    path = new_folder(fx.spark, "s04")
    tables.write_table(fx.person().select("url", "nombre", "familia"), f"{path}/processed", sep=";")
    return tables.read_first_existing(fx.spark, [f"{path}/raw/*.csv", f"{path}/processed/*.csv"])


@query("s05_csv_sink", "v_spell", """
    SELECT CAST(anio AS VARCHAR) AS anio, CAST(count(*) AS VARCHAR) AS n FROM v_spell GROUP BY 1""")
def _(fx):
    path = new_folder(fx.spark, "s05")
    counts = fx.spell().groupBy("anio").agg(F.count("*").alias("n"))
    if tables.write_table(counts.filter("n < 0"), f"{path}/empty"):
        raise RuntimeError("an empty result was written")
    tables.write_table(counts, f"{path}/n")
    return tables.read_csv_table(fx.spark, f"{path}/n")


@query("s06_country_sink", "v_person", "SELECT url, nombre, pais FROM v_person")
def _(fx):
    path = new_folder(fx.spark, "s06")
    tables.write_by_country(fx.person().select("url", "nombre", "pais"), path)
    return tables.read_partitioned(fx.spark, f"{path}/pais=*/*.csv", r"pais=([^/]+)/")


@query("s06_rewrite_country", "v_person", """
    SELECT url, CASE WHEN pais = 'ASIA' THEN upper(nombre) ELSE nombre END AS nombre, pais FROM v_person
    WHERE pais <> 'ASIA' OR familia <> 'BUILDING'""")
def _(fx):
    path = new_folder(fx.spark, "s06")
    tables.write_by_country(fx.person().select("url", "nombre", "pais"), path)
    again = fx.person().filter("pais = 'ASIA' AND familia <> 'BUILDING'").select("url", F.upper("nombre").alias("nombre"), "pais")
    tables.write_by_country(again, path, only_given=True)
    return tables.read_partitioned(fx.spark, f"{path}/pais=*/*.csv", r"pais=([^/]+)/")


@query("s07_manifest", "v_person", "SELECT pais, count(*) AS filas FROM v_person GROUP BY pais")
def _(fx):
    return tables.manifest(fx.person(), "pais")


@query("s08_csv_table", "v_spell", """
    SELECT CAST(person_id AS VARCHAR) AS person_id, concat('"', cargo_text, '"', chr(10), 'sigue') AS cargo_text, CAST(anio AS VARCHAR) AS anio FROM v_spell""")
def _(fx):
    path = new_folder(fx.spark, "s08")
    cargo = F.concat(F.lit('"'), "cargo_text", F.lit('"\nsigue')).alias("cargo_text")
    tables.write_table(fx.spell().select("person_id", cargo, "anio"), path)
    return tables.read_csv_table(fx.spark, path)


# The text of a fragment in DuckDB.
def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for code, char in [*html.ENTITIES, *((f"&#{c};", chr(c)) for c in (34, 39, 225, 241)), ("&#xED;", "í"), html.AMPERSAND]:
        out = f"replace({out}, '{code}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim({out}, ' ')"


def _pair_sql(label: str, value: str) -> str:
    p = rf"(?is)<{label}(?:\s[^>]*)?>(.*?)</{label}>\s*<{value}(?:\s[^>]*)?>(.*?)</{value}>"
    return f"""
    WITH x AS (SELECT page_id, regexp_extract_all(html, '{p}', 1) AS l, regexp_extract_all(html, '{p}', 2) AS v FROM pages),
    y AS (SELECT page_id, unnest(generate_series(1, len(l))) AS i, l, v FROM x)
    SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {_plain('l[i]')} AS label, {_plain('v[i]')} AS value FROM y"""


@query("s09_html_pairs", "", _pair_sql("h1", "p"))
def _(fx):
    return html.html_pairs(fx.t("pages"), label_tag="h1", value_tag="p")


_LINKS = f"""
    x AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*("[^"]*"|''[^'']*'')[^>]*>(.*?)</a\\s*>', 1), lambda z: z[2:-2]) AS h,
                 regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*("[^"]*"|''[^'']*'')[^>]*>(.*?)</a\\s*>', 2) AS t FROM pages),
    y AS (SELECT page_id, unnest(generate_series(1, len(h))) AS i, h, t FROM x),
    links AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {_plain('t[i]')} AS text, h[i] AS href FROM y)"""


@query("s10_html_links", "", f"""WITH {_LINKS}
    SELECT page_id, pos, text, href, concat(text, ' (https://es.wikipedia.org', href, ')') AS entrada FROM links
    WHERE href LIKE '/%' AND href NOT LIKE '/The%' AND href NOT LIKE '/Nicht%'""")
def _(fx):
    links = html.html_links(fx.t("pages"), exclude_prefixes=["/The", "/Nicht"], prefix="/")
    return links.withColumn("entrada", html.link_entry())


@query("s11_html_text", "", rf"""
    SELECT page_id, {_plain(r"regexp_extract(html, '(?s)<h1(?:\s[^>]*)?>(.*?)</h1>', 1)")} AS title,
           regexp_replace(trim(array_to_string(list_transform(
               regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: {_plain('x')}), chr(10)), ' '),
               '\[\d+\]', '', 'g') AS text FROM pages""")
def _(fx):
    return html.html_text(fx.t("pages"))


@query("s12_html_members", "", f"""WITH {_LINKS}
    SELECT DISTINCT page_id, text, href FROM links
    WHERE href LIKE '/%' AND contains(text, 'e') AND NOT contains(text, 'th')""")
def _(fx):
    return html.html_members(fx.t("pages"), include=["e"], exclude=["th"])

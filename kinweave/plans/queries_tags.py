"""S09-S11 by the tag reader, over pages set into nested tables with comments, scripts and quoted marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.plans.registry import query
from kinweave.sources import html, tags

BEFORE = """<table title="a > b"><tr><th>Url<td>página <!-- <a href="/x">x</a> --><table><tr><th>In</th><td>"""
AFTER = """</td></tr></table> cola</td></tr><tr><th>Sin valor</th></tr></table><a title="href='/no' >" href='/fin'>fin</a>"""


def boxed(fx):
    """Every page as a cell of a table inside a cell, and a plain copy of its text after it."""
    page = F.concat(F.lit(BEFORE), "html", F.lit(AFTER), "html")
    return fx.t("pages").select("page_id", page.alias("html"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _decoded(x: str) -> str:
    for code, char in [*html.ENTITIES, *((f"&#{c};", chr(c)) for c in (34, 39, 225, 241)), ("&#xED;", "í"), html.AMPERSAND]:
        x = f"replace({x}, '{code}', '{_quoted(char)}')"
    return f"trim({x}, ' ')"


def _segments_sql(ends: list[str], scope: str) -> str:
    names = ", ".join(f"'{e}', '/{e}'" for e in ends)
    levels = {"inside": "CASE WHEN depth > 0 THEN range(1, depth + 1) ELSE [0] END", "own": "[depth]", "page": "[0]"}[scope]
    own = "depth = level AND name <> '/table' AND" if scope == "inside" else ""
    return rf"""
    page AS (SELECT page_id, '{_quoted(BEFORE)}' || html || '{_quoted(AFTER)}' || html AS html FROM pages),
    token AS (SELECT page_id, unnest(t) AS t, unnest(range(len(t))) AS place FROM
        (SELECT page_id, regexp_extract_all(html, '{_quoted(tags.token_pattern(""))}') AS t FROM page)),
    named AS (SELECT *, lower(regexp_extract(t, '{tags.NAME}', 1)) AS name, CASE WHEN t NOT LIKE '<%' OR t = '<' THEN t ELSE '' END AS text FROM token),
    summed AS (SELECT *, sum(CASE name WHEN 'table' THEN 1 WHEN '/table' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place) AS s FROM named),
    deep AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY place)) AS INTEGER) AS depth FROM summed),
    levelled AS (SELECT *, unnest({levels}) AS level FROM deep),
    cut AS (SELECT *, sum(CASE WHEN {own} name IN ({names}) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, level ORDER BY place) AS seg FROM levelled),
    part AS (SELECT page_id, level, min(place) AS place, arg_min(name, place) AS name, arg_min(t, place) AS tag,
                    {_decoded("string_agg(text, '' ORDER BY place)")} AS text FROM cut GROUP BY page_id, level, seg)"""


@query("s09_tag_pairs", "", rf"""WITH {_segments_sql(tags.ends_of("th", "td"), "inside")},
    kept AS (SELECT *, lead(name) OVER w AS n, lead(text) OVER w AS value FROM part WHERE name <> '' AND (name NOT LIKE '/%' OR regexp_matches(text, '\S'))
             WINDOW w AS (PARTITION BY page_id, level ORDER BY place))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INTEGER) AS pos, CAST(level AS INTEGER) AS level, text AS label, value
    FROM kept WHERE name = 'th' AND n = 'td'""")
def _(fx):
    return tags.read_pairs(boxed(fx))


@query("s10_tag_links", "", rf"""WITH {_segments_sql(tags.ends_of("a"), "page")},
    links AS (SELECT page_id, place, text, CASE WHEN tag LIKE '%/fin%' THEN '/fin' ELSE regexp_extract(tag, 'href="([^"]*)"', 1) END AS href FROM part WHERE name = 'a'),
    placed AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INTEGER) AS pos, text, href FROM links)
    SELECT * FROM placed WHERE href LIKE '/%' AND href NOT LIKE '/The%' AND href NOT LIKE '/Nicht%'""")
def _(fx):
    return tags.read_links(boxed(fx), exclude_prefixes=["/The", "/Nicht"], prefix="/")


@query("s11_tag_text", "", rf"""WITH {_segments_sql(tags.ends_of("h1", "p"), "own")}
    SELECT page_id, arg_min(text, place) FILTER (name = 'h1') AS title,
           regexp_replace(trim(coalesce(string_agg(text, chr(10) ORDER BY place) FILTER (name = 'p'), ''), ' '), '\[\d+\]', '', 'g') AS text
    FROM part GROUP BY page_id""")
def _(fx):
    return tags.read_text(boxed(fx))

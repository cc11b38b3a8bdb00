"""Extraction from page HTML with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import fixed

# Latin-1 letter entities by their code, and entities of marks; the ampersand comes last.
MARKS = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"),
         ("&laquo;", "«"), ("&raquo;", "»"), ("&iexcl;", "¡"), ("&iquest;", "¿"), ("&ordm;", "º"), ("&ordf;", "ª")]
LETTERS = [(f"&{base}{kind};", chr(code)) for kind, codes in {
    "grave": {"A": 192, "E": 200, "I": 204, "O": 210, "U": 217, "a": 224, "e": 232, "i": 236, "o": 242, "u": 249},
    "acute": {"A": 193, "E": 201, "I": 205, "O": 211, "U": 218, "Y": 221, "a": 225, "e": 233, "i": 237, "o": 243, "u": 250, "y": 253},
    "circ": {"A": 194, "E": 202, "I": 206, "O": 212, "U": 219, "a": 226, "e": 234, "i": 238, "o": 244, "u": 251},
    "tilde": {"A": 195, "N": 209, "O": 213, "a": 227, "n": 241, "o": 245},
    "uml": {"A": 196, "E": 203, "I": 207, "O": 214, "U": 220, "a": 228, "e": 235, "i": 239, "o": 246, "u": 252, "y": 255},
    "cedil": {"C": 199, "c": 231}}.items() for base, code in codes.items()]
ENTITIES = [*MARKS, *LETTERS]
AMPERSAND = ("&amp;", "&")


def _element(tag: str) -> str:
    return rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"


def _entities(text: Column) -> Column:
    """Named and numeric entities as their characters."""
    for code, char in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(char))
    # a text is cut at its numeric entities: the odd parts are their numbers
    parts = F.split(F.regexp_replace(text, r"&#(x?[0-9A-Fa-f]{1,6});", "\u0001$1\u0001"), "\u0001")
    number = lambda p: F.when(F.lower(F.substring(p, 1, 1)) == "x", F.conv(F.substring(p, 2, 9), 16, 10)).otherwise(p)
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(F.try_to_number(number(p), F.lit("9999999999")).cast("long")), 8, "0")), "UTF-32")
    numeric = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(char(p), F.lit(""))).otherwise(p)), "")
    text = F.when(F.contains(text, F.lit("&#")), numeric).otherwise(text)
    return F.replace(text, F.lit(AMPERSAND[0]), F.lit(AMPERSAND[1]))


def plain(html: Column) -> Column:
    """Text of a fragment: no tags, entities decoded, trimmed."""
    return decode(F.regexp_replace(html, r"<[^>]*>", ""))


def decode(text: Column) -> Column:
    """Text with its entities decoded, trimmed."""
    return F.trim(F.when(F.contains(text, F.lit("&")), _entities(text)).otherwise(text))


def _all(html: str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.col(html), F.lit("(?is)" + pattern), F.lit(group))


def html_pairs(df: DataFrame, html: str = "html", label_tag: str = "th", value_tag: str = "td",
               id_col: str = "page_id") -> DataFrame:
    """Header cell and the value cell that follows it."""
    pattern = _element(label_tag) + r"\s*" + _element(value_tag)
    pairs = F.arrays_zip(_all(html, pattern, 1).alias("label"), _all(html, pattern, 2).alias("value"))
    rows = df.select(id_col, F.posexplode(pairs).alias("pos", "x"))
    return rows.select(id_col, "pos", plain(F.col("x.label")).alias("label"), plain(F.col("x.value")).alias("value"))


def html_links(df: DataFrame, html: str = "html", exclude_prefixes: list[str] | None = None,
               prefix: str = "/wiki/", id_col: str = "page_id") -> DataFrame:
    """Links to pages, without the excluded name spaces."""
    pattern = r"""<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*')[^>]*>(.*?)</a\s*>"""
    links = F.arrays_zip(_all(html, pattern, 1).alias("href"), _all(html, pattern, 2).alias("text"))
    rows = df.select(id_col, F.posexplode(links).alias("pos", "x"))
    quoted = F.col("x.href")
    href = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    out = rows.select(id_col, "pos", plain(F.col("x.text")).alias("text"), href.alias("href"))
    keep = F.col("href").startswith(prefix)
    for p in fixed.NON_PERSON_LINKS if exclude_prefixes is None else exclude_prefixes:
        keep = keep & ~F.col("href").startswith(p)
    return out.filter(keep)


def link_entry(base: str = "https://es.wikipedia.org") -> Column:
    """``text (url)`` of a link row, the form relation columns hold."""
    return F.concat(F.col("text"), F.lit(" ("), F.lit(base), F.col("href"), F.lit(")"))


def html_text(df: DataFrame, html: str = "html", title_tag: str = "h1", id_col: str = "page_id") -> DataFrame:
    """Title and paragraph text without numeric footnote marks."""
    title = plain(F.get(_all(html, _element(title_tag), 1), F.lit(0)))
    paragraphs = F.transform(_all(html, _element("p"), 1), plain)
    text = F.regexp_replace(F.trim(F.array_join(paragraphs, "\n")), r"\[\d+\]", "")
    return df.select(id_col, title.alias("title"), text.alias("text"))


def html_members(df: DataFrame, html: str = "html", include: list[str] | None = None,
                 exclude: list[str] | None = None, prefix: str = "/", id_col: str = "page_id") -> DataFrame:
    """Distinct links of list pages by words in their text."""
    links = html_links(df, html, [], prefix, id_col)
    for w in fixed.FAMILY_LIST_INCLUDE if include is None else include:
        links = links.filter(F.contains("text", F.lit(w)))
    for w in fixed.FAMILY_LIST_EXCLUDE if exclude is None else exclude:
        links = links.filter(~F.contains("text", F.lit(w)))
    return links.select(id_col, "text", "href").distinct()

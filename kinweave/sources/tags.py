"""Page HTML read tag by tag: nesting, comments, scripts, quotes and tags left open.

A page is cut into tokens (comments, scripts, tags with their quoted attributes, text) by one expression; tokens
become rows, and running sums over a page say how many tables are open and which element a piece of text is in. So
a cell keeps all of its text when a table stands inside it, and the inner table gives its own pairs. The work is
linear in a page's tokens, but for text inside ``k`` nested tables, which is a row for each of them. One page is
ordered in one task; pages share nothing.

An element ends at its closing tag or where the next one of its kind begins, as tags may be left open. A tag whose
quote is never closed is text from its ``<`` on. NULL pages give no pairs and links, and an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.functions import fixed
from kinweave.sources.html import decode

# Fixed values of HTML: tags that bound a cell, and block tags, which bound a paragraph or heading.
CELLS = ["table", "thead", "tbody", "tfoot", "tr", "th", "td"]
BLOCKS = ["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu",
          "nav", "ol", "p", "pre", "section", "summary", "ul"]


def token_pattern(more: str = "+") -> str:
    """Comment, script, style, tag, declaration, text or a lone ``<``; ``more`` makes repeats possessive."""
    inside = rf"""(?:[^>"']+{more}|"[^"]*{more}"|'[^']*{more}')*{more}"""
    raw = "|".join(rf"<{t}(?:[\s/]{inside})?>.*?(?:</{t}\s*>|\z)" for t in ("script", "style"))
    return rf"(?is)<!--.*?(?:-->|\z)|{raw}|</?[a-z]{inside}>|<[!?][^>]*>|[^<]+|<"


NAME = "^<(/?[a-zA-Z][a-zA-Z0-9]*)"


def ends_of(*tags: str) -> list[str]:
    """Tags that end one of the given elements: cells end at cells only, so a cell may hold paragraphs."""
    if set(tags) <= {"th", "td"}:
        return CELLS
    return ["a", *CELLS] if set(tags) == {"a"} else CELLS + BLOCKS


def segments(df: DataFrame, html: str, id_col: str, ends: list[str], scope: str) -> DataFrame:
    """Stretches of a page from one bounding tag to the next: ``id, _row, level, place, name, tag, text``.

    ``level`` counts open tables. By ``scope`` a stretch takes in what stands in tables within it (``inside``),
    leaves that out and ends there (``own``), or knows no tables (``page``, level 0).
    """
    tokens = F.regexp_extract_all(F.col(html), F.lit(token_pattern()), F.lit(0))
    def row(t: Column, i: Column) -> Column:
        text = F.when(~t.startswith("<") | (t == "<"), t).otherwise("")
        return F.struct(i.alias("place"), F.lower(F.regexp_extract(t, NAME, 1)).alias("name"), F.when(text == "", t).alias("tag"), text.alias("text"))

    # the number of the page is given before its tokens become rows
    numbered = df.select(id_col, html, F.monotonically_increasing_id().alias("_row"))
    rows = numbered.select(id_col, "_row", F.inline_outer(F.transform(tokens, row)))
    rows = rows.filter("place IS NULL OR name <> '' OR text <> ''")
    page = W.partitionBy("_row").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("name") == "table", 1).when(F.col("name") == "/table", -1).otherwise(0)
    rows = rows.withColumn("_sum", F.sum(step).over(page))
    rows = rows.withColumn("depth", (F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(page))).cast("int"))
    bound = F.col("name").isin([*ends, *(f"/{e}" for e in ends)])
    if scope == "inside":
        levels = F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth"))).otherwise(F.array(F.lit(0)))
        rows = rows.withColumn("level", F.explode(levels))
        # after the end of a table the cell that holds it goes on
        bound = bound & (F.col("depth") == F.col("level")) & (F.col("name") != "/table")
    else:
        rows = rows.withColumn("level", F.col("depth") if scope == "own" else F.lit(0))
    inside = W.partitionBy("_row", "level").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_segment", F.sum(bound.cast("int")).over(inside))
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("place", "text"))))
    out = rows.groupBy(id_col, "_row", "level", "_segment").agg(F.min(F.struct("place", "name", "tag")).alias("_first"), texts.alias("_texts"))
    text = decode(F.array_join(F.transform("_texts", lambda x: x["text"]), ""))
    return out.select(id_col, "_row", "level", "_first.*", text.alias("text"))


def read_pairs(df: DataFrame, html: str = "html", label_tag: str = "th", value_tag: str = "td", id_col: str = "page_id") -> DataFrame:
    """Header cell and the value cell right after it, at every depth of tables."""
    ends = ends_of(label_tag, value_tag)
    parts = segments(df, html, id_col, ends, "inside" if ends is CELLS else "own")
    # what follows a closing tag counts only when it holds text: it then parts label and value
    parts = parts.filter((F.col("name") != "") & (~F.col("name").startswith("/") | F.col("text").rlike(r"\S")))
    here = W.partitionBy("_row", "level").orderBy("place")
    nxt = parts.withColumns({"_n": F.lead("name").over(here), "value": F.lead("text").over(here)})
    pairs = nxt.filter((F.col("name") == label_tag) & (F.col("_n") == value_tag))
    pos = F.row_number().over(W.partitionBy("_row").orderBy("place")) - 1
    return pairs.select(id_col, pos.alias("pos"), "level", F.col("text").alias("label"), "value")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag; names inside the quoted values of others do not count."""
    pattern = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)"""
    names = F.regexp_extract_all(tag, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(pattern), F.lit(2))
    found = F.get(F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.lower(x["n"]) == name), F.lit(0))["v"]
    return F.regexp_replace(found, r"""^["']|["']$""", "")


def read_links(df: DataFrame, html: str = "html", exclude_prefixes: list[str] | None = None,
               prefix: str = "/wiki/", id_col: str = "page_id") -> DataFrame:
    """Links to pages, without the excluded name spaces; those in comments and scripts are none."""
    links = segments(df, html, id_col, ends_of("a"), "page").filter("name = 'a'").withColumn("href", attribute(F.col("tag"), "href"))
    links = links.filter("href IS NOT NULL")
    pos = F.row_number().over(W.partitionBy("_row").orderBy("place")) - 1
    keep = F.col("href").startswith(prefix)
    for p in fixed.NON_PERSON_LINKS if exclude_prefixes is None else exclude_prefixes:
        keep = keep & ~F.col("href").startswith(p)
    return links.select(id_col, pos.alias("pos"), "text", "href").filter(keep)


def read_text(df: DataFrame, html: str = "html", title_tag: str = "h1", id_col: str = "page_id") -> DataFrame:
    """Title, and the paragraphs outside and inside tables, without numeric footnote marks."""
    parts = segments(df, html, id_col, ends_of(title_tag, "p"), "own")
    title = F.min(F.when(F.col("name") == title_tag, F.struct("place", "text")))["text"]
    body = F.array_sort(F.collect_list(F.when(F.col("name") == "p", F.struct("place", "text"))))
    text = F.array_join(F.transform(body, lambda x: x["text"]), "\n")
    out = parts.groupBy(id_col, "_row").agg(title.alias("title"), text.alias("text"))
    return out.select(id_col, "title", F.regexp_replace(F.trim("text"), r"\[\d+\]", "").alias("text"))

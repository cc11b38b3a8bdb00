"""Text, name, year and JSON expressions. Each returns a native Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions import fixed

ANY_SPACE = r"\s+"
INFOBOX_SCHEMA = "array<struct<label:string,value_text:string>>"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_blank(c: str | Column) -> Column:
    """True when a text is neither NULL nor only spaces (never NULL)."""
    return F.coalesce(F.trim(as_col(c)) != "", F.lit(False))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squish(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(as_col(c), ANY_SPACE, " "))


def matches(c: str | Column, pattern: str) -> Column:
    return as_col(c).rlike(pattern)


def any_of(words: list[str]) -> str:
    return "|".join(words)


def whole_word(words: list[str]) -> str:
    """Pattern with letter boundaries that also hold next to accented letters."""
    return r"(^|[^\p{L}\p{N}_])(" + any_of(words) + r")($|[^\p{L}\p{N}_])"


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def fold(c: str | Column) -> Column:
    """Lower case without accents."""
    low = F.lower(as_col(c))
    for wide, narrow in (("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        low = F.replace(low, F.lit(wide), F.lit(narrow))
    return F.translate(low, fixed.FOLD_FROM, fixed.FOLD_TO)


# --- relation text -----------------------------------------------------------

def relation_urls(c: str | Column, balanced: bool = False) -> Column:
    """URLs in parentheses of a relation text.

    A slug ends at the first ``)``; ``balanced`` lets it hold one inner pair.
    """
    slug = r"((?:[^()]++|\([^()]*\))+)" if balanced else r"([^)]+)"
    found = _all(as_col(c), r"\(https://es\.wikipedia\.org/wiki/" + slug + r"\)", 1)
    return F.transform(found, lambda s: F.concat(F.lit(fixed.WIKI), s))


def relation_urls_loose(c: str | Column, self_url: str | Column) -> Column:
    """As ``relation_urls`` but bare URLs count when no URL is in parentheses."""
    strict = relation_urls(c)
    bare = F.transform(_all(as_col(c), r"https://es\.wikipedia\.org/wiki/[^\s)]+", 0), lambda u: F.trim(u))
    urls = F.array_distinct(F.when(F.size(strict) > 0, strict).otherwise(bare))
    own = as_col(self_url)
    return F.filter(urls, lambda u: (u != "") & ~u.eqNullSafe(own))


def _named(c: Column, pattern: str) -> Column:
    names, urls = _all(c, pattern, 1), _all(c, pattern, 2)
    return F.transform(
        names, lambda n, i: F.struct(F.trim(n).alias("name"), F.get(urls, i).alias("url"))
    )


def name_urls(c: str | Column) -> Column:
    """``Name (url)`` pairs as ``array<struct<name,url>>``."""
    return _named(as_col(c), r"([^(;]+?)\s*\((https://es\.wikipedia\.org/wiki/[^)]+)\)")


def links_any(c: str | Column) -> Column:
    """``Name (url)`` on any host; a text without URL is one name with NULL url."""
    text = as_col(c)
    pairs = _named(text, r"([^;]+?)\s*\((https?://[^)]+)\)")
    alone = F.array(F.struct(text.alias("name"), F.lit(None).cast("string").alias("url")))
    none = F.slice(alone, 1, 0)
    return (
        F.when(text.isNull() | (text == ""), none).when(F.size(pairs) > 0, pairs).otherwise(alone)
    )


def split_list(c: str | Column, sep: str = ";") -> Column:
    """Squished non-blank entries of a delimited text."""
    parts = F.split(F.coalesce(as_col(c), F.lit("")), f"[{sep}]")
    return F.filter(F.transform(parts, squish), lambda t: t != "")


def strip_marks(c: str | Column, drop_words: list[str] | None = None) -> Column:
    """Remove ``[refs]`` and ``(…)``; NULL for entries that hold a drop word."""
    text = as_col(c)
    clean = squish(F.regexp_replace(F.regexp_replace(text, r"\[.*?\]", ""), r"\(.*?\)", ""))
    if not drop_words:
        return clean
    return F.when(~matches(F.lower(clean), any_of(drop_words)), clean)


def dict_names(c: str | Column) -> Column:
    """Keys of a ``{'name': …}`` text."""
    return _all(as_col(c), r"'([^']+)'\s*:", 1)


# --- names ------------------------------------------------------------------

def family_name(categoria: str | Column, familia: str | Column) -> Column:
    """Family of a category URL, else the family field without its prefix."""
    from_url = null_if_empty(F.regexp_extract(as_col(categoria), r"Categoría:Familia_([^/]+)", 1))
    from_field = null_if_empty(F.regexp_replace(as_col(familia), "[Ff]amilia ", ""))
    return F.coalesce(F.translate(from_url, "_", " "), from_field)


def _name_tokens(nombre: str | Column) -> Column:
    return F.filter(F.split(as_col(nombre), ANY_SPACE), lambda t: t != "")


def surnames(nombre: str | Column) -> Column:
    """Last and last-but-one token after particles, as ``struct<surname_1,surname_2>``."""
    tokens = F.filter(_name_tokens(nombre), lambda t: ~F.lower(t).isin(fixed.NAME_PARTICLES))

    def valid(t: Column) -> Column:
        bad = t.rlike(r"[()\d]") | (F.length(t) < 2) | F.lower(t).isin(fixed.NOT_SURNAMES)
        return F.when(~bad, t)

    return F.struct(
        valid(F.try_element_at(tokens, F.lit(-1))).alias("surname_1"),
        valid(F.try_element_at(tokens, F.lit(-2))).alias("surname_2"),
    )


def last_two_tokens(nombre: str | Column) -> Column:
    """Last two tokens with particles kept; a missing one is ''."""
    tokens = F.split(as_col(nombre), ANY_SPACE)
    return F.struct(
        F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit("")).alias("surname_1"),
        F.coalesce(F.try_element_at(tokens, F.lit(-2)), F.lit("")).alias("surname_2"),
    )


def given_name(nombre: str | Column) -> Column:
    return F.when(as_col(nombre) != "", F.get(F.split(as_col(nombre), ANY_SPACE), F.lit(0)))


def slugify(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(squish(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def country_slug(c: str | Column) -> Column:
    return F.translate(F.lower(as_col(c)), "éúíóá ", "euioa_")


def title_from_url(url: str | Column) -> Column:
    """Readable page title: text after ``wiki/``, spaces for ``_``, decoded."""
    raw = null_if_empty(F.regexp_extract(as_col(url), r"wiki/(.+)", 1))
    spaced = F.translate(raw, "_", " ")
    return F.coalesce(F.try_url_decode(F.replace(spaced, F.lit("+"), F.lit("%2B"))), spaced)


def letters_only(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(as_col(c), r"[^a-zA-ZáéíóúñÁÉÍÓÚÑ\s]", ""))


def shorten(c: str | Column, n: int = 22) -> Column:
    """Keep ``n - 3`` characters and dots when a label is longer than ``n``."""
    text = as_col(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def sentence_case(c: str | Column) -> Column:
    text = as_col(c)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def safe_text(c: str | Column, n: int = 2000) -> Column:
    return F.substring(F.trim(F.coalesce(as_col(c), F.lit(""))), 1, n)


# --- years ------------------------------------------------------------------

YEAR_WIDE = r"1[0-9]{3}|20[0-2][0-9]"
YEAR_MODERN = r"1[789]\d{2}|20[0-2]\d"


def _year_pattern(variant: str) -> str:
    body = {"wide": YEAR_WIDE, "modern": YEAR_MODERN}[variant]
    return rf"\b({body})\b"


def first_year(c: str | Column, variant: str = "modern") -> Column:
    found = F.regexp_extract(as_col(c), _year_pattern(variant), 1)
    return null_if_empty(found).try_cast("int")


def years(cols: list[str | Column], lo: int = 1800, hi: int = 2025) -> Column:
    """All distinct years of several texts, in order of appearance."""
    found = F.flatten(F.array(*[_all(as_col(c), _year_pattern("modern"), 1) for c in cols]))
    ints = F.transform(found, lambda y: y.cast("int"))
    return F.array_distinct(F.filter(ints, lambda y: y.between(lo, hi)))


def decade(y: str | Column) -> Column:
    return (F.floor(as_col(y) / 10) * 10).cast("int")


def persistence(n_gen: str | Column, total: str | Column) -> Column:
    return as_col(n_gen) * F.log1p(as_col(total))


# --- infobox and JSON ---------------------------------------------------------

def label_values(c: str | Column) -> Column:
    """``label: value | …`` as ``array<struct<label,value>>``."""
    pairs = F.transform(F.split(null_if_empty(as_col(c)), " [|] "), lambda e: F.split(e, ": ", 2))

    def entry(p: Column) -> Column:
        label = p[0]
        return F.struct(
            F.trim(F.when(label != "", label).otherwise(F.array_join(p, ": "))).alias("label"),
            F.when((label != "") & (F.size(p) > 1), F.trim(F.get(p, F.lit(1)))).otherwise("").alias("value"),
        )

    return F.transform(pairs, entry)


def no_control(c: str | Column) -> Column:
    return F.regexp_replace(as_col(c), r"[\x00-\x1F\x7F]", " ")


def infobox_rows(c: str | Column) -> Column:
    """Label rows of an infobox JSON array; NULL when the JSON is bad."""
    return F.from_json(F.trim(no_control(c)), INFOBOX_SCHEMA)


def any_label(c: str | Column, pattern: str) -> Column:
    """True when one JSON label matches, false for bad or missing JSON."""
    hit = F.exists(infobox_rows(c), lambda x: F.coalesce(F.lower(x["label"]).rlike(pattern), F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def json_ok(c: str | Column) -> Column:
    return F.try_parse_json(as_col(c)).isNotNull()


def clean_json(c: str | Column) -> Column:
    """JSON text after control characters and stray escapes are repaired, else NULL."""
    first = null_if_empty(squish(no_control(c)))
    second = first
    for bad, good in ((r"\'", "'"), (r"\"", '"'), (r"\n", " ")):
        second = F.replace(second, F.lit(bad), F.lit(good))
    second = squish(second)
    return F.when(json_ok(first), first).when(json_ok(second), second)


def first_object(c: str | Column, schema: str) -> Column:
    """First balanced ``{…}`` of a text, fenced or not, parsed; NULL when bad."""
    return F.from_json(first_object_text(c), schema)


def first_object_text(c: str | Column) -> Column:
    text = F.trim(F.coalesce(as_col(c), F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), F.trim(fenced)).otherwise(text)
    # Pieces are strings, braces and what lies between, so the running depth is a fold over few elements
    # and a brace inside a string does not count.
    tokens = r'(?s)"(?:[^"\\]++|\\.)*+"|[{}]|[^{}"]++|"'
    pieces = F.regexp_extract_all(F.regexp_extract(body, r"(?s)\{.*", 0), F.lit(tokens), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        i = acc["i"] + 1
        end = F.when((acc["end"] == 0) & (depth == 0), i).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), i.alias("i"), end.alias("end"))

    end = F.aggregate(pieces, start, step)["end"]
    return F.when(end > 0, F.array_join(F.slice(pieces, F.lit(1), F.greatest(end, F.lit(0))), ""))


def kwic(c: str | Column, words: list[str], width: int = 50) -> Column:
    """Every hit of the first word that occurs, with its context, joined by `` | ``.

    A hit never crosses a line, so only lines that hold the word are searched.
    """
    text, around = as_col(c), f".{{0,{width}}}"

    def hits(w: str) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(w))
        found = F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(around + w + around), F.lit(0)))
        return null_if_empty(F.array_join(F.flatten(found), " | "))

    return F.coalesce(*[F.when(text.rlike(w), hits(w)) for w in words])

"""J07, D01, D04 and D05 with a dictionary table: part names and the beginnings of all lines of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import phrases
from kinweave.plans.registry import query

LONGEST = 4  # words of a line's beginning


def _beginning(n: int) -> str:
    return rf"^{phrases.GAP}*({phrases.WORD}+(?:{phrases.GAP}+{phrases.WORD}+){{{n - 1}}})(?:{phrases.GAP}|$)"


def dictionary(fx):
    """Part names with their brands and the first 1 to 4 words of every line with its language."""
    names = fx.t("part").select(F.col("p_name").alias("phrase"), F.col("p_brand").alias("label"))
    lines = fx.t("documents").select("lang", F.explode_outer(F.split(F.lower("text"), "\n")).alias("line"))
    begins = lines.select(F.explode(F.array(*[
        F.regexp_extract("line", _beginning(n), 1) for n in range(1, LONGEST + 1)])).alias("phrase"), F.col("lang").alias("label"))
    return names.union(begins.filter("phrase <> ''")).distinct()


_DICTIONARY = f"""
    lines AS (SELECT lang, lower(unnest(string_split(text, chr(10)))) AS line FROM documents),
    dict AS (SELECT DISTINCT phrase, label FROM (SELECT lower(p_name) AS phrase, p_brand AS label FROM part
        {' '.join(f"UNION ALL SELECT regexp_extract(line, '{_beginning(n)}', 1), lang FROM lines" for n in range(1, LONGEST + 1))}) WHERE phrase <> '')"""


def _hits_sql(texts: str, keys: str) -> str:
    """Hits of the dictionary in ``texts (keys, text)``, grams of 1 to 4 words by windows; names of parts have two words."""
    grams = []
    for n in range(1, LONGEST + 1):
        parts = ["w"] + [f"lead(gap, {i - 1}, '') OVER o || lead(w, {i}) OVER o" if i > 1 else "gap || lead(w, 1) OVER o" for i in range(1, n)]
        grams.append(f"SELECT {keys}, i AS start, {n} AS n_words, {' || '.join(parts)} AS phrase FROM words WINDOW o AS (PARTITION BY {keys} ORDER BY i)")
    return rf"""
    {_DICTIONARY},
    cut AS (SELECT {keys}, regexp_extract_all(regexp_replace(lower(text), '^{phrases.GAP}+', ''), '({phrases.WORD}+)({phrases.GAP}*)', 1) AS ws,
                   regexp_extract_all(regexp_replace(lower(text), '^{phrases.GAP}+', ''), '({phrases.WORD}+)({phrases.GAP}*)', 2) AS gs FROM {texts}),
    words AS (SELECT {keys}, unnest(ws) AS w, unnest(gs) AS gap, unnest(range(len(ws))) AS i FROM cut),
    grams AS ({' UNION ALL '.join(grams)}),
    met AS (SELECT {keys}, start, n_words, phrase FROM grams WHERE phrase IN (SELECT phrase FROM dict)),
    outer_hits AS (SELECT {keys}, start, n_words, phrase FROM (SELECT *, max(start + n_words) OVER (PARTITION BY {keys} ORDER BY start, n_words DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM met) WHERE reach IS NULL OR reach < start + n_words),
    hits AS (SELECT h.*, d.label FROM outer_hits h JOIN dict d USING (phrase)),
    any_hits AS (SELECT m.*, d.label FROM met m JOIN dict d USING (phrase))"""


@query("j07_phrase_join", "", f"""WITH {_hits_sql('documents', 'doc_id, lang')}
    SELECT doc_id, lang, label AS vinculo, count(*) AS n_hits, count(DISTINCT phrase) AS n_phrases FROM hits
    WHERE lower(trim(label)) <> lang GROUP BY ALL""")
def _(fx):
    return phrases.phrase_join(fx.t("documents").select("doc_id", "lang", "text"), "doc_id", "lang", ["text"], dictionary(fx))


@query("d01_infer_by_phrases", "", f"""WITH {_hits_sql('documents', 'doc_id')}
    SELECT doc_id, min(label) AS pais FROM any_hits GROUP BY doc_id""")
def _(fx):
    return phrases.infer_by_phrases(fx.t("documents").select("doc_id", "text"), "doc_id", ["text"], dictionary(fx))


_FIELDS = "(SELECT doc_id, lang, 'biografia' AS kind, text FROM documents UNION ALL SELECT doc_id, lang, 'nota', concat('nota small ring ', source) FROM documents)"


@query("d04_mentions_by_phrases", "", f"""WITH {_hits_sql(_FIELDS, 'doc_id, lang, kind')}
    SELECT DISTINCT doc_id, lang, label AS vinculo, kind AS tipo_vinculo, CASE kind WHEN 'nota' THEN 'nota' ELSE 'text' END AS campo_detectado
    FROM any_hits WHERE lower(trim(label)) <> lang""")
def _(fx):
    d = fx.t("documents").withColumn("nota", F.concat(F.lit("nota small ring "), "source"))
    return phrases.mentions_by_phrases(d, "doc_id", "lang", {"text": "biografia", "nota": "nota"}, dictionary(fx))


@query("d05_targets_by_phrases", "", f"""WITH {_hits_sql('documents', 'doc_id')}
    SELECT doc_id, string_agg(label, ', ' ORDER BY label) AS conecta_con FROM (SELECT DISTINCT doc_id, label FROM any_hits) GROUP BY doc_id""")
def _(fx):
    return phrases.targets_by_phrases(fx.t("documents").select("doc_id", "text"), "doc_id", ["text"], dictionary(fx))

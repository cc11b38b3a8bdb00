"""W01-W09 and T01-T06 over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions.text import persistence
from kinweave.operators import ranking as rk
from kinweave.operators.aggregates import count_by
from kinweave.plans.registry import query

COUNTS = "c AS (SELECT pais, linaje, count(*) AS n FROM v_person GROUP BY 1, 2)"


def _counts(fx):
    return count_by(fx.person(), ["pais", "linaje"])


@query("w01_rank_in", "v_mention", """
    WITH c AS (SELECT periodo, surname_1, count(*) AS n FROM v_mention GROUP BY 1, 2)
    SELECT periodo, surname_1, n, row_number() OVER (PARTITION BY periodo ORDER BY n DESC, surname_1) AS rank FROM c""")
def _(fx):
    c = count_by(fx.mention(), ["periodo", "surname_1"])
    return rk.rank_in(c, ["periodo"], [F.desc("n"), F.col("surname_1")])


@query("w02_top_with_ties", "v_edge v_person", """
    WITH d AS (SELECT pais, person_id, count(*) AS n FROM v_edge JOIN v_person ON src = person_id GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY pais ORDER BY n DESC) AS INTEGER) AS ranking FROM d) WHERE ranking <= 15""")
def _(fx):
    d = fx.edge().join(fx.person(), F.col("src") == F.col("person_id")).groupBy("pais", "person_id").agg(F.count("*").alias("n"))
    return rk.top_with_ties(d, ["pais"], "n", 15)


@query("w03_share", "v_person", f"""
    WITH {COUNTS} SELECT pais, linaje, n, CAST(sum(n) OVER (PARTITION BY pais) AS BIGINT) AS total,
           round(100.0 * n / sum(n) OVER (PARTITION BY pais), 1)::DOUBLE AS pct FROM c""")
def _(fx):
    return rk.share(_counts(fx), ["pais"], "n")


@query("w04_group_totals", "v_person", """
    WITH c AS (SELECT linaje, ocupacion, count(*) AS n FROM v_person GROUP BY 1, 2),
    t AS (SELECT linaje, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT ocupacion) AS distintos FROM c GROUP BY 1)
    SELECT c.*, t.total, t.distintos, round(t.distintos * ln(t.total + 1), 6) AS puntaje FROM c JOIN t ON c.linaje = t.linaje""")
def _(fx):
    c = count_by(fx.person(), ["linaje", "ocupacion"])
    return rk.group_totals(c, ["linaje"], "n", "ocupacion").withColumn("puntaje", F.round(persistence("distintos", "total"), 6))


@query("w05_dominant", "v_person", """
    WITH c AS (SELECT linaje, ocupacion, count(*) AS n FROM v_person GROUP BY 1, 2)
    SELECT linaje, ocupacion, n, first_value(ocupacion) OVER (PARTITION BY linaje ORDER BY n DESC, ocupacion) AS dominante FROM c""")
def _(fx):
    return rk.dominant(count_by(fx.person(), ["linaje", "ocupacion"]), ["linaje"], "ocupacion", "n")


@query("w06_first_per_key", "v_spell", """
    SELECT person_id, spell_id, anio, cargo_text, o_orderstatus FROM
      (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY anio, spell_id) AS rn FROM v_spell) WHERE rn = 1""")
def _(fx):
    return rk.first_per_key(fx.spell(), ["person_id"], [F.col("anio"), F.col("spell_id")])


@query("w07_ordinal", "v_edge", """
    SELECT src, dst, relation_type, concat('familiar', CAST(row_number() OVER (PARTITION BY src ORDER BY dst, relation_type) AS VARCHAR)) AS ordinal FROM v_edge""")
def _(fx):
    return rk.ordinal(fx.edge(), ["src"], [F.col("dst"), F.col("relation_type")], "familiar")


@query("w08_segment_headers", "", """
    WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('Senador ', CAST(turn AS VARCHAR))
                      WHEN turn % 3 = 0 THEN 'detalle' WHEN turn % 3 = 1 THEN 'Predecesor' ELSE 'Sucesor' END AS label,
                      CASE WHEN role = 'user' THEN '' ELSE text END AS value, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS h FROM conversations),
    s AS (SELECT *, sum(h) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM r)
    SELECT conv_id, min(label) FILTER (h = 1) AS cargo, arg_min(value, turn) FILTER (label = 'detalle') AS periodo,
           arg_max(value, turn) FILTER (label = 'Predecesor') AS predecesor, arg_max(value, turn) FILTER (label = 'Sucesor') AS sucesor
    FROM s WHERE seg > 0 GROUP BY conv_id, seg""")
def _(fx):
    user = F.col("role") == "user"
    rows = fx.t("conversations").select(
        "conv_id", "turn",
        F.when(user, F.concat(F.lit("Senador "), F.col("turn"))).when(F.col("turn") % 3 == 0, "detalle")
        .when(F.col("turn") % 3 == 1, "Predecesor").otherwise("Sucesor").alias("label"),
        F.when(user, "").otherwise(F.col("text")).alias("value"))
    return rk.segment_headers(rows, "conv_id", "turn", "label", "value", "presidente|senador")


_RING = """
    WITH k AS (SELECT linaje, person_id AS src, lead(person_id) OVER w AS nxt, first_value(person_id) OVER w AS fst,
                      row_number() OVER w AS k FROM {0} WINDOW w AS (PARTITION BY linaje ORDER BY person_id))
    SELECT linaje, src, coalesce(nxt, fst) AS dst FROM k WHERE nxt IS NOT NULL OR k >= {1}"""


@query("w09_ring_edges", "v_person", _RING.format("v_person", 3))
def _(fx):
    return rk.ring_edges(fx.person().select("linaje", "person_id"), ["linaje"], "person_id", [F.col("person_id")])


@query("t01_top_n", "v_person", "SELECT person_id, nombre, c_acctbal FROM v_person ORDER BY c_acctbal DESC, person_id LIMIT 15")
def _(fx):
    return rk.top_n(fx.person().select("person_id", "nombre", "c_acctbal"), [F.desc("c_acctbal"), F.col("person_id")], 15)


@query("t02_top_n_per", "v_person", """
    SELECT pais, person_id, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY pais ORDER BY c_acctbal DESC, person_id) AS rn FROM v_person) WHERE rn <= 5""")
def _(fx):
    return rk.top_n_per(fx.person().select("pais", "person_id", "c_acctbal"), ["pais"], [F.desc("c_acctbal"), F.col("person_id")], 5)


@query("t03_filter_top", "v_mention", """
    SELECT person_id, spell_id, surname_1 FROM v_mention WHERE surname_1 IN
      (SELECT surname_1 FROM v_mention GROUP BY 1 ORDER BY count(*) DESC, surname_1 LIMIT 5)""")
def _(fx):
    return rk.filter_top(fx.mention().select("person_id", "spell_id", "surname_1"), "surname_1", 5)


@query("t04_most_common", "v_person", """
    WITH c AS (SELECT pais, nombre, count(*) AS n FROM v_person GROUP BY 1, 2)
    SELECT pais, nombre, n FROM (SELECT *, row_number() OVER (PARTITION BY pais ORDER BY n DESC, nombre) AS rn FROM c) WHERE rn <= 20""")
def _(fx):
    return rk.most_common(fx.person(), ["pais"], "nombre", 20)


@query("t05_argmax_row", "v_person", f"WITH {COUNTS} SELECT pais, linaje, n FROM c ORDER BY n DESC, linaje LIMIT 1")
def _(fx):
    return rk.argmax_row(_counts(fx), "n", "linaje")


@query("t06_head_sample", "v_person", "SELECT person_id, nombre FROM v_person WHERE pais = 'ASIA' ORDER BY person_id LIMIT 50")
def _(fx):
    return rk.head_sample(fx.person().filter("pais = 'ASIA'").select("person_id", "nombre"), [F.col("person_id")], 50)

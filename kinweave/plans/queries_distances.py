"""Queries of distances between persons (N13, A07) and of betweenness after peeling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import distances as dt
from kinweave.operators import graph
from kinweave.operators.ranking import top_n_per
from kinweave.plans.queries_graph import COMP, MUTUAL, betweenness_sql
from kinweave.plans.registry import query
from kinweave.session import cut

STEPS = 24  # well past the diameter of the fixtures


def steps_sql(adj: str, nodes: str) -> str:
    """Search steps unrolled: ``pairs(s, d, n)`` counts the nodes at each distance from each node."""
    out = [f"d0 AS MATERIALIZED (SELECT id AS s, id AS v FROM ({nodes}))"]
    for k in range(STEPS):
        back = f"SELECT s, v FROM d{k} UNION ALL SELECT s, v FROM d{k - 1}" if k else "SELECT s, v FROM d0"
        out.append(f"d{k + 1} AS MATERIALIZED (SELECT DISTINCT s, b AS v FROM d{k} JOIN {adj} ON v = a EXCEPT SELECT s, v FROM ({back}))")
    counted = " UNION ALL ".join(f"SELECT s, {k} AS d, count(*) AS n FROM d{k} GROUP BY 1" for k in range(1, STEPS + 1))
    return ", ".join([*out, f"pairs AS ({counted})"])


@query("n13_distance_counts", "v_adj", f"WITH {steps_sql('v_adj', 'SELECT DISTINCT a AS id FROM v_adj')} SELECT d, CAST(sum(n) AS BIGINT) AS pares FROM pairs GROUP BY 1")
def _(fx):
    return dt.distance_counts(fx.edge())


@query("n13_giant_distance", "v_adj", f"""WITH RECURSIVE {COMP}, g AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
    {steps_sql('v_adj', 'SELECT id FROM comp WHERE component = (SELECT component FROM g)')}
    SELECT CAST(sum(n) AS BIGINT) AS pares, max(d) AS diametro, round(sum(d * n) / sum(n), 9) AS distancia_media FROM pairs""")
def _(fx):
    return dt.giant_distance(fx.edge()).withColumn("distancia_media", F.round("distancia_media", 9))


@query("a07_giant_distance", "v_kin", f"""WITH RECURSIVE nd AS (SELECT src AS id, src_pais AS g FROM v_kin UNION SELECT dst, dst_pais FROM v_kin WHERE dst_pais IS NOT NULL),
    us AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM v_kin WHERE clase_pais = 'Intra-país' AND src <> dst),
    v_adj AS MATERIALIZED (SELECT s AS a, d AS b FROM us UNION ALL SELECT d, s FROM us), {COMP},
    cs AS (SELECT g, component, count(*) AS n, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, component) AS rn FROM comp JOIN nd USING (id) GROUP BY 1, 2),
    {steps_sql('v_adj', 'SELECT id FROM comp WHERE component IN (SELECT component FROM cs WHERE rn = 1)')}
    SELECT g AS pais, CAST(sum(n) AS BIGINT) AS pares, max(d) AS diametro, round(sum(d * n) / sum(n), 3) AS avg_path FROM pairs JOIN nd ON s = id GROUP BY 1""")
def _(fx):
    kin = fx.kin()
    nodes = kin.select(F.col("src").alias("id"), F.col("src_pais").alias("grupo")).union(
        kin.filter(F.col("dst_pais").isNotNull()).select("dst", "dst_pais")).distinct()
    out = dt.giant_distance(kin.filter("clase_pais = 'Intra-país'").select("src", "dst"), cut(nodes))
    return out.select(F.col("grupo").alias("pais"), "pares", "diametro", F.round("distancia_media", 3).alias("avg_path"))


@query("n14_forest_houses", "v_hadj", f"""WITH RECURSIVE {betweenness_sql('v_hadj')}
    SELECT a AS id, round(coalesce(b, 0), 6) AS betweenness FROM (SELECT DISTINCT a FROM v_hadj) LEFT JOIN bt ON a = id""")
def _(fx):
    return dt.forest_betweenness(fx.house_links()).withColumn("betweenness", F.round("betweenness", 6))


PERSONS = f"{MUTUAL}, ma AS MATERIALIZED (SELECT src AS a, dst AS b FROM mutual UNION ALL SELECT dst, src FROM mutual), {betweenness_sql('ma')}"


@query("n14_forest_persons", "v_edge", f"""WITH RECURSIVE {PERSONS}
    SELECT a AS id, round(coalesce(b, 0), 6) AS betweenness FROM (SELECT DISTINCT a FROM ma) LEFT JOIN bt ON a = id""")
def _(fx):
    return dt.forest_betweenness(graph.mutual(fx.edge())).withColumn("betweenness", F.round("betweenness", 6))


@query("a23_top_connectors_by_paths", "v_edge v_person", f"""WITH RECURSIVE {PERSONS},
    sc AS (SELECT a AS id, count(*) AS grado FROM ma GROUP BY 1),
    rk AS (SELECT pais, nombre, id, grado, round(coalesce(b, 0), 6) AS betweenness,
                  CAST(row_number() OVER (PARTITION BY pais ORDER BY round(coalesce(b, 0), 6) DESC, grado DESC, id) AS INTEGER) AS ranking
           FROM sc LEFT JOIN bt USING (id) JOIN v_person ON id = person_id)
    SELECT * FROM rk WHERE ranking <= 3""")
def _(fx):
    both = cut(graph.mutual(fx.edge()))
    score = dt.forest_betweenness(both).withColumn("betweenness", F.round("betweenness", 6)).join(graph.degree(both).select("id", "grado"), "id")
    who = fx.person().select(F.col("person_id").alias("id"), "pais", "nombre")
    return top_n_per(score.join(who, "id"), ["pais"], [F.desc("betweenness"), F.desc("grado"), F.col("id")], 3, "ranking")

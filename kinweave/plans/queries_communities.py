"""Queries of communities by local moves: modularity (N15, A32, N17) and the map equation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import communities as cm
from kinweave.operators import graph
from kinweave.plans.queries_graph import MUTUAL
from kinweave.plans.registry import query

H = "CASE WHEN ({0}) > 0 THEN ({0}) * log2({0}) ELSE 0 END"


def h(x: str) -> str:
    return H.format(x)


def _modularity(s: str) -> dict[str, str]:
    return {
        "gain": "m2 * (w - w_own)::HUGEINT - k::HUGEINT * (tot - (tot_own - k))",
        "value": f"(SELECT (SELECT m2 FROM {s}m) * sum(inside)::HUGEINT - sum(tot::HUGEINT * tot) FROM {{0}})",
    }


def _flow(s: str) -> dict[str, str]:
    f = lambda x: f"({x})::DOUBLE / m2"
    less, more = "(tot_own - inside_own - (k - loop) + 2 * w_own)", "(tot - inside + (k - loop) - 2 * w)"
    own, to = "(tot_own - inside_own)", "(tot - inside)"
    before = f"{h(f('leaving'))} - 2 * ({h(f(own))} + {h(f(to))}) + {h(f(own + ' + tot_own'))} + {h(f(to + ' + tot'))}"
    after = (f"{h(f(f'leaving + {less} - {own} + {more} - {to}'))} - 2 * ({h(f(less))} + {h(f(more))}) "
             f"+ {h(f(less + ' + tot_own - k'))} + {h(f(more + ' + tot + k'))}")
    whole, out = "(sum(tot - inside))::DOUBLE / m2", f("tot - inside")
    return {
        "gain": f"round({before} - ({after}), 9)",
        "value": f"(SELECT -round({h(whole)} - 2 * sum({h(out)}) + sum({h(f('tot - inside + tot'))}), 9) FROM {{0}}, {s}m GROUP BY m2)",
    }


def moves_sql(edges: str, measure, levels: int = cm.LEVELS, rounds: int = cm.ROUNDS) -> str:
    """Rounds and levels unrolled; ``found(id, c)`` are the communities of linked nodes, ``trace`` the value of each level."""
    out = [f"g0 AS MATERIALIZED (SELECT src AS a, dst AS b, 1 AS w FROM {edges} UNION ALL SELECT dst, src, 1 FROM {edges})"]
    for level in range(levels):
        s, g = f"s{level}", f"g{level}"
        text = measure(s)
        out += [f"{s}k AS MATERIALIZED (SELECT a AS id, sum(w)::BIGINT AS k, coalesce(sum(w) FILTER (a = b), 0)::BIGINT AS loop FROM {g} GROUP BY 1)",
                f"{s}m AS MATERIALIZED (SELECT sum(k)::BIGINT AS m2 FROM {s}k)",
                f"{s}c0 AS MATERIALIZED (SELECT id, id AS c FROM {s}k)"]

        def standing(labels: str, g: str = g) -> str:
            return (f"SELECT x.c AS c, sum(w)::BIGINT AS tot, coalesce(sum(w) FILTER (x.c = y.c), 0)::BIGINT AS inside FROM {g} "
                    f"JOIN {labels} x ON a = x.id JOIN {labels} y ON b = y.id GROUP BY 1")

        out.append(f"{s}t0 AS MATERIALIZED ({standing(f'{s}c0')})")
        for r in range(rounds):
            c, t = f"{s}c{r}", f"{s}t{r}"
            move = f"instr('13579bdf', right(md5(concat(o.id::VARCHAR, ':{level * rounds + r}')), 1)) > 0"
            out += [
                f"{s}v{r} AS MATERIALIZED (SELECT a AS id, c, sum(w)::BIGINT AS w FROM {g} JOIN {c} ON b = id WHERE a <> b GROUP BY 1, 2)",
                f"{s}w{r} AS MATERIALIZED (SELECT id, to_c FROM (SELECT id, to_c, row_number() OVER (PARTITION BY id ORDER BY gain DESC, to_c) AS rn FROM "
                f"(SELECT v.id, v.c AS to_c, {text['gain']} AS gain FROM (SELECT v.id, v.c, v.w, o.c AS own, coalesce(z.w, 0) AS w_own, k, loop, "
                f"p.tot AS tot_own, p.inside AS inside_own, q.tot, q.inside, m2, (SELECT sum(tot - inside) FROM {t}) AS leaving "
                f"FROM {s}v{r} v JOIN {c} o ON o.id = v.id LEFT JOIN {s}v{r} z ON z.id = v.id AND z.c = o.c JOIN {s}k kk ON kk.id = v.id "
                f"JOIN {t} p ON p.c = o.c JOIN {t} q ON q.c = v.c, {s}m WHERE v.c <> o.c) v) WHERE gain > 0) WHERE rn = 1)",
                f"{s}n{r} AS MATERIALIZED (SELECT o.id, CASE WHEN to_c IS NOT NULL AND {move} THEN to_c ELSE o.c END AS c FROM {c} o LEFT JOIN {s}w{r} w ON w.id = o.id)",
                f"{s}u{r} AS MATERIALIZED ({standing(f'{s}n{r}')})",
                f"{s}j{r} AS MATERIALIZED (SELECT {text['value'].format(f'{s}u{r}')} > {text['value'].format(t)} AS better)",
                f"{s}c{r + 1} AS MATERIALIZED (SELECT n.id, CASE WHEN better THEN n.c ELSE o.c END AS c FROM {s}n{r} n JOIN {c} o ON o.id = n.id, {s}j{r})",
                f"{s}t{r + 1} AS MATERIALIZED ({standing(f'{s}c{r + 1}')})",
            ]
        last = f"{s}c{rounds}"
        out.append(f"f{level} AS MATERIALIZED (SELECT id, c FROM {last})" if not level else
                   f"f{level} AS MATERIALIZED (SELECT f.id, x.c FROM f{level - 1} f JOIN {last} x ON f.c = x.id)")
        out.append(f"g{level + 1} AS MATERIALIZED (SELECT x.c AS a, y.c AS b, sum(w)::BIGINT AS w FROM {g} JOIN {last} x ON a = x.id JOIN {last} y ON b = y.id GROUP BY 1, 2)")
    return ", ".join([*out, f"found AS (SELECT * FROM f{levels - 1})"])


IDS = "SELECT src AS id FROM v_edge UNION SELECT dst FROM v_edge"
ALL = f"SELECT i.id, coalesce(c, i.id) AS community FROM ({IDS}) i LEFT JOIN found USING (id)"
MOVES = moves_sql("v_simple", _modularity)
BOTH_WAYS = moves_sql("mutual", _modularity)
FLOWS = moves_sql("v_simple", _flow)
QUALITY = """SELECT (2 * l::DOUBLE / d - dd / (d::DOUBLE * d)) AS q FROM (SELECT sum(l) AS l, sum(d) AS d, sum(d * d)::DOUBLE AS dd FROM (
    SELECT c, sum(l) AS l, count(*) AS d FROM (SELECT a.c AS c, CASE WHEN a.c = b.c THEN 1 ELSE 0 END AS l FROM v_simple e JOIN {0} a ON e.src = a.id JOIN {0} b ON e.dst = b.id
    UNION ALL SELECT b.c, 0 FROM v_simple e JOIN {0} b ON e.dst = b.id) GROUP BY c))"""


@query("n15_louvain", "v_simple v_edge", f"WITH {MOVES} {ALL}")
def _(fx):
    return cm.louvain(fx.edge())


@query("n15_louvain_levels", "v_simple v_edge", f"WITH {MOVES}, levels AS ({' UNION ALL '.join(
    f'SELECT {i} AS level, (SELECT count(DISTINCT c) FROM f{i}) AS communities, ({QUALITY.format(f"f{i}")}) AS q' for i in range(cm.LEVELS))})"
    " SELECT level, communities, round(q, 9) AS modularity FROM levels l WHERE level = 0 OR communities < (SELECT communities FROM levels p WHERE p.level = l.level - 1)")
def _(fx):
    return cm.louvain_levels(fx.edge()).withColumn("modularity", F.round("modularity", 9))


@query("n16_flow_communities", "v_simple v_edge", f"WITH {FLOWS}, a AS ({ALL}) SELECT id, community, count(*) OVER (PARTITION BY community) AS size FROM a")
def _(fx):
    return cm.flow_communities(fx.edge())


@query("n16_code_length", "v_simple v_edge", f"""WITH {FLOWS}, n AS (SELECT sum(w) AS m2 FROM g0),
    st AS (SELECT x.c AS c, sum(w) AS tot, coalesce(sum(w) FILTER (x.c = y.c), 0) AS inside FROM g0 JOIN found x ON a = x.id JOIN found y ON b = y.id GROUP BY 1),
    own AS (SELECT -sum({h('k::DOUBLE / m2')}) AS single FROM s0k, n),
    moving AS (SELECT {h('sum(tot - inside)::DOUBLE / m2')} - 2 * sum({h('(tot - inside)::DOUBLE / m2')}) + sum({h('(tot - inside + tot)::DOUBLE / m2')}) AS bits FROM st, n GROUP BY m2)
    SELECT round(bits + single, 6) AS bits, round(single, 6) AS bits_single FROM own, moving""")
def _(fx):
    e = fx.edge()
    return cm.code_length(e, cm.flow_communities(e).select("id", "community"))


@query("n17_mixed_louvain", "v_edge v_person", f"""WITH {MUTUAL}, {BOTH_WAYS}, a AS ({ALL})
    SELECT community, count(*) FILTER (pais = 'ASIA') AS n_a, count(*) FILTER (pais = 'EUROPE') AS n_b, count(*) AS total
    FROM a JOIN v_person ON id = person_id GROUP BY 1 HAVING n_a > 0 AND n_b > 0""")
def _(fx):
    where = fx.person().select(F.col("person_id").alias("id"), "pais")
    return graph.mixed_communities(cm.louvain(fx.edge(), "mutual").join(where, "id"), "pais", "ASIA", "EUROPE")


@query("a32_louvain_sizes", "v_edge", f"""WITH {MUTUAL}, {BOTH_WAYS}, a AS ({ALL}), g AS (SELECT community, count(*) AS n FROM a GROUP BY 1)
    SELECT community, n, CASE WHEN n >= 3 THEN concat('Clúster ', CAST(community AS VARCHAR)) ELSE 'Pequeño' END AS community_label FROM g""")
def _(fx):
    return graph.community_labels(cm.louvain(fx.edge(), "mutual"), 3)

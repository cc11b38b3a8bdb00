"""SQL of the fixture views, for the check queries."""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_person": ([], """
        SELECT c_custkey AS person_id, concat('https://es.wikipedia.org/wiki/P', CAST(c_custkey AS VARCHAR)) AS url,
               p_name AS nombre, r_name AS pais, c_mktsegment AS familia, n_name AS linaje,
               p_type AS ocupacion, p_brand AS lugar, c_acctbal
        FROM customer JOIN part ON c_custkey = p_partkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "v_known": (["v_person"], "SELECT * FROM v_person WHERE lugar <> 'Brand#1'"),
    "v_attr": (["v_person"], """
        SELECT person_id, url, nombre, pais, familia, linaje,
               CASE WHEN lugar = 'Brand#1' THEN NULL WHEN lugar = 'Brand#2' THEN '  ' ELSE lugar END AS lugar,
               CASE WHEN c_acctbal > 6000 THEN concat(lower(ocupacion), ' ', lower(linaje))
                    WHEN c_acctbal < 0 THEN '' END AS cargos,
               ocupacion, c_acctbal
        FROM v_person"""),
    "v_edge": ([], """
        SELECT DISTINCT o_custkey AS src, (o_orderkey * 37 + 11) % (SELECT count(*) FROM customer) AS dst,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'conyuge' WHEN '2-HIGH' THEN 'pareja'
                    WHEN '3-MEDIUM' THEN 'padres' WHEN '4-NOT SPECIFIED' THEN 'hijos' ELSE 'hermanos' END AS relation_type
        FROM orders"""),
    "v_house": (["v_edge", "v_person"], """
        SELECT DISTINCT concat(a.pais, '/', a.lugar) AS src, concat(b.pais, '/', b.lugar) AS dst, a.pais AS pa, b.pais AS pb
        FROM v_edge e JOIN v_person a ON e.src = a.person_id JOIN v_person b ON e.dst = b.person_id
        WHERE relation_type IN ('conyuge', 'pareja') AND concat(a.pais, '/', a.lugar) <> concat(b.pais, '/', b.lugar)"""),
    "v_hadj": (["v_house"], "SELECT src AS a, dst AS b FROM v_house UNION SELECT dst, src FROM v_house"),
    "v_spell": ([], """
        SELECT o_custkey AS person_id, o_orderkey AS spell_id, CAST(year(o_orderdate) AS INTEGER) AS anio,
               lower(o_orderpriority) AS cargo_text, o_orderstatus FROM orders"""),
    "v_kin": (["v_edge", "v_known"], """
        SELECT e.src, e.dst, e.relation_type, a.nombre AS src_nombre, a.pais AS src_pais, a.familia AS src_familia,
               b.nombre AS dst_nombre, b.pais AS dst_pais, b.familia AS dst_familia,
               CASE WHEN a.pais = b.pais THEN 'Intra-país' WHEN a.pais <> b.pais THEN 'Inter-país'
                    ELSE 'Desconocido' END AS clase_pais,
               CASE WHEN a.familia = b.familia THEN 'Intra-familia' WHEN a.familia <> b.familia THEN 'Inter-familia'
                    ELSE 'Desconocido' END AS clase_familia
        FROM v_edge e JOIN v_known a ON e.src = a.person_id LEFT JOIN v_known b ON e.dst = b.person_id"""),
    "v_lkin": (["v_edge", "v_known"], """
        SELECT e.src, e.dst, e.relation_type, a.nombre AS src_nombre, a.pais AS src_pais, a.linaje AS src_familia,
               b.nombre AS dst_nombre, b.pais AS dst_pais, b.linaje AS dst_familia,
               CASE WHEN a.pais = b.pais THEN 'Intra-país' WHEN a.pais <> b.pais THEN 'Inter-país'
                    ELSE 'Desconocido' END AS clase_pais,
               CASE WHEN a.linaje = b.linaje THEN 'Intra-familia' WHEN a.linaje <> b.linaje THEN 'Inter-familia'
                    ELSE 'Desconocido' END AS clase_familia
        FROM v_edge e JOIN v_known a ON e.src = a.person_id LEFT JOIN v_known b ON e.dst = b.person_id"""),
    "v_mention": (["v_spell", "v_person"], """
        SELECT s.person_id, s.spell_id, s.anio, s.cargo_text, p.pais, p.familia,
               string_split(p.nombre, ' ')[-1] AS surname_1,
               CASE WHEN s.anio < 1997 THEN 'Pre-1997' WHEN s.anio < 1999 THEN '1997-1998' ELSE '1999+' END AS periodo
        FROM v_spell s JOIN v_person p ON s.person_id = p.person_id"""),
    "v_simple": (["v_edge"], """
        SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM v_edge WHERE src <> dst"""),
    "v_adj": (["v_simple"], "SELECT src AS a, dst AS b FROM v_simple UNION ALL SELECT dst, src FROM v_simple"),
}


def with_views(views: str, body: str) -> str:
    """Prepend the named views, with what they need, as common table expressions."""
    order: list[str] = []

    def add(v: str) -> None:
        for dep in VIEWS[v][0]:
            add(dep)
        if v not in order:
            order.append(v)

    for v in views.split():
        add(v)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in order)
    text = body.strip()
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE '):]}"
    if text.startswith("WITH "):
        return f"WITH {ctes},\n{text[len('WITH '):]}"
    return f"WITH {ctes}\n{text}"

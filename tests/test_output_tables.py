"""The whole chain from country files to output tables on a few Spanish biographies."""

import pytest

from kinweave.functions.fixed import WIKI
from kinweave.plans.output_tables import output_tables, write_output_tables
from kinweave.sources.tables import read_csv_table, read_partitioned

HEADER = ["nombre", "url", "biografia", "fecha_nacimiento", "lugar_nacimiento", "nacionalidad", "ocupacion", "conyuge", "hijos", "familia",
          "cargos_politicos", "infobox_json", "infobox_completa"]


def person(nombre, slug, **kw):
    return {"nombre": nombre, "url": WIKI + slug, **kw}


CHILE = [
    person("Pedro Montt", "Pedro", fecha_nacimiento="29 de junio de 1849", lugar_nacimiento="Santiago, Chile", nacionalidad="Chilena",
           ocupacion="abogado", conyuge=f"Sara Campo ({WIKI}Sara)", hijos=f"Hijo Uno ({WIKI}Hijo_Uno); Eva Paz ({WIKI}Eva)", familia="Familia Montt",
           cargos_politicos="Presidente de Chile 1906-1910", infobox_json='[{"label": "Presidente", "value_text": "1906"}]',
           infobox_completa="Presidente de Chile | detalle: 1906 | Predecesor: Riesco | Sucesor: Figueroa"),
    person("Sara Campo", "Sara", lugar_nacimiento="Valparaíso", ocupacion="primera dama", familia="Familia Montt", biografia='dijo "no" en 1975;\nluego calló'),
    person("Sara Campo", "Sara", lugar_nacimiento="Valparaíso", familia="Familia Montt"),
]
PERU = [
    person("Eva Paz", "Eva", nacionalidad="chilena", lugar_nacimiento="Lima", ocupacion="diplomática", conyuge=f"Otro ({WIKI}Otro)", familia="Familia Paz",
           cargos_politicos="Embajadora, luego ministra 1991", biografia="vivió como chilena en Lima", infobox_json="{roto"),
    person("Otro Paz", "Otro", familia="Familia Sol", hijos=f"Pedro ({WIKI}Pedro)"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("familias")
    for pais, people in (("Chile", CHILE), ("Perú", PERU)):
        (base / pais).mkdir()
        lines = [";".join(HEADER)] + [";".join('"' + x.get(c, "").replace('"', '""') + '"' for c in HEADER) for x in people]
        (base / pais / "consolidado.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return output_tables(read_partitioned(spark, f"{base}/*/consolidado.csv", r"/([^/]+)/consolidado\.csv", multi_line=True))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_endogamy_counts_each_person_once(tables):
    got = rows(tables["endogamia_por_pais"], "pais", "matrimonios_total", "matrimonios_endogamicos", "tasa_endogamia_familiar")
    assert got == [("Chile", 1, 1, 100.0), ("Perú", 1, 0, 0.0)]


def test_links_between_countries(tables):
    assert rows(tables["resumen_conexiones_inter_pais"], "pais", "conexiones_salientes", "conexiones_entrantes") == [("Chile", 1, 1), ("Perú", 1, 1)]
    assert rows(tables["analisis_desconocidos"], "src_pais", "relation_type", "n") == [("Chile", "hijos", 1)]
    assert rows(tables["red_matrimonial_familias"], "src", "dst", "weight") == [("Paz", "Sol", 1)]


def test_offices(tables):
    assert rows(tables["cargos"], "cargo", "periodo", "predecesor", "sucesor") == [("Presidente de Chile", "1906", "Riesco", "Figueroa")]
    assert rows(tables["cargos_por_pais"], "pais", "cargo_tipo", "n") == [
        ("Chile", "Presidente", 1), ("Chile", "Sin cargo político", 1), ("Perú", "Embajador", 1), ("Perú", "Sin cargo político", 1)]
    assert rows(tables["json_limpieza_resumen"], "pais", "n_total", "n_json_valido") == [("Chile", 2, 1), ("Perú", 2, 0)]


def test_surnames_by_period(tables):
    got = rows(tables["apellidos_por_periodo"], "periodo", "surname_1", "n")
    assert got == [("Dictadura (1973-1990)", "Campo", 1), ("Post-dictadura (1990+)", "Paz", 1), ("Pre-1973", "Montt", 2)]


def test_nationality(tables):
    assert rows(tables["casos_especiales_nacionalidad"], "nombre", "pais_familia", "pais_nacionalidad") == [("Eva Paz", "Perú", "Chile")]
    assert ("Eva Paz", "Chile") in rows(tables["nodos_puente"], "nombre", "conecta_con")


def test_network(tables):
    got = rows(tables["metricas_red_por_pais"], "pais", "n_nodes", "n_edges", "giant_size")
    assert got == [("Chile", 2, 1, 2), ("Perú", 2, 1, 2)]


def test_every_table_runs_and_non_empty_ones_are_written(spark, tables, tmp_path):
    names = write_output_tables(tables, str(tmp_path))
    assert len(tables) == 45 and set(tables) - set(names) <= {
        "casos_especiales_nacionalidad", "conexiones_cruzadas_nacionalidad", "conexiones_diplomaticas", "patrones_nomenclatura_familias"}
    assert read_csv_table(spark, str(tmp_path / "endogamia_por_pais")).count() == 2

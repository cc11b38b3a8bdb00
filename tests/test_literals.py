"""Small literal cases: default dictionaries, ties, blanks, brackets and broken input."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions import text as tx
from kinweave.operators import aggregates as agg
from kinweave.operators import graph, joins, rules, sets, shape
from kinweave.operators import ranking as rk
from kinweave.plans import reports
from kinweave.sources import html, tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_slug_stops_at_first_bracket_unless_balanced(spark):
    t = "Juan (https://es.wikipedia.org/wiki/Juan_(político)); Ana (https://es.wikipedia.org/wiki/Ana)"
    assert one(spark, tx.relation_urls("t"), t=t) == [fixed.WIKI + "Juan_(político", fixed.WIKI + "Ana"]
    assert one(spark, tx.relation_urls("t", balanced=True), t=t) == [fixed.WIKI + "Juan_(político)", fixed.WIKI + "Ana"]


def test_relation_urls_of_missing_text(spark):
    assert one(spark, tx.relation_urls("t"), t=None) == []
    assert one(spark, tx.links_any("t"), t="") == []
    assert [tuple(x) for x in one(spark, tx.links_any("t"), t="solo texto")] == [("solo texto", None)]


def test_loose_urls(spark):
    t = "ver https://es.wikipedia.org/wiki/A y https://es.wikipedia.org/wiki/B y https://es.wikipedia.org/wiki/A"
    assert one(spark, tx.relation_urls_loose("t", F.lit(fixed.WIKI + "B")), t=t) == [fixed.WIKI + "A"]


@pytest.mark.parametrize("name,want", [
    ("Pedro Montt", ("Montt", "Pedro")), ("María de la Luz y Prado", ("Prado", "Luz")), ("Eva (actor)", (None, "Eva")),
    ("Luis Actor", (None, "Luis")), ("Ana B", (None, "Ana")), ("", (None, None)), (None, (None, None)), ("Jorge XV2 Pinto", ("Pinto", None)),
])
def test_surnames(spark, name, want):
    assert tuple(one(spark, tx.surnames("n"), n=name)) == want


def test_family_name(spark):
    url = fixed.WIKI + "Categoría:Familia_García_Huidobro/x"
    assert one(spark, tx.family_name("c", "f"), c=url, f="otra") == "García Huidobro"
    assert one(spark, tx.family_name("c", "f"), c="", f="Familia Montt") == "Montt"
    assert one(spark, tx.family_name("c", "f"), c=None, f="") is None


def test_title_from_url(spark):
    assert one(spark, tx.title_from_url("u"), u=fixed.WIKI + "Jos%C3%A9_Pi%C3%B1era_C+D") == "José Piñera C+D"
    assert one(spark, tx.title_from_url("u"), u=fixed.WIKI + "Mal_%ZZ") == "Mal %ZZ"
    assert one(spark, tx.title_from_url("u"), u="https://example.org") is None


def test_years(spark):
    assert one(spark, tx.years(["t"]), t="1790, 1973-1990; 1973 y 2029 12345 x2001") == [1973, 1990]
    assert one(spark, tx.first_year("t"), t="sin año 1650") is None
    assert one(spark, tx.first_year("t", "wide"), t="sin año 1650") == 1650


def test_first_object(spark):
    assert one(spark, tx.first_object_text("t"), t='a {"x": {"y": {"z": 1}}} {"b": 2}') == '{"x": {"y": {"z": 1}}}'
    assert one(spark, tx.first_object_text("t"), t='{ nunca {"b": 2}') is None
    assert one(spark, tx.first_object_text("t"), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, tx.first_object_text("t"), t=None) is None
    for text in ('{"a": "x } y"}', r'{"a": "q \" } {"}', '{"a": {"b": "{"}}', '{"a": "' + "w\\\\" * 9000 + '}"}'):
        assert one(spark, tx.first_object_text("t"), t=f"ante {text} post }}") == text
    assert one(spark, tx.first_object_text("t"), t='{"a": "sin fin } ') == '{"a": "sin fin }'


def test_several_overrides_of_one_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, pais string")
    manual = spark.createDataFrame([(1, "z", 1), (1, "y", 2), (1, None, 0), (3, "c", 1), (None, "q", 1)], "id int, pais string, n int")
    rows = lambda d: sorted((r.id, r.pais) for r in d.collect())
    assert rows(joins.apply_overrides(df, manual, "id", "pais")) == [(1, "y"), (2, "b"), (3, "c")]
    assert rows(joins.apply_overrides(df, manual, "id", "pais", [F.col("n")])) == [(1, "z"), (2, "b"), (3, "c")]
    assert one(spark, tx.first_object("t", "struct<a:int>"), t="{roto}") in (None, (None,))


def test_clean_json(spark):
    assert one(spark, tx.clean_json("t"), t='{"a":\x01 1}\n') == '{"a": 1}'
    assert one(spark, tx.clean_json("t"), t=r'{\"a\": \"b\"}') == '{"a": "b"}'
    assert one(spark, tx.clean_json("t"), t="{a") is None
    assert one(spark, tx.clean_json("t"), t="   ") is None


def test_label_values(spark):
    got = [tuple(x) for x in one(spark, tx.label_values("t"), t="Presidente: | detalle: 1920: 1925 | suelto | : x")]
    assert got == [("Presidente:", ""), ("detalle", "1920: 1925"), ("suelto", ""), (": x", "")]


def test_kwic_takes_first_word_that_hits(spark):
    t = "a" * 60 + " embajador en Chile " + "b" * 60
    got = one(spark, tx.kwic("t", ["ministro", "embajador.*chile", "embajador"], 10), t=t)
    assert got == "a" * 9 + " embajador en Chile "[:11].rstrip() + " en Chile "[:10]


def test_country_dictionary_defaults(spark):
    assert one(spark, rules.infer_country("t"), t="Nació en Valparaíso") == "chile"
    assert one(spark, rules.infer_country("t"), t="vivió en clima frío") == "peru"  # 'lima' inside a word
    assert one(spark, rules.infer_country("t", word=True), t="vivió en clima frío") is None
    assert one(spark, rules.infer_country("t", exclude=F.lit("chile")), t="de Santiago a Quito") == "ecuador"
    assert one(spark, rules.infer_country("t"), t=" ") is None


def test_nationality_tiers(spark):
    nat = rules.nationality("n", "l", ["b"])
    assert one(spark, nat, n="mexicana", l=None, b=None) == "México"   # name misses, demonym hits
    assert one(spark, nat, n="Chile", l="Lima", b=None) == "Chile"
    assert one(spark, nat, n=None, l="Cusco, Perú", b="chileno") == "Perú"
    assert one(spark, nat, n=None, l=None, b=None) == "Desconocido"
    assert one(spark, rules.nationality_pair("n", "l", ["b"]), n="chilena", l="Rosario", b=None) == "Chile"


def test_office_profile_defaults(spark):
    def prof(j, c, o):
        x = one(spark, rules.office_profile("j", "c", "o"), j=j, c=c, o=o)
        return x["cargo_tipo"], x["cargo_nivel"]

    assert prof(None, "Embajador y Ministro", None) == ("Embajador", "Nacional")
    assert prof('[{"label": "Embajador de X"}]', "Presidente", None) == ("Presidente", "Internacional")
    assert prof("roto", None, "diplomático") == ("Diplomático", "Internacional")
    assert prof(None, "regidor", "político") == ("Otro político", "Nacional")
    assert prof(None, "", None) == ("Sin cargo político", None)


def test_office_types_and_flags(spark):
    kind = shape.first_match("c", fixed.OFFICE_TYPES, "Otro")
    assert one(spark, kind, c="Ex Subsecretario y Senador") == "Senador"
    assert one(spark, kind, c="Vicepresidente y ministro") == "Presidente"
    assert one(spark, kind, c=None) == "Otro"
    df = spark.createDataFrame([("General y Alcalde",), (None,)], "c string")
    rows = shape.flag_bank(df, "c", fixed.OFFICE_FLAGS).collect()
    assert rows[0]["es_militar"] and rows[0]["es_alcalde"] and not rows[0]["es_senador"]
    assert not any(rows[1][f] for f in fixed.OFFICE_FLAGS)


def test_family_groups(spark):
    group = shape.first_match("c", fixed.FAMILY_GROUPS, "Otra")
    assert one(spark, group, c="Toronis") == "Otra"
    assert one(spark, group, c="Fermín Toro") == "Toro"
    assert one(spark, group, c="Vicente García-Huidobro") == "García-Huidobro"


def test_visibility_word_boundaries(spark):
    v = rules.visibility("n", "o")
    assert one(spark, v, n="Anaís Pérez", o="abogada")["categoria"] == fixed.VISIBILITY_LABELS[1]
    assert one(spark, v, n="Ana Pérez", o=None)["categoria"] == fixed.VISIBILITY_LABELS[0]
    x = one(spark, v, n="Rosa", o="esposa de X")
    assert x["solo_dependiente"] and not x["visibilidad_independiente"]
    y = one(spark, v, n="Rosa", o="esposa de X y escritora")
    assert not y["solo_dependiente"] and not y["visibilidad_independiente"]


def test_bands(spark):
    band = shape.bucket(F.col("y").try_cast("int"), *fixed.PERIOD_BANDS)
    assert [one(spark, band, y=y) for y in ("1972", "1973", "1989", "1990", None)] == [
        "Pre-1973", "Dictadura (1973-1990)", "Dictadura (1973-1990)", "Post-dictadura (1990+)", None]


def test_rank_ties_follow_the_key(spark):
    df = spark.createDataFrame([("p", "Pinto", 84), ("p", "Montt", 84), ("p", "Alessandri", 90)], "periodo string, s string, n long")
    got = rk.rank_in(df, ["periodo"], [F.desc("n"), F.col("s")]).orderBy("rank").collect()
    assert [r["s"] for r in got] == ["Alessandri", "Montt", "Pinto"]


def test_persistence_value(spark):
    df = spark.createDataFrame([(5, 29)], "g long, t long")
    assert df.select(tx.persistence("g", "t")).first()[0] == pytest.approx(17.00599, abs=1e-5)


def test_full_zero(spark):
    a = spark.createDataFrame([("México", 2), ("Chile", 1)], "p string, s long")
    b = spark.createDataFrame([("Chile", 4)], "p string, e long")
    got = {r["p"]: (r["s"], r["e"], r["total"]) for r in joins.full_zero(a, b, ["p"]).collect()}
    assert got == {"México": (2, 0, 2), "Chile": (1, 4, 5)}


def test_shorten(spark):
    assert one(spark, tx.shorten("t"), t="a" * 22) == "a" * 22
    assert one(spark, tx.shorten("t"), t="b" * 23) == "b" * 19 + "..."
    assert one(spark, tx.sentence_case("t"), t="ÉCUADOR") == "Écuador"


def test_curated_edges_by_default_rules(spark):
    p = spark.createDataFrame([(3, "Cornelio Saavedra"), (1, "Saturnina de Otálora"), (2, "Otro")], "person_id long, nombre string")
    e = spark.createDataFrame([(8, 9, "hijos")], "src long, dst long, relation_type string")
    got = sets.add_curated_edges(e, p, fixed.CURATED_EDGES).collect()
    assert sorted(map(tuple, got)) == [(3, 1, "conyuge"), (8, 9, "hijos")]


def test_curated_edge_keeps_base_row(spark):
    base = spark.createDataFrame([("a", "1")], "url string, n string")
    extra = spark.createDataFrame([("a", "2", "x"), ("b", "3", "y")], "url string, n string, z string")
    got = sets.append_keep_base(base, extra, "url", ["n"]).orderBy("url").collect()
    assert [(r["url"], r["n"], r["z"]) for r in got] == [("a", "1", None), ("b", "3", "y")]


def test_merge_attributes_defaults(spark):
    answer = '{"cargo_1": "Alcalde", "nacimiento_ano": 1901, "hijos_lista": ["a", "b"], "partido_limpio": null}'
    df = spark.createDataFrame([(answer, "viejo")], "r string, partido_limpio string")
    x = rules.merge_attributes(df, "r").first()
    assert (x["cargo_1"], x["nacimiento_ano"], x["hijos_lista"], x["partido_limpio"], x["cargo_2"]) == ("Alcalde", 1901, "a | b", "viejo", None)


def test_ordinals_have_no_width(spark):
    df = spark.createDataFrame([(1, i) for i in range(12)], "id long, v long")
    got = agg.widen_ordinal(df, "id", "v", "familiar", [F.col("v")]).collect()
    assert {r["ordinal"]: r["valor"] for r in got} == {f"familiar{i + 1}": i for i in range(12)}


def test_html_in_any_spelling(spark):
    page = ("<H1>Mar&iacute;a N&#250;&ntilde;ez &amp;lt; &#x41;&#128161; &#0;</H1><TABLE><TR><TH>C&oacute;nyuge</TH ><TD><A HREF = '/wiki/Ana'>"
            "&Aacute;na</A></TD></TR></TABLE><P>&iquest;Qu&eacute;?</P>")
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [(r["label"], r["value"]) for r in html.html_pairs(df).collect()] == [("Cónyuge", "Ána")]
    assert [(r["href"], r["text"]) for r in html.html_links(df).collect()] == [("/wiki/Ana", "Ána")]
    t = html.html_text(df).first()
    assert (t["title"].replace("\0", ""), t["text"]) == ("María Núñez &lt; A💡 ", "¿Qué?")


def test_own_country_in_a_slug_is_left_out(spark):
    df = spark.createDataFrame([("chile", "un chileno y argentino"), ("peru", "nació en perú"), ("argentina", "un chileno")], "pais string, t string")
    pats = {"Chile": ["chilen"], "Perú": ["perú"], "Argentina": ["argentin"]}
    got = {r["pais"]: (r["conecta_con"], r["contexto_conexion"]) for r in reports.bridge_persons(df, "t", pats, "pais", pats).collect()}
    assert got.keys() == {"chile", "argentina"}
    assert got["chile"][0] == "Argentina" and "argentin" in got["chile"][1]
    assert got["argentina"][0] == "Chile" and "chilen" in got["argentina"][1]
    same = spark.createDataFrame([("chile", "Chile"), ("peru", "Chile")], "a string, b string")
    assert [r["a"] for r in rules.special_cases(same, "a", "b").collect()] == ["peru"]


def test_line_breaks_survive_a_table(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\nb"), ("2", 'c "d"')], "x string, y string")
    assert tables.write_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_csv_table(spark, str(tmp_path / "t")).collect())) == [("1", "a\nb"), ("2", 'c "d"')]


def test_html_pairs_and_links(spark):
    page = ('<h1>Familia X</h1><table><tr><th>Cónyuge</th> <td><a href="/wiki/Ana" title="Ana">Ana &amp; Eva</a></td></tr>'
            '<tr><th class="c">Hijos</th><td><a href="/wiki/Familia_Y">Y</a>, <a href="https://x.org">web</a></td></tr></table><p>Uno[1].</p><p>Dos[23]</p>')
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [(r["label"], r["value"]) for r in html.html_pairs(df).collect()] == [("Cónyuge", "Ana & Eva"), ("Hijos", "Y, web")]
    assert [r["href"] for r in html.html_links(df).collect()] == ["/wiki/Ana"]
    t = html.html_text(df).first()
    assert (t["title"], t["text"]) == ("Familia X", "Uno.\nDos")


def test_partitioned_read_unites_different_headers(spark, tmp_path):
    for pais, header, row in (("chile", "url;nombre", 'u1;"A; ""b""\nc"'), ("peru", "nombre;url;pais", "D;u2;"), ("cuba", "nombre;url;pais", "E;u3;otro")):
        (tmp_path / pais).mkdir()
        (tmp_path / pais / "consolidado.csv").write_text(f"{header}\n{row}\n", encoding="utf-8")
    got = tables.read_partitioned(spark, f"{tmp_path}/*/consolidado.csv", r"/([^/]+)/consolidado\.csv", multi_line=True)
    rows = sorted((r["url"], r["nombre"], r["pais"]) for r in got.collect())
    assert rows == [("u1", 'A; "b"\nc', "chile"), ("u2", "D", "peru"), ("u3", "E", "otro")]
    forced = tables.read_partitioned(spark, f"{tmp_path}/*/consolidado.csv", r"/([^/]+)/consolidado\.csv", override=True, multi_line=True)
    assert sorted(r["pais"] for r in forced.collect()) == ["chile", "cuba", "peru"]


def test_line_breaks_are_declared(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"dos ""2"""\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('x;y\n1;"dos\ntres"\n', encoding="utf-8")
    assert tables.read_persons(spark, str(tmp_path / "a.csv")).first()["y"] == 'dos "2"'
    assert tables.read_persons(spark, str(tmp_path / "b.csv"), multi_line=True).first()["y"] == "dos\ntres"


def test_first_existing(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x;y\n1;2\n", encoding="utf-8")
    assert tables.read_first_existing(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_first_existing(spark, [str(tmp_path / "nada.csv")])


def test_empty_result_is_not_written(spark, tmp_path):
    df = spark.createDataFrame([], "a string")
    assert tables.write_table(df, str(tmp_path / "t")) is False
    assert not (tmp_path / "t").exists()


def test_reciprocal_keeps_known_way_back(spark):
    e = spark.createDataFrame([("a", "b", "padres"), ("b", "a", "otro"), ("a", "c", "padres")], "src string, dst string, relation_type string")
    got = {(r["src"], r["dst"], r["relation_type"]) for r in graph.reciprocal(e).filter("anadida").collect()}
    assert got == {("c", "a", "hijos")}


def test_checkpoint_folder_of_the_session_is_used(spark):
    from kinweave.session import shared_root
    first = shared_root(spark)
    assert first == shared_root(spark)

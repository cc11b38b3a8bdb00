"""The tag reader on pages that a pattern per element gets wrong, and against the parser of the standard library."""

import random
from html.parser import HTMLParser

from kinweave.sources import tags

SCHEMA = "page_id long, html string"


def pairs(spark, page):
    rows = tags.read_pairs(spark.createDataFrame([(1, page)], SCHEMA)).orderBy("pos").collect()
    return [(r["label"], r["value"]) for r in rows]


def test_nested_tables_keep_all_text(spark):
    page = "<table><tr><th>Padres</th><td>uno <table><tr><th>x</th><td>y</td></tr></table> dos</td></tr><tr><th>Hijos<td>tres</table>"
    assert pairs(spark, page) == [("Padres", "uno xy dos"), ("x", "y"), ("Hijos", "tres")]


def test_label_and_value_must_meet(spark):
    assert pairs(spark, "<table><tr><th>a</th></tr><tr><td>b</td></tr></table>") == []
    assert pairs(spark, "<table><tr><th>a</th> und <td>b</td></tr></table>") == []
    assert pairs(spark, "<TABLE><TR><TH a='>'>a</TH>\n<!-- <td>z</td> --><TD>b<p>c</p></TD></TR></TABLE>") == [("a", "bc")]


def test_links_outside_comments_and_scripts(spark):
    page = """<!-- <a href="/wiki/no">no</a> --><script>var s = '<a href="/wiki/no">no</a>';</script><style>a > b {}</style>
      <a title="x > y href='/wiki/no'" HREF='/wiki/si'>s&iacute;</a><a name="z">ancla</a><a href=/wiki/dos><b>dos</b><a href="/wiki/tres">tres"""
    rows = tags.read_links(spark.createDataFrame([(1, page)], SCHEMA)).orderBy("pos").collect()
    assert [(r["pos"], r["href"], r["text"]) for r in rows] == [(0, "/wiki/si", "sí"), (1, "/wiki/dos", "dos"), (2, "/wiki/tres", "tres")]


def test_text_with_paragraphs_left_open(spark):
    page = "<h1>Tí<i>tulo</i></h1><article><p>uno[1]<br><p>dos &lt;b&gt;<table><tr><td><p>tres</td></tr></table>fuera</article><script><p>no</p></script>"
    row = tags.read_text(spark.createDataFrame([(1, page)], SCHEMA)).first()
    assert (row["title"], row["text"]) == ("Título", "uno\ndos <b>\ntres")


def test_null_empty_repeated_and_broken_pages(spark):
    rows = [(1, None), (2, ""), (3, "<"), (4, '<p title="x>y</p>'), (5, "</table></table><table><tr><th>a<td>b"), (5, "</table><table><tr><th>a<td>b")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in tags.read_pairs(df).collect()] == [(5, 0, 1, "a", "b")] * 2
    assert tags.read_links(df).count() == 0
    assert sorted((r["page_id"], r["title"], r["text"]) for r in tags.read_text(df).collect()) == [(i, None, "") for i in (1, 2, 3, 4, 5, 5)]
    assert tags.read_pairs(df.limit(0)).count() == 0


class Cells(HTMLParser):
    """Pairs with a stack of open tables, each with its finished and its open cells."""

    def __init__(self):
        super().__init__()
        self.tables, self.out, self.cells = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag in ("tr", "th", "td") and self.tables:
            here = self.tables[-1]
            if here:
                here[-1][2] = False
            cell = [tag, "", True]
            here.append(cell)
            self.cells.append(cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.tables:
            here = self.tables.pop()
            self.out += [(a[1].strip(" "), b[1].strip(" ")) for a, b in zip(here, here[1:]) if (a[0], b[0]) == ("th", "td")]
        elif tag in ("th", "td", "tr") and self.tables and self.tables[-1]:
            self.tables[-1][-1][2] = False

    def handle_data(self, data):
        for table in self.tables:
            if table and table[-1][2]:
                table[-1][1] += data


def _table(rnd, depth):
    def cell():
        inner = _table(rnd, depth - 1) if depth and rnd.random() < 0.4 else rnd.choice(["", "<b>n</b>", '<i title="</td>">i</i>', "<!-- <td> -->"])
        return rnd.choice("abc") + inner + rnd.choice(["", " f", "&amp;"])

    def row():
        return "<tr>" + "".join(f"<{t}>{cell()}" + rnd.choice([f"</{t}>", ""]) for t in rnd.choices(["th", "td"], k=rnd.randint(0, 4))) + rnd.choice(["</tr>", ""])

    return "<table>" + "".join(row() for _ in range(rnd.randint(0, 3))) + "</table>"


def test_random_tables_as_the_standard_parser_sees_them(spark):
    rnd = random.Random(11)
    pages = [(i, "x" + _table(rnd, 3) + "y" + _table(rnd, 2)) for i in range(150)]
    want = []
    for i, page in pages:
        parser = Cells()
        parser.feed(page)
        parser.close()
        want += [(i, *pair) for pair in parser.out]
    got = tags.read_pairs(spark.createDataFrame(pages, SCHEMA)).collect()
    assert sorted((r["page_id"], r["label"], r["value"]) for r in got) == sorted(want) and len(want) > 100

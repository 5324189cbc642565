import pytest
from fixtures import package
from pyspark.sql import functions as F

from foliospark.operators import edits as E
from foliospark.operators import nodes as N
from foliospark.operators import validate as V
from foliospark.sources import packages as P

COLUMNS = ("part", "pre", "end", "parent", "depth", "nth", "paragraph", "local", "text", "tail", "section_index")


@pytest.fixture(scope="module")
def doc(spark):
    found = P.parts(P.entries(spark.createDataFrame([("a", package())], "doc string, content binary"))).cache()
    return found, P.nodes(found).where("pre is not null").cache()


def rows(nodes):
    return sorted((tuple(r[c] for c in COLUMNS) + (tuple(r.ancestors),) for r in nodes.collect()), key=str)


def reparsed(found, nodes):
    """The edited nodes, written as XML and parsed again."""
    xml = P.serialize(nodes).withColumnRenamed("content", "new")
    parts = found.join(xml, ["doc", "path"], "left").withColumn("content", F.coalesce("new", "content")).drop("new")
    return parts, P.nodes(parts).where("pre is not null")


def texts(nodes, section=0):
    return [r.text for r in N.paragraph_text(nodes).where(F.col("section_index") == section).orderBy("paragraph").collect()]


def test_renumber_is_identity(doc):
    assert rows(E.rewrite(doc[1], lambda r: r)) == rows(doc[1])


def test_insert_and_append(doc):
    found, nodes = doc
    new = E.append_paragraph(E.insert_paragraph(nodes, 0, 1, "in & between"), 0, "at the end").cache()
    want = texts(nodes)
    assert texts(new) == [want[0], "in & between", *want[1:], "at the end"] and texts(new, 10) == texts(nodes, 10)
    parts, again = reparsed(found, new)
    assert rows(again) == rows(new)
    assert V.validate(parts, again, "strict").count() == 0
    assert texts(E.insert_paragraph(nodes, 0, -1, "last but one"))[-2] == "last but one"


def test_delete_move_copy(doc):
    _, nodes = doc
    want = texts(nodes)
    assert texts(E.delete_paragraph(nodes, 0, 2)) == want[:2] + want[3:]
    assert texts(E.move_paragraph(nodes, 0, 0, 3)) == [want[1], want[2], want[0], *want[3:]]
    assert texts(E.copy_paragraph(nodes, 0, 1, 0)) == [want[1], *want]
    only = E.delete_paragraph(E.delete_paragraph(nodes, 10, 0), 10, 0)
    assert texts(only, 10) == ["Second & last"]


def test_replace(doc):
    _, nodes = doc
    assert E.count_replacements(nodes, "e").first().n == 5
    assert E.replace_text(nodes, "e", "E", 2).where("text like '%E%'").count() == 2
    got = texts(E.replace_text(nodes, "e", "EE", 3))
    assert got[0] == "TitlEE" and got[3] == "hEErEE" and got[4] == "endx"
    assert texts(E.replace_text(nodes, "e", ""))[3] == "hr"


def test_styles_controls_and_parts(doc):
    found, nodes = doc
    styled = E.apply_style(nodes, contains="here", styleIDRef="9")
    assert [r.paragraph for r in styled.where("attrs['styleIDRef'] = '9'").collect()] == [3]
    assert rows(E.apply_style(nodes, styleIDRef="9")) == rows(nodes)
    bare = E.delete_controls(nodes, "tbl")
    assert N.select(bare, "tables").count() == 0 and texts(bare)[1] == ""
    more = E.append_control(nodes, 0, E.control_xml("bookmark", name='a "b"'))
    assert sorted(r.attrs["name"] for r in N.select(more, "bookmarks").collect()) == ['a "b"', "mark"]
    more = E.append_control(nodes, 0, E.table_xml([["1", "2"], ["3", "4"]]))
    assert sorted(map(str, (r.rows for r in N.table_matrices(more).collect()))) == ["[['1', '2'], ['3', '4']]", "[['a', 'b'], ['last', '']]"]
    for kind in E.CONTROLS:
        values = dict(name="n", id="50", type="rect" if kind == "shape" else "edit", url="u", paragraph=E.paragraph_xml("q"), num="1", script="s", item="pic1", text="t", part="Chart/chart1.xml")
        E.fragment(E.control_xml(kind, **values))
    with pytest.raises(ValueError):
        E.fragment("<hp:a/><hp:b/>")
    parts = E.put_part(E.put_part(found, "Scripts/x.js", b"1"), "mimetype", b"other")
    got = {r.path: (r.entry_ord, r.kind) for r in parts.collect()}
    assert got["Scripts/x.js"] == (9, "script") and got["mimetype"] == (0, "mimetype") and E.remove_part(parts, "mimetype").count() == len(got) - 1


def test_repair_layout(spark):
    from fixtures import p, parts, t
    from test_packages import S0, sec

    body = p(t("abc")).replace("</hp:p>", '<hp:linesegarray><hp:lineseg textpos="0"/><hp:lineseg textpos="9"/></hp:linesegarray></hp:p>') + p(t("fine")).replace("</hp:p>", '<hp:linesegarray><hp:lineseg textpos="0"/></hp:linesegarray></hp:p>')
    found = P.parts(P.entries(spark.createDataFrame([("a", package(parts(**{S0: sec(body)})))], "doc string, content binary"))).cache()
    nodes = P.nodes(found).where("pre is not null").cache()
    fixed = E.repair_layout(found, nodes)
    assert fixed.where("local = 'linesegarray'").count() == 1 and V.paragraph_layout_cache(found, fixed).count() == 0

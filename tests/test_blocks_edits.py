import random

import fixtures
import pytest
from pyspark.sql import functions as F

from foliospark.functions import numbers, text
from foliospark.operators import blocks as K
from foliospark.operators import convert, edits
from foliospark.operators import nodes as N
from foliospark.operators import relational as R
from foliospark.operators import validate as V
from foliospark.sources import packages as P


@pytest.fixture(scope="module")
def nodes(spark):
    files = spark.createDataFrame([("a", fixtures.package()), ("b", fixtures.package())], "doc string, content binary")
    return P.nodes(P.parts(P.entries(files))).cache()


def texts(nodes, section=0, doc="a"):
    rows = N.paragraph_text(nodes).where((F.col("doc") == doc) & (F.col("section_index") == section)).orderBy("paragraph").collect()
    return [r.text for r in rows]


def test_paragraph_edits(nodes):
    before = texts(nodes)
    got = texts(edits.set_paragraph_text(nodes, 0, 2, "new & <own>"))
    assert got == [*before[:2], "new & <own>", *before[3:]]
    # Controls of the paragraph stay.
    ctrl = lambda df: df.where("doc = 'a' and paragraph = 2 and local = 'fieldBegin'").count()
    assert ctrl(edits.set_paragraph_text(nodes, 0, 2, "x")) == ctrl(nodes) == 1
    assert texts(edits.replace_paragraph_xml(nodes, 0, 1, edits.paragraph_xml("flat")))[1] == "flat"
    assert texts(edits.append_run_xml(nodes, 0, -1, '<hp:run charPrIDRef="0"><hp:t>tail</hp:t></hp:run>'))[-1] == before[-1] + "tail"
    assert texts(edits.set_paragraph_text(nodes, 0, 99, "x")) == before


def test_control_edits(nodes):
    where = lambda df, tag: [(r.doc, r.paragraph) for r in df.where((F.col("local") == tag) & F.col("section_index").isNotNull()).orderBy("doc", "section_index", "pre").collect()]
    marks = where(nodes, "bookmark")
    moved = edits.move_control(nodes, 0, 3, 0, 0, 0)
    assert where(moved, "bookmark") == [(d, 0) for d, _ in marks]
    assert len(where(edits.copy_control(nodes, 0, 3, 0, 0, 0), "bookmark")) == 2 * len(marks)
    assert where(edits.delete_control(nodes, 0, 3, 0), "bookmark") == []
    added = edits.insert_control_xml_at(nodes, 0, 1, 0, '<hp:ctrl><hp:bookmark name="z"/></hp:ctrl>')
    assert where(added, "bookmark") == [("a", 1), ("a", 3), ("b", 1), ("b", 3)]
    tags = [r.local for r in added.where("doc = 'a' and paragraph = 1 and local in ('bookmark', 'tbl')").orderBy("pre").collect()]
    assert tags == ["bookmark", "tbl"]


def test_sections_metadata_definitions(spark, nodes):
    more = edits.add_section(nodes, 10)
    parts = P.parts(P.entries(P.assemble(P.serialize(more).select("doc", F.lit(0).alias("entry_ord"), "path", "content"))))
    again = P.nodes(parts).cache()
    assert sorted({r.section_index for r in again.where("section_index is not null").collect()}) == [0, 10, 11]
    assert texts(again, 11) == texts(nodes, 10)
    assert {r.attrs["secCnt"] for r in again.where("part = 'Contents/header.xml' and depth = 0").collect()} == {"3"}
    kinds = {r.kind for r in V.validate(parts, again, "basic").collect()}
    assert not kinds & {"spine_itemref", "header_section_count", "manifest_item"}
    fewer = edits.remove_section(again, 0)
    assert {r.path for r in N.manifest(fewer).collect()} & {"Contents/section0.xml"} == set()
    assert {r.attrs["secCnt"] for r in fewer.where("part = 'Contents/header.xml' and depth = 0").collect()} == {"2"}
    only = edits.remove_section(edits.remove_section(fewer, 10), 11)
    assert only.where("section_index is not null").count() > 0
    got = N.metadata(edits.set_metadata(nodes, title="T", creator="C", keyword="k")).where("doc = 'a'").first()
    assert (got.title, got.creator, got.keyword, got.language) == ("T", "B", "k", "ko") or (got.title, got.keyword) == ("T", "k")
    with pytest.raises(ValueError):
        edits.set_metadata(nodes, colour="x")
    styled = edits.append_definition(edits.append_definition(nodes, "style", "styles", name="New"), "memoPr", "memoProperties")
    assert [r.attrs["id"] for r in N.select(styled, "styles").where("doc = 'a'").orderBy("ord").collect()] == ["0", "1"]
    assert styled.where("local = 'memoProperties' and doc = 'a'").first().attrs["itemCnt"] == "2"
    parts = edits.set_preview_text(P.parts(P.entries(spark.createDataFrame([("a", fixtures.package())], "doc string, content binary"))), "seen")
    assert parts.where("path = 'Preview/PrvText.txt'").first().kind == "preview_text"


def test_append_blocks_by_name(nodes):
    out = edits.append_block(nodes, "Text", text="words")
    for kind, values in (("eq", {"script": "a"}), ("image", {"item": "pic1"}), ("comment", {"text": "m"}), ("link", {"url": "u"}), ("tbl", {"rows": [["1", "2"]]}), ("note", {"text": "n", "which": "endNote"}), ("shape", {"type": "line"})):
        out = edits.append_block(out, kind, **values)
    out = edits.append_inline(out, "bookmark", name="q")
    got = N.blocks(out).where("doc = 'a' and section_index = 0").orderBy("ord").collect()
    kinds = [r.kind for r in got if r.kind != "paragraph"][-8:]
    assert kinds == ["equation", "picture", "memo", "hyperlink", "table", "note", "shape", "bookmark"]
    with pytest.raises(ValueError):
        edits.append_block(nodes, "nonsense")


def test_block_appends_round_trip(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc string, who string")
    d = K.Draft(docs)
    d.append_paragraph(F.concat(F.lit("by "), "who")).append_table(2, 2, [["1"], ["2", "3"]])
    for kind in ("picture", "chart", "ole", "shape", "form"):
        d.append(kind)
    d.append("equation", "x+y").append_hyperlink("http://x", "shown").append_bookmark("m")
    d.append_mail_merge_field("m").append_calculation_field("a+b").append_cross_reference("m").append_doc_property_field("p").append_date_field()
    d.append_endnote("e").append_footnote("f").append("auto_number").append("footer", "below").append("header", "above").append("memo", "hm")
    d.append_paragraph("last", section=d.append_section())
    for kind in K.DEFINITIONS:
        d.define(kind, name="n").define(kind, name="o")
    b = d.blocks().cache()
    ids = b.where("section_index = -1 and doc = 'a'").groupBy("kind").agg(F.sort_array(F.collect_list(F.col("attrs")["id"])).alias("ids")).collect()
    assert len(ids) == 6 and all(r.ids == ["0", "1"] for r in ids)
    own = [r.kind for r in b.where("doc = 'b' and section_index = 0").orderBy("ord").collect()]
    assert own == ["paragraph", "table", "picture", "chart", "ole", "shape", "form", "equation", "hyperlink", "bookmark", "field", "field", "field", "field", "field", "note", "note", "auto_number", "footer", "header", "memo"]
    again = P.nodes(P.parts(P.entries(convert.to_packages(b)))).cache()
    got = [r.kind for r in N.blocks(again).where("doc = 'b' and section_index = 0").orderBy("ord").collect() if r.kind != "paragraph"]
    assert got == [k for k in own if k != "paragraph"]
    assert texts(again, 0, "b")[0] == "by y" and texts(again, 1, "b") == ["", "last"]
    assert N.table_matrices(again).where("doc = 'a'").first().rows == [["1", ""], ["2", "3"]]
    more = K.Draft(docs, b)
    more.append_paragraph("after").define("style").append_paragraph("new", section=more.append_section())
    grown = more.blocks().where("doc = 'a'").cache()
    assert grown.count() == b.where("doc = 'a'").count() + 4
    assert [(r.section_index, r.ord, r.text) for r in grown.where("kind = 'paragraph'").orderBy("section_index", "ord").collect()] == [(0, 0, "by x"), (0, 21, "after"), (1, 0, ""), (1, 1, "last"), (2, 0, ""), (2, 1, "new")]
    assert grown.where("kind = 'style'").agg(F.max(F.col("attrs")["id"])).first()[0] == "2"
    with pytest.raises(ValueError):
        d.append("nonsense")


def brute_pairs(left, right):
    unused, out = list(range(len(right))), []
    for i, k in enumerate(left):
        j = next((u for u in unused if k and right[u] == k), unused[0] if unused else None)
        if j is not None:
            unused.remove(j)
        out.append((i, j))
    return out + [(None, j) for j in unused]


def test_ordered_merges(spark):
    rnd = random.Random(3)
    left = {g: [rnd.choice(["a", "b", "", "c"]) for _ in range(rnd.randint(0, 12))] for g in range(30)}
    right = {g: [rnd.choice(["a", "b", "", "d"]) for _ in range(rnd.randint(0, 12))] for g in range(30)}
    frame = lambda x: spark.createDataFrame([(g, i, k) for g, ks in x.items() for i, k in enumerate(ks)], "g int, o long, k string")
    got = {}
    for r in R.pair_by_key(frame(left), frame(right), ["g"], "o", "k").collect():
        got.setdefault(r.g, set()).add((r.left_o, r.right_o))
    assert got == {g: set(p) for g in left if (p := brute_pairs(left[g], right[g]))}
    matched = {}
    for r in R.forward_matches(frame(left), frame(right), ["g"], "o", "k").collect():
        matched.setdefault(r.g, {})[r.token_o] = r.item_o
    for g, ks in left.items():
        at = 0
        for i, k in enumerate(ks):
            j = next((j for j in range(at, len(right[g])) if right[g][j] == k), None)
            assert matched[g][i] == j
            at = at if j is None else j + 1
    marks = {g: [rnd.choice("()xx") for _ in range(15)] for g in range(20)}
    kept = {}
    for r in R.outside_open_fields(frame(marks), ["g"], "o", F.col("k") == "(", F.col("k") == ")").collect():
        kept.setdefault(r.g, set()).add(r.o)
    for g, ks in marks.items():
        depth, want = 0, set()
        for i, k in enumerate(ks):
            if depth == 0 or (depth == 1 and k == ")"):
                want.add(i)
            depth = max(0, depth + (k == "(") - (k == ")"))
        assert kept.get(g, set()) == want


def test_small_functions(spark):
    row = spark.createDataFrame([("'My ''own'' sheet'!$A$1", "plain!B2", "none", 27, 5)], "a string, b string, c string, i int, n int")
    got = row.select(numbers.sheet_anchor(F.col("a")), numbers.sheet_anchor(F.col("b")), numbers.sheet_anchor(F.col("c")), numbers.a1_range(F.lit("it's"), F.col("i"), F.col("n")), numbers.rescaled(F.lit(5), F.lit(10), F.lit(25)), numbers.rescaled(F.lit(5), F.lit(0), F.lit(25))).first()
    assert tuple(got) == ("My 'own' sheet", "plain", None, "'it''s'!$AB$2:$AB$6", 12, 5)
    maps = spark.sql("select map('p.a', '1', 'p.b', null, 'q', '2') as m, 'pre{\"x\": 1}' as c, '{\"k\": {\"b\": 2, \"a\": 1}, \"s\": \"t\"}' as j")
    got = maps.select(text.normal_map(F.col("m")), text.sub_map(F.col("m"), "p."), text.carried_json(F.col("c"), "pre", "map<string,int>"), text.carried_json(F.col("c"), "no", "map<string,int>"), text.flat_paths(F.col("j")), text.filled_json(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")))).first()
    assert got[0] == {"p.a": "1", "q": "2"} and got[1] == {"a": "1", "b": None} and got[2] == {"x": 1} and got[3] is None
    assert [tuple(x) for x in got[4]] == [("k.a", "1"), ("k.b", "2"), ("s", "t")] and got[5] == '{"a":1}'
    with pytest.raises(ValueError):
        text.same_length_replace(F.lit("x"), "a", "bc")
    base = spark.createDataFrame([(1, i, v) for i, v in enumerate("abcde")] + [(2, 0, "x")], "g int, o int, v string")
    other = spark.createDataFrame([(1, i, v) for i, v in enumerate("zcde")] + [(3, 0, "x")], "g int, o int, v string")
    assert [tuple(r) for r in R.common_suffix(base, other, ["g"], "o", ["v"]).collect()] == [(1, 3)]
    cells = spark.createDataFrame([(1, 0, 2), (1, 2, 9), (1, 9, 1)], "g int, c int, s int")
    sizes = spark.createDataFrame([(1, i, 10 * (i + 1)) for i in range(4)], "g int, i int, w int")
    assert {r.c: r.extent for r in R.span_extents(cells, sizes, ["g"], "c", "s", "i", "w").collect()} == {0: 30, 2: 70, 9: 0}

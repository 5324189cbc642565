import base64
import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import convert
from foliospark.operators.blocks import Draft
from foliospark.sources import binary as B
from foliospark.sources import encoders as E
from foliospark.sources import payloads as D

SHAPES = list(E.SHAPES)


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    docs = spark.createDataFrame([("a",), ("b",)], "doc string")
    d = Draft(docs).append_paragraph("first \U0001f600 & more").append_table(2, 3, [["r0", "x", "y"], ["", "가"]]).append_hyperlink("https://x.org/a:b", "shown").append_bookmark("mark")
    d.append_mail_merge_field("who", shown="W").append_calculation_field("1+2", shown="3").append_cross_reference("mark", shown="see").append_doc_property_field("author", shown="A").append_date_field(shown="today")
    d.append_footnote("foot").append_endnote("end").append("form", "label", name="n;=1", value="v", checked=True).append("memo", "remark", author="me").append("chart", "title", categories=json.dumps(["a", "b"]))
    d.append("auto_number", num=7).append("auto_number", which="autoNum").append("header", "top", applyPageType="ODD").append("footer", "").append("equation", "a over b", description="about")
    for s in SHAPES:
        d.append("shape", "in it", which=s, width=1000, height=401, line_color="#0000FF")
    d.append("picture", data=base64.b64encode(b"PNG1").decode(), extension="png").append("ole", data=base64.b64encode(b"OLE").decode()).append("picture")
    index = d.append_section()
    d.append_paragraph("second section", section=index).append_paragraph(None, section=index)
    d.define("style", name="Own").define("paragraph_style", alignment="CENTER").define("character_style", height=1400, bold=True).define("numbering", start=3).define("bullet", char="-").define("memo_shape", width=9)
    path = str(tmp_path_factory.mktemp("blocks") / "t")
    d.blocks().write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def read(spark, blocks, tmp_path_factory):
    out = {}
    path = tmp_path_factory.mktemp("read")
    convert.to_binary(blocks).write.parquet(str(path / "files"))
    out["files"] = spark.read.parquet(str(path / "files"))
    for name, make in (("streams", lambda: B.streams(out["files"])), ("records", lambda: B.records(out["streams"])), ("blocks", lambda: convert.binary_blocks(out["records"]))):
        make().write.parquet(str(path / name))
        out[name] = spark.read.parquet(str(path / name))
    return out


def of(df, kind):
    return [r for r in df.where(F.col("doc") == "a").where(F.col("kind") == kind).orderBy("section_index", "ord").collect()]


def test_all_kinds_come_back(blocks, read):
    cut = lambda df: [(r.section_index, r.kind) for r in df.where("doc = 'b' and section_index >= 0").orderBy("section_index", "ord").collect()]
    want, got = cut(blocks), cut(read["blocks"])
    # A link's or field's shown text is its paragraph's text.
    assert [x for x in got if x[1] != "paragraph"] == [x for x in want if x[1] != "paragraph"]
    assert [r.text for r in of(read["blocks"], "paragraph") if r.text] == ["first \U0001f600 & more", "shown", "W", "3", "see", "A", "today", "second section"]
    (table,) = of(read["blocks"], "table")
    assert json.loads(table.text) == [["r0", "x", "y"], ["", "가", ""]] and (table.attrs["rowCnt"], table.attrs["colCnt"]) == ("2", "3")
    assert [r.attrs["url"] for r in of(read["blocks"], "hyperlink")] == ["https://x.org/a:b"]
    assert [r.attrs["name"] for r in of(read["blocks"], "bookmark")] == ["mark"]
    fields = [(r.attrs["type"], {k: v for k, v in r.attrs.items() if k != "type"}) for r in of(read["blocks"], "field")]
    assert fields == [("%mai", {"name": "who"}), ("%for", {"expression": "1+2"}), ("%cro", {"bookmark": "mark"}), ("%doc", {"name": "author"}), ("%dat", {})]
    assert [(r.text, r.attrs["which"]) for r in of(read["blocks"], "note")] == [("foot", "footNote"), ("end", "endNote")]
    (form,) = of(read["blocks"], "form")
    assert form.text == "label" and (form.attrs["name"], form.attrs["value"], form.attrs["checked"], form.attrs["type"]) == ("n;=1", "v", "True", "INPUT")
    (memo,) = of(read["blocks"], "memo")
    assert memo.text == "remark" and memo.attrs["author"] == "me"
    (chart,) = of(read["blocks"], "chart")
    assert chart.text == "title" and json.loads(chart.attrs["categories"]) == ["a", "b"] and chart.attrs["chartType"] == "BAR"
    assert [(r.attrs["which"], r.attrs.get("num")) for r in of(read["blocks"], "auto_number")] == [("newNum", "7"), ("autoNum", None)]
    assert [(r.text, r.attrs["applyPageType"]) for r in of(read["blocks"], "header") + of(read["blocks"], "footer")] == [("top", "ODD"), (None, "BOTH")]
    assert [r.text for r in of(read["blocks"], "equation")] == ["a over b"]
    assert [r.attrs["which"] for r in of(read["blocks"], "shape")] == SHAPES


def test_second_trip_is_stable(spark, read, tmp_path):
    convert.binary_blocks(B.records(B.streams(convert.to_binary(read["blocks"])))).write.parquet(str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t"))
    cut = lambda df: [(r.doc, r.section_index, r.kind, r.text, r.attrs) for r in df.orderBy("doc", "section_index", "ord").collect()]
    assert cut(again) == cut(read["blocks"])


def test_new_numbers_of_any_size(spark, tmp_path):
    numbers = ["0", "65535", "65536", "100892", "2147483648", "-1", "007"]
    d = Draft(spark.createDataFrame([("a",)], "doc string"))
    for n in numbers:
        d.append("auto_number", num=n)
    d.append("auto_number")
    d.blocks().write.parquet(str(tmp_path / "blocks"))
    made = convert.to_binary(spark.read.parquet(str(tmp_path / "blocks")))
    found = convert.binary_blocks(B.records(B.streams(made))).where("kind = 'auto_number'").orderBy("ord").collect()
    assert [r.attrs for r in found] == [{"which": "newNum", "num": n} for n in [*numbers, "1"]]


def test_lint_and_data(read):
    assert [r for r in B.lint(read["streams"], read["records"]).collect()] == []
    data = {r.path: bytes(r.logical) for r in read["streams"].where("doc = 'a'").collect()}
    assert (data["BinData/BIN0001.png"], data["BinData/BIN0002.ole"]) == (b"PNG1", b"OLE")
    assert data["PrvText"].decode("utf-16-le") == "first \U0001f600 & more"
    counts = B.id_mappings(read["records"]).where("doc = 'a'").first().counts
    assert {k: v for k, v in counts.items() if v} == {"bin_data": 2, "char_shapes": 2, "numberings": 1, "bullets": 1, "para_shapes": 2, "styles": 2, "memo_shapes": 1}


def test_decoders_are_inverse(read):
    r = read["records"].where("doc = 'a'")
    line = D.decode(r, "line").orderBy("ord").first()
    assert (line.end.x, line.end.y, line.start.x) == (1000, 401, 0)
    ellipse = D.decode(r, "ellipse").first()
    assert (ellipse.center.x, ellipse.center.y, ellipse.axis1.x, ellipse.axis2.y) == (500, 200, 1000, 401)
    polygon = D.decode(r, "polygon").first()
    assert [(p.x, p.y) for p in polygon.points] == [(0, 0), (1000, 0), (1000, 401), (0, 401)]
    assert [t.text for t in D.decode(r, "textart").collect()] == ["in it"]
    shapes = D.decode(r, "shape_component").orderBy("ord").collect()
    own = [s for s in shapes if s.reference_bounds.width == 1000]
    assert len(own) == len(SHAPES) and {(s.reference_bounds.height, s.line_color, s.line_width, s.fill_color, s.center) for s in own} == {(401, "#0000FF", 33, "#FFFFFF", None)}
    assert sum(s.is_connect_line for s in own) == 1
    assert [p.crop for p in D.decode(r, "picture").collect()] == [None, None]
    about = D.decode_controls(B.controls(r), "equation").first()
    assert about.description == "about" and about.layout.treat_as_char
    assert [n.start_numbers for n in D.decode(r, "numbering").collect()] == [[3] * 7]
    assert [n.levels[0].format for n in D.decode(r, "numbering").collect()] == ["^1."]
    assert [b.bullet_char for b in D.decode(r, "bullet").collect()] == ["-"]
    assert [p.alignment for p in D.decode(r, "para_shape").orderBy("ord").collect()] == ["JUSTIFY", "CENTER"]
    assert [c.base_size for c in D.decode(r, "char_shape").orderBy("ord").collect()] == [1000, 1400]
    assert [m.width for m in D.decode(r, "memo_shape").collect()] == [9]
    assert [s.name for s in B.styles(r).orderBy("id").collect()] == ["Normal", "Own"]


def test_append_and_settings(spark, read):
    new = Draft(spark.createDataFrame([("a",)], "doc string")).append_footnote("late").append_paragraph("last").blocks()
    grown = E.append(read["records"], new)
    again = B.records(B.encode(grown))
    assert again.count() == read["records"].count() + 8
    texts = [p.text for p in B.paragraphs(again).where("doc = 'a' and section_index = 0").orderBy("paragraph").collect()]
    assert [t.strip() for t in texts[-3:]] == ["", "late", "last"]
    page = spark.createDataFrame([("a", "BodyText/Section0", 0, 0, B.TAGS["page_def"], 1, bytes(10), 10)], "doc string, stream string, section_index int, ord int, tag_id int, level int, payload binary, size long")
    got = D.decode(E.set_section(page, 0, page_width=59528, gutter=7), "page_def").first()
    assert (got.page_width, got.gutter, got.page_height) == (59528, 7, 0)
    assert D.decode(E.set_section(page, 1, page_width=1), "page_def").first().page_width == 0
    with pytest.raises(ValueError, match="unknown settings"):
        E.set_section(page, 0, depth=1)


def test_capacity_and_diffs(read):
    room = {r.path: r for r in B.capacities(read["streams"].where("doc = 'a'")).collect()}
    assert all(r.fits and r.capacity == r.needed for r in room.values())
    grown = read["streams"].withColumn("logical", F.when(F.col("path") == "PrvText", F.concat("logical", F.lit(b"more"))).otherwise(F.col("logical")))
    assert [r.path for r in B.capacities(grown).where("doc = 'a' and not fits").collect()] == ["PrvText"]
    a = B.audit(read["streams"], grown).where("doc = 'a'").first()
    assert (a.changed, a.added, a.removed, a.same) == (1, 0, 0, a.streams - 1)
    one, two = (B.layout(read["files"].where(F.col("doc") == d)) for d in "ab")
    assert B.layout_diff(one, two.withColumn("doc", F.lit("a"))).count() == 0 and B.layout_diff(one, two).count() == one.count() + two.count()
    x = read["records"].where("doc = 'a'")
    y = x.withColumn("payload", F.when(B.tag("ellipse"), F.lit(b"")).otherwise(F.col("payload")))
    assert B.subtree_diff(x, y).count() == 1 and B.subtree_diff(x, x).count() == 0

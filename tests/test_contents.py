import base64
import json

import pytest
from fixtures import p, package, parts, t
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import convert
from foliospark.operators import edits as E
from foliospark.operators import nodes as N
from foliospark.operators import validate as V
from foliospark.operators.contents import package_blocks
from foliospark.sources import binary as B
from foliospark.sources import packages as P

SPACES = " ".join(f'xmlns:{k}="{v}"' for k, v in P.NAMESPACES.items())
SCHEMA = "doc string, section_index int, paragraph int, ord int, kind string, text string, attrs map<string,string>"


def sub(*lines):
    return "<hp:subList>" + "".join(p(x) for x in lines) + "</hp:subList>"


def cell(r, c, inner):
    return f'<hp:tc>{sub(inner)}<hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc>'


INNER = f'<hp:tbl rowCnt="1" colCnt="1"><hp:tr>{cell(0, 0, t("deep"))}</hp:tr></hp:tbl>'
RECT = f'<hp:rect><hp:sz width="70" height="30"/><hp:lineShape color="#0000FF" width="5"/><hc:fillBrush><hc:winBrush faceColor="#FFFF00"/></hc:fillBrush><hp:drawText>{sub(t("in box"))}</hp:drawText></hp:rect>'
LINK = '<hp:ctrl><hp:fieldBegin id="5" fieldid="5" type="HYPERLINK" name=""><hp:parameters><hp:stringParam name="Command">http\\://x.org/a\\;b;1;0;</hp:stringParam></hp:parameters></hp:fieldBegin></hp:ctrl>'
FORMULA = '<hp:ctrl><hp:fieldBegin id="6" fieldid="6" type="%FOR" name="sum"><hp:parameters><hp:stringParam name="Expression">a;b=c</hp:stringParam></hp:parameters></hp:fieldBegin></hp:ctrl>'
SECTION = (
    p(t("one") + LINK + t("shown") + '<hp:ctrl><hp:fieldEnd beginIDRef="5"/></hp:ctrl>' + t(" two"))
    + p(f"<hp:ctrl><hp:footNote>{sub(t('first'), t(''), t('third') + INNER)}</hp:footNote></hp:ctrl>" + t("after"))
    + p(f'<hp:tbl rowCnt="1" colCnt="2"><hp:tr>{cell(0, 0, t("a") + RECT)}{cell(0, 1, t("b"))}</hp:tr></hp:tbl>')
    + p(RECT + FORMULA + t("3") + '<hp:ctrl><hp:fieldEnd beginIDRef="6"/></hp:ctrl>')
    + p('<hp:equation><hp:sz width="9"/><hp:script>x &lt; y</hp:script></hp:equation>' + '<hp:checkBtn name="c" value="1"><hp:text>tick</hp:text></hp:checkBtn>')
    + p('<hp:pic><hp:sz width="4" height="5"/><hc:img binaryItemIDRef="pic1"/></hp:pic>' + '<hp:switch><hp:case><hp:chart chartIDRef="c1"/></hp:case><hp:default><hp:ole binaryItemIDRef="pic1"/></hp:default></hp:switch>')
    + p(f'<hp:ctrl><hp:hiddenComment author="me">{sub(t("remark"))}</hp:hiddenComment></hp:ctrl>')
)
_ser = lambda name, values: f'<c:ser><c:tx><c:v>{name}</c:v></c:tx><c:cat><c:pt><c:v>x</c:v></c:pt><c:pt><c:v>y</c:v></c:pt></c:cat><c:val>{"".join(f"<c:pt><c:v>{v}</c:v></c:pt>" for v in values)}</c:val></c:ser>'
CHART = f'<c:chartSpace><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>Big </a:t></a:r><a:r><a:t>title</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:pie3DChart>{_ser("s", [1, 2.5])}{_ser("r", [3, 4])}</c:pie3DChart></c:plotArea></c:chart></c:chartSpace>'


def read(spark, tmp_path, files):
    out = []
    for i, make in enumerate((lambda: P.parts(P.entries(files)), lambda: P.nodes(out[0]))):
        make().write.parquet(str(tmp_path / f"t{i}"))
        out.append(spark.read.parquet(str(tmp_path / f"t{i}")))
    return out


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("contents")
    whole = lambda body: body.replace(">", f" {SPACES}>", 1).encode()
    files = spark.createDataFrame([("a", package(parts(**{"Contents/section0.xml": whole(f"<hs:sec>{SECTION}</hs:sec>"), "Chart/chart1.xml": whole(CHART)})))], "doc string, content binary")
    package_blocks(*read(spark, tmp, files)).write.parquet(str(tmp / "b"))
    return spark.read.parquet(str(tmp / "b"))


def test_contents_of_every_kind(found):
    rows = [(r.paragraph, r.kind, r.text, {k: v for k, v in r.attrs.items() if k not in ("width", "height")}) for r in found.where("section_index = 0").orderBy("ord").collect()]
    box = {"which": "rect", "line_color": "#0000FF", "line_width": "5", "fill_color": "#FFFF00"}
    picture = {"item": "pic1", "data": base64.b64encode(b"\x89PNG").decode(), "extension": "png"}
    series = json.dumps([{"name": "s", "values": ["1", "2.5"]}, {"name": "r", "values": ["3", "4"]}], separators=(",", ":"))
    assert rows == [
        (0, "paragraph", "one two", {}), (0, "hyperlink", "shown", {"url": "http://x.org/a;b"}),
        (1, "paragraph", "after", {}), (1, "note", "first\n\nthird", {"which": "footNote"}), (1, "table", '[["deep"]]', {"rowCnt": "1", "colCnt": "1", "inside": "footNote"}),
        (2, "paragraph", "", {}), (2, "table", '[["ain box","b"]]', {"rowCnt": "1", "colCnt": "2"}), (2, "shape", None, box | {"inside": "tc"}),
        (3, "paragraph", "", {}), (3, "shape", "in box", box), (3, "field", "3", {"type": "FORMULA", "name": "sum", "Expression": "a;b=c"}),
        (4, "paragraph", "", {}), (4, "equation", "x < y", {}), (4, "form", "tick", {"name": "c", "value": "1", "tag": "checkBtn", "form_type": "CHECKBOX"}),
        (5, "paragraph", "", {}), (5, "picture", None, picture), (5, "chart", "Big title", {"chart_type": "PIE", "categories": '["x","y"]', "series": series}),
        (6, "paragraph", "", {}), (6, "memo", "remark", {"author": "me"}),
    ]
    assert [r.attrs["width"] for r in found.where("kind = 'picture'").collect()] == ["4"]


def test_package_to_package_is_stable(spark, found, tmp_path):
    parts_, nodes = read(spark, tmp_path, convert.to_packages(found))
    assert V.validate(parts_, nodes, "reference").count() == 0
    # What stands in cells and notes comes back as their text; nested controls stand beside them.
    places = {0: 0, 10: 1, 1: 1}  # sections are numbered without gaps when they are written
    cut = lambda df: [(places[r.section_index], r.kind, r.text, {k: v for k, v in r.attrs.items() if k not in ("item", "inside", "width", "height")}) for r in df.where("attrs['inside'] is null").orderBy("section_index", "ord").collect()]
    again = package_blocks(parts_, nodes)
    want = [x for x in cut(found)]
    got = [x for x in cut(again) if x[:3] not in ((0, "table", '[["deep"]]'), (0, "shape", ""))]
    assert got == want


def test_all_reserved_characters(spark, tmp_path):
    """No character makes a part unreadable or cuts a name, in either format."""
    bad = "".join(map(chr, range(32))) + "￾￿"
    odd = f"a;b=c%3Bd\\e:f&<>\"'{{}}\t\n{bad}z"
    safe = T.markup_safe(odd)
    assert safe == "a;b=c%3Bd\\e:f&<>\"'{}\t\n\t\nz"
    kinds = [("paragraph", {}), ("hyperlink", {"url": odd}), ("bookmark", {"name": odd}), ("field", {"type": "MAILMERGE", "name": odd, "Other": odd}), ("form", {"name": odd}), ("memo", {"author": odd}), ("note", {"which": "endNote"}), ("equation", {}), ("chart", {"categories": json.dumps([odd])}), ("shape", {"which": "ellipse"}), ("table", {"rowCnt": "1", "colCnt": "1"})]
    rows = [("d", 0, i, i, k, json.dumps([[odd]]) if k == "table" else odd, a) for i, (k, a) in enumerate(kinds)]
    blocks = spark.createDataFrame(rows, SCHEMA)
    parts_, nodes = read(spark, tmp_path, convert.to_packages(blocks))
    assert nodes.where("error is not null").count() == 0
    out = {r.kind: r for r in package_blocks(parts_, nodes).where("kind <> 'paragraph' or text <> ''").collect()}
    assert len(out) == len(kinds)
    lines = safe  # paragraphs of notes are lines
    assert out["paragraph"].text == out["hyperlink"].text == out["field"].text == out["equation"].text == out["chart"].text == out["form"].text == safe and out["note"].text == out["memo"].text == out["shape"].text == lines
    assert out["hyperlink"].attrs["url"] == out["bookmark"].attrs["name"] == out["field"].attrs["name"] == out["field"].attrs["Other"] == out["form"].attrs["name"] == out["memo"].attrs["author"] == safe
    assert json.loads(out["chart"].attrs["categories"]) == [safe] and json.loads(out["table"].text) == [[safe]]
    # Binary documents: everything but NUL and the format's own control units can stand in names and data.
    name = "a;b=c%3Bd\\e:f&<>"
    rows = [("d", 0, i, i, k, "x", {"url": name} if k == "hyperlink" else {"name": name, "author": name, "type": "MAILMERGE", "k;=": name}) for i, k in enumerate(("hyperlink", "bookmark", "field", "form", "memo"))]
    convert.to_binary(spark.createDataFrame(rows, SCHEMA)).write.parquet(str(tmp_path / "f"))
    B.records(B.streams(spark.read.parquet(str(tmp_path / "f")))).write.parquet(str(tmp_path / "r"))
    native = {r.kind: r.attrs for r in convert.binary_blocks(spark.read.parquet(str(tmp_path / "r"))).collect()}
    assert native["hyperlink"]["url"] == native["bookmark"]["name"] == native["field"]["name"] == native["field"]["k;="] == native["form"]["name"] == native["memo"]["author"] == name


def test_edits_write_safe_markup(spark, tmp_path):
    nodes = read(spark, tmp_path, spark.createDataFrame([("a", package())], "doc string, content binary"))[1]
    bad = "x" + "".join(map(chr, range(32))) + "￾y"
    edited = E.set_paragraph_text(E.insert_paragraph(nodes, 0, 0, bad), 0, 1, bad)
    edited = E.set_attributes(edited, F.col("local") == "bookmark", name=bad)
    found = P.serialize(edited).select("doc", F.lit(0).alias("entry_ord"), "path", "content")
    again = P.nodes(P.parts(P.entries(P.assemble(found))))
    assert again.where("error is not null").count() == 0
    texts = [r.text for r in N.paragraph_text(again).where("section_index = 0 and paragraph < 2").orderBy("paragraph").collect()]
    assert texts == ["x\t\ny", "x\t\ny"]


def test_escapes_are_inverse(spark):
    odd = ["", "a", ";=%", "%3B", "%253B=;", "a=b;c"]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select("t", T.unreserved(T.reserved(F.col("t"))).alias("u"), T.noted(F.concat(F.lit("escaped=1;k="), T.reserved(F.col("t")))).alias("m"), T.noted(F.concat(F.lit("k="), "t")).alias("raw")).collect()
    assert all(r.u == r.t and r.m == {"k": r.t} for r in got)
    assert [r.raw for r in got if r.t == "%3B"] == [{"k": "%3B"}]  # without the mark nothing is decoded


def test_only_changed_parts_are_written(spark, tmp_path):
    """An edit elsewhere leaves a part's bytes alone; new parts come last, parts without nodes left go."""
    parts_, nodes = read(spark, tmp_path, spark.createDataFrame([("a", package()), ("b", package())], "doc string, content binary"))
    edited = E.set_attributes(nodes, (F.col("doc") == "a") & (F.col("local") == "bookmark"), name="other")
    out = {(r.doc, r.path): r for r in P.with_changed(parts_, nodes, edited).collect()}
    was = {(r.doc, r.path): bytes(r.content) for r in parts_.collect()}
    assert {k for k in was if bytes(out[k].content) != was[k]} == {("a", "Contents/section0.xml")} and set(out) == set(was)
    assert b'name="other"' in bytes(out["a", "Contents/section0.xml"].content)
    grown = nodes.where("part <> 'Chart/chart1.xml'").unionByName(nodes.where("part = 'Contents/section10.xml'").withColumn("part", F.lit("Contents/section11.xml")))
    out = {(r.doc, r.path): r for r in P.with_changed(parts_, nodes, grown).collect()}
    assert ("a", "Chart/chart1.xml") not in out and out["a", "Contents/section11.xml"].kind == "section"
    assert out["b", "Contents/section11.xml"].entry_ord == 1 + max(r.entry_ord for r in parts_.where("doc = 'b'").collect())

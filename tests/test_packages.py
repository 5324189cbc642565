import pytest
from fixtures import END, FIELD, HPF, SECTION0, TABLE, p, package, parts, t, xml

from foliospark.operators import nodes as N
from foliospark.operators import validate as V
from foliospark.sources import packages as P


def load(spark, **files):
    df = spark.createDataFrame([(k, v) for k, v in files.items()], "doc string, content binary")
    entries = P.entries(df)
    found = P.parts(entries).cache()
    return entries, found, P.nodes(found).cache()


@pytest.fixture(scope="module")
def good(spark):
    return load(spark, a=package())


def test_files_and_parts(spark, tmp_path, good):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.hwpx").write_bytes(package())
    (tmp_path / "y.bin").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"rest")
    (tmp_path / "z.hwp").write_bytes(b"?")
    (tmp_path / "w.txt").write_bytes(b"?")
    got = {r.doc.rsplit("/", 1)[1]: r.format for r in P.read_files(spark, str(tmp_path)).collect()}
    assert got == {"x.hwpx": "hwpx", "y.bin": "hwp", "z.hwp": "hwp", "w.txt": None}
    kinds = {r.path: r.kind for r in good[1].collect()}
    assert kinds["Contents/section10.xml"] == "section" and kinds["BinData/pic1.png"] == "bindata" and kinds["Chart/chart1.xml"] == "xml" and kinds["mimetype"] == "mimetype"
    assert [r.path for r in P.sections(good[1]).orderBy("section_index").collect()] == ["Contents/section0.xml", "Contents/section10.xml"]


def test_bad_files(spark):
    entries, found, nodes = load(spark, bad=b"PK\x03\x04 no zip", none=None, dup=package(extra=[("BinData/pic1.png", b"second")]))
    assert {r.doc for r in entries.where("error is not null").collect()} == {"bad", "none"}
    dup = found.where("path = 'BinData/pic1.png'").collect()
    assert len(dup) == 1 and bytes(dup[0].content) == b"second" and dup[0].copies == 2 and dup[0].entry_ord == 7


def test_tree_is_an_interval(good):
    rows = [r for r in good[2].where("part = 'Contents/section0.xml'").collect()]
    by = {r.pre: r for r in rows}
    for r in rows:
        assert list(r.ancestors) == ([*by[r.parent].ancestors, r.parent] if r.parent is not None else [])
        assert all(by[a].pre < r.pre <= by[a].end for a in r.ancestors)
        assert r.depth == len(r.ancestors)


def test_selectors(good):
    nodes = good[2]
    n = lambda s: [r.local for r in N.select(nodes, s).orderBy("ord").collect()]
    assert n("tables") == ["tbl"] and n("notes") == ["footNote", "endNote"] and n("hyperlinks") == ["fieldBegin"] and n("cross_references") == ["fieldBegin"]
    assert n("oles") == [] and n("shapes") == [] and n("charts") == ["chart"] and n("styles") == ["style"] and n("memo_shapes") == ["memoPr"]
    assert N.select(nodes, "tables", 1).count() == 0


def test_all_selectors_at_once(good):
    nodes = good[2]
    got = {}
    for r in N.select_all(nodes).collect():
        got.setdefault(r.selector, set()).add((r.part, r.pre, r.ord))
    for selector in (*N.TAGS, *N.FIELD_TYPES):
        assert got.get(selector, set()) == {(r.part, r.pre, r.ord) for r in N.select(nodes, selector).collect()}


def test_text(good):
    nodes = good[2]
    got = {(r.section_index, r.paragraph): r.text for r in N.paragraph_text(nodes).collect()}
    assert got[0, 1] == "abclaststray" and got[0, 4] == "endx" and got[10, 0] == "" and got[10, 1] == "Second & last"
    assert N.document_text(nodes).first().text == "Title\nabclaststray\nlink\nhere\nendx\n\n\n\n\nSecond & last"


def test_projections(good):
    nodes = good[2]
    m = N.metadata(nodes).first()
    assert (m.title, m.language, m.creator, m.extra) == ("My title", "ko", "B", {"other": "z"})
    f = {r.id: r for r in N.fields(nodes).collect()}
    assert f["7"].url == "http://x.org" and f["7"].type == "HYPERLINK" and f["8"].target == "mark" and f["8"].type == "CROSSREF"
    assert {(r.begin is not None, r.text) for r in N.field_spans(nodes).collect()} == {(True, "link"), (True, "")}
    assert N.table_matrices(nodes).first().rows == [["a", "b"], ["last", ""]]
    s = N.section_settings(nodes).first()
    assert (s.width, s.height, s.landscape, s.margins["left"]) == (100, 200, "WIDELY", "5")
    kinds = [(r.paragraph, r.kind, r.text) for r in N.blocks(nodes).where("section_index = 0").orderBy("ord").collect()]
    assert kinds[:4] == [(0, "paragraph", "Title"), (1, "paragraph", ""), (1, "table", None), (2, "paragraph", "link")]
    assert N.features(nodes).first().features == ["bookmark", "chart", "field", "hyperlink", "note", "paragraph", "picture", "table"]
    assert {(r.label, r.n) for r in N.signature(nodes).where("paragraph = 3").collect()} >= {("ctrl/bookmark[name=mark]", 1)}


def test_large_table(good):
    """A table of more cells than a grid may have still gives those it has."""
    large = N.table_matrices(good[2], most=3).first()
    assert large.rows is None and [tuple(c) for c in large.cells] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "last")]


def test_valid_package_has_no_issues(good):
    _, found, nodes = good
    for suite in ("xml", "strict"):  # strict holds the other suites
        assert [r.asDict() for r in V.validate(found, nodes, suite).collect()] == []


def sec(body):
    return xml(f"<hs:sec>{body}</hs:sec>")


S0 = "Contents/section0.xml"
FAULTS = {
    "missing_part": {"version.xml": None}, "mimetype": {"mimetype": b"text/plain"}, "xml_serialization": {"settings.xml": b"<a><b></a>"}, "container_reference": {"META-INF/container.xml": b'<container><rootfile full-path="gone.xml"/></container>'},
    "manifest_item": {"Contents/content.hpf": xml(HPF.replace('id="c1"', 'id="s0"').replace('id="header" ', ""))}, "manifest_reference": {"Chart/chart1.xml": None}, "spine_itemref": {"Contents/content.hpf": xml(HPF.replace('idref="s1"', 'idref="s9"'))},
    "header_section_count": {"Contents/section10.xml": None}, "xml_root": {"version.xml": b"<other/>"}, "section_structure": {S0: sec("<hp:x/>")}, "table_structure": {S0: sec(p(TABLE.replace('rowCnt="2"', 'rowCnt="0"')))},
    "table_cell_span": {S0: sec(p(TABLE.replace('rowSpan="1"', 'rowSpan="0"', 1)))}, "bookmark": {S0: sec(p('<hp:bookmark name=""/><hp:bookmark name="m"/><hp:bookmark name="m"/>'))}, "field_reference": {S0: sec(p(FIELD + FIELD + END + END.replace('"7"', '"99"')))},
    "style_reference": {S0: sec(p(t("x"), ref="55"))}, "binary_reference": {S0: sec(p('<hp:pic><hp:img binaryItemIDRef="zz"/></hp:pic>'))}, "chart_reference": {S0: sec(p('<hp:chart chartIDRef="Chart/none.xml"/>'))},
    "cross_reference": {S0: sec(SECTION0.replace('<hp:bookmark name="mark"/>', ""))}, "memo_reference": {S0: sec(SECTION0.replace('memoShapeIDRef="0"', 'memoShapeIDRef="4"'))}, "style_binding": {S0: sec(SECTION0.replace(' styleIDRef="0"', "", 1))},
    "control_subtree": {S0: sec(p("<hp:edit/><hp:hiddenComment/>"))}, "chart_closure": {S0: sec(p("<hp:chart><hp:sz/><hp:pos/><hp:outMargin/></hp:chart>"))}, "binary_closure": {"BinData/extra.png": b"x"}, "binary_media_type": {"Contents/content.hpf": xml(HPF.replace("image/png", "image/gif"))},
    "metadata_schema": {S0: sec(p('<hp:edit command="X_FORM_META:{&quot;items&quot;: [1], &quot;label&quot;: 3}"/><hp:edit command="X_FORM_META:nope"/>'))},
    "paragraph_layout_cache": {S0: sec(p(t("abc")).replace("</hp:p>", '<hp:linesegarray><hp:lineseg textpos="0"/><hp:lineseg textpos="9"/></hp:linesegarray></hp:p>'))},
}


def test_each_fault_is_found(spark):
    files = {k: package(parts(**change)) for k, change in FAULTS.items()}
    _, found, nodes = load(spark, duplicate_zip_entry=package(extra=[("version.xml", b"<HCFVersion/>")]), **files)
    issues = {(r.doc, r.kind) for r in V.validate(found, nodes, "strict").collect()} | {(r.doc, r.kind) for r in V.validate(found, nodes, "xml").collect()}
    for kind in [*FAULTS, "duplicate_zip_entry"]:
        assert (kind, kind) in issues, kind
    text = V.report(V.validate(found, nodes, "basic")).where("doc = 'mimetype'").first().text
    assert text.startswith("1. [mimetype] mimetype")


def test_packaging(spark):
    members = parts()
    first = {"version.xml": members["version.xml"], **members}
    _, found, nodes = load(spark, a=package(first))
    assert [r.message for r in V.mimetype_packaging(found, nodes).collect()] == ["mimetype must be the first package entry"]


def test_round_trip(spark, tmp_path, good):
    _, found, nodes = good
    xml_parts = P.serialize(nodes)
    again = found.join(xml_parts.withColumnRenamed("content", "new"), ["doc", "path"], "left").selectExpr("doc", "entry_ord", "path", "coalesce(new, content) as content")
    packed = P.assemble(again)
    saved = P.save(packed, f"file://{tmp_path}").first()
    _, found2, nodes2 = load(spark, a=open(saved.path, "rb").read())
    for suite in ("strict",):
        assert V.validate(found2, nodes2, suite).count() == 0
    key = lambda n: sorted((r.part, r.pre, r.end, r.local, r.ns or "", r.text or "", r.tail or "", str(sorted(r.attrs.items()))) for r in n.collect())
    assert key(nodes2) == key(nodes)
    assert N.document_text(nodes2).first() == N.document_text(nodes).first()

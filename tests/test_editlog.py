import hashlib
import io
import zipfile

import pytest
from fixtures import p, package, parts, t
from pyspark.sql import functions as F

from foliospark.operators import editlog as L
from foliospark.operators import nodes as N
from foliospark.sources import packages as P

HP = "http://www.hancom.co.kr/hwpml/2011/paragraph"
#: A section with what must survive: a comment, an instruction, odd white space and quotes, a prefix of its own, line segments.
RAW = (
    f"<?xml version='1.0' encoding='UTF-8'?>\n<!-- kept --><s:sec  xmlns:s='http://www.hancom.co.kr/hwpml/2011/section'\n xmlns:q=\"{HP}\"><?keep me?>"
    '<q:p id="1"\tstyleIDRef="0"><q:run><q:t>one &amp; one<q:tab/>tail</q:t></q:run><!-- in --><q:linesegarray><q:lineseg/></q:linesegarray></q:p>\n'
    '<q:p id="2"><q:run><q:ctrl><q:bookmark name="a>b"/></q:ctrl><q:t>two</q:t></q:run><q:run><q:tbl><q:tr/></q:tbl></q:run></q:p> <!-- after -->'
    '<q:p id="3"/></s:sec><!-- end -->'
).encode()


class R:
    def __init__(self, **kv):
        self.__dict__.update(dict.fromkeys(("seq", "op", "section", "table", "row", "col", "to_row", "to_col", "paragraph", "at", "control", "to_section", "to_paragraph", "to_control", "n", "text", "old", "xml", "attrs")) | kv)


def done(*rows, raw=RAW, others=()):
    """The section after the edits, and the results."""
    members = parts(**{"Contents/section0.xml": raw}, **dict(others))
    new, told = L.edit(package(members), [R(seq=i, section=r.pop("section", 0), **r) for i, r in enumerate(rows)])
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.testzip() is None
        for name in members:
            if not name.startswith("Contents/section"):
                assert z.read(name) == members[name]
        return z.read("Contents/section0.xml"), told, z.read("Contents/section10.xml")


def test_nothing_else_changes():
    raw, told, _ = done(dict(op="append_paragraph", text="x < y\x0b"))
    new = b'<q:p id="0" paraPrIDRef="0" styleIDRef="0" pageBreak="0" columnBreak="0" merged="0"><q:run charPrIDRef="0"><q:t>x &lt; y</q:t></q:run></q:p>'
    assert raw == RAW.replace(b'<q:p id="3"/>', b'<q:p id="3"/>' + new) and told == [(0, True, None)]
    raw, _, _ = done(dict(op="delete_paragraph", paragraph=1))
    assert raw == RAW[: RAW.index(b'<q:p id="2"')] + RAW[RAW.index(b'<q:p id="3"') :]
    raw, _, _ = done(dict(op="set_style", paragraph=0, attrs={"styleIDRef": "7", "paraPrIDRef": '"'}))
    assert raw == RAW.replace(b'<q:p id="1"\tstyleIDRef="0">', b"<q:p paraPrIDRef='\"' id=\"1\" styleIDRef=\"7\">")
    raw, _, _ = done(dict(op="replace_text", old="nothing", text="x"))
    assert raw == RAW


def test_texts():
    raw, told, _ = done(dict(op="replace_text", old="one", text="1<", n=1))
    assert raw == RAW.replace(b"one &amp; one<q:tab/>", b"1&lt; &amp; one<q:tab/>").replace(b"<q:linesegarray><q:lineseg/></q:linesegarray>", b"")
    raw, _, _ = done(dict(op="set_text", paragraph=1, text="new"), dict(op="set_text", paragraph=2, text="filled", attrs={"charPrIDRef": "4"}))
    assert raw == RAW.replace(b'<q:t>two</q:t></q:run><q:run><q:tbl><q:tr/></q:tbl></q:run></q:p>', b'</q:run><q:run charPrIDRef="0"><q:t>new</q:t></q:run></q:p>').replace(b'<q:p id="3"/>', b'<q:p id="3"><q:run charPrIDRef="4"><q:t>filled</q:t></q:run></q:p>')
    raw, _, _ = done(dict(op="replace_xml", paragraph=0, xml="<hp:p id='9'/>"))
    assert f"<hp:p xmlns:hp='{HP}' id='9'/>".replace("'", '"').encode() in raw.replace(b"'", b'"') and b"<!-- in -->" not in raw


def test_order():

    raw, told, _ = done(dict(op="move_paragraph", paragraph=0, at=2), dict(op="copy_paragraph", paragraph=-1, at=0), dict(op="insert_xml", at=3, xml='<hp:p id="new"/>'))
    ids = [x.split(b'"')[0] for x in raw.split(b' id="')[1:]]
    assert ids == [b"3", b"2", b"1", b"new", b"3"] and all(ok for _, ok, _ in told)
    assert b"<!-- in -->" in raw and raw.startswith(RAW[: RAW.index(b"<q:p")]) and raw.endswith(b"<!-- end -->")


def test_controls_between_sections():
    other = f'<hs:sec xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hp="{HP}"><hp:p><hp:run><hp:t>there</hp:t></hp:run></hp:p></hs:sec>'.encode()
    move = dict(op="move_control", paragraph=1, control=0, to_section=1, to_paragraph=0)
    raw, told, second = done(move, others={"Contents/section10.xml": other})
    assert told == [(0, True, None)] and b"bookmark" not in raw and b"<q:tbl>" in raw
    assert f'<hp:run charPrIDRef="0"><q:ctrl xmlns:q="{HP}"><q:bookmark name="a&gt;b"/>'.replace("&gt;", ">").encode() in second
    nodes, error = P.parse(second)
    assert error is None and [r[6] for r in nodes if r[7] == "bookmark"] == [HP]
    raw, told, _ = done(dict(op="move_control", paragraph=1, control=0, to_paragraph=1, to_control=2), dict(op="delete_control", paragraph=1, control=1), dict(op="insert_control", paragraph=2, xml='<hp:ctrl><hp:bookmark name="z"/></hp:ctrl>'))
    assert all(ok for _, ok, _ in told) and raw.count(b"bookmark") == 1 and b"<q:tbl>" in raw
    raw, told, _ = done(dict(op="copy_control", paragraph=1, control=-1, to_paragraph=0, to_control=0))
    assert raw.count(b"<q:tbl>") == 2 and told[0][1]


def grid(*cells, rows=3, cols=3):
    """A section with one table; a cell is (row, column, row span, column span, text)."""
    by = {}
    for r, c, rs, cs, x in cells:
        by.setdefault(r, []).append(f'<hp:tc name="k"><hp:subList>{p(t(x))}{p(t("more"))}</hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="{cs}" rowSpan="{rs}"/></hp:tc>')
    body = "".join(f"<hp:tr>{''.join(by.get(r, []))}</hp:tr>" for r in range(rows))
    return f'<hs:sec xmlns:hs="x" xmlns:hp="{HP}">{p(t("before"))}{p(f"""<hp:tbl rowCnt="{rows}" colCnt="{cols}">{body}</hp:tbl>""")}</hs:sec>'.encode()


def cells_of(raw):
    """(row, column, row span, column span, texts) of all cells, and the declared rows."""
    section = L.Section(raw)
    i, table = section.table(R(table=0))
    texts = lambda c: ["".join(e.text) for e in table.within(c.tc, "t")]
    return [(c.row, c.col, c.row_span, c.col_span, texts(c)) for c in table.cells], L._attr(table.p[table.top.start : table.top.inner], "rowCnt")


FULL = [(r, c, 1, 1, f"{r}{c}") for r in range(3) for c in range(3)]
SPANNED = [(0, 0, 3, 1, "tall"), (0, 1, 1, 2, "wide"), (1, 1, 2, 2, "block")]


def test_rows_and_merges():
    raw, told, _ = done(dict(op="append_row", table=0, text='["a<", null]'), raw=grid(*FULL))
    cells, n = cells_of(raw)
    assert n == "4" and told == [(0, True, None)]
    assert cells[:9] == [(r, c, 1, 1, [x, "more"]) for r, c, _, _, x in FULL] and cells[9:] == [(3, 0, 1, 1, ["a<", ""]), (3, 1, 1, 1, ["", ""]), (3, 2, 1, 1, ["", ""])]
    raw, told, _ = done(dict(op="merge_cells", table=0, row=0, col=1, to_row=1, to_col=2), dict(op="merge_cells", table=0, row=0, col=0, to_row=0, to_col=1), dict(op="set_cell", table=0, row=0, col=1, text="one"), dict(op="set_cell", table=0, row=1, col=1, text="gone"), raw=grid(*FULL))
    assert [ok for _, ok, _ in told] == [True, False, True, False] and "crosses the edge" in told[1][2]
    assert cells_of(raw)[0] == [(0, 0, 1, 1, ["00", "more"]), (0, 1, 2, 2, ["one", ""]), (1, 0, 1, 1, ["10", "more"]), *((2, c, 1, 1, [f"2{c}", "more"]) for c in range(3))]


def test_rows_below_spans():
    """Spans that end at the last row get cells below them."""
    raw, told, _ = done(dict(op="append_row", table=0, text='["x", "y"]'), dict(op="merge_cells", table=0, row=1, col=1, to_row=2, to_col=2), dict(op="merge_cells", table=0, row=2, col=0, to_row=3, to_col=0), raw=grid(*SPANNED))
    cells, n = cells_of(raw)
    assert n == "4" and [ok for _, ok, _ in told] == [True, True, False]
    assert cells[3:] == [(3, 0, 1, 1, ["x", ""]), (3, 1, 1, 1, ["y", ""]), (3, 2, 1, 1, ["", ""])]
    taken = [(r + i, c + j) for r, c, rs, cs, _ in cells for i in range(rs) for j in range(cs)]
    assert sorted(taken) == [(r, c) for r in range(4) for c in range(3)]


def test_tables_that_are_refused():
    raw = grid(*FULL[:8], (2, 2, 1, 1, "x"))
    held = raw.replace(b"<hp:t>22</hp:t>", b"").replace(b"<hp:t>x</hp:t>", b'<hp:ctrl><hp:bookmark name="b"/></hp:ctrl>')
    for source, row in ((held, dict(op="append_row", table=0)), (raw, dict(op="append_row", table=1)), (raw, dict(op="append_row", table=0, text="[1,2,3,4]")), (raw, dict(op="append_row", table=0, text="{")), (raw, dict(op="merge_cells", table=0, row=1, col=1, to_row=0, to_col=1)), (raw, dict(op="merge_cells", table=0, row=0, col=0, to_row=3, to_col=0)), (grid(rows=0), dict(op="append_row", table=0)), (raw, dict(op="set_cell", table=0, row=0, col=0))):
        new, told, _ = done(dict(row), raw=source)
        assert new == source and told[0][1] is False


@pytest.mark.parametrize("row", [dict(op="fly"), dict(op="set_text", paragraph=9, text=""), dict(op="set_text", paragraph=0), dict(op="append_paragraph", text="x", section=5), dict(op="insert_xml", at=0, xml="<hp:p/><hp:p/>"), dict(op="insert_xml", at=0, xml="<hp:p>"), dict(op="insert_xml", at=0, xml=""), dict(op="delete_control", paragraph=0, control=0), dict(op="move_control", paragraph=1, control=0, to_paragraph=7), dict(op="move_control", paragraph=1, control=0, to_paragraph=0, to_control=5), dict(op="insert_paragraph", at=4, text=""), dict(op="replace_text", old="", text="x")])
def test_what_cant_be_applied_changes_nothing(row):
    raw, told, _ = done(row)
    assert raw == RAW and told[0][1] is False and told[0][2]


def test_bad_packages_and_parts():
    assert L.edit(b"no zip", [R(seq=1, op="append_paragraph", text="x")])[1][0][:2] == (1, False)
    for raw in (b"<broken", b"", "<?xml version='1.0' encoding='utf-16'?><s/>".encode("utf-16"), b"<s/>"):
        new, told, _ = done(dict(op="append_paragraph", text="x"), raw=raw)
        assert new == raw and told[0][1] is False


def test_many_documents(spark):
    """Each with its own edits; files that no log names pass as they are, and zip entries keep their order and dates."""
    files = spark.createDataFrame([(d, package()) for d in ("a", "b", "c", "none")] + [("null", None)], "doc string, content binary")
    rows = [("a", i, "append_paragraph", 0, f"t{i}", "extra") for i in range(5)] + [("b", 1, "append_paragraph", 1, "u", "x"), ("b", 2, "set_text", 0, "u", "x"), ("lost", 1, "append_paragraph", 0, "x", "x"), ("null", 1, "append_paragraph", 0, "x", "x")]
    log = spark.createDataFrame(rows[::-1], "doc string, seq int, op string, section int, text string, content string")
    got = {r.doc: r for r in L.apply_log(files, log).collect()}
    assert sorted(got) == ["a", "b", "c", "none", "null"] and [d for d in sorted(got) if got[d].changed] == ["a", "b"]
    assert bytes(got["c"].content) == package() and got["c"].results == [] and got["null"].results[0].ok is False
    assert [(r.seq, r.ok) for r in got["b"].results] == [(1, True), (2, False)] and got["b"].results[1].reason == "set_text needs paragraph"
    nodes = P.nodes(P.parts(P.entries(L.apply_log(files, log).where("doc = 'a'"))))
    assert [r.text for r in N.paragraph_text(nodes).where("section_index = 0").orderBy("paragraph").collect()][-5:] == [f"t{i}" for i in range(5)]
    with zipfile.ZipFile(io.BytesIO(bytes(got["a"].content))) as z, zipfile.ZipFile(io.BytesIO(package())) as y:
        assert [(i.filename, i.date_time, i.compress_type) for i in z.infolist()] == [(i.filename, i.date_time, i.compress_type) for i in y.infolist()]
        same = [i.filename for i in z.infolist() if hashlib.sha256(z.read(i)).digest() == hashlib.sha256(y.read(i.filename)).digest()]
        assert len(same) == len(z.infolist()) - 1
    plan = L.apply_log(files, log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert L.apply_log(files, log.where(F.lit(False))).where("changed").count() == 0

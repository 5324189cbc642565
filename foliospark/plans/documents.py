"""Queries that build documents of both formats from `conversations` and run the real operators on them.

A conversation is a document, its turns are paragraphs: even turns stand in the
first section, odd ones in the second. The kind of control in a paragraph
follows from conversation and turn, so SQL over the same table knows what each
operator must find. Everything is built with column functions; packages and
compound files are then written and read by the engine's own sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators import edits as E
from foliospark.operators import nodes as N
from foliospark.operators import validate as V
from foliospark.plans.catalogue import query, table
from foliospark.sources import binary as B
from foliospark.sources import packages as P
from foliospark.sources.shared import kept

_SUB = '<hp:subList><hp:p id="0" paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:t>in @</hp:t></hp:run></hp:p></hp:subList>'


def _field(kind: str, params: str = "") -> str:
    return f'<hp:ctrl><hp:fieldBegin id="@" fieldid="f@" type="{kind}" name="b#">{params}</hp:fieldBegin></hp:ctrl><hp:t>shown @</hp:t><hp:ctrl><hp:fieldEnd beginIDRef="@" fieldid="f@"/></hp:ctrl>'


def _cell(r: int, c: int, text: str) -> str:
    return f'<hp:tc><hp:subList><hp:p id="0" paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:t>{text}</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc>'


#: Controls by number: `@` is the document's and turn's own number, `#` the document's.
CONTROLS = (
    f'<hp:ctrl><hp:header applyPageType="BOTH">{_SUB}</hp:header></hp:ctrl>', f'<hp:ctrl><hp:footer applyPageType="BOTH">{_SUB}</hp:footer></hp:ctrl>',
    f'<hp:tbl rowCnt="2" colCnt="2"><hp:tr>{_cell(0, 0, "@")}{_cell(0, 1, "b")}</hp:tr><hp:tr>{_cell(1, 0, "c")}{_cell(1, 1, "#")}</hp:tr></hp:tbl>',
    '<hp:pic><hp:sz/><hp:pos/><hp:outMargin/><hc:img binaryItemIDRef="pic1"/></hp:pic>', '<hp:ole binaryItemIDRef="pic1"><hp:sz/><hp:pos/><hp:outMargin/></hp:ole>',
    f"<hp:ctrl><hp:footNote>{_SUB}</hp:footNote></hp:ctrl>", f"<hp:ctrl><hp:endNote>{_SUB}</hp:endNote></hp:ctrl>", f"<hp:ctrl><hp:hiddenComment>{_SUB}</hp:hiddenComment></hp:ctrl>",
    '<hp:checkBtn name="n@"/>', '<hp:edit name="n@"/>',
    '<hp:switch><hp:case><hp:chart chartIDRef="Chart/chart1.xml"><hp:sz/><hp:pos/><hp:outMargin/></hp:chart></hp:case><hp:default><hp:ole binaryItemIDRef="pic1"><hp:rotationInfo/></hp:ole></hp:default></hp:switch>',
    '<hp:ctrl><hp:bookmark name="m@"/></hp:ctrl>', _field("HYPERLINK", '<hp:parameters><hp:stringParam name="Command">http\\://x.org/@;1;0;</hp:stringParam></hp:parameters>'),
    _field("MAILMERGE"), _field("FORMULA"), _field("CROSSREF"), '<hp:ctrl><hp:autoNum num="@" numType="PAGE"/></hp:ctrl>', '<hp:ctrl><hp:newNum num="@" numType="PAGE"/></hp:ctrl>',
    "<hp:equation><hp:sz/><hp:pos/><hp:outMargin/><hp:script>x+@</hp:script></hp:equation>",
    *(f"<hp:{t}><hp:sz/><hp:pos/><hp:outMargin/></hp:{t}>" for t in N.SHAPES[:-1]), "",
)
_K = f"((conv_id + turn) % {len(CONTROLS)})"
_BASE = f"with d as (select conv_id, turn, text, (turn % 2)::int as section_index, (turn // 2)::int as paragraph, {_K}::int as k, conv_id * 10 + turn as n, 'c' || conv_id as doc from conversations)"
#: Selectors and the numbers of the controls they find.
SELECTED = {
    "headers": (0,), "footers": (1,), "tables": (2,), "pictures": (3,), "oles": (4,), "notes": (5, 6), "memos": (7,), "forms": (8, 9), "charts": (10,), "bookmarks": (11,), "fields": (12, 13, 14, 15),
    "hyperlinks": (12,), "mail_merge_fields": (13,), "calculation_fields": (14,), "cross_references": (15,), "auto_numbers": (16, 17), "equations": (18,), "shapes": (*range(19, 28), 4),
}
_HEADERS = ("styles", "paragraph_styles", "character_styles", "memo_shapes")


def _turns(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc"), "conv_id", "turn", "text", (F.col("turn") % 2).cast("int").alias("section"), F.expr(_K).cast("int").alias("k"), (F.col("conv_id") * 10 + F.col("turn")).alias("n"))


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def packages(spark, sf, faults: bool = False) -> DataFrame:
    """(doc, content): a package for each conversation; with faults in some, by their number."""
    turns = _turns(spark, sf)
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in P.NAMESPACES.items())
    control = F.replace(F.replace(F.get(F.array(*map(F.lit, CONTROLS)), F.col("k")), F.lit("@"), F.col("n").cast("string")), F.lit("#"), F.col("conv_id").cast("string"))
    style = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 0), "9").otherwise("0") if faults else F.lit("0")
    paragraph = F.concat(F.lit('<hp:p id="'), F.col("turn").cast("string"), F.lit('" paraPrIDRef="0" styleIDRef="'), style, F.lit('"><hp:run charPrIDRef="0"><hp:t>'), _escaped(F.col("text")), F.lit('</hp:t></hp:run><hp:run charPrIDRef="0">'), control, F.lit("</hp:run></hp:p>"))
    sections = turns.groupBy("doc", "conv_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", paragraph.alias("xml")))), lambda s: s.xml), "").alias("xml"))
    bodies = sections.select("doc", (F.col("section") + 5).alias("entry_ord"), F.concat(F.lit("Contents/section"), F.col("section").cast("string"), F.lit(".xml")).alias("path"), F.concat(F.lit(f"<hs:sec {spaces}>"), "xml", F.lit("</hs:sec>")).alias("text"))
    docs = sections.groupBy("doc", "conv_id").agg(F.count("*").alias("sections"))
    number = F.col("conv_id").cast("string")
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.col("sections").cast("int") - 1), lambda i: F.format_string('<opf:item id="s%d" href="Contents/section%d.xml" media-type="application/xml"/>', i, i)), "")
    refs = F.when(F.lit(faults) & (F.col("conv_id") % 5 == 2), F.lit('<opf:itemref idref="lost"/>')).otherwise(F.lit(""))
    hpf = F.concat(
        F.lit(f'<opf:package {spaces}><opf:metadata><opf:title>Title '), number, F.lit('</opf:title><opf:language>ko</opf:language><opf:meta name="creator">x</opf:meta><opf:meta name="creator">by '), number,
        F.lit('</opf:meta><opf:meta name="mood">calm</opf:meta></opf:metadata><opf:manifest><opf:item id="header" href="Contents/header.xml" media-type="application/xml"/><opf:item id="pic1" href="BinData/pic1.png" media-type="image/png"/>'
              '<opf:item id="chart1" href="Chart/chart1.xml" media-type="application/xml"/>'), items, F.lit('</opf:manifest><opf:spine><opf:itemref idref="s0"/>'), refs, F.lit("</opf:spine></opf:package>"),
    )
    header = F.concat(F.lit(f'<hh:head {spaces} secCnt="'), F.when(F.lit(faults) & (F.col("conv_id") % 11 == 4), F.lit(9)).otherwise(F.col("sections")).cast("string"), F.lit('"><hh:style id="0"/><hh:paraPr id="0"/><hh:charPr id="0"/><hh:memoProperties itemCnt="1"><hh:memoPr id="1"/></hh:memoProperties></hh:head>'))
    fixed = {"mimetype": F.lit(P.MIMETYPE), "version.xml": F.lit("<HCFVersion/>"), "META-INF/container.xml": F.lit('<container><rootfiles><rootfile full-path="Contents/content.hpf"/></rootfiles></container>'), "Contents/content.hpf": hpf, "Contents/header.xml": header}
    more = {"BinData/pic1.png": F.lit("PNG"), "Chart/chart1.xml": F.lit("<chart/>")}
    rows = [F.struct(F.lit(i).alias("entry_ord"), F.lit(p).alias("path"), c.alias("text")) for i, (p, c) in enumerate(fixed.items())] + [F.struct(F.lit(10 + i).alias("entry_ord"), F.lit(p).alias("path"), c.alias("text")) for i, (p, c) in enumerate(more.items())]
    parts = docs.select("doc", "conv_id", F.explode(F.array(*rows)).alias("r")).select("doc", "conv_id", "r.*")
    if faults:
        parts = parts.where(~((F.col("conv_id") % 13 == 6) & (F.col("path") == "version.xml")))
    parts = parts.drop("conv_id").unionByName(bodies)
    return P.assemble(parts.select("doc", "entry_ord", "path", F.encode("text", "UTF-8").alias("content")))


def _read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = kept(P.parts(P.entries(files)), "parts")
    return parts, kept(P.nodes(parts), "nodes")


@query(f"{_BASE}, p(path, kind) as (values ('mimetype', 'mimetype'), ('version.xml', 'version'), ('META-INF/container.xml', 'container'), ('Contents/content.hpf', 'content_hpf'), ('Contents/header.xml', 'header'), ('BinData/pic1.png', 'bindata'), ('Chart/chart1.xml', 'xml')) select doc, path, kind, path = 'mimetype' as stored, 1::bigint as copies from (select distinct doc from d) cross join p union all select distinct doc, 'Contents/section' || section_index || '.xml', 'section', false, 1::bigint from d")
def package_parts(spark, sf):
    """Zip members, their kinds and how they are stored."""
    return _read(packages(spark, sf))[0].select("doc", "path", "kind", "stored", "copies")


@query(f"{_BASE} select doc, row_number() over (partition by doc order by section_index) - 1 as section_index, 'Contents/section' || section_index || '.xml' as path from (select distinct doc, section_index from d)")
def package_sections(spark, sf):
    """Sections by their numbers."""
    return P.sections(_read(packages(spark, sf))[0]).select("doc", F.col("section_index").cast("long").alias("section_index"), "path")


_values = ", ".join(f"('{s}', {k}, {i if s in N.TAG_MAJOR else 0})" for s, ks in SELECTED.items() for i, k in enumerate(ks))


@query(f"{_BASE}, s(selector, k, major) as (values {_values}) select selector, doc, section_index, paragraph, row_number() over (partition by selector, doc order by section_index, major, paragraph) - 1 as ord from d join s using (k) union all select h, doc, null, null, 0 from (select distinct doc from d) cross join (values {', '.join(f"('{h}')" for h in _HEADERS)}) t(h)")
def package_selectors(spark, sf):
    """Every selector, with the order of its rows in the document."""
    _, nodes = _read(packages(spark, sf))
    return N.select_all(nodes).select("selector", "doc", "section_index", "paragraph", F.col("ord").cast("long").alias("ord"))


_inner = "case when k in (0, 1, 5, 6, 7) then 'in ' || n when k = 2 then n || 'bc' || conv_id when k between 12 and 15 then 'shown ' || n else '' end"


@query(f"{_BASE} select doc, string_agg(t, chr(10) || chr(10) order by section_index) as text from (select doc, section_index, string_agg(text || {_inner}, chr(10) order by paragraph) as t from d group by all) group by doc")
def package_text(spark, sf):
    """Text of documents: paragraphs with all that is in them, by lines; sections by blank lines."""
    return N.document_text(_read(packages(spark, sf))[1])


@query(f"{_BASE} select distinct doc, 'Title ' || conv_id as title, 'ko' as language, 'by ' || conv_id as creator, 'calm' as mood from d")
def package_metadata(spark, sf):
    """Metadata: of equal names the last counts, unknown ones go to a map."""
    return N.metadata(_read(packages(spark, sf))[1]).select("doc", "title", "language", "creator", F.col("extra")["mood"].alias("mood"))


@query(f"{_BASE} select doc, section_index, paragraph, case k when 12 then 'HYPERLINK' when 13 then 'MAILMERGE' when 14 then 'FORMULA' else 'CROSSREF' end as type, n::varchar as id, case when k = 15 then 'b' || conv_id end as target, case when k = 12 then 'http://x.org/' || n end as url, 'shown ' || n as shown from d where k between 12 and 15")
def package_fields(spark, sf):
    """Fields with type, target and address, and the text between their ends."""
    _, nodes = _read(packages(spark, sf))
    spans = N.field_spans(nodes).select("doc", "part", F.col("begin").alias("pre"), F.col("text").alias("shown"))
    return N.fields(nodes).join(spans, ["doc", "part", "pre"], "left").select("doc", "section_index", "paragraph", "type", "id", "target", "url", "shown")


@query(f"{_BASE} select doc, [[n::varchar, 'b'], ['c', conv_id::varchar]] as rows, 4::bigint as cells from d where k = 2")
def package_tables(spark, sf):
    """Table grids, and how many cells they have."""
    _, nodes = _read(packages(spark, sf))
    n = N.cells(nodes).groupBy("doc", "part", "table").agg(F.count("*").alias("cells"))
    return N.table_matrices(nodes).drop("cells").join(n, ["doc", "part", "table"]).select("doc", "rows", "cells")


_kinds = {0: "header", 1: "footer", 2: "table", 3: "picture", 4: "shape", 5: "note", 6: "note", 7: "memo", 8: "form", 9: "form", 10: "chart", 11: "bookmark", 12: "hyperlink", 13: "field", 14: "field", 15: "field", 16: "auto_number", 17: "auto_number", 18: "equation"}
_case = "case " + " ".join(f"when k = {k} then '{v}'" for k, v in _kinds.items() if k != 4) + " when k = 4 then 'ole' else 'shape' end"


@query(f"{_BASE}, b as (select doc, section_index, paragraph, 0 as place, 'paragraph' as kind, text || case when k between 12 and 15 then 'shown ' || n else '' end as text from d union all select doc, section_index, paragraph, 1, {_case}, null from d where k < 28) select doc, section_index, paragraph, row_number() over (partition by doc, section_index order by paragraph, place) - 1 as ord, kind, text from b")
def package_blocks(spark, sf):
    """Documents as sequences of typed blocks."""
    return N.blocks(_read(packages(spark, sf))[1]).select("doc", "section_index", "paragraph", F.col("ord").cast("long").alias("ord"), "kind", "text")


@query(f"{_BASE}, b as (select distinct doc, {_case} as kind from d where k < 28 union select distinct doc, 'paragraph' from d) select doc, list_sort(list(kind)) as features from b group by doc")
def package_features(spark, sf):
    """Kinds of blocks that a document has."""
    return N.features(_read(packages(spark, sf))[1])


@query(f"{_BASE}, i(doc, kind) as (select doc, 'style_reference' from d where conv_id % 7 = 3 and turn = 0 union all select distinct doc, 'spine_itemref' from d where conv_id % 5 = 2 union all select distinct doc, 'header_section_count' from d where conv_id % 11 = 4 union all select distinct doc, 'missing_part' from d where conv_id % 13 = 6 union all select doc, 'cross_reference' from d where k = 15) select doc, kind, count(*) as n from i group by all")
def package_validation(spark, sf):
    """Issues by kind, of packages with planted faults; each rule is a join."""
    parts, nodes = _read(packages(spark, sf, faults=True))
    return V.validate(parts, nodes, "reference").groupBy("doc", "kind").agg(F.count("*").alias("n"))


@query(f"{_BASE} select doc, string_agg(t, chr(10) || chr(10) order by section_index) as text from (select doc, section_index, string_agg(replace(text, 'the', 'THE') || replace({_inner}, 'the', 'THE'), chr(10) order by o) as t from (select *, case when section_index = 0 and paragraph = 0 then 99 else paragraph end::double as o from d union all select distinct conv_id, 0, 'begun', 0, 0, 28, 0, doc, 0.5 from d) group by all) group by doc")
def package_edits(spark, sf):
    """Insert a paragraph, move the first to the end, replace in all texts; written, read again."""
    _, nodes = _read(packages(spark, sf))
    edited = E.insert_paragraph(E.move_paragraph(nodes, 0, 0, 1 << 20), 0, 0, "begun")
    edited = E.replace_text(edited, "the", "THE")
    found = P.serialize(edited).select("doc", F.lit(0).alias("entry_ord"), "path", "content")
    return N.document_text(_read(P.assemble(found))[1])


@query(f"{_BASE} select distinct doc, true as same from d")
def package_round_trip(spark, sf):
    """Nodes of packages written from their nodes and read again are the same."""
    _, nodes = _read(packages(spark, sf))
    cut = lambda df: df.groupBy("doc", "part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("pre", "end", "ns", "local", "text", "tail", F.array_sort(F.map_entries("attrs")))).alias("h"))
    again = _read(P.assemble(P.serialize(nodes).select("doc", F.lit(0).alias("entry_ord"), "path", "content")))[1]
    both = cut(nodes).join(cut(again).withColumnsRenamed({"n": "m", "h": "g"}), ["doc", "part"], "full_outer")
    return both.groupBy("doc").agg(F.bool_and(F.col("n").eqNullSafe(F.col("m")) & F.col("h").eqNullSafe(F.col("g"))).alias("same"))


# -- binary documents ------------------------------------------------------------------------

#: Controls of binary documents by number: the id, and the record below it, if any.
NATIVE = (
    ("tbl ", "table"), ("bokm", None), ("fn  ", None), ("en  ", None), ("pgnp", None), ("eqed", None), ("form", "form_object"), ("head", None), ("foot", None), ("atno", None), ("nwno", None), ("%hlk", None), ("%mai", None), ("%for", None),
    ("%ref", None), ("%doc", None), ("%dat", None), *(("gso ", s) for s in ("picture", "line", "connect_line", "rectangle", "ellipse", "arc", "polygon", "curve", "container", "textart", "ole", "chart_data")),
)
_NK = f"((conv_id + turn) % {len(NATIVE)})"
_NBASE = _BASE.replace(_K, _NK)
_SHAPES = (*range(18, 26), 26, 27, 28)
NATIVE_SELECTED = {
    "tables": (0,), "bookmarks": (1,), "notes": (2, 3), "page_numbers": (4,), "equations": (5,), "forms": (6,), "fields": tuple(range(11, 17)), "hyperlinks": (11,), "mail_merge_fields": (12,), "calculation_fields": (13,), "cross_references": (14,), "doc_property_fields": (15,),
    "date_fields": (16,), "pictures": (17,), "lines": (18,), "connect_lines": (19,), "rectangles": (20,), "ellipses": (21,), "arcs": (22,), "polygons": (23,), "curves": (24,), "containers": (25,), "textarts": (26,), "oles": (27,), "charts": (28,), "shapes": tuple(range(18, 29)),
}


def _le(value: Column, size: int) -> Column:
    """Hex of a number, lowest byte first."""
    h = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def _u16(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-16LE"))


def binary_records(spark, sf, faults: bool = False) -> DataFrame:
    """(doc, stream, ord, tag_id, level, payload) of a binary document for each conversation."""
    turns = _turns(spark, sf).withColumn("k", F.expr(_NK).cast("int"))
    zero = lambda n: F.lit("00" * n)
    shape = F.when(F.lit(faults) & (F.col("conv_id") % 7 == 3) & (F.col("turn") == 0), F.lit(9)).otherwise(F.lit(0))
    head = F.concat(_le(F.length("text") + 1, 4), zero(4), _le(shape, 2), zero(2))
    record = lambda name, level, payload: F.struct(F.lit(B.TAGS[name]).alias("tag_id"), F.lit(level).alias("level"), payload.alias("hex"))
    ident = lambda cid: F.lit(cid[::-1].encode("latin-1").hex().upper())

    def own(cid: str, below: str | None) -> Column:
        rows = [record("ctrl_header", 1, F.concat(ident(cid), zero(40)))]
        if cid == "gso ":
            rows.append(record("shape_component", 2, F.concat(F.lit(B.CONNECT_LINE.hex().upper() if below == "connect_line" else "00" * 8), zero(200))))
            rows.append(record({"connect_line": "line"}.get(below, below), 3, zero(80)))
        elif below:
            rows.append(record(below, 2, zero(20)))
        return F.array(*rows)

    control = F.get(F.array(*[own(*x) for x in NATIVE]), F.col("k"))
    text = F.array(record("para_text", 1, _u16(F.concat("text", F.lit("\r")))))
    rows = turns.select("doc", F.concat(F.lit("BodyText/Section"), F.col("section").cast("string")).alias("stream"), "turn", F.posexplode(F.concat(F.array(record("para_header", 0, head)), text, control)).alias("i", "r"))
    body = rows.select("doc", "stream", (F.col("turn") * 100 + F.col("i")).alias("ord"), "r.tag_id", "r.level", F.unhex("r.hex").alias("payload"))
    docs = turns.groupBy("doc", "conv_id").agg(F.countDistinct("section").alias("sections"))
    counts = [F.lit(0)] * 18
    counts[0], counts[13], counts[14] = F.lit(1), F.when(F.lit(faults) & (F.col("conv_id") % 5 == 2), F.lit(0)).otherwise(F.lit(1)), F.lit(1)
    number = F.col("conv_id").cast("string")
    info = F.array(
        record("document_properties", 0, F.concat(_le(F.col("sections"), 2), *[_le(F.lit(1), 2)] * 6, zero(8), _le(F.col("conv_id"), 4))), record("id_mappings", 0, F.concat(*[_le(c, 4) for c in counts])),
        record("bin_data", 0, F.concat(_le(F.lit(1), 2), _le(F.lit(1), 2), _le(F.lit(3), 2), _u16(F.lit("png")))), record("face_name", 0, F.concat(F.lit("80"), _le(F.length(number) + 5, 2), _u16(F.concat(F.lit("Font "), number)))),
        record("para_shape", 0, zero(54)), record("style", 0, F.concat(_le(F.lit(4), 2), _u16(F.lit("Body")), _le(F.lit(4), 2), _u16(F.lit("Base")), zero(2), _le(F.lit(1042), 2), zero(2), _le(F.lit(3), 2), _le(F.lit(4), 2))),
    )
    infos = docs.select("doc", F.lit("DocInfo").alias("stream"), F.posexplode(info).alias("ord", "r")).select("doc", "stream", F.col("ord").cast("long").alias("ord"), "r.tag_id", "r.level", F.unhex("r.hex").alias("payload"))
    return body.unionByName(infos)


def compound_files(spark, sf, faults: bool = False) -> DataFrame:
    """(doc, content): compound files of binary_records(), with a header and a picture."""
    streams = B.encode(binary_records(spark, sf, faults))
    docs = streams.select("doc").distinct()
    header = B.SIGNATURE.encode().ljust(32, b"\0") + bytes([1, 0, 1, 5]) + (1).to_bytes(4, "little")
    fixed = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(b).alias("logical")) for p, b in (("FileHeader", header.ljust(256, b"\0")), ("BinData/BIN0001.png", b"PNG" * 2000))])
    return B.rebuild(streams.unionByName(docs.select("doc", F.explode(fixed).alias("f")).select("doc", "f.*")))


def _records(spark, sf, faults: bool = False) -> tuple[DataFrame, DataFrame]:
    streams = kept(B.streams(compound_files(spark, sf, faults)), "streams")
    return streams, kept(B.records(streams), "records")


@query(f"{_NBASE} select distinct doc, unnest(['FileHeader', 'DocInfo', 'BinData/BIN0001.png']) as path, null::int as section from d union all select distinct doc, 'BodyText/Section' || section_index, section_index from d")
def binary_streams(spark, sf):
    """Streams of compound files; sections by number."""
    number = F.regexp_extract("path", r"^BodyText/Section(\d+)$", 1).try_cast("int")
    return B.streams(compound_files(spark, sf)).select("doc", "path", number.alias("section"))


_nvalues = ", ".join(f"('{s}', {k})" for s, ks in NATIVE_SELECTED.items() for k in ks)


@query(f"{_NBASE}, s(selector, k) as (values {_nvalues}) select selector, doc, section_index, paragraph::bigint as paragraph from d join s using (k)")
def binary_selectors(spark, sf):
    """Every selector of binary documents, with the paragraph of each control."""
    return B.select_all(B.controls(_records(spark, sf)[1])).select("selector", "doc", "section_index", "paragraph")


@query(f"{_NBASE} select doc, section_index, paragraph::bigint as paragraph, text || chr(13) as text, length(text) + 1 as char_count from d")
def binary_paragraphs(spark, sf):
    """Paragraphs of binary documents with their headers."""
    return B.paragraphs(_records(spark, sf)[1]).select("doc", "section_index", "paragraph", "text", "char_count")


@query(f"{_NBASE} select doc, string_agg(t, chr(10) order by section_index, paragraph) as text from (select *, regexp_replace(text || chr(10), '^\\n+|\\n+$', '', 'g') as t from d) where t <> '' group by doc")
def binary_text(spark, sf):
    """Text of binary documents: breaks at the ends of paragraphs go, empty ones too."""
    return B.document_text(B.paragraphs(_records(spark, sf)[1]))


@query(f"{_NBASE} select doc, 'HWP Document File' as signature, '5.1.0.1' as version, true as compressed, count(distinct section_index) as sections, any_value(conv_id) as at, 1::bigint as bin_data, 'png' as extension, 'Font ' || any_value(conv_id) as font, 'Body' as style, 'Base' as english, 3::bigint as para_shape from d group by doc")
def binary_docinfo(spark, sf):
    """File header, document properties, id mappings, and records of binary data, faces and styles."""
    streams, records = _records(spark, sf)
    out = B.file_header(streams).select("doc", "signature", "version", "compressed")
    out = out.join(B.document_properties(records).select("doc", F.col("section_count").alias("sections"), F.col("character_position").alias("at")), "doc")
    out = out.join(B.id_mappings(records).select("doc", F.col("counts")["bin_data"].alias("bin_data")), "doc").join(B.bin_data(records).select("doc", "extension"), "doc")
    out = out.join(B.face_names(records).select("doc", F.col("name").alias("font")), "doc")
    return out.join(B.styles(records).select("doc", F.col("name").alias("style"), F.col("english_name").alias("english"), F.col("para_shape_id").alias("para_shape")), "doc")


@query(f"{_NBASE}, i(doc, kind) as (select doc, 'docinfo_reference' from d where conv_id % 7 = 3 and turn = 0 union all select distinct doc, 'docinfo_mapping' from d where conv_id % 5 = 2) select doc, kind, count(*) as n from i group by all")
def binary_lint(spark, sf):
    """Issues of binary documents with planted faults."""
    return B.lint(*_records(spark, sf, faults=True)).groupBy("doc", "kind").agg(F.count("*").alias("n"))


@query(f"{_NBASE} select doc, k, count(*) as n from (select doc, case " + " ".join(f"when k = {i} then '{cid}'" for i, (cid, _) in enumerate(NATIVE)) + " end as k from d) group by all")
def binary_control_counts(spark, sf):
    """Controls of each kind: donors' summaries."""
    return B.counts(_records(spark, sf)[1]).select("doc", F.explode("control_counts").alias("k", "n"))


@query(f"{_NBASE} select distinct doc, true as same from d")
def binary_round_trip(spark, sf):
    """Records of rebuilt compound files are the same, stream by stream."""
    streams, records = _records(spark, sf)
    again = B.streams(B.rebuild(B.encode(records).unionByName(streams.where("path in ('FileHeader', 'BinData/BIN0001.png')").select("doc", "path", "logical"))))
    x, y = streams.select("doc", "path", F.sha2("logical", 256).alias("x")), again.select("doc", "path", F.sha2("logical", 256).alias("y"))
    return x.join(y, ["doc", "path"], "full_outer").groupBy("doc").agg(F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("same"))


# -- edits of whole documents ------------------------------------------------------------------


@query(f"{_BASE} select doc, count(distinct section_index) + 1 as sections, (count(distinct section_index) + 1)::varchar as declared, count(*) + count(*) filter (section_index = 0) as paragraphs, 0::bigint as issues from d group by doc")
def package_section_edits(spark, sf):
    """The first section cloned as the last: parts, the declared count, paragraphs, and issues of the package written and read again."""
    _, nodes = _read(packages(spark, sf))
    parts, again = _read(P.assemble(P.serialize(E.add_section(nodes, 0)).select("doc", F.lit(0).alias("entry_ord"), "path", "content")))
    top = again.where((F.col("depth") == 1) & (F.col("local") == "p") & F.col("section_index").isNotNull())
    out = top.groupBy("doc").agg(F.countDistinct("part").alias("sections"), F.count("*").alias("paragraphs"))
    declared = again.where((F.col("part") == E.HEADER) & (F.col("depth") == 0)).select("doc", F.col("attrs")["secCnt"].alias("declared"))
    issues = V.spine_itemref(parts, again).unionByName(V.header_section_count(parts, again)).unionByName(V.manifest_item(parts, again)).groupBy("doc").agg(F.count("*").alias("n"))
    return out.join(declared, "doc").join(issues, "doc", "left").select("doc", "sections", "declared", "paragraphs", F.coalesce("n", F.lit(0)).alias("issues"))


@query(f"{_BASE} select distinct doc, 'new title' as title, 'ko' as language, 'some words' as keyword, 'calm' as mood from d")
def package_metadata_edits(spark, sf):
    """Title replaced, a keyword added; the rest stays."""
    _, nodes = _read(packages(spark, sf))
    return N.metadata(E.set_metadata(nodes, title="new title", keyword="some words")).select("doc", "title", "language", "keyword", F.col("extra")["mood"].alias("mood"))


@query(f"{_BASE} select doc, paragraph, case when paragraph = 0 then case when k in (0, 1, 5, 6, 7) then 'in ' || n else '' end || 'set' else text || {_inner} end as text from d where section_index = 0")
def package_text_edits(spark, sf):
    """The first paragraph's own text set: runs with controls stay, without texts of their own, and the new text follows them; other runs go, and what is in them."""
    _, nodes = _read(packages(spark, sf))
    return N.paragraph_text(E.set_paragraph_text(nodes, 0, 0, "set")).where("section_index = 0").select("doc", "paragraph", "text")


@query(
    f"{_BASE}, b as (select doc, section_index, paragraph, 0 as place, 'paragraph' as kind, text || case when k between 12 and 15 then 'shown ' || n else '' end as text from d union all select doc, section_index, paragraph, 1, {_case}, null from d where k < 28 "
    "union all select doc, 0, 1000 + i, 0, kind, text from (select distinct doc from d) cross join (values (1, 'paragraph', 'end'), (2, 'bookmark', null), (3, 'note', 'n')) t(i, kind, text) union all select doc, max(section_index) + 1, 0, 0, 'paragraph', '' from d group by doc) "
    "select doc, section_index, row_number() over (partition by doc, section_index order by paragraph, place) - 1 as ord, kind, text from b"
)
def package_drafts(spark, sf):
    """Blocks appended to documents read from packages, to the first section and to a new one: all blocks in order."""
    from foliospark.operators.blocks import Draft

    _, nodes = _read(packages(spark, sf))
    base = N.blocks(nodes)
    draft = Draft(base.select("doc").distinct(), base)
    draft.append_paragraph("end").append_bookmark("m").append_footnote("n").append_section()
    return draft.blocks().select("doc", "section_index", F.col("ord").cast("long").alias("ord"), "kind", "text")


# -- drafts as binary documents ----------------------------------------------------------------


def _draft_files(spark, sf) -> DataFrame:
    """(doc, content): compound files of drafts, one a conversation, with a block of every kind."""
    from foliospark.operators import convert
    from foliospark.operators.blocks import Draft

    name = F.col("conv_id").cast("string")
    docs = _turns(spark, sf).select("doc", "conv_id").distinct()
    d = Draft(docs).append_paragraph(F.concat(F.lit("p "), name)).append_table(2, 2, [["a", "b"], ["c"]]).append_hyperlink(F.concat(F.lit("http://x.org/"), name), "shown").append_bookmark(F.concat(F.lit("m"), name))
    d.append_mail_merge_field("who", shown="w").append_calculation_field("1+2", shown="3").append_cross_reference("m", shown="see").append_doc_property_field("author", shown="me").append_date_field(shown="now")
    d.append_footnote(F.concat(F.lit("f "), name)).append_endnote("e").append("form", "label", name="n").append("memo", F.concat(F.lit("c "), name)).append("chart", "title").append("auto_number", num=7)
    d.append("header", "top").append("footer", F.concat(F.lit("page "), name)).append("equation", "x over y").append("shape", "in").append("shape", which="line").append("picture", data="UE5H").append("ole")
    return convert.to_binary(kept(d.blocks(), "blocks"))


#: What is read of a draft: kind, text and naming attribute, where `#` is the document's number.
_DRAWN = (
    ("table", '[["a","b"],["c",""]]', ""), ("hyperlink", "", "http://x.org/#"), ("bookmark", "", "m#"), ("field", "", "%mai"), ("field", "", "%for"), ("field", "", "%cro"), ("field", "", "%doc"), ("field", "", "%dat"), ("note", "f #", "footNote"),
    ("note", "e", "endNote"), ("form", "label", "n"), ("memo", "c #", ""), ("chart", "title", ""), ("auto_number", "", "newNum"), ("header", "top", "BOTH"), ("footer", "page #", "BOTH"), ("equation", "x over y", ""), ("shape", "in", "rect"), ("shape", "", "line"), ("picture", "", ""), ("ole", "", ""),
)
_drawn = ", ".join(f"({i}, '{k}', '{t}', '{n}')" for i, (k, t, n) in enumerate(_DRAWN))


@query(f"select 'c' || conv_id as doc, nth, kind, replace(text, '#', conv_id::varchar) as text, replace(name, '#', conv_id::varchar) as name from (select distinct conv_id from conversations) cross join (values {_drawn}) v(nth, kind, text, name)")
def binary_drafts(spark, sf):
    """Blocks of every kind written to compound files and read from them: texts and naming attributes, in order."""
    from foliospark.operators import convert
    from foliospark.operators import relational as R

    found = convert.binary_blocks(kept(B.records(B.streams(_draft_files(spark, sf))), "records")).where("kind <> 'paragraph'")
    at = lambda k: F.try_element_at("attrs", F.lit(k))
    name = F.when(F.col("kind") == "field", at("type")).when(F.col("kind").isin("header", "footer"), at("applyPageType")).otherwise(F.coalesce(at("url"), at("which"), at("name"), F.lit("")))
    return R.ordinal(found, ["doc"], [F.col("ord")], "nth", 0).select("doc", F.col("nth").cast("int").alias("nth"), "kind", F.coalesce("text", F.lit("")).alias("text"), name.alias("name"))


@query("select 'c' || conv_id as doc, 0::bigint as issues, 1::bigint as bin_data, 'p ' || conv_id as preview, true as fits from (select distinct conv_id from conversations)")
def binary_draft_checks(spark, sf):
    """Drafts as compound files: lint, binary data, preview, and the room of streams that did not change."""
    streams = kept(B.streams(_draft_files(spark, sf)), "streams")
    records = kept(B.records(streams), "records")
    issues = B.lint(streams, records).groupBy("doc").agg(F.count("*").alias("n"))
    preview = streams.where("path = 'PrvText'").select("doc", F.decode("logical", "UTF-16LE").alias("preview"))
    room = B.capacities(streams).groupBy("doc").agg(F.bool_and("fits").alias("fits"))
    out = B.id_mappings(records).select("doc", F.col("counts")["bin_data"].alias("bin_data")).join(preview, "doc").join(room, "doc").join(issues, "doc", "left")
    return out.select("doc", F.coalesce("n", F.lit(0)).alias("issues"), "bin_data", "preview", "fits")

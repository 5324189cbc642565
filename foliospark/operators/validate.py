"""Validation rules of document packages: each a function of (parts, nodes) to issues; suites are unions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import bool_like, first_filled, normal_path
from foliospark.operators import nodes as N
from foliospark.operators.nodes import attr, children, within
from foliospark.sources.packages import MIMETYPE

ISSUE = ("doc", "kind", "message", "code", "part_path", "section_index", "paragraph_index", "cell_row", "cell_column", "xpath", "line", "column", "context", "hint")
_INTS = ("section_index", "paragraph_index", "cell_row", "cell_column", "line", "column")
HPF, HEADER = "Contents/content.hpf", "Contents/header.xml"

Rule = Callable[[DataFrame, DataFrame], DataFrame]


def issues(rows: DataFrame, kind: str, message: Column | str, **columns) -> DataFrame:
    """Rows as issues; the code is the kind, columns not given are null."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    given = {"kind": lit(kind), "code": lit(kind), "message": lit(message)} | {k: lit(v) for k, v in columns.items()}
    return rows.select("doc", *[given.get(c, F.lit(None)).cast("int" if c in _INTS else "string").alias(c) for c in ISSUE[1:]])


def _say(text: str, *values: Column) -> Column:
    return F.format_string(text, *values)


def _repeats(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc", *keys).orderBy("part", "pre") if "part" in rows.columns else Window.partitionBy("doc", *keys).orderBy("pre"))).where("_n > 1")


def protected(nodes: DataFrame) -> DataFrame:
    """Documents whose distribution flag protects them."""
    return nodes.where((F.col("part") == HPF) & (F.col("depth") == 0) & (attr("{http://www.hancom.co.kr/schema/2011/hpf}distribution") == "1")).select("doc").distinct()


def _place(**more):
    return {"part_path": F.col("part"), "section_index": F.col("section_index"), "paragraph_index": F.col("paragraph")} | more


# -- basic rules ------------------------------------------------------------------------


def missing_part(parts, nodes):
    need = F.array(*map(F.lit, ("mimetype", "version.xml", HPF, "META-INF/container.xml", HEADER)))
    want = parts.select("doc").distinct().select("doc", F.explode(need).alias("path"))
    exempt = protected(nodes).withColumn("path", F.lit(HEADER))
    rows = want.join(exempt, ["doc", "path"], "left_anti").join(parts, ["doc", "path"], "left_anti")
    return issues(rows, "missing_part", _say("Missing required part: %s", F.col("path")), part_path=F.col("path"))


def duplicate_zip_entry(parts, nodes):
    rows = parts.where("copies > 1").groupBy("doc").agg(F.array_join(F.sort_array(F.collect_set("path")), ", ").alias("p"))
    return issues(rows, "duplicate_zip_entry", _say("Duplicate zip entries found: %s", F.col("p")))


def mimetype(parts, nodes):
    rows = parts.where((F.col("path") == "mimetype") & (F.trim(F.decode("content", "UTF-8")) != MIMETYPE))
    return issues(rows, "mimetype", f"mimetype must be {MIMETYPE}", part_path="mimetype")


def xml_serialization(parts, nodes):
    return issues(nodes.where("error is not null"), "xml_serialization", _say("Invalid XML part serialization: %s", F.col("error")), part_path=F.col("part"))


def container_reference(parts, nodes):
    roots = nodes.where("part = 'META-INF/container.xml' and local = 'rootfile'").select("doc", normal_path(attr("full-path")).alias("path")).where("path <> 'Preview/PrvText.txt'")
    rows = roots.join(parts, ["doc", "path"], "left_anti")
    return issues(rows, "container_reference", _say("container.xml references missing rootfile: %s", F.col("path")), part_path="META-INF/container.xml")


def manifest_item(parts, nodes):
    items = N.manifest(nodes)
    has_id, has_href = F.coalesce("id", F.lit("")) != "", F.coalesce("href", F.lit("")) != ""
    out = [
        issues(items.where(~has_id), "manifest_item", "content.hpf manifest item is missing id", part_path=HPF),
        issues(_repeats(items.where(has_id), "id"), "manifest_item", _say("Duplicate content.hpf manifest id: %s", F.col("id")), part_path=HPF),
        issues(items.where(~has_href), "manifest_item", "content.hpf manifest item is missing href", part_path=HPF),
        issues(_repeats(items.where(has_href & has_id), "path"), "manifest_item", _say("Duplicate content.hpf manifest href: %s", F.col("path")), part_path=HPF),
    ]
    return reduce(DataFrame.unionByName, out)


def manifest_reference(parts, nodes):
    rows = N.manifest(nodes).where("href <> ''").join(parts, ["doc", "path"], "left_anti")
    return issues(rows, "manifest_reference", _say("content.hpf manifest references missing part: %s", F.col("href")), part_path=HPF)


def spine_itemref(parts, nodes):
    refs = N.spine(nodes)
    named = refs.where("idref <> ''")
    unknown = named.join(N.manifest(nodes).select("doc", F.col("id").alias("idref")), ["doc", "idref"], "left_anti")
    missing = refs.where("idref is null or idref = ''")
    return issues(missing, "spine_itemref", "content.hpf spine itemref is missing idref", part_path=HPF).unionByName(issues(unknown, "spine_itemref", _say("content.hpf spine references unknown manifest id: %s", F.col("idref")), part_path=HPF))


def header_section_count(parts, nodes):
    actual = parts.groupBy("doc").agg(F.count_if(F.col("kind") == "section").alias("n"))
    rows = nodes.where((F.col("part") == HEADER) & (F.col("depth") == 0)).select("doc", attr("secCnt").try_cast("long").alias("declared")).join(actual, "doc").where("declared <> 0 and declared <> n")
    return issues(rows, "header_section_count", _say("header.xml secCnt=%d does not match section count=%d", F.col("declared"), F.col("n")), part_path=HEADER)


def document_structure(parts, nodes):
    rows = parts.groupBy("doc").agg(F.count_if(F.col("kind") == "section").alias("n")).where("n = 0").join(protected(nodes), "doc", "left_anti")
    return issues(rows, "document_structure", "Document must contain at least one section part")


def paragraph_layout_cache(parts, nodes):
    """Line segments of a paragraph that begin beyond its text (or anywhere in an empty one)."""
    segs = children(nodes, "lineseg").select("doc", "part", F.try_element_at("ancestors", F.lit(-2)).alias("p"), attr("textpos").try_cast("int").alias("textpos"))
    top = segs.groupBy("doc", "part", F.col("p").alias("pre")).agg(F.max("textpos").alias("most"))
    text = nodes.where("local = 't'").select("doc", "part", F.try_element_at("ancestors", F.lit(-2)).alias("pre"), F.length(F.concat(F.coalesce("text", F.lit("")))).alias("n")).groupBy("doc", "part", "pre").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    other = within(nodes.where("local not in ('t', 'run', 'p', 'linesegarray', 'lineseg')"), children(nodes, "p"), "p").select("doc", "part", F.col("p").alias("pre")).distinct().withColumn("mixed", F.lit(True))
    captions = within(children(nodes, "p"), children(nodes, "caption")).select("doc", "part", "pre").distinct().withColumn("in_caption", F.lit(True))
    rows = children(nodes, "p").where("section_index is not null").join(top, ["doc", "part", "pre"])
    for extra in (text, other, captions):
        rows = rows.join(extra, ["doc", "part", "pre"], "left")
    n = F.coalesce("n", F.lit(0))
    empty = (n == 0) & F.col("mixed").isNull() & (F.col("most") > 0)
    plain = (F.col("texts") == 1) & F.col("mixed").isNull() & (n > 0) & (F.col("most") > n)
    caption = F.col("in_caption") & (n > 0) & (F.col("most") > n)
    said = (
        F.when(caption, "Caption paragraph carries line segment positions beyond the caption text length.")
        .when(plain, "Plain-text paragraph carries line segment positions beyond the text length.")
        .when(empty, "Empty paragraph carries stale line segment positions.")
    )
    rows = rows.withColumn("said", said).where("said is not null")
    return issues(rows, "paragraph_layout_cache", F.col("said"), **_place(xpath="./hp:linesegarray", context=_say("max_textpos=%d;text_len=%d", F.col("most"), n)))


BASIC: tuple[Rule, ...] = (missing_part, duplicate_zip_entry, mimetype, xml_serialization, container_reference, manifest_item, manifest_reference, spine_itemref, header_section_count, document_structure, paragraph_layout_cache)

# -- structure ----------------------------------------------------------------------------

#: The root element of each part.
ROOTS = {"version.xml": "HCFVersion", HPF: "package", HEADER: "head", "settings.xml": "HWPApplicationSetting", "META-INF/container.xml": "container", "META-INF/manifest.xml": "manifest", "META-INF/container.rdf": "RDF"}


def xml_part_type(parts, nodes):
    rows = parts.where(F.col("path").isin(*ROOTS) & (F.col("kind") == "binary_other"))
    return issues(rows, "xml_part_type", _say("%s is expected to be XML but is loaded as %s", F.col("path"), F.col("kind")), part_path=F.col("path"))


def xml_root(parts, nodes):
    want = F.create_map(*[F.lit(x) for kv in ROOTS.items() for x in kv])[F.col("part")]
    expected = F.coalesce(want, F.when(F.col("section_index").isNotNull(), "sec"))
    rows = nodes.where("depth = 0").withColumn("want", expected).where("want <> local")
    return issues(rows, "xml_root", _say("%s root element must be %s, got %s", F.col("part"), F.col("want"), F.col("local")), part_path=F.col("part"), section_index=F.col("section_index"))


def section_structure(parts, nodes):
    rows = nodes.where("depth = 0 and section_index is not null").join(nodes.where("depth = 1 and local = 'p'").select("doc", "part"), ["doc", "part"], "left_anti")
    return issues(rows, "section_structure", _say("%s must contain at least one paragraph", F.col("part")), part_path=F.col("part"), section_index=F.col("section_index"))


def table_structure(parts, nodes):
    n = lambda a: F.coalesce(attr(a).try_cast("int"), F.lit(0))
    rows = children(nodes, "tbl").where((n("rowCnt") < 1) | (n("colCnt") < 1))
    return issues(rows, "table_structure", _say("%s contains a table with invalid row/column count", F.col("part")), part_path=F.col("part"), section_index=F.col("section_index"))


def table_cell_span(parts, nodes):
    rows = N.cells(nodes).where("row_span < 1 or col_span < 1")
    return issues(rows, "table_cell_span", _say("%s table cell has invalid span", F.col("part")), part_path=F.col("part"), cell_row=F.col("row"), cell_column=F.col("column"))


STRUCTURE: tuple[Rule, ...] = (xml_part_type, xml_root, section_structure, table_structure, table_cell_span)

# -- references -----------------------------------------------------------------------------


def bookmark(parts, nodes):
    marks = N.select(nodes, "bookmarks").withColumn("name", attr("name"))
    unnamed = marks.where("name is null or name = ''")
    return issues(unnamed, "bookmark", "bookmark is missing name").unionByName(issues(_repeats(marks.where("name <> ''"), "name"), "bookmark", _say("duplicate bookmark name: %s", F.col("name"))))


def field_reference(parts, nodes):
    begins = children(nodes, "fieldBegin").withColumn("id", attr("id")).withColumn("fieldid", attr("fieldid"))
    # Of equal ids the last counts, in the whole document.
    known = begins.where("id <> ''").groupBy("doc", "id").agg(F.max_by(F.coalesce("fieldid", F.lit("")), F.struct("part", "pre")).alias("expected"))
    ends = children(nodes, "fieldEnd").withColumn("id", attr("beginIDRef")).withColumn("fieldid", attr("fieldid"))
    named = ends.where("id <> ''").join(known, ["doc", "id"], "left")
    out = [
        issues(_repeats(begins.where("id <> ''"), "id"), "field_reference", _say("duplicate fieldBegin id: %s", F.col("id"))),
        issues(_repeats(begins.where("fieldid <> ''"), "fieldid"), "field_reference", _say("duplicate fieldid: %s", F.col("fieldid"))),
        issues(ends.where("id is null or id = ''"), "field_reference", "fieldEnd is missing beginIDRef", **_place()),
        issues(named.where("expected is null"), "field_reference", _say("fieldEnd references unknown fieldBegin id %s", F.col("id")), **_place()),
        issues(named.where("expected <> '' and fieldid <> '' and expected <> fieldid"), "field_reference", _say("fieldEnd fieldid=%s does not match fieldBegin fieldid=%s", F.col("fieldid"), F.col("expected")), **_place()),
    ]
    return reduce(DataFrame.unionByName, out)


def style_reference(parts, nodes):
    out = []
    for rows, ref, selector in (("p", "styleIDRef", "styles"), ("p", "paraPrIDRef", "paragraph_styles"), ("run", "charPrIDRef", "character_styles")):
        ids = N.select(nodes, selector).select("doc", attr("id").alias("ref")).where("ref is not null").join(protected(nodes), "doc", "left_anti").distinct()
        used = children(nodes, rows).where("section_index is not null").withColumn("ref", attr(ref)).where("ref <> ''")
        unknown = used.join(ids.select("doc").distinct(), "doc", "left_semi").join(ids, ["doc", "ref"], "left_anti")
        name = "paragraph" if rows == "p" else "run"
        out.append(issues(unknown, "style_reference", _say(f"{name} references unknown {ref}=%s", F.col("ref")), **_place()))
    return reduce(DataFrame.unionByName, out)


def binary_reference(parts, nodes):
    """Pictures, shapes and oles whose binary item the manifest lacks."""
    ids = N.manifest(nodes).select("doc", F.col("id").alias("ref"))
    refs = nodes.where(attr("binaryItemIDRef").isNotNull() & (attr("binaryItemIDRef") != "") & F.col("section_index").isNotNull()).withColumn("ref", attr("binaryItemIDRef"))
    owner = F.when(F.col("local").isin("img", "pic"), "picture").when(F.col("local") == "ole", "ole").otherwise("shape")
    rows = refs.join(ids, ["doc", "ref"], "left_anti")
    return issues(rows, "binary_reference", _say("%s references unknown manifest id %s", owner, F.col("ref")), **_place())


def chart_reference(parts, nodes):
    charts = N.select(nodes, "charts").withColumn("ref", attr("chartIDRef"))
    missing = charts.where("ref is null or ref = ''")
    lost = charts.where("ref <> ''").withColumn("path", normal_path(F.col("ref"))).join(parts.select("doc", "path"), ["doc", "path"], "left_anti")
    return issues(missing, "chart_reference", "chart is missing chartIDRef", **_place()).unionByName(issues(lost, "chart_reference", _say("chart references missing chart part: %s", F.col("ref")), **_place()))


def cross_reference(parts, nodes):
    marks = N.select(nodes, "bookmarks").select("doc", attr("name").alias("target"))
    rows = N.fields(nodes).where("type = 'CROSSREF' and target <> ''").join(marks, ["doc", "target"], "left_anti")
    return issues(rows, "cross_reference", _say("cross reference points to unknown bookmark: %s", F.col("target")), **_place())


def memo_metadata(parts, nodes):
    """Flags and order of the fields that carry memos."""
    carriers = N.fields(nodes).where(F.upper("type").endswith("_MEMO"))
    visible, order = F.col("params")["Visible"], F.col("params")["Order"]
    a = issues(carriers.where(~bool_like(visible)), "metadata_schema", "memo carrier Visible parameter must be a bool-like literal.", **_place())
    return a.unionByName(issues(carriers.where(order.isNotNull() & order.try_cast("long").isNull()), "metadata_schema", "memo carrier Order parameter must be an integer.", **_place()))


REFERENCES: tuple[Rule, ...] = (bookmark, field_reference, style_reference, binary_reference, chart_reference, cross_reference, memo_metadata)

# -- strict lint -------------------------------------------------------------------------------


def mimetype_packaging(parts, nodes):
    m = parts.where("path = 'mimetype'")
    return issues(m.where("entry_ord <> 0"), "mimetype_packaging", "mimetype must be the first package entry", part_path="mimetype").unionByName(issues(m.where("not stored"), "mimetype_packaging", "mimetype must be stored without compression", part_path="mimetype"))


def memo_reference(parts, nodes):
    head = nodes.where(F.col("part") == HEADER).join(protected(nodes), "doc", "left_anti")
    shapes = children(head, "memoPr").withColumn("id", attr("id"))
    counts = shapes.groupBy("doc", F.col("parent").alias("pre")).agg(F.count("*").alias("n"))
    wrong = children(head, "memoProperties").join(counts, ["doc", "pre"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("declared", attr("itemCnt")).where("declared <> '' and declared <> cast(n as string)")
    secs = nodes.where("local = 'secPr' and paragraph = 0 and section_index is not null").groupBy("doc", "part", "section_index").agg(F.min_by(attr("memoShapeIDRef"), "pre").alias("id")).where("id <> '' and id <> '0'")
    unknown = secs.join(protected(nodes), "doc", "left_anti").join(shapes.select("doc", "id"), ["doc", "id"], "left_anti")
    out = [
        issues(wrong, "memo_reference", _say("memoProperties itemCnt=%s does not match memoPr count=%d", F.col("declared"), F.col("n")), part_path=HEADER),
        issues(_repeats(shapes.where("id <> ''"), "parent", "id"), "memo_reference", _say("Duplicate hh:memoPr id: %s", F.col("id")), part_path=HEADER),
        issues(unknown, "memo_reference", _say("memoShapeIDRef points to unknown hh:memoPr id %s", F.col("id")), part_path=F.col("part"), section_index=F.col("section_index")),
    ]
    return reduce(DataFrame.unionByName, out)


def style_binding(parts, nodes):
    """Paragraphs and runs without the style references that the document has definitions for."""
    out = []
    for rows, ref, selector in (("p", "styleIDRef", "styles"), ("p", "paraPrIDRef", "paragraph_styles"), ("run", "charPrIDRef", "character_styles")):
        defined = N.select(nodes, selector).where(attr("id").isNotNull()).select("doc").distinct().join(protected(nodes), "doc", "left_anti")
        bare = children(nodes, rows).where(F.col("section_index").isNotNull() & (F.coalesce(attr(ref), F.lit("")) == "")).join(defined, "doc", "left_semi")
        out.append(issues(bare, "style_binding", f"{'paragraph' if rows == 'p' else 'run'} is missing {ref}", **_place()))
    return reduce(DataFrame.unionByName, out)


def _lacks(rows: DataFrame, nodes: DataFrame, child: str) -> DataFrame:
    return rows.join(children(nodes, child).select("doc", "part", F.col("parent").alias("pre")), ["doc", "part", "pre"], "left_anti")


def control_subtree(parts, nodes):
    """Children that controls can't be without."""
    forms, charts = N.select(nodes, "forms"), N.select(nodes, "charts")
    out = [issues(_lacks(rows, nodes, c), "control_subtree", _say(f"%s is missing hp:{c}", F.col("local")), **_place()) for rows in (forms, charts) for c in ("sz", "pos", "outMargin")]
    captions = children(nodes, "caption").join(forms.select("doc", "part", F.col("pre").alias("parent"), F.col("local").alias("form")), ["doc", "part", "parent"])
    out.append(issues(_lacks(captions, nodes, "subList"), "control_subtree", _say("%s caption is missing hp:subList", F.col("form")), **_place()))
    out.append(issues(_lacks(forms.where("local <> 'scrollBar'"), nodes, "formCharPr"), "control_subtree", _say("%s is missing hp:formCharPr", F.col("local")), **_place()))
    out.append(issues(_lacks(forms.where("local = 'edit'"), nodes, "text"), "control_subtree", "edit is missing hp:text", **_place()))
    out.append(issues(_lacks(N.select(nodes, "memos"), nodes, "subList"), "control_subtree", "hiddenComment is missing hp:subList", **_place()))
    return reduce(DataFrame.unionByName, out)


def form_metadata(parts, nodes):
    """JSON that form commands carry after their prefix: an object, with texts and a list of texts."""
    forms = N.select(nodes, "forms").withColumn("json", F.regexp_extract(F.coalesce(attr("command"), F.lit("")), r"(?s)^[A-Z]+_FORM_META:(.*)$", 1)).where("json <> ''")
    forms = forms.withColumn("v", F.try_parse_json("json")).withColumn("shape", F.schema_of_variant("v"))
    field = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    bad = lambda cond, text: issues(forms.where(cond), "metadata_schema", _say(f"%s {text}", F.col("local")), **_place())
    out = [
        bad(F.col("v").isNull(), "command metadata must be valid JSON"),
        bad(~F.col("shape").startswith("OBJECT"), "command metadata must decode to a JSON object."),
        bad(~field("placeholder").isin("STRING", "VOID"), "placeholder metadata must be a string."),
        bad(~field("items").startswith("ARRAY") & (field("items") != "VOID"), "items metadata must be a list."),
        bad(field("items").startswith("ARRAY") & ~field("items").isin("ARRAY<STRING>", "ARRAY<VOID>"), "items metadata entries must be strings."),
        bad(~field("label").isin("STRING", "VOID"), "label metadata must be a string."),
    ]
    return reduce(DataFrame.unionByName, out)


def chart_closure(parts, nodes):
    """Charts stand in a switch with a fallback; chart parts, references and the manifest agree."""
    charts = N.select(nodes, "charts")
    cases = children(nodes, "case").select("doc", "part", F.col("pre").alias("parent"), F.col("parent").alias("switch"))
    switches = children(nodes, "switch").select("doc", "part", F.col("pre").alias("switch"))
    wrapped = charts.join(cases.join(switches, ["doc", "part", "switch"]), ["doc", "part", "parent"])
    bare = charts.join(cases.join(switches, ["doc", "part", "switch"]), ["doc", "part", "parent"], "left_anti")
    oles = children(nodes, "ole").select("doc", "part", "pre", "parent").join(children(nodes, "default").select("doc", "part", F.col("pre").alias("parent"), F.col("parent").alias("switch")), ["doc", "part", "parent"])
    no_ole = wrapped.join(oles, ["doc", "part", "switch"], "left_anti")
    turned = oles.join(children(nodes, "rotationInfo").select("doc", "part", F.col("parent").alias("pre")), ["doc", "part", "pre"], "left_semi")
    no_turn = wrapped.join(oles, ["doc", "part", "switch"], "left_semi").join(turned, ["doc", "part", "switch"], "left_anti")
    own = parts.where(F.col("path").startswith("Chart/"))
    used = charts.select("doc", normal_path(attr("chartIDRef")).alias("path"))
    out = [
        issues(bare, "chart_closure", "native hp:chart control must be wrapped by hp:switch/hp:case", **_place()),
        issues(no_ole, "chart_closure", "native hp:chart control is missing hp:default/hp:ole fallback", **_place()),
        issues(no_turn, "chart_closure", "native hp:chart fallback hp:ole is missing hp:rotationInfo", **_place()),
        issues(own.join(used, ["doc", "path"], "left_anti"), "chart_closure", _say("Chart part is not referenced by any native hp:chart control: %s", F.col("path")), part_path=F.col("path")),
        issues(own.where("kind <> 'xml'"), "chart_closure", _say("Chart part must be XML: %s", F.col("path")), part_path=F.col("path")),
        issues(own.join(N.manifest(nodes).select("doc", "path"), ["doc", "path"], "left_anti"), "chart_closure", _say("Chart part is not declared in content.hpf manifest: %s", F.col("path")), part_path=F.col("path")),
    ]
    return reduce(DataFrame.unionByName, out)


def binary_closure(parts, nodes):
    """Binary parts are in the manifest, binary items are used, and item references lead to binary parts."""
    data = parts.where("kind = 'bindata'")
    items = N.manifest(nodes)
    binary = items.where(F.col("path").startswith("BinData/") & (F.col("id") != ""))
    used = nodes.where(attr("binaryItemIDRef") != "").select("doc", "part", "section_index", "paragraph", attr("binaryItemIDRef").alias("id"))
    stray = used.join(items.select("doc", "id", "path"), ["doc", "id"]).where(~F.col("path").startswith("BinData/"))
    # Media types by suffix.
    types = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "bmp": "image/bmp", "gif": "image/gif", "svg": "image/svg+xml", "ole": "application/ole"}
    expected = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))]
    wrong = binary.withColumn("expected", expected).where("media_type <> '' and expected <> media_type and not (expected = 'image/jpeg' and media_type = 'image/jpg')")
    out = [
        issues(data.join(items.select("doc", "path"), ["doc", "path"], "left_anti"), "binary_closure", _say("BinData part is not referenced by content.hpf manifest: %s", F.col("path")), part_path=F.col("path")),
        issues(binary.join(used.select("doc", "id"), ["doc", "id"], "left_anti"), "binary_closure", _say("manifest binary item is not referenced by any control: %s", F.col("id")), part_path=HPF),
        issues(stray, "binary_closure", _say("binaryItemIDRef %s must resolve to a BinData part, got %s", F.col("id"), F.col("path")), **_place()),
        issues(wrong, "binary_media_type", _say("manifest media-type %s does not match expected %s for %s", F.col("media_type"), F.col("expected"), F.col("path")), part_path=HPF),
    ]
    return reduce(DataFrame.unionByName, out)


STRICT: tuple[Rule, ...] = (mimetype_packaging, memo_reference, style_binding, control_subtree, form_metadata, chart_closure, binary_closure)

SUITES = {"basic": BASIC, "xml": STRUCTURE, "reference": BASIC + REFERENCES, "strict": BASIC + REFERENCES + STRICT}


def validate(parts: DataFrame, nodes: DataFrame, suite: str = "basic") -> DataFrame:
    """All issues of a suite. `nodes` is read by every rule: cache it, or read it from a table."""
    return reduce(DataFrame.unionByName, [rule(parts, nodes) for rule in SUITES[suite]])


def control_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Controls of paragraphs that an edit has lost, as multisets of N.signature()."""
    key = ["doc", "section_index", "paragraph", "label"]
    rows = before.join(after.withColumnRenamed("n", "m"), key, "left").where(F.col("n") > F.coalesce("m", F.lit(0)))
    return issues(rows, "control_preservation", _say("lost %d of %s", F.col("n") - F.coalesce("m", F.lit(0)), F.col("label")), section_index=F.col("section_index"), paragraph_index=F.col("paragraph"))


def location(row: str = "") -> Column:
    """Where an issue is, in words; nulls are left out."""
    labelled = lambda label, c: F.concat(F.lit(f"{label}="), F.col(c).cast("string"))
    return F.concat_ws(" ", "part_path", labelled("section", "section_index"), "context", labelled("paragraph", "paragraph_index"), labelled("row", "cell_row"), labelled("column", "cell_column"), "xpath", labelled("line", "line"))


def report(found: DataFrame) -> DataFrame:
    """(doc, text): numbered lines of a document's issues."""
    order = Window.partitionBy("doc").orderBy("kind", "message", location())
    lines = found.withColumn("n", F.row_number().over(order)).withColumn("line_text", F.format_string("%d. [%s] %s: %s", F.col("n"), F.col("code"), location(), F.col("message")))
    return lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line_text"))), lambda s: s.line_text), "\n").alias("text"))

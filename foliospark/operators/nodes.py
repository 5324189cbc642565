"""Selectors, text and projections over the node table of document packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import first_filled, hyperlink_parts, key_values, normal_path

#: Form tags, shape tags in their order, and the names that field types go by.
FORMS = ("checkBtn", "radioBtn", "btn", "edit", "comboBox", "listBox", "scrollBar")
SHAPES = ("rect", "line", "ellipse", "arc", "polygon", "curve", "connectLine", "textart", "container", "ole")
GRAPHICS = ("tbl", "pic", *SHAPES)
MAIL_MERGE = ("%MAI", "MAILMERGE", "MAIL_MERGE", "MERGEFIELD")
CALCULATION = ("%FOR", "%CAL", "CALCULATE", "CALC", "FORMULA")
CROSS_REFERENCE = ("%REF", "%PAG", "%CRO", "REF", "PAGEREF", "BOOKMARKREF", "CROSSREF", "CROSS_REF")
#: Selector -> tags. Where there are several and the selector is tag-major, the order of tags comes before that of nodes.
TAGS = {
    "headers": ("header",), "footers": ("footer",), "tables": ("tbl",), "pictures": ("pic",), "oles": ("ole",), "notes": ("footNote", "endNote"), "memos": ("hiddenComment",),
    "forms": FORMS, "charts": ("chart",), "bookmarks": ("bookmark",), "fields": ("fieldBegin",), "auto_numbers": ("autoNum", "newNum"), "equations": ("equation",), "shapes": SHAPES,
    "styles": ("style",), "paragraph_styles": ("paraPr",), "character_styles": ("charPr",), "memo_shapes": ("memoPr",),
}
TAG_MAJOR = ("notes", "auto_numbers", "shapes")
IN_HEADER = ("styles", "paragraph_styles", "character_styles", "memo_shapes")
FIELD_TYPES = {"hyperlinks": ("HYPERLINK",), "mail_merge_fields": MAIL_MERGE, "calculation_fields": CALCULATION, "cross_references": CROSS_REFERENCE}


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def field_type() -> Column:
    return F.upper(F.trim(attr("type")))


def semantic_type(kind: Column) -> Column:
    """Canonical type of a field; one that has no alias keeps its own."""
    return F.when(kind.isin(*MAIL_MERGE), "MAILMERGE").when(kind.isin(*CALCULATION), "FORMULA").when(kind.isin(*CROSS_REFERENCE), "CROSSREF").otherwise(kind)


def select(nodes: DataFrame, selector: str, section_index: int | None = None) -> DataFrame:
    """Rows of a selector with their order `ord` in the document."""
    if selector in FIELD_TYPES:
        rows = nodes.where((F.col("local") == "fieldBegin") & field_type().isin(*FIELD_TYPES[selector]))
    else:
        rows = nodes.where(F.col("local").isin(*TAGS[selector]))
    rows = rows.where(F.col("part") == "Contents/header.xml") if selector in IN_HEADER else rows.where(F.col("section_index").isNotNull())
    if "ole" in TAGS.get(selector, ()):
        rows = without_chart_fallbacks(rows, nodes)
    if section_index is not None:
        rows = rows.where(F.col("section_index") == section_index)
    major = F.array_position(F.array(*map(F.lit, TAGS[selector])), F.col("local")) if selector in TAG_MAJOR else F.lit(0)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy(F.col("section_index").asc_nulls_first(), major, "pre")) - 1)


def select_all(nodes: DataFrame) -> DataFrame:
    """Rows with each `selector` that finds them and their order `ord` in its result: all selectors in one pass."""
    tags = sorted({t for ts in TAGS.values() for t in ts})
    entry = lambda s, major: F.struct(F.lit(s).alias("selector"), F.lit(major).alias("major"))
    in_header, in_section = (F.create_map(*[x for t in tags for x in (F.lit(t), F.array(*[entry(s, ts.index(t) + 1 if s in TAG_MAJOR else 0) for s, ts in TAGS.items() if t in ts and (s in IN_HEADER) == header]).cast("array<struct<selector:string,major:int>>"))]) for header in (True, False))
    fields = F.filter(F.array(*[F.when(field_type().isin(*kinds), entry(s, 0)) for s, kinds in FIELD_TYPES.items()]), lambda e: e.isNotNull())
    known = nodes.where(F.col("local").isin(*tags) & ((F.col("part") == "Contents/header.xml") | F.col("section_index").isNotNull()))
    own = F.when(F.col("part") == "Contents/header.xml", in_header[F.col("local")]).otherwise(in_section[F.col("local")])
    both = F.when(F.col("local") == "fieldBegin", F.concat(own, fields)).otherwise(own)
    rows = without_chart_fallbacks(known, nodes).withColumn("_s", F.explode(both)).withColumns({"selector": F.col("_s.selector"), "_major": F.col("_s.major")})
    order = Window.partitionBy("doc", "selector").orderBy(F.col("section_index").asc_nulls_first(), "_major", "pre")
    return rows.withColumn("ord", F.row_number().over(order) - 1).drop("_s", "_major")


def within(rows: DataFrame, ancestors: DataFrame, name: str = "ancestor") -> DataFrame:
    """Pairs of rows with those of `ancestors` (doc, part, pre) they lie in, by their lists of ancestors."""
    own = rows.withColumn("_up", F.explode("ancestors"))
    up = ancestors.select(F.col("doc").alias("_d"), F.col("part").alias("_p"), F.col("pre").alias(name))
    return own.join(up, (own.doc == up["_d"]) & (own.part == up["_p"]) & (own["_up"] == up[name])).drop("_d", "_p", "_up")


def children(nodes: DataFrame, *tags: str) -> DataFrame:
    return nodes.where(F.col("local").isin(*tags))


def without_chart_fallbacks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows but for oles in the default of a switch whose case holds a chart."""
    cases = children(nodes, "chart").select("doc", "part", F.col("parent").alias("pre")).join(children(nodes, "case").select("doc", "part", "pre", F.col("parent").alias("switch")), ["doc", "part", "pre"])
    defaults = children(nodes, "default").join(cases.select("doc", "part", F.col("switch").alias("parent")).distinct(), ["doc", "part", "parent"], "left_semi")
    hidden = within(children(rows, "ole"), defaults).select("doc", "part", "pre").distinct()
    return rows.join(hidden, ["doc", "part", "pre"], "left_anti")


# -- text -----------------------------------------------------------------------------


def paragraph_text(nodes: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, text): all text inside each top-level paragraph, tables and notes in it too."""
    all_ = nodes.where((F.col("section_index").isNotNull()) & (F.col("depth") == 1) & (F.col("local") == "p")).select("doc", "section_index", "paragraph")
    texts = nodes.where((F.col("local") == "t") & F.col("section_index").isNotNull() & F.col("paragraph").isNotNull())
    joined = texts.groupBy("doc", "section_index", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: F.coalesce(s.text, F.lit(""))), "").alias("text"))
    return all_.join(joined, ["doc", "section_index", "paragraph"], "left").select("doc", "section_index", "paragraph", F.coalesce("text", F.lit("")).alias("text"))


def _join(rows: DataFrame, group: list[str], order: str, separator: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s.text), separator).alias("text"))


def section_text(nodes: DataFrame) -> DataFrame:
    return _join(paragraph_text(nodes), ["doc", "section_index"], "paragraph", "\n")


def document_text(nodes: DataFrame) -> DataFrame:
    """Paragraphs by line breaks, sections by blank lines; empty ones stay."""
    return _join(section_text(nodes), ["doc"], "section_index", "\n\n")


# -- projections ------------------------------------------------------------------------


def metadata(nodes: DataFrame) -> DataFrame:
    """(doc, title, language, creator, ..., extra): of equal names the last counts, other names go to a map."""
    hpf = nodes.where("part = 'Contents/content.hpf'")
    meta = hpf.where("local = 'meta'").select("doc", attr("name").alias("name"), F.coalesce("text", F.lit("")).alias("value"), "pre").where("name is not null and name <> ''")
    last = meta.groupBy("doc", "name").agg(F.max_by("value", "pre").alias("value"))
    # The names that have columns.
    named = {"creator": "creator", "subject": "subject", "description": "description", "lastsaveby": "lastsaveby", "CreatedDate": "created", "ModifiedDate": "modified", "date": "date", "keyword": "keyword"}
    first = lambda tag: F.min_by(F.when(F.col("local") == tag, F.col("text")), F.when(F.col("local") == tag, F.col("pre")))
    base = hpf.groupBy("doc").agg(first("title").alias("title"), first("language").alias("language"))
    pick = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(c) for n, c in named.items()]
    entry = F.when(~F.col("name").isin(*named), F.struct("name", "value"))
    rest = last.groupBy("doc").agg(*pick, F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("extra"))
    return base.join(rest, "doc", "left")


def manifest(nodes: DataFrame) -> DataFrame:
    """(doc, pre, id, href, media_type, path) of the manifest's items."""
    rows = nodes.where("part = 'Contents/content.hpf' and local = 'item'")
    return rows.select("doc", "pre", attr("id").alias("id"), attr("href").alias("href"), attr("media-type").alias("media_type"), normal_path(attr("href")).alias("path"))


def spine(nodes: DataFrame) -> DataFrame:
    return nodes.where("part = 'Contents/content.hpf' and local = 'itemref'").select("doc", "pre", attr("idref").alias("idref"))


def parameters(nodes: DataFrame) -> DataFrame:
    """(doc, part, pre, params): parameters of each field by name; of equal names the last counts."""
    values = children(nodes, "stringParam", "integerParam", "booleanParam", "floatParam", "unsignedintegerParam")
    pairs = within(values, children(nodes, "fieldBegin"), "field").select("doc", "part", "field", attr("name").alias("name"), F.col("pre").alias("at"), F.coalesce("text", F.lit("")).alias("value")).where("name is not null")
    last = pairs.groupBy("doc", "part", "field", "name").agg(F.max_by("value", "at").alias("value"))
    return last.groupBy("doc", "part", F.col("field").alias("pre")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("params"))


def fields(nodes: DataFrame) -> DataFrame:
    """Fields with their canonical type, ids, parameters, target and hyperlink."""
    rows = select(nodes, "fields").join(parameters(nodes), ["doc", "part", "pre"], "left").withColumn("params", F.coalesce("params", F.create_map().cast("map<string,string>")))
    p = lambda k: F.col("params")[k]
    kind = semantic_type(field_type())
    return rows.select(
        "doc", "part", "section_index", "paragraph", "pre", "ord", attr("id").alias("id"), attr("fieldid").alias("field_id"), attr("name").alias("name"), kind.alias("type"), "params",
        F.when(kind == "CROSSREF", first_filled(p("BookmarkName"), p("Path"), attr("name"))).alias("target"),
        F.when(kind == "HYPERLINK", F.when(p("Command").isNotNull() & p("Path").rlike(r"[;\\]"), p("Path")).otherwise(F.element_at(hyperlink_parts(F.coalesce(p("Command"), p("Path"), F.lit(""))), 1))).alias("url"),
        key_values(F.coalesce(p("Command"), F.lit(""))).alias("settings"),
    )


def field_spans(nodes: DataFrame) -> DataFrame:
    """(doc, part, begin, end, text): each fieldEnd with the fieldBegin it names, and the text between them."""
    begins = children(nodes, "fieldBegin").groupBy("doc", attr("id").alias("id")).agg(F.max_by(F.struct("part", "pre", "paragraph"), "pre").alias("b"))
    ends = children(nodes, "fieldEnd").select("doc", "part", F.col("pre").alias("end_pre"), "paragraph", attr("beginIDRef").alias("id"))
    spans = ends.join(begins, ["doc", "id"]).where("b.part = part and b.paragraph = paragraph").select("doc", "part", "paragraph", F.col("b.pre").alias("begin"), F.col("end_pre").alias("end"))
    t = nodes.where("local = 't'").select("doc", "part", "paragraph", F.col("pre").alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    inside = spans.join(t, ["doc", "part", "paragraph"], "left").withColumn("text", F.when(F.col("at").between(F.col("begin"), F.col("end")), F.col("text")))
    return inside.groupBy("doc", "part", "begin", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda s: s.text), "").alias("text"))


def cells(nodes: DataFrame) -> DataFrame:
    """(doc, part, table, pre, row, column, row_span, col_span, text) of table cells; address 0 and span 1 unless given."""
    tc = children(nodes, "tc").select("doc", "part", "pre", F.try_element_at("ancestors", F.lit(-2)).alias("table"))
    facts = children(nodes, "cellAddr", "cellSpan").groupBy("doc", "part", F.col("parent").alias("pre")).agg(
        *[F.max(F.when(F.col("local") == tag, attr(a).try_cast("int"))).alias(c) for tag, a, c in (("cellAddr", "rowAddr", "row"), ("cellAddr", "colAddr", "column"), ("cellSpan", "rowSpan", "row_span"), ("cellSpan", "colSpan", "col_span"))]
    )
    t = within(children(nodes, "t"), tc, "cell").select("doc", "part", F.col("cell").alias("c"), "pre", "text")
    texts = t.groupBy("doc", "part", F.col("c").alias("pre")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: F.coalesce(s.text, F.lit(""))), "").alias("text"))
    rows = tc.join(facts, ["doc", "part", "pre"], "left").join(texts, ["doc", "part", "pre"], "left")
    filled = {"row": 0, "column": 0, "row_span": 1, "col_span": 1}
    return rows.select("doc", "part", "table", "pre", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in filled.items()], F.coalesce("text", F.lit("")).alias("text"))


def table_matrices(nodes: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc, part, table, rows, cells): a full grid of each table's texts; of equal addresses the later cell counts, strays are dropped.

    A table that declares more than `most` cells, which may be false, gives
    (row, column, text) of the cells it has as `cells`, in order, and no grid.
    """
    t = children(nodes, "tbl").select("doc", "part", F.col("pre").alias("table"), F.coalesce(attr("rowCnt").try_cast("int"), F.lit(0)).alias("n"), F.coalesce(attr("colCnt").try_cast("int"), F.lit(0)).alias("m"))
    return grids(t, cells(nodes), ["doc", "part", "table"], "pre", most)


def grids(t: DataFrame, found: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """(keys, rows, cells): grids of n x m texts for tables `t` from their cells (keys, row, column, text), see table_matrices."""
    last = found.groupBy(*keys, "row", "column").agg(F.max_by("text", order).alias("text"))
    got = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "column"), "text"))).alias("at"))
    count = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    empty = F.create_map().cast("map<struct<row:int,column:int>,string>")
    cell = lambda r, c: F.coalesce(F.try_element_at(F.coalesce("at", empty), F.struct(r.alias("row"), c.alias("column"))), F.lit(""))
    grid = F.transform(count("n"), lambda r: F.transform(count("m"), lambda c: cell(r, c)))
    held = F.transform(F.map_entries(F.coalesce("at", empty)), lambda e: F.struct(e.key.row.alias("row"), e.key.column.alias("column"), e.value.alias("text")))
    held = F.array_sort(F.filter(held, lambda e: e.row.between(0, F.col("n") - 1) & e.column.between(0, F.col("m") - 1)))
    small = F.col("n").cast("long") * F.col("m") <= most
    return t.join(got, keys, "left").select(*keys, F.when(small, grid).alias("rows"), F.when(~small, held).alias("cells"))


def section_settings(nodes: DataFrame) -> DataFrame:
    """(doc, section_index, width, height, landscape, margins) of the first secPr in the first paragraph."""
    first = nodes.where("local = 'secPr' and paragraph = 0").groupBy("doc", "part", "section_index").agg(F.min_by("attrs", "pre").alias("sec"))
    page = nodes.where("local = 'pagePr' and paragraph = 0").groupBy("doc", "part").agg(F.min_by("attrs", "pre").alias("page"))
    margin = nodes.where("local = 'margin' and paragraph = 0").groupBy("doc", "part").agg(F.min_by("attrs", "pre").alias("margins"))
    rows = first.join(page, ["doc", "part"], "left").join(margin, ["doc", "part"], "left")
    return rows.select("doc", "section_index", F.col("page")["width"].try_cast("int").alias("width"), F.col("page")["height"].try_cast("int").alias("height"), F.col("page")["landscape"].alias("landscape"), "margins", "sec")


def signature(nodes: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, label, n): how often each control stands in a paragraph, by tag and ids."""
    # The attributes that name a control, in their order.
    keys = ("id", "fieldid", "name", "type", "beginIDRef", "binaryItemIDRef", "chartIDRef", "num")
    ids = F.concat_ws(",", *[F.when(attr(k) != "", F.concat(F.lit(k + "="), attr(k))) for k in keys])
    controls = nodes.where(F.col("section_index").isNotNull() & F.try_element_at("ancestors", F.lit(-1)).isNotNull()).join(children(nodes, "ctrl").select("doc", "part", F.col("pre").alias("parent")), ["doc", "part", "parent"], "left_semi")
    label = F.concat(F.lit("ctrl/"), F.col("local"), F.when(ids != "", F.concat(F.lit("["), ids, F.lit("]"))).otherwise(""))
    return controls.groupBy("doc", "section_index", "paragraph", label.alias("label")).agg(F.count("*").alias("n"))


def block_rows(nodes: DataFrame) -> DataFrame:
    """(doc, part, section_index, paragraph, pre, kind, text, attrs): blocks at the places of their nodes; controls have no text here."""
    # Tag -> kind of block.
    kinds = {"tbl": "table", "pic": "picture", "fieldBegin": "field", "bookmark": "bookmark", "autoNum": "auto_number", "newNum": "auto_number", "footNote": "note", "endNote": "note", "equation": "equation", "chart": "chart", "hiddenComment": "memo", "header": "header", "footer": "footer"}
    kinds |= {t: "form" for t in FORMS} | {t: "shape" for t in SHAPES} | {"ole": "ole"}
    tag = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    controls = without_chart_fallbacks(nodes.where(F.col("section_index").isNotNull() & F.col("local").isin(*kinds)), nodes)
    hyper = F.when((F.col("local") == "fieldBegin") & (field_type() == "HYPERLINK"), "hyperlink")
    kind = F.coalesce(hyper, tag[F.col("local")])
    which = F.when(kind.isin("shape", "note", "auto_number"), F.map_concat(F.map_filter("attrs", lambda k, _: k != "which"), F.create_map(F.lit("which"), "local"))).otherwise(F.col("attrs"))
    rows = controls.select("doc", "part", "section_index", "paragraph", "pre", kind.alias("kind"), F.lit(None).cast("string").alias("text"), which.alias("attrs"))
    owned = ("tbl", "footNote", "endNote", "hiddenComment", "header", "footer", *SHAPES)
    t = nodes.where("local = 't' and section_index is not null")
    inner = within(t, children(nodes, *owned)).select("doc", "part", "pre").distinct()
    own = t.join(inner, ["doc", "part", "pre"], "left_anti").groupBy("doc", "section_index", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: F.coalesce(s.text, F.lit(""))), "").alias("text"))
    p = nodes.where("depth = 1 and local = 'p' and section_index is not null").drop("text").join(own, ["doc", "section_index", "paragraph"], "left")
    paragraphs = p.select("doc", "part", "section_index", "paragraph", "pre", F.lit("paragraph").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "attrs")
    return paragraphs.unionByName(rows)


def blocks(nodes: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, ord, kind, text, attrs): the document as a sequence of typed blocks.

    Every control is a block at its place in document order, without its
    contents (see `contents.package_blocks`); a paragraph's own text is the
    block `paragraph` at its start.
    """
    order = Window.partitionBy("doc", "section_index").orderBy("pre")
    return block_rows(nodes).withColumn("ord", F.row_number().over(order) - 1).drop("part", "pre")


def features(nodes: DataFrame) -> DataFrame:
    """(doc, features): the sorted kinds of blocks that a document has."""
    return blocks(nodes).groupBy("doc").agg(F.sort_array(F.collect_set("kind")).alias("features"))

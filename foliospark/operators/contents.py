"""Blocks of packages with what stands in them: texts, grids, addresses, scripts, data.

A control owns the paragraphs whose nearest container it is, so nested notes,
shapes and cells don't give their text twice; one join of texts and paragraphs
with the containers finds all owners. Everything else that a control holds is a
child of it, or a part that it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import normal_path
from foliospark.operators import nodes as N

#: Controls whose paragraphs are their text, and form tags by type.
CONTAINERS = ("footNote", "endNote", "hiddenComment", "header", "footer", *N.SHAPES[:-1])
FORM_TYPES = {"checkBtn": "CHECKBOX", "radioBtn": "RADIOBUTTON", "btn": "BUTTON", "edit": "INPUT", "comboBox": "COMBOBOX", "listBox": "LISTBOX", "scrollBar": "SCROLLBAR"}
_NODE = ["doc", "part", "pre"]


def _as_map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def _near(nodes: DataFrame) -> DataFrame:
    """Texts and paragraphs of sections with the container and the paragraph that are next above each."""
    body = nodes.where("section_index is not null")
    inner = body.where((F.col("local") == "t") | (F.col("local") == "p"))
    above = body.where(F.col("local").isin("p", "tc", *CONTAINERS)).withColumn("_holds", F.col("local") != "p")
    pairs = inner.select(*_NODE, "paragraph", F.col("local").alias("what"), "text", F.explode_outer("ancestors").alias("_up")).join(above.select("doc", "part", F.col("pre").alias("_up"), "_holds"), ["doc", "part", "_up"], "left")
    return pairs.groupBy(*_NODE, "what").agg(F.max(F.when(F.col("_holds"), F.col("_up"))).alias("owner"), F.max(F.when(~F.col("_holds"), F.col("_up"))).alias("line"), F.first("text").alias("text"), F.first("paragraph").alias("paragraph"))


def _joined(at: str, text: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(at, text)))), lambda s: s[text]), separator)


def owned_text(nodes: DataFrame) -> DataFrame:
    """(doc, part, pre, text): the paragraphs that each container owns, by line feeds; without paragraphs no row.

    Cells own their paragraphs too, so a table in a note is none of its text.
    """
    found = _near(nodes).where("owner is not null").select("doc", "part", "owner", F.when(F.col("what") == "p", F.col("pre")).otherwise(F.col("line")).alias("line"), "pre", F.when(F.col("what") == "t", F.coalesce("text", F.lit(""))).alias("text"))
    lines = found.groupBy("doc", "part", "owner", "line").agg(_joined("pre", "text", "").alias("text"))
    return lines.groupBy("doc", "part", F.col("owner").alias("pre")).agg(_joined("line", "text", "\n").alias("text"))


def own_text(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, part, paragraph, text) of top-level paragraphs: what no container and no field in it shows; carriage returns go."""
    texts = _near(nodes).where("what = 't' and owner is null and paragraph is not null").select("doc", "part", "paragraph", F.col("pre").alias("at"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("step"))
    edges = F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))
    edges = spans.select("doc", "part", "paragraph", F.explode(edges).alias("e")).select("doc", "part", "paragraph", "e.at", F.lit(None).cast("string").alias("text"), "e.step")
    open_ = F.sum("step").over(Window.partitionBy("doc", "part", "paragraph").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    kept = texts.unionByName(edges).withColumn("_open", open_).where("_open = 0 and step = 0")
    return kept.groupBy("doc", "part", "paragraph").agg(F.replace(_joined("at", "text", ""), F.lit("\r"), F.lit("")).alias("own"))


def charts(nodes: DataFrame) -> DataFrame:
    """(doc, path, title, chart_type, categories, series) of chart parts; the first series has the categories, values stay as they are written.

    `categories` is a JSON list, `series` a JSON list of names and values.
    """
    c = nodes.where(F.startswith("part", F.lit("Chart/")))
    up = lambda rows, tag, name: N.within(rows, N.children(c, tag), name)
    join = lambda col: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: F.coalesce(s.text, F.lit(""))), "").alias(col)
    title = up(N.children(c, "t"), "title", "_in").select(*_NODE, "text").distinct().groupBy("doc", "part").agg(join("title"))
    kind = c.where(F.col("local").rlike("^[a-z]+(3D)?Chart$")).groupBy("doc", "part").agg(F.upper(F.regexp_replace(F.min_by("local", "pre"), r"(3D)?Chart$", "")).alias("chart_type"))
    v = up(N.children(c, "v"), "ser", "ser")
    role = N.within(v, c.where("local in ('tx', 'cat', 'val')"), "_of").select(*_NODE, "ser", "text", F.col("_of").alias("of"))
    named = role.join(c.select("doc", "part", F.col("pre").alias("of"), F.col("local").alias("role")), ["doc", "part", "of"])
    listed = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pre", "text")))), lambda s: F.coalesce(s.text, F.lit("")))
    series = named.groupBy("doc", "part", "ser").agg(F.array_join(listed("tx"), "").alias("name"), listed("cat").alias("cat"), listed("val").alias("values"))
    all_ = series.groupBy("doc", "part").agg(F.min_by("cat", "ser").alias("cat"), F.transform(F.array_sort(F.collect_list(F.struct("ser", "name", "values"))), lambda s: F.struct(s["name"].alias("name"), s["values"].alias("values"))).alias("ser"))
    rows = c.select("doc", "part").distinct().join(title, ["doc", "part"], "left").join(kind, ["doc", "part"], "left").join(all_, ["doc", "part"], "left")
    return rows.select("doc", F.col("part").alias("path"), "title", "chart_type", F.when(F.size("cat") > 0, F.to_json("cat")).alias("categories"), F.when(F.size("ser") > 0, F.to_json("ser")).alias("series"))


def _parts_of(nodes: DataFrame) -> DataFrame:
    """(doc, part, pre, ...): what children of controls say: sizes, scripts, texts, items, lines and fills."""
    up = F.when(F.col("local") == "winBrush", F.try_element_at("ancestors", F.lit(-2))).otherwise(F.col("parent"))
    rows = nodes.where(F.col("section_index").isNotNull() & F.col("local").isin("sz", "script", "text", "img", "lineShape", "shapeComment", "winBrush"))
    pick = lambda tag, value: F.min_by(F.when(F.col("local") == tag, value), F.when(F.col("local") == tag, F.col("at")))
    a = N.attr
    return rows.select("doc", "part", F.col("pre").alias("at"), up.alias("pre"), "local", "text", "attrs").groupBy(*_NODE).agg(
        pick("sz", a("width")).alias("width"), pick("sz", a("height")).alias("height"), pick("script", F.coalesce("text", F.lit(""))).alias("script"), pick("text", F.coalesce("text", F.lit(""))).alias("label"), pick("img", a("binaryItemIDRef")).alias("item"),
        pick("lineShape", a("color")).alias("line_color"), pick("lineShape", a("width")).alias("line_width"), pick("winBrush", a("faceColor")).alias("fill_color"), pick("shapeComment", F.col("text")).alias("description"),
    )


def package_blocks(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, ord, kind, text, attrs): blocks with their contents, as `convert.binary_blocks` gives them.

    Texts: what a paragraph shows outside of its controls, the paragraphs that a note, memo, header, footer or shape owns, a
    table's grid as JSON, an equation's script, a form's label, a chart's
    title, what a link or field shows. Attributes name the rest; pictures and
    objects have their `data` (base64) where the package holds it. Controls in
    a table's cell have no text of their own but for tables, as the cell has
    it; `inside` names the container that a nested control stands in.
    """
    rows = N.block_rows(nodes)
    body = nodes.where("section_index is not null")
    grids = N.table_matrices(body, most=1 << 31).select("doc", "part", F.col("table").alias("pre"), F.to_json("rows").alias("grid"))
    found = N.field_spans(body)
    spans = found.select("doc", "part", F.col("begin").alias("pre"), F.col("text").alias("shown"))
    places = body.where("local = 'fieldBegin'").select("doc", "part", F.col("pre").alias("begin"), "paragraph")
    own_texts = own_text(nodes, found.join(places, ["doc", "part", "begin"]))
    fields = N.fields(body).select(*_NODE, F.col("type").alias("field_type"), "params", "target", "url")
    items = N.manifest(nodes).groupBy("doc", F.col("id").alias("item_id")).agg(F.min_by("path", "pre").alias("item_path"))
    held = parts.where(F.startswith("path", F.lit("BinData/"))).select("doc", F.col("path").alias("item_path"), F.base64("content").alias("data"))
    data = items.join(held, ["doc", "item_path"])
    chart_items = items.select("doc", F.col("item_id").alias("_chart"), F.col("item_path").alias("_named"))
    above = N.within(body.where(F.col("local").isin("bookmark", "fieldBegin", "tbl", "autoNum", "newNum", "pic", "equation", "chart", "ole", *N.FORMS, *CONTAINERS)), N.children(body, "tc", *CONTAINERS), "_in")
    near = above.groupBy(*_NODE).agg(F.max("_in").alias("_in")).join(N.children(body, "tc", *CONTAINERS).select("doc", "part", F.col("pre").alias("_in"), F.col("local").alias("inside")), ["doc", "part", "_in"]).drop("_in")

    out = rows
    for more in (owned_text(nodes).withColumnRenamed("text", "owned"), grids, spans, fields, _parts_of(nodes), near):
        out = out.join(more, _NODE, "left")
    out = out.join(own_texts, ["doc", "part", "paragraph"], "left")
    a, kind = N.attr, F.col("kind")
    item = F.coalesce(F.col("item"), a("binaryItemIDRef"))
    out = out.withColumn("_item", F.when(kind.isin("picture", "ole"), item)).join(data.select("doc", F.col("item_id").alias("_item"), "item_path", "data"), ["doc", "_item"], "left")
    out = out.withColumn("_chart", F.when(kind == "chart", a("chartIDRef"))).join(chart_items, ["doc", "_chart"], "left")
    out = out.withColumn("_path", F.coalesce("_named", normal_path(F.col("_chart")))).join(charts(nodes).withColumnRenamed("path", "_path"), ["doc", "_path"], "left")

    text = (
        F.when(kind == "paragraph", F.coalesce("own", F.lit(""))).when(kind == "table", F.col("grid")).when(kind == "equation", F.coalesce("script", F.lit(""))).when(kind == "form", F.coalesce("label", a("caption"), F.lit("")))
        .when(kind == "chart", F.coalesce("title", F.lit(""))).when(kind.isin("field", "hyperlink"), F.coalesce("shown", F.lit(""))).when(kind.isin("note", "memo", "header", "footer", "shape"), F.coalesce("owned", a("text"), F.lit("")))
    )
    text = F.when((F.col("inside") == "tc") & ~kind.isin("paragraph", "table"), F.lit(None).cast("string")).otherwise(text)
    tag = a("which")
    sized = kind.isin("table", "picture", "ole", "equation", "chart", "shape")
    drawn = F.regexp_extract("item_path", r"\.([^./]+)$", 1)
    own = {
        "rowCnt": F.when(kind == "table", a("rowCnt")), "colCnt": F.when(kind == "table", a("colCnt")), "which": F.when(kind.isin("shape", "note", "auto_number"), tag), "url": F.when(kind == "hyperlink", F.coalesce("url", F.lit(""))),
        "name": F.when(kind.isin("bookmark", "form", "field"), F.nullif(F.coalesce(a("name"), F.lit("")), F.lit(""))), "type": F.when(kind == "field", F.col("field_type")), "num": F.when(kind == "auto_number", a("num")), "numType": F.when(kind == "auto_number", a("numType")),
        "applyPageType": F.when(kind.isin("header", "footer"), F.coalesce(a("applyPageType"), F.lit("BOTH"))), "number": F.when(kind == "note", a("number")), "tag": F.when(kind == "form", F.col("_tag")), "form_type": F.when(kind == "form", _as_map(FORM_TYPES)[F.col("_tag")]),
        "value": F.when(kind == "form", a("value")), "author": F.when(kind == "memo", a("author")), "memo_id": F.when(kind == "memo", a("memoId")), "chart_type": F.when(kind == "chart", F.col("chart_type")), "categories": F.when(kind == "chart", F.col("categories")), "series": F.when(kind == "chart", F.col("series")),
        "width": F.when(sized, F.col("width")), "height": F.when(sized, F.col("height")), "line_color": F.when(kind == "shape", F.col("line_color")), "line_width": F.when(kind == "shape", F.col("line_width")), "fill_color": F.when(kind == "shape", F.col("fill_color")),
        "description": F.when(sized, F.col("description")), "item": F.when(kind.isin("picture", "ole"), F.col("_item")), "data": F.when(kind.isin("picture", "ole"), F.col("data")), "extension": F.when(kind.isin("picture", "ole") & F.col("data").isNotNull(), F.nullif(drawn, F.lit(""))), "inside": F.when(kind != "paragraph", F.col("inside")),
    }
    known = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in own.items()]), lambda e: e.value.isNotNull()))
    none = F.create_map().cast("map<string,string>")
    params = F.when(kind == "field", F.map_filter(F.coalesce("params", none), lambda k, _: ~F.map_contains_key(known, k) & (k != "Command"))).otherwise(none)
    tags = nodes.where(F.col("local").isin(*N.FORMS)).select(*_NODE, F.col("local").alias("_tag"))
    order = Window.partitionBy("doc", "section_index").orderBy("pre")
    out = out.join(tags, _NODE, "left").select("doc", "section_index", "paragraph", "pre", "kind", text.alias("text"), F.map_concat(known, params).alias("attrs"))
    return out.withColumn("ord", F.row_number().over(order) - 1).select("doc", "section_index", "paragraph", "ord", "kind", "text", "attrs")

"""Records of binary documents from blocks: what `payloads` and `binary` decode, made by built-in functions alone.

A paragraph is a header, its text and its controls; a control stands in the
text as eight units and below the header as records. Objects get plain
layouts: sizes, texts and names are written, styling is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import reserved
from foliospark.sources.binary import CONNECT_LINE, ID_MAPPINGS, TAGS

#: The units that mark a control in a paragraph's text, by the control's id.
MARKERS = {"head": 0x10, "foot": 0x10, "atno": 0x12, "nwno": 0x15, "pgnp": 0x15, "gso ": 0x0B, "eqed": 0x0B, "tbl ": 0x0B, "fn  ": 0x11, "en  ": 0x11, "bokm": 0x16}
FIELD_BEGIN, FIELD_END = 0x03, 0x04
#: Shapes by the name that blocks use: the component's id and the record.
SHAPES = {"line": ("$lin", "line"), "connectLine": ("$col", "line"), "rect": ("$rec", "rectangle"), "ellipse": ("$ell", "ellipse"), "arc": ("$arc", "arc"), "polygon": ("$pol", "polygon"), "curve": ("$cur", "curve"), "container": ("$con", "container"), "textart": ("$tat", "textart")}
#: Codes of pages that headers and footers apply to, the head of a bookmark's data, the code of page numbers, what stands around a script.
PAGES = {"BOTH": 0, "EVEN": 1, "ODD": 2}
BOOKMARK = bytes.fromhex("1b020100000000400100")
AUTO_NUMBER_PAGE = 0x0C
EQUATION = ("* ", "`Equation Version 60\u0007HYhwpEQ")
#: Own notes of controls are text: this word, which is this engine's, then key=value pairs whose keys are fixed values of the format's users.
NOTES = "FOLIO_CTRL_META"

_NO_RECORDS = "array<struct<tag_id:int,level:int,payload:binary>>"


# -- scalars ---------------------------------------------------------------------------------


def le(value: Column | int, size: int) -> Column:
    """A whole number in `size` bytes, lowest first; the inverse of `numbers.little_endian`."""
    return F.unhex(_le_hex(value, size))


def _le_hex(value: Column | int, size: int) -> Column:
    if isinstance(value, int):
        return F.lit((value % (1 << 8 * size)).to_bytes(size, "little").hex())
    h = F.right(F.lpad(F.hex(value.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * size))
    return F.regexp_replace(F.reverse(h), "(.)(.)", "$2$1")


def words(sizes: str, *values: Column | int) -> Column:
    """Numbers one after another; `sizes` has a digit for each."""
    return F.unhex(F.concat(*[_le_hex(v, int(s)) for s, v in zip(sizes, values, strict=True)]))


def utf16(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-16LE")


def counted(text: Column) -> Column:
    """A text after its length in units; what a length of 16 bits can't say is refused."""
    raw = utf16(text)
    units = (F.octet_length(raw) / 2).cast("int")
    return F.when(units < 1 << 16, F.concat(le(units, 2), raw)).otherwise(F.raise_error(F.lit("a text of a control has over 65535 units")).cast("binary"))


def ident(name: str) -> Column:
    return F.lit(name.ljust(4)[::-1].encode("latin-1"))


def marker(name: str | Column, code: int) -> Column:
    """A control's eight units."""
    raw = ident(name) if isinstance(name, str) else F.encode(F.reverse(name), "ISO-8859-1")
    return F.concat(le(code, 2), raw, F.lit(b"\0" * 8), le(code, 2))


def notes(values: dict[str, Column]) -> Column:
    """Key=value pairs as a control's data; nulls are left out, reserved characters are escaped (see `text.noted`)."""
    pairs = [F.concat(F.lit(f"{k}="), reserved(v.cast("string"))) for k, v in values.items()]
    return utf16(F.concat_ws(";", F.lit(NOTES), F.lit("escaped=1"), *pairs))


def attr(name: str, default: str | None = None) -> Column:
    found = F.try_element_at("attrs", F.lit(name))
    return found if default is None else F.coalesce(found, F.lit(default))


def number(name: str, default: int) -> Column:
    """An attribute as a number; the default where there is none, or it isn't one."""
    return F.coalesce(attr(name).try_cast("int"), F.lit(default))


# -- records ---------------------------------------------------------------------------------


def record(name: str, level: int, payload: Column) -> Column:
    return F.struct(F.lit(TAGS[name]).alias("tag_id"), F.lit(level).alias("level"), payload.alias("payload"))


def paragraph(level: int, raw: Column, mask: Column | int = 0) -> Column:
    """Header and text of a paragraph; an empty one has no text record."""
    whole = F.concat(raw, F.lit(b"\r\0"))
    head = record("para_header", level, F.concat(le((F.octet_length(whole) / 2).cast("int"), 4), le(mask, 4), F.lit(b"\0" * 16)))
    return F.when(F.octet_length(raw) > 0, F.array(head, record("para_text", level + 1, whole))).otherwise(F.array(head))


def listed(level: int, text: Column, more: bytes = b"") -> Column:
    """A list of one paragraph."""
    return F.concat(F.array(record("list_header", level, F.lit(b"\1" + b"\0" * 7 + more))), paragraph(level, utf16(text)))


def graphic_header() -> Column:
    """Control of an object that stands like a character, with its size and description."""
    name = F.when(F.col("kind") == "table", ident("tbl ")).when(F.col("kind") == "equation", ident("eqed")).otherwise(ident("gso "))
    return F.concat(name, F.lit(bytes([0x11, 0x23, 0x2A, 0x08]) + b"\0" * 8), words("44", F.col("w"), F.col("h")), F.lit(b"\0" * 20), counted(attr("description", "")))


def component() -> Column:
    """Bounds, centre, line and fill of a shape."""
    ids = F.create_map(*[F.lit(x) for k, (c, _) in SHAPES.items() for x in (k, CONNECT_LINE if c == "$col" else c[::-1].encode() * 2)])
    other = F.when(F.col("kind") == "picture", F.lit(b"cip$cip$")).when(F.col("kind") == "ole", F.lit(b"elo$elo$")).otherwise(F.lit(b"cer$cer$"))
    kind = F.coalesce(F.when(F.col("kind") == "shape", F.try_element_at(ids, attr("which", "rect"))), other)
    colour = lambda key, default: F.coalesce(F.conv(F.regexp_extract(attr(key, default), "^#([0-9A-Fa-f]{6})$", 1), 16, 10).try_cast("long"), F.lit(0))
    w, h = F.col("w"), F.col("h")
    middle = words("24444444", 0, F.floor(w / 2), F.floor(h / 2), 0, 0, 0, 0, 0)
    return F.concat(kind, F.lit(b"\0" * 12), words("44444", 0, 0, w, h, 0), middle, F.lit(b"\0" * 126), words("42421444", colour("line_color", "#000000"), number("line_width", 33), 0, 0, 0, 1, colour("fill_color", "#FFFFFF"), 0), F.lit(b"\0" * 11))


def outline(which: str, text: Column) -> Column:
    """The record of a shape, from its size."""
    w, h = F.col("w"), F.col("h")
    x, y = F.floor(w / 2), F.floor(h / 2)
    if which == "line":
        return words("44444", 0, 0, w, h, 0)
    if which == "rectangle":
        return words("144444444", 0, 0, 0, w, 0, w, h, 0, h)
    if which == "ellipse":
        return F.concat(words("4444444", 0, x, y, w, y, x, h), F.lit(b"\0" * 32))
    if which == "arc":
        return words("4444444", 0, x, y, w, y, x, h)
    if which in ("polygon", "curve"):
        return words("244444444", 4, 0, w, w, 0, 0, 0, h, h)
    return F.concat(F.lit(b"\0" * 32), counted(text)) if which == "textart" else F.lit(b"\0" * 4)


def shape() -> Column:
    """Records of a shape of any of SHAPES: text stands in a list, or in the notes of shapes that have none; nothing for other names."""
    text, which = F.col("text"), attr("which", "rect")
    known = {own: [k for k, (_, o) in SHAPES.items() if o == own] for _, own in SHAPES.values()}
    none = F.array().cast(_NO_RECORDS)
    inner = F.when(which.isin("rect", "curve", "container") & (F.length(text) > 0), listed(3, text)).otherwise(none)
    noted = F.when(which.isin("ellipse", "arc", "polygon", "line", "connectLine"), F.array(record("ctrl_data", 2, notes({"kind": which, "text": F.nullif(text, F.lit(""))})))).otherwise(none)
    own = F.coalesce(*[F.when(which.isin(*names), record(tag, 3, outline(tag, text))) for tag, names in known.items()])
    return F.when(own.isNotNull(), F.concat(F.array(record("ctrl_header", 1, F.col("graphic"))), noted, F.array(record("shape_component", 2, F.col("component"))), inner, F.array(own))).otherwise(none)


def table() -> Column:
    """A table of `rowCnt` x `colCnt`, its texts a JSON array of rows; without that, empty cells."""
    rows, columns = F.greatest(number("rowCnt", 1), F.lit(1)), F.greatest(number("colCnt", 1), F.lit(1))
    w, h = F.floor(F.col("w") / columns), F.floor(F.col("h") / rows)
    texts = F.from_json(F.col("text"), "array<array<string>>")
    widths = F.unhex(F.repeat(F.hex(le(columns, 2)), rows))
    head = F.concat(words("42222222", 0x04000006, rows, columns, 0, 510, 510, 141, 141), widths, words("22", 1, 0))

    def cell(i: Column) -> Column:
        r, c = F.floor(i / columns).cast("int"), (i % columns).cast("int")
        facts = F.concat(words("4422224422222", 1, 0x20, c, r, 1, 1, w, h, 510, 510, 141, 141, 1), le(w, 4), F.lit(b"\0" * 9))
        return F.concat(F.array(record("list_header", 2, facts)), paragraph(2, utf16(F.get(F.get(texts, r), c))))

    cells = F.flatten(F.transform(F.sequence(F.lit(0), rows * columns - 1), cell))
    return F.concat(F.array(record("ctrl_header", 1, F.col("graphic")), record("table", 2, head)), cells)


def field_id() -> Column:
    """The control id of a field's type: its first three letters after a percent sign, or the id itself."""
    kind = F.trim(attr("type", ""))
    letters = F.regexp_replace(F.lower(kind), "[^0-9a-z]", "")
    return F.rpad(F.when(kind.startswith("%"), F.substring(kind, 1, 4)).when(letters == "", "%fld").otherwise(F.concat(F.lit("%"), F.substring(letters, 1, 3))), 4, " ")


def field() -> Column:
    """A field, with its attributes but the type as data."""
    kept = F.map_filter("attrs", lambda k, _: ~k.isin("type", "id", "editable", "dirty"))
    some = F.exists(F.map_entries(kept), lambda e: F.concat_ws("", e.key, e.value).rlike("[%;=]"))
    pairs = F.transform(F.map_entries(kept), lambda e: F.concat(reserved(e.key), F.lit("="), F.coalesce(reserved(e.value), F.lit(""))))
    pairs = F.when(some, F.array_append(pairs, F.lit("escaped=1"))).otherwise(pairs)
    head = record("ctrl_header", 1, F.concat(F.encode(F.reverse(field_id()), "ISO-8859-1"), F.lit(b"\0" * 11)))
    data = record("ctrl_data", 2, utf16(F.array_join(F.array_sort(pairs), ";")))
    return F.when(F.cardinality(kept) > 0, F.array(head, data)).otherwise(F.array(head))


def controls() -> dict[str, tuple[Column, Column, Column]]:
    """For each kind of block: its records, its units in the text, and the bit of its code."""
    text = F.col("text")
    head = lambda name, more: record("ctrl_header", 1, F.concat(ident(name), more))
    marked = lambda name: (marker(name, MARKERS[name]), F.lit(1 << MARKERS[name]))
    plain = (F.lit(b""), F.lit(0))
    first = lambda flag, a, b: tuple(F.when(flag, x).otherwise(y) for x, y in zip(a, b, strict=True))
    shown = lambda name: (F.concat(marker(name, FIELD_BEGIN), utf16(text), F.concat(le(FIELD_END, 2), F.lit(b"\0" * 12), le(FIELD_END, 2))), F.lit(1 << FIELD_BEGIN | 1 << FIELD_END))
    page = F.coalesce(F.create_map(*[F.lit(x) for kv in PAGES.items() for x in kv])[F.upper(attr("applyPageType", "BOTH"))], F.lit(0))
    note = lambda name: (F.concat(F.array(head(name, F.concat(le(number("number", 1), 4), F.lit(b"\0" * 12)))), listed(2, text, b"\0" * 8)), *marked(name))
    area = lambda name, code: (F.concat(F.array(head(name, words("44", page, code))), listed(2, text, b"\0" * 26)), *marked(name))
    url = F.coalesce(attr("url"), text, F.lit(""))
    command = F.concat(F.replace(F.replace(url, F.lit(":"), F.lit("\\:")), F.lit(";"), F.lit("\\;")), F.lit(";1;0;0;"))
    link = F.array(head("%hlk", F.concat(F.lit(b"\0" * 5), counted(command), F.lit(b"\0" * 4))))
    # What the command's escapes may leave open is carried in the control's data too.
    link = F.when(url.rlike(r"[;\\]"), F.array_append(link, record("ctrl_data", 2, notes({"url": url})))).otherwise(link)
    storage = F.coalesce(F.col("storage_id"), F.lit(0))
    drawn = lambda own, payload, *more: F.array(record("ctrl_header", 1, F.col("graphic")), *more, record("shape_component", 2, F.col("component")), record(own, 3, payload))
    w, h = F.col("w"), F.col("h")
    picture = F.concat(F.lit(b"\0" * 12), words("44444444", 0, 0, w, 0, w, h, 0, h), words("4444", 0, 0, w, h), F.lit(b"\0" * 11), le(storage, 2), F.lit(b"\0" * 18))
    form = {f"form.{k}": attr(k) for k in ("name", "value", "checked", "placeholder", "items", "tag")}
    # The format has 16 bits for a new number; one that they don't say is carried in the control's data too.
    num, said = attr("num", "1"), F.pmod(number("num", 1), F.lit(1 << 16))
    new = F.array(head("nwno", words("42", 0, said)))
    new = F.when(said.cast("string") != num, F.array_append(new, record("ctrl_data", 2, notes({"num": num})))).otherwise(new)
    return {
        "table": (table(), *marked("tbl ")), "note": first(attr("which", "footNote") == "endNote", note("en  "), note("fn  ")), "header": area("head", 1), "footer": area("foot", 2),
        "bookmark": (F.array(head("bokm", F.lit(b"")), record("ctrl_data", 2, F.concat(F.lit(BOOKMARK), counted(attr("name", ""))))), *marked("bokm")),
        "hyperlink": (link, *shown("%hlk")), "field": (field(), *shown(field_id())),
        "auto_number": first(attr("which", "newNum") == "autoNum", (F.array(head("atno", words("444", 0, AUTO_NUMBER_PAGE, 0))), *marked("atno")), (new, *marked("nwno"))),
        "form": (F.array(head("mrof", F.lit(b"")), record("ctrl_data", 2, notes({"form.type": F.upper(F.coalesce(attr("form_type"), attr("type", "INPUT"))), "form.label": text, **form})), record("form_object", 2, utf16(text))), *plain),
        "memo": (F.array(head("omem", F.lit(b"")), record("ctrl_data", 2, notes({"memo.author": attr("author"), "memo.memoId": F.coalesce(attr("memo_id"), attr("memoId")), "memo.anchorId": F.coalesce(attr("anchor_id"), attr("anchorId")), "memo.order": attr("order")})), record("memo_list", 2, utf16(text))), *plain),
        "chart": (drawn("chart_data", utf16(text), record("ctrl_data", 2, notes({"chart.title": text, "chart.chartType": F.upper(F.coalesce(attr("chart_type"), attr("chartType", "BAR"))), "chart.categories": attr("categories"), "chart.series": attr("series"), "chart.dataRef": attr("data_ref")}))), *marked("gso ")),
        "equation": (F.array(record("ctrl_header", 1, F.col("graphic")), record("eqedit", 2, F.concat(F.lit(b"\0" * 4), utf16(F.concat(F.lit(EQUATION[0]), F.coalesce(text, F.lit("")), F.lit(EQUATION[1])))))), *plain),
        "shape": (shape(), *marked("gso ")), "picture": (drawn("picture", picture), *marked("gso ")),
        "ole": (drawn("ole", F.concat(words("4442", 0, w, h, storage), F.lit(b"\0" * 10))), *marked("gso ")),
    }


# -- documents -------------------------------------------------------------------------------


def section_records(blocks: DataFrame, renumber: bool = True) -> DataFrame:
    """(doc, stream, ord, tag_id, level, payload) of the sections of blocks (with `storage_id`).

    Blocks of one paragraph share its header; its text and its controls keep
    their order. Unknown kinds are left out. Sections are numbered anew without
    gaps unless told not to.
    """
    known = controls()
    pick = lambda i, other: F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in known.items()], other)
    own = pick(0, F.array().cast(_NO_RECORDS))
    units = F.when(F.col("kind") == "paragraph", utf16(F.replace("text", F.lit("\r"), F.lit("")))).otherwise(pick(1, F.lit(b"")))
    section = F.dense_rank().over(Window.partitionBy("doc").orderBy("section_index")) - 1 if renumber else F.col("section_index")
    rows = blocks.where("section_index >= 0").withColumns({"paragraph": F.coalesce("paragraph", "ord"), "section": section})
    sized = rows.withColumns({"w": number("width", 12000), "h": number("height", 3200)})
    made = sized.withColumns({"graphic": graphic_header(), "component": component()}).select("doc", "section", "paragraph", F.struct("ord", own.alias("own"), units.alias("units"), pick(2, F.lit(0)).alias("bit")).alias("b"))
    grouped = made.groupBy("doc", "section", "paragraph").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    raw = F.aggregate("bs", F.lit(b""), lambda a, b: F.concat(a, b.units))
    mask = F.aggregate("bs", F.lit(0), lambda a, b: a.bitwiseOR(b.bit))
    whole = F.flatten(F.transform("bs", lambda b: b.own))
    bodies = grouped.select("doc", "section", "paragraph", raw.alias("raw"), mask.alias("mask"), whole.alias("own")).select("doc", "section", "paragraph", F.posexplode(F.concat(paragraph(0, F.col("raw"), F.col("mask")), F.col("own"))).alias("i", "r"))
    order = Window.partitionBy("doc", "section").orderBy("paragraph", "i")
    return bodies.select("doc", F.concat(F.lit("BodyText/Section"), F.col("section").cast("string")).alias("stream"), (F.row_number().over(order) - 1).alias("ord"), "r.tag_id", "r.level", "r.payload")


def definition_records(blocks: DataFrame) -> DataFrame:
    """(doc, kind, at, tag_id, level, payload) of definitions: blocks of section -1."""
    name, local = attr("name", ""), attr("english_name", "")
    style = F.concat(counted(name), counted(local), words("222222", 0, 1033, 0, number("paraPrIDRef", 0), number("charPrIDRef", 0), 0))
    codes = F.create_map(*[F.lit(x) for kv in (("JUSTIFY", 0), ("LEFT", 1), ("RIGHT", 2), ("CENTER", 3), ("DISTRIBUTE", 4), ("DISTRIBUTE_SPACE", 5)) for x in kv])
    para = F.concat(le(F.coalesce(codes[F.upper(attr("alignment", "JUSTIFY"))], F.lit(0)), 4), F.lit(b"\0" * 20), le(number("line_spacing", 160), 4), F.lit(b"\0" * 26))
    bold, italic = (F.when(F.lower(attr(n, "false")).isin("true", "1"), 1).otherwise(0) for n in ("bold", "italic"))
    char = F.concat(F.lit(b"\0" * 14 + b"\x64" * 7 + b"\0" * 7 + b"\x64" * 7 + b"\0" * 7), le(number("height", 1000), 4), le(italic + 2 * bold, 4), F.lit(b"\0" * 18), le(F.lit(0), 4))
    level = F.concat(words("4224", 0, 0, 0, -1), counted(attr("format", "^1.")))
    numbering = F.concat(*[level] * 7, le(0, 2), *[le(number("start", 1), 4)] * 7)
    bullet = F.concat(words("4224", 0, 0, 0, -1), F.substring(F.concat(utf16(attr("char", "●")), F.lit(b"\0\0")), 1, 2))
    memo = notes({k: attr(k) for k in ("width", "lineWidth", "lineType", "lineColor", "fillColor", "activeColor", "memoType")})
    made = {"style": ("style", style), "paragraph_style": ("para_shape", para), "character_style": ("char_shape", char), "numbering": ("numbering", numbering), "bullet": ("bullet", bullet), "memo_shape": ("memo_shape", memo)}
    tags = F.create_map(*[F.lit(x) for k, (t, _) in made.items() for x in (k, TAGS[t])])
    payload = F.coalesce(*[F.when(F.col("kind") == k, p) for k, (_, p) in made.items()])
    rows = blocks.where("section_index = -1").where(F.col("kind").isin(*made))
    return rows.select("doc", "kind", F.col("ord").alias("at"), tags[F.col("kind")].alias("tag_id"), F.lit(0).alias("level"), payload.alias("payload"))


def info_records(blocks: DataFrame, data: DataFrame) -> DataFrame:
    """(doc, stream, ord, tag_id, level, payload) of DocInfo: properties, counts, binary data (doc, storage_id, extension) and definitions.

    Every document has a first style and a first shape of paragraphs and characters, which its text uses.
    """
    docs = blocks.groupBy("doc").agg(F.countDistinct(F.when(F.col("section_index") >= 0, F.col("section_index"))).alias("sections"))
    named = F.concat(counted(F.lit("Normal")), counted(F.lit("Normal")), words("222222", 0, 1033, 0, 0, 0, 0))
    base = [("char_shape", F.concat(F.lit(b"\0" * 14 + b"\x64" * 7 + b"\0" * 7 + b"\x64" * 7 + b"\0" * 7), le(1000, 4), F.lit(b"\0" * 26))), ("para_shape", F.lit(b"\0" * 54)), ("style", named)]
    rows = data.select("doc", F.col("storage_id").alias("at"), F.lit(TAGS["bin_data"]).alias("tag_id"), F.lit(0).alias("level"), F.concat(words("22", 1, F.col("storage_id")), counted(F.col("extension"))).alias("payload"))
    firsts = F.array(*[F.struct(F.lit(-1).alias("at"), F.lit(TAGS[t]).alias("tag_id"), F.lit(0).alias("level"), p.alias("payload")) for t, p in base])
    rows = rows.unionByName(docs.select("doc", F.explode(firsts).alias("r")).select("doc", "r.*")).unionByName(definition_records(blocks).drop("kind"))
    kinds = {"bin_data": "bin_data", "char_shapes": "char_shape", "numberings": "numbering", "bullets": "bullet", "para_shapes": "para_shape", "styles": "style", "memo_shapes": "memo_shape"}
    counts = rows.groupBy("doc").agg(*[F.count_if(F.col("tag_id") == TAGS[kinds[n]]).alias(n) if n in kinds else F.lit(0).alias(n) for n in ID_MAPPINGS])
    properties = words("2222222444", F.col("sections"), *[1] * 6, 0, 0, 0)
    heads = F.array(F.struct(F.lit(-3).alias("at"), F.lit(TAGS["document_properties"]).alias("tag_id"), F.lit(0).alias("level"), properties.alias("payload")), F.struct(F.lit(-2).alias("at"), F.lit(TAGS["id_mappings"]).alias("tag_id"), F.lit(0).alias("level"), words("4" * len(ID_MAPPINGS), *[F.col(n) for n in ID_MAPPINGS]).alias("payload")))
    rows = rows.unionByName(docs.join(counts, "doc").select("doc", F.explode(heads).alias("r")).select("doc", "r.*"))
    # Tags of DocInfo rise in the order that the format wants.
    order = Window.partitionBy("doc").orderBy("tag_id", "at")
    return rows.select("doc", F.lit("DocInfo").alias("stream"), (F.row_number().over(order) - 1).alias("ord"), "tag_id", "level", "payload")


def append(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records of documents with those of blocks after the last ones of the sections they name; what was there stays as it is.

    Appended text takes the first styles; pictures and objects with data need `convert.to_binary`.
    """
    cut = rows.select("doc", "stream", "ord", "tag_id", "level", "payload")
    last = cut.groupBy("doc", "stream").agg((F.max("ord") + 1).alias("n"))
    new = section_records(blocks.withColumn("storage_id", F.lit(None).cast("int")), renumber=False).join(last, ["doc", "stream"], "left")
    return cut.unionByName(new.select("doc", "stream", (F.col("ord") + F.coalesce("n", F.lit(0))).alias("ord"), "tag_id", "level", "payload"))


#: Settings of sections: the record that holds each, where, and in how many bytes.
SETTINGS = {
    "page_width": ("page_def", 0, 4), "page_height": ("page_def", 4, 4), "left": ("page_def", 8, 4), "right": ("page_def", 12, 4), "top": ("page_def", 16, 4), "header": ("page_def", 20, 4), "footer": ("page_def", 24, 4),
    "bottom": ("page_def", 28, 4), "gutter": ("page_def", 32, 4), "border_fill_id": ("page_border_fill", 12, 2), "space_columns": ("secd", 8, 2), "line_grid": ("secd", 10, 2), "char_grid": ("secd", 12, 2), "tab_stop": ("secd", 14, 4),
    "numbering_shape_id": ("secd", 18, 2), "page": ("secd", 20, 2), "pic": ("secd", 22, 2), "tbl": ("secd", 24, 2), "equation": ("secd", 26, 2), "between_notes": ("footnote_shape", 18, 2), "above_line": ("footnote_shape", 14, 2), "below_line": ("footnote_shape", 16, 2),
}


def set_section(rows: DataFrame, section_index: int, **values: int) -> DataFrame:
    """Records with settings of a section patched in place; too short payloads are filled with zeros, an unknown setting raises."""
    if unknown := set(values) - set(SETTINGS):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    payload = F.col("payload")
    for name, value in values.items():
        kind, at, size = SETTINGS[name]
        here = (F.col("tag_id") == TAGS["ctrl_header"]) & F.startswith("payload", ident("secd")) if kind == "secd" else F.col("tag_id") == TAGS[kind]
        whole = F.when(F.octet_length(payload) < at + size, F.rpad(payload, at + size, F.lit(b"\0"))).otherwise(payload)
        payload = F.when(here & (F.col("section_index") == section_index), F.overlay(whole, le(value, size), at + 1, size)).otherwise(payload)
    return rows.withColumn("payload", payload).withColumn("size", F.octet_length("payload").cast("long"))

"""Binary documents: compound files to streams to records to paragraphs and controls, and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.numbers import control_id, little_endian, utf16_field
from foliospark.operators import relational as R
from foliospark.operators.nodes import grids
from foliospark.operators.validate import ISSUE, issues
from foliospark.sources import compound

SIGNATURE = "HWP Document File"
#: Tags of records.
TAGS = {
    "document_properties": 0x10, "id_mappings": 0x11, "bin_data": 0x12, "face_name": 0x13, "border_fill": 0x14, "char_shape": 0x15, "tab_def": 0x16, "numbering": 0x17, "bullet": 0x18,
    "para_shape": 0x19, "style": 0x1A, "doc_data": 0x1B, "compatible_document": 0x1E, "layout_compatibility": 0x1F, "para_header": 0x42, "para_text": 0x43, "para_char_shape": 0x44,
    "para_line_seg": 0x45, "para_range_tag": 0x46, "ctrl_header": 0x47, "list_header": 0x48, "page_def": 0x49, "footnote_shape": 0x4A, "page_border_fill": 0x4B, "shape_component": 0x4C,
    "table": 0x4D, "line": 0x4E, "rectangle": 0x4F, "ellipse": 0x50, "arc": 0x51, "polygon": 0x52, "curve": 0x53, "ole": 0x54, "picture": 0x55, "container": 0x56, "ctrl_data": 0x57,
    "eqedit": 0x58, "textart": 0x5A, "form_object": 0x5B, "memo_shape": 0x5C, "memo_list": 0x5D, "chart_data": 0x5E, "track_change": 0x5F, "track_change_author": 0x60,
}
#: What the counts of id mappings count, in their order.
ID_MAPPINGS = ("bin_data", "ko_fonts", "en_fonts", "cn_fonts", "jp_fonts", "other_fonts", "symbol_fonts", "user_fonts", "border_fills", "char_shapes", "tab_defs", "numberings", "bullets", "para_shapes", "styles", "memo_shapes", "track_changes", "track_change_authors")
#: Control ids -> kinds.
CONTROLS = {"tbl ": "table", "bokm": "bookmark", "fn  ": "footnote", "en  ": "endnote", "pgnp": "page_number", "eqed": "equation", "form": "form", "mrof": "form", "omem": "memo", "head": "header", "foot": "footer", "secd": "section", "cold": "column", "atno": "auto_number", "nwno": "auto_number", "%hlk": "hyperlink", "%mai": "mail_merge_field", "%for": "calculation_field", "%cal": "calculation_field", "%ref": "cross_reference", "%pag": "cross_reference", "%cro": "cross_reference", "%doc": "doc_property_field", "%dat": "date_field"}
#: Shapes by the records below a graphic control, the first that is there.
SHAPES = ("chart_data", "ole", "picture", "container", "textart", "line", "rectangle", "ellipse", "arc", "polygon", "curve")


#: Fixed value: a component that starts so is a connecting line's.
CONNECT_LINE = b"loc$loc$"


def tag(name: str) -> Column:
    return F.col("tag_id") == TAGS[name]


def inflate(raw: bytes) -> bytes:
    """Raw deflate; what comes before a break is kept."""
    z = zlib.decompressobj(-15)
    return z.decompress(raw) + z.flush()


def deflate(raw: bytes) -> bytes:
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush()


def streams(files: DataFrame) -> DataFrame:
    """(doc, path, raw, logical, error): streams of compound files, inflated where the header and path say so.

    A file that can't be read has one row with the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    found = compound.Reader(raw.as_py() or b"").streams()
                    header = found.get("FileHeader", b"")
                    if not header.startswith(SIGNATURE.encode()):
                        raise compound.CompoundError("no file header")
                    packed = len(header) >= 40 and header[36] & 1
                    for path, b in found.items():
                        rows.append((path, b, inflate(b) if packed and (path == "DocInfo" or path.startswith("BodyText/")) else b, None))
                except (compound.CompoundError, zlib.error, struct.error) as e:
                    rows = [(None, None, None, f"{type(e).__name__}: {e}")]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.string()), strict=True))], ["doc", "path", "raw", "logical", "error"])

    return files.select("doc", "content").mapInArrow(run, "doc string, path string, raw binary, logical binary, error string")


def layout(files: DataFrame) -> DataFrame:
    """(doc, path, kind, start, size): entries of the directories of compound files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    e = compound.Reader(raw.as_py() or b"").entries
                except (compound.CompoundError, struct.error):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(e), pa.string()), pa.array([x.path for x in e]), pa.array([x.kind for x in e], pa.int32()), pa.array([x.start for x in e], pa.int64()), pa.array([x.size for x in e], pa.int64())], ["doc", "path", "kind", "start", "size"])

    return files.select("doc", "content").mapInArrow(run, "doc string, path string, kind int, start long, size long")


def file_header(found: DataFrame) -> DataFrame:
    """(doc, signature, version, flags, compressed, password, distributable)."""
    h = found.where("path = 'FileHeader'")
    raw, flags = F.col("raw"), little_endian(F.col("raw"), 36, 4)
    version = F.concat_ws(".", *[little_endian(raw, 35 - i, 1).cast("string") for i in range(4)])
    bit = lambda i: F.getbit(flags, F.lit(i)) == 1
    name = F.regexp_extract(F.decode(F.substring(raw, 1, 32), "ISO-8859-1"), "^([^\\x00]*)", 1)
    return h.select("doc", name.alias("signature"), version.alias("version"), flags.alias("flags"), bit(0).alias("compressed"), bit(1).alias("password"), bit(2).alias("distributable"))


def parse_records(raw: bytes, strict: bool = True) -> Iterator[tuple]:
    """(ord, tag_id, level, size, header_size, offset, payload); a truncated last record is dropped, or kept short unless strict."""
    at = n = 0
    while at + 4 <= len(raw):
        (head,) = struct.unpack_from("<I", raw, at)
        size, wide = head >> 20, 4
        if size == 0xFFF:
            if at + 8 > len(raw):
                return
            size, wide = struct.unpack_from("<I", raw, at + 4)[0], 8
        payload = raw[at + wide : at + wide + size]
        if len(payload) < size and strict:
            return
        yield n, head & 0x3FF, head >> 10 & 0x3FF, size, wide, at, payload
        at, n = at + wide + size, n + 1


def record_bytes(tag_id: int, level: int, payload: bytes) -> bytes:
    size = len(payload)
    head = tag_id & 0x3FF | (level & 0x3FF) << 10 | min(size, 0xFFF) << 20
    return struct.pack("<I", head) + (struct.pack("<I", size) if size >= 0xFFF else b"") + payload


def records(found: DataFrame, strict: bool = True) -> DataFrame:
    """(doc, stream, section_index, ord, tag_id, level, size, header_size, offset, payload, parent, end, ancestors).

    Sections are numbered by the order of their paths as text, as the format's
    readers do. `parent` is the nearest earlier record of a smaller level, `end`
    the last record below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "stream", "ord", "tag_id", "level", "size", "header_size", "offset", "payload", "parent", "end", "ancestors"]
        types = [pa.string(), pa.string(), *[pa.int32()] * 3, pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        for batch in batches:
            for doc, path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows, up = [], []
                for r in parse_records(raw.as_py() or b"", strict):
                    while up and rows[up[-1]][4] >= r[2]:
                        up.pop()
                    rows.append([doc, path, *r, up[-1] if up else None, r[0], list(up)])
                    up.append(r[0])
                for r in reversed(rows):
                    if r[9] is not None:
                        rows[r[9]][10] = max(rows[r[9]][10], r[10])
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000], strict=True), types, strict=True)], names)

    own = found.where(F.col("path").startswith("BodyText/") | (F.col("path") == "DocInfo"))
    index = F.row_number().over(Window.partitionBy("doc", F.col("path").startswith("BodyText/")).orderBy("path")) - 1
    numbers = own.select("doc", F.col("path").alias("stream"), F.when(F.col("path").startswith("BodyText/"), index).alias("section_index"))
    schema = "doc string, stream string, ord int, tag_id int, level int, size long, header_size int, offset long, payload binary, parent int, end int, ancestors array<int>"
    return own.select("doc", "path", "logical").mapInArrow(run, schema).join(numbers, ["doc", "stream"])


def _visible(raw: bytes) -> str:
    """Text without control characters: line breaks and tabs stay, a control of eight units goes as one."""
    units = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if u >= 32 or u in (9, 10, 13):
            out.append(u)
        i += 8 if u < 32 and i + 7 < len(units) and not any(units[i + 3 : i + 7]) else 1
    # Pairs of surrogates become one character again; a lone one can't be held by a string.
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "ignore")


def paragraphs(rows: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, level, char_count, control_mask, para_shape_id, style_id, split_flags, raw_text, text, ord)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decode("utf-16-le", "ignore") for v in values]), pa.array([_visible(v) for v in values])], ["at", "raw_text", "text"])

    body = rows.where("section_index is not null")
    order = Window.partitionBy("doc", "section_index").orderBy("ord")
    marked = body.where(tag("para_header") | tag("para_text")).withColumn("paragraph", F.sum(F.when(tag("para_header"), 1).otherwise(0)).over(order) - 1).where("paragraph >= 0")
    last = marked.where(tag("para_text")).groupBy("doc", "section_index", "paragraph").agg(F.max_by("payload", "ord").alias("payload"))
    texts = last.select(F.struct("doc", "section_index", "paragraph").alias("at"), "payload").mapInArrow(run, "at struct<doc:string,section_index:int,paragraph:bigint>, raw_text string, text string").select("at.*", "raw_text", "text")
    p = lambda at, n: F.coalesce(little_endian(F.col("payload"), at, n), F.lit(0))
    heads = marked.where(tag("para_header")).select("doc", "section_index", "paragraph", "level", "ord", p(0, 4).alias("char_count"), p(4, 4).alias("control_mask"), p(8, 2).alias("para_shape_id"), p(10, 1).alias("style_id"), p(11, 1).alias("split_flags"))
    return heads.join(texts, ["doc", "section_index", "paragraph"], "left").withColumn("raw_text", F.coalesce("raw_text", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))


def text_tokens(rows: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, token, at, units, kind, text, control_id): texts of paragraphs as runs of characters and controls.

    A control is eight units whose fourth to seventh are 0, after a code below
    32; it is a `control` with the id that it names, or the `end` of a field. A
    code without that form is passed over, but for tabs and breaks, which are
    characters. `at` counts units from the paragraph's start; lone surrogates
    are dropped from texts.
    """

    def cut(raw: bytes) -> list[tuple[int, int, str, str | None, str | None]]:
        u = np.frombuffer(raw, "<u2", len(raw) // 2)
        out, i, begin, kept = [], 0, None, []

        def close(end: int) -> None:
            nonlocal begin
            if begin is not None:
                out.append((begin, end - begin, "text", np.array(kept, "<u2").tobytes().decode("utf-16-le", "ignore"), None))
                begin = None
                kept.clear()

        for stop in [*np.flatnonzero(u < 32).tolist(), len(u)]:
            if stop < i:  # within a control
                continue
            if stop > i:
                begin = i if begin is None else begin
                kept.extend(u[i:stop].tolist())
            if stop == len(u):
                i = stop
                break
            if stop + 7 < len(u) and not u[stop + 3 : stop + 7].any():
                if u[stop] in (9, 10, 13):
                    begin = stop if begin is None else begin
                    kept.append(int(u[stop]))
                close(stop)
                name = u[stop + 1 : stop + 3].tobytes()[::-1].decode("latin-1")
                out.append((stop, 8, "end", None, None) if name == "\0\0\0\0" else (stop, 8, "control", None, name))
                i = stop + 8
            else:
                if u[stop] in (9, 10, 13):
                    begin = stop if begin is None else begin
                    kept.append(int(u[stop]))
                i = stop + 1
        close(i)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                found = [(n, *t) for n, t in enumerate(cut(batch.column(1)[i].as_py() or b""))]
                for j in range(0, len(found), 20_000):
                    piece = list(zip(*found[j : j + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(piece[0]))), *(pa.array(c, t) for c, t in zip(piece, types, strict=True))], ["p", "token", "at", "units", "kind", "text", "control_id"])

    body = rows.where("section_index is not null")
    order = Window.partitionBy("doc", "section_index").orderBy("ord")
    marked = body.where(tag("para_header") | tag("para_text")).withColumn("paragraph", F.sum(F.when(tag("para_header"), 1).otherwise(0)).over(order) - 1).where("paragraph >= 0")
    last = marked.where(tag("para_text")).groupBy("doc", "section_index", "paragraph").agg(F.max_by("payload", "ord").alias("payload"))
    made = last.select(F.struct("doc", "section_index", "paragraph").alias("p"), "payload").mapInArrow(run, "p struct<doc:string,section_index:int,paragraph:bigint>, token int, at int, units int, kind string, text string, control_id string")
    return made.select("p.*", "token", "at", "units", "kind", "text", "control_id")


def inline_controls(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, token, ord): each control in a text with its record, in order; `ord` is null where there is none.

    `tokens` are text_tokens(), `found` controls(). A token takes the first
    record of its id after the last one taken, as records follow their texts.
    """
    at = ["doc", "section_index", "paragraph"]
    mine = tokens.where("kind = 'control'").select(*at, F.col("token").cast("long").alias("ord"), "control_id")
    theirs = found.select(*at, F.col("ord").cast("long").alias("ord"), "control_id")
    pairs = R.forward_matches(mine, theirs.join(mine.select(*at).distinct(), at, "left_semi"), at, "ord", "control_id")
    return pairs.select(*at, F.col("token_ord").cast("int").alias("token"), F.col("item_ord").cast("int").alias("ord"))


def shown_texts(tokens: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, token, text): what each field shows, by the token that begins it; texts in a field within count for the inner one."""
    at = ["doc", "section_index", "paragraph"]
    order = Window.partitionBy(*at).orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    field = (F.col("kind") == "control") & F.startswith("control_id", F.lit("%"))
    # Ends are matched like brackets: at every depth the last field begun is the open one.
    deep = tokens.withColumn("_begin", F.when(field, F.col("token"))).withColumn("_depth", F.sum(F.when(field, 1).when(F.col("kind") == "end", -1).otherwise(0)).over(order))
    level = Window.partitionBy(*at, "_depth").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    owned = deep.withColumn("_open", F.max("_begin").over(level)).where("kind = 'text' and _depth > 0 and _open is not null")
    texts = R.joined_text(owned, [*at, "_open"], "token", "text", "").withColumnRenamed("_open", "token")
    return deep.where(field).select(*at, "token").join(texts, [*at, "token"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def document_text(found: DataFrame) -> DataFrame:
    """(doc, text): carriage returns are line breaks, breaks at the ends and empty paragraphs go."""
    clean = F.regexp_replace(F.replace("text", F.lit("\r"), F.lit("\n")), r"^\n+|\n+$", "")
    rows = found.withColumn("text", clean).where("text <> ''").withColumn("at", F.struct("section_index", "paragraph"))
    return found.select("doc").distinct().join(R.joined_text(rows, ["doc"], "at", "text", "\n"), "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"))


def below(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Records at any depth below each of `tops` (doc, stream, top), by their lists of ancestors."""
    own = rows.select("doc", "stream", "ord", "tag_id", "size", "payload", F.explode("ancestors").alias("top"))
    return own.join(tops.select("doc", "stream", F.col("ord").alias("top")), ["doc", "stream", "top"])


def controls(rows: DataFrame) -> DataFrame:
    """(doc, section_index, paragraph, ord, control_id, kind, payload): controls with the paragraph they stand in.

    A graphic control is the kind of shape whose record lies below it.
    """
    order = Window.partitionBy("doc", "section_index").orderBy("ord")
    body = rows.where("section_index is not null").withColumn("paragraph", F.sum(F.when(tag("para_header"), 1).otherwise(0)).over(order) - 1)
    heads = body.where(tag("ctrl_header")).withColumn("control_id", control_id(F.col("payload")))
    graphic = heads.where("control_id = 'gso '")
    rank = F.array_position(F.array(*[F.lit(TAGS[s]) for s in SHAPES]), F.col("tag_id"))
    shapes = below(rows.where("section_index is not null"), graphic).groupBy("doc", "stream", F.col("top").alias("ord")).agg(F.min(F.when(rank > 0, rank)).alias("r"), F.max(tag("shape_component") & F.startswith("payload", F.lit(CONNECT_LINE))).alias("connects"))
    name = F.element_at(F.array(*[F.lit({"chart_data": "chart"}.get(s, s)) for s in SHAPES]), F.col("r").cast("int"))
    known = F.create_map(*[F.lit(x) for kv in CONTROLS.items() for x in kv])[F.col("control_id")]
    name = F.when(F.coalesce("connects", F.lit(False)) & (name == "line"), "connect_line").otherwise(name)
    kind = F.when(F.col("control_id") == "gso ", F.coalesce(name, F.lit("shape"))).otherwise(F.coalesce(known, F.when(F.col("control_id").startswith("%"), "field"), F.lit("other")))
    return heads.join(shapes, ["doc", "stream", "ord"], "left").select("doc", "stream", "section_index", "paragraph", "ord", "control_id", kind.alias("kind"), "payload")


_SHAPE_KINDS = ("shape", "line", "connect_line", "rectangle", "ellipse", "arc", "polygon", "curve", "container", "textart", "ole", "chart")
#: Selector -> kinds of controls: shapes hold oles and charts, lines don't hold connecting lines. Fields go by their ids.
SELECTORS: dict[str, tuple[str, ...]] = {
    "tables": ("table",), "pictures": ("picture",), "hyperlinks": ("hyperlink",), "bookmarks": ("bookmark",), "notes": ("footnote", "endnote"), "page_numbers": ("page_number",), "shapes": _SHAPE_KINDS, "forms": ("form",), "memos": ("memo",), "equations": ("equation",),
    "mail_merge_fields": ("mail_merge_field",), "calculation_fields": ("calculation_field",), "cross_references": ("cross_reference",), "doc_property_fields": ("doc_property_field",), "date_fields": ("date_field",), **{f"{s}s": (s,) for s in _SHAPE_KINDS[1:]},
}


def select(found: DataFrame, selector: str) -> DataFrame:
    """Controls of a selector (see SELECTORS); fields are all that have a field's id."""
    return found.where(F.col("control_id").startswith("%")) if selector == "fields" else found.where(F.col("kind").isin(*SELECTORS[selector]))


def select_all(found: DataFrame) -> DataFrame:
    """Controls with each `selector` that finds them: a row for each, in one pass."""
    kinds = sorted({k for ks in SELECTORS.values() for k in ks})
    by_kind = F.create_map(*[x for k in kinds for x in (F.lit(k), F.array(*[F.lit(s) for s, ks in SELECTORS.items() if k in ks]))])
    own = F.coalesce(by_kind[F.col("kind")], F.array().cast("array<string>"))
    return found.withColumn("selector", F.explode(F.when(F.col("control_id").startswith("%"), F.array_append(own, F.lit("fields"))).otherwise(own)))


def table_cells(rows: DataFrame) -> DataFrame:
    """(doc, section_index, table, ord, row, column, row_span, col_span, text) of native tables' cells; `table` is the control's place.

    A cell is a list below the control after its table record; its paragraphs,
    which follow it, are joined by line breaks. Tables within keep their own cells.
    """
    body = rows.where("section_index is not null")
    p = F.col("payload")
    tables = body.where(tag("ctrl_header") & (control_id(p) == "tbl ")).select("doc", "section_index", F.col("ord").alias("parent"))
    inner = body.where(tag("list_header") | tag("para_header") | tag("table")).join(tables, ["doc", "section_index", "parent"])
    order = Window.partitionBy("doc", "section_index", "parent").orderBy("ord")
    inner = inner.withColumns({"cell": F.max(F.when(tag("list_header"), F.col("ord"))).over(order), "seen": F.max(tag("table")).over(order)}).where("seen")
    found = paragraphs(rows).select("doc", "section_index", "ord", F.regexp_replace("text", "\r", "").alias("text"))
    texts = R.joined_text(inner.where(tag("para_header")).select("doc", "section_index", "ord", "cell").join(found, ["doc", "section_index", "ord"]), ["doc", "section_index", "cell"], "ord", "text", "\n")
    word = lambda at, other: F.coalesce(little_endian(p, at, 2), F.lit(other)).cast("int")
    cells = inner.where(tag("list_header")).select("doc", "section_index", F.col("parent").alias("table"), "ord", word(10, 0).alias("row"), word(8, 0).alias("column"), word(14, 1).alias("row_span"), word(12, 1).alias("col_span"))
    return cells.join(texts.withColumnRenamed("cell", "ord"), ["doc", "section_index", "ord"], "left").select("doc", "section_index", "table", "ord", "row", "column", "row_span", "col_span", F.coalesce("text", F.lit("")).alias("text"))


def table_matrices(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc, section_index, table, rows, cells): grids of native tables, as of `nodes.table_matrices`."""
    p, at = F.col("payload"), ["doc", "section_index", "table"]
    size = lambda i: F.coalesce(little_endian(p, i, 2), F.lit(0)).cast("int")
    t = rows.where(tag("table") & F.col("section_index").isNotNull()).select("doc", "section_index", F.col("parent").alias("table"), size(4).alias("n"), size(6).alias("m"))
    return grids(t, table_cells(rows), at, "ord", most)


# -- document information ----------------------------------------------------------------


def docinfo(rows: DataFrame, name: str) -> DataFrame:
    """Records of a kind in DocInfo, numbered from 0 by their order (their id)."""
    return R.ordinal(rows.where((F.col("stream") == "DocInfo") & tag(name)), ["doc"], [F.col("ord")], "id", 0)


def id_mappings(rows: DataFrame) -> DataFrame:
    """(doc, counts): declared counts by name; further ones are index_N."""
    n = (F.octet_length("payload") / 4).cast("int")
    name = lambda i: F.coalesce(F.get(F.array(*map(F.lit, ID_MAPPINGS)), i), F.concat(F.lit("index_"), i.cast("string")))
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    counts = F.map_from_entries(F.transform(index, lambda i: F.struct(name(i).alias("k"), little_endian(F.col("payload"), i * 4, 4).alias("v"))))
    return docinfo(rows, "id_mappings").where("id = 0").select("doc", counts.alias("counts"))


def document_properties(rows: DataFrame) -> DataFrame:
    names = ("section_count", "page_start", "footnote_start", "endnote_start", "picture_start", "table_start", "equation_start")
    p = F.col("payload")
    return docinfo(rows, "document_properties").where("id = 0").select("doc", *[little_endian(p, 2 * i, 2).alias(n) for i, n in enumerate(names)], *[little_endian(p, 14 + 4 * i, 4).alias(n) for i, n in enumerate(("list_id", "paragraph_id", "character_position"))])


def bin_data(rows: DataFrame) -> DataFrame:
    """(doc, id, kind, storage_id, extension, abs_path, rel_path): embedded data, or links by path."""
    p, flags = F.col("payload"), F.coalesce(little_endian(F.col("payload"), 0, 2), F.lit(0))
    link = flags.bitwiseAND(15) == 0
    rel_at = (F.lit(4) + little_endian(p, 2, 2) * 2).cast("int")
    return docinfo(rows, "bin_data").select("doc", "id", flags.bitwiseAND(15).cast("int").alias("kind"), F.when(~link, little_endian(p, 2, 2)).alias("storage_id"), F.when(~link, utf16_field(p, 4)).alias("extension"), F.when(link, utf16_field(p, 2)).alias("abs_path"), F.when(link, utf16_field(p, rel_at)).alias("rel_path"))


def face_names(rows: DataFrame) -> DataFrame:
    p = F.col("payload")
    bit = lambda i: F.getbit(little_endian(p, 0, 1), F.lit(i)) == 1
    return docinfo(rows, "face_name").select("doc", "id", little_endian(p, 0, 1).alias("flags"), utf16_field(p, 1).alias("name"), bit(7).alias("has_substitute"), bit(6).alias("has_information"), bit(5).alias("has_default"))


def styles(rows: DataFrame) -> DataFrame:
    """(doc, id, name, english_name, type, lang_id, next_style_id, para_shape_id, char_shape_id)."""
    p = F.col("payload")
    english = (F.lit(2) + little_endian(p, 0, 2) * 2).cast("int")
    at = english + F.lit(2) + (little_endian(p, english, 2) * 2).cast("int")
    word = lambda i: F.coalesce(little_endian(p, at + 2 * i, 2), F.lit(0))
    kind = word(0).bitwiseAND(255)
    return docinfo(rows, "style").select("doc", "id", utf16_field(p, 0).alias("name"), utf16_field(p, english).alias("english_name"), F.when(kind == 0, "PARA").when(kind == 1, "CHAR").otherwise(F.concat(F.lit("CODE_"), kind.cast("string"))).alias("type"), word(1).alias("lang_id"), word(2).alias("next_style_id"), word(3).alias("para_shape_id"), word(4).alias("char_shape_id"))


def counts(rows: DataFrame) -> DataFrame:
    """(doc, control_counts, tag_counts): donors' summaries."""
    c = rows.where(tag("ctrl_header") & F.col("section_index").isNotNull()).groupBy("doc", control_id(F.col("payload")).alias("k")).agg(F.count("*").alias("n"))
    t = rows.groupBy("doc", F.col("tag_id").alias("k")).agg(F.count("*").alias("n"))
    as_map = lambda df, name: df.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    return as_map(t, "tag_counts").join(as_map(c, "control_counts"), "doc", "left").select("doc", F.coalesce("control_counts", F.create_map().cast("map<string,bigint>")).alias("control_counts"), "tag_counts")


def best_donor(summaries: DataFrame, k: int = 1) -> DataFrame:
    """Documents with most tables, then pictures (graphics with picture records), then links, then by name."""
    n = lambda key: F.coalesce(F.col("control_counts")[key], F.lit(0))
    pictures = F.when(F.coalesce(F.col("tag_counts")[TAGS["picture"]], F.lit(0)) > 0, n("gso ")).otherwise(F.lit(0))
    return R.top_k(summaries, [], [n("tbl ").desc(), pictures.desc(), n("%hlk").desc(), F.col("doc")], k)


# -- lint ----------------------------------------------------------------------------------


def lint(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Issues of binary documents: counts, binary data, references, subtrees and payloads."""
    data = bin_data(rows).where("storage_id > 0")
    first = data.withColumn("n", F.row_number().over(Window.partitionBy("doc", "storage_id").orderBy("id")))
    files = found.where(F.col("path").rlike(r"^BinData/BIN\d+\.")).select("doc", "path", F.regexp_extract("path", r"BIN(\d+)\.", 1).cast("long").alias("storage_id")).withColumn("n", F.row_number().over(Window.partitionBy("doc", "storage_id").orderBy("path")))
    both = first.where("n = 1").select("doc", "storage_id", "extension", F.lit(True).alias("declared")).join(files.where("n = 1").select("doc", "storage_id", "path"), ["doc", "storage_id"], "full_outer")
    ext, want = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)), F.lower(F.regexp_replace("extension", r"^\.+", ""))
    said = F.format_string
    out = [
        issues(first.where("n > 1"), "docinfo_mapping", said("Duplicate BinData docinfo storage id: %d", "storage_id"), context="DocInfo"),
        issues(files.where("n > 1"), "binary_closure", said("Duplicate BinData stream for storage id %d: %s", "storage_id", "path"), context="BinData"),
        issues(both.where("path is null"), "binary_closure", said("DocInfo BinData id %d is missing a BinData stream.", "storage_id"), context="DocInfo"),
        issues(both.where("declared is null"), "binary_closure", said("BinData stream is not declared in DocInfo: %s", "path"), context="BinData"),
        issues(both.where((want != "") & (ext != "") & (want != ext)), "binary_media_type", said("DocInfo BinData id %d expects .%s but stream path is %s.", F.col("storage_id"), want, F.col("path")), context="BinData"),
    ]
    maps = id_mappings(rows)
    kinds = {"border_fills": "border_fill", "char_shapes": "char_shape", "tab_defs": "tab_def", "numberings": "numbering", "bullets": "bullet", "para_shapes": "para_shape", "styles": "style", "memo_shapes": "memo_shape", "track_changes": "track_change", "track_change_authors": "track_change_author"}
    tags = F.create_map(*[F.lit(x) for c, t in kinds.items() for x in (TAGS[t], c)])
    actual = rows.where("stream = 'DocInfo'").groupBy("doc", tags[F.col("tag_id")].alias("what")).agg(F.count("*").alias("n")).where("what is not null")
    short = actual.join(maps, "doc").withColumn("declared", F.coalesce(F.try_element_at("counts", F.col("what")), F.lit(0))).where("declared < n")
    out.append(issues(short, "docinfo_mapping", said("DocInfo id_mappings.%s=%d is smaller than actual %s record count %d.", "what", "declared", "what", "n"), context="DocInfo"))
    most = both.groupBy("doc").agg(F.max("storage_id").alias("most")).join(maps, "doc").withColumn("declared", F.coalesce(F.try_element_at("counts", F.lit("bin_data")), F.lit(0))).where("declared < most")
    out.append(issues(most, "docinfo_mapping", said("DocInfo id_mappings.bin_data_count=%d is smaller than max BinData id %d.", "declared", "most"), context="DocInfo"))
    have = rows.where("stream = 'DocInfo'").groupBy("doc").agg(F.count_if(tag("para_shape")).alias("shapes"), F.count_if(tag("style")).alias("styles"))
    p = paragraphs(rows).join(have, "doc")
    where = {"section_index": F.col("section_index"), "paragraph_index": F.col("paragraph")}
    out.append(issues(p.where("para_shape_id >= shapes"), "docinfo_reference", said("Paragraph references missing para shape id %d.", "para_shape_id"), context="ParagraphHeader", **where))
    out.append(issues(p.where("style_id >= styles"), "docinfo_reference", said("Paragraph references missing style id %d.", "style_id"), context="ParagraphHeader", **where))
    ctrl = controls(rows)
    body = rows.where("section_index is not null")
    need = [("gso ", ("shape_component", "chart_data"), "Graphic control does not contain a shape component or chart data record."), *((f, ("form_object",), "Form control does not contain a form object record.") for f in ("form", "mrof")), ("tbl ", ("table",), "Table control does not contain a table record.")]
    for cid, wanted, text in need:
        own = ctrl.where(F.col("control_id") == cid)
        have_it = below(body, own).where(F.col("tag_id").isin(*[TAGS[w] for w in wanted])).select("doc", "stream", F.col("top").alias("ord"))
        out.append(issues(own.join(have_it, ["doc", "stream", "ord"], "left_anti"), "control_subtree", text, **where))
    for name, least, text in (("picture", 73, "Picture payload is shorter than the expected 73-byte minimum."), ("ole", 20, "OLE payload is shorter than the expected 20-byte minimum.")):
        out.append(issues(body.where(tag(name) & (F.col("size") < least)), "payload_sanity", text, section_index=F.col("section_index")))
    for name, text in (("chart_data", "Chart payload is not UTF-16 aligned."), ("form_object", "Form payload is not UTF-16 aligned."), ("memo_list", "Memo payload is not UTF-16 aligned.")):
        out.append(issues(body.where(tag(name) & (F.col("size") % 2 == 1)), "payload_sanity", text, section_index=F.col("section_index")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.select(*ISSUE)


# -- writing ---------------------------------------------------------------------------------


def rebuild(found: DataFrame) -> DataFrame:
    """(doc, content): compound files of streams (doc, path, logical), deflated as the header's flag asks. One file, one task."""

    def pack(pdf):
        import pandas as pd

        have = {p: bytes(b) for p, b in zip(pdf["path"], pdf["logical"], strict=True)}
        packed = len(h := have.get("FileHeader", b"")) >= 40 and h[36] & 1
        have = {p: deflate(b) if packed and (p == "DocInfo" or p.startswith("BodyText/")) else b for p, b in have.items()}
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "content": [compound.write(have)]})

    return found.where("path is not null").select("doc", "path", "logical").groupBy("doc").applyInPandas(pack, "doc string, content binary")


def encode(rows: DataFrame) -> DataFrame:
    """(doc, path, logical): streams from their records in order."""

    def join(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        raw = b"".join(record_bytes(int(t), int(v), bytes(p)) for t, v, p in zip(pdf["tag_id"], pdf["level"], pdf["payload"], strict=True))
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "path": [pdf["stream"].iloc[0]], "logical": [raw]})

    return rows.select("doc", "stream", "ord", "tag_id", "level", "payload").groupBy("doc", "stream").applyInPandas(join, "doc string, path string, logical binary")


# -- differences -----------------------------------------------------------------------------


def stream_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, path, status) of streams that differ between two versions of each document, by digest: added, removed or changed."""
    cut = lambda r, name: r.where("path is not null").select("doc", "path", F.sha2("logical", 256).alias(name))
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed")
    return cut(a, "x").join(cut(b, "y"), ["doc", "path"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("doc", "path", status.alias("status"))


def record_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of each document that differ by place in their stream."""
    cut = lambda r: r.select("doc", "stream", "ord", "tag_id", "level", F.sha2("payload", 256).alias("digest"))
    return R.positional_diff(cut(a), cut(b), ["doc", "stream", "ord"], ["tag_id", "level", "digest"])


def subtree_diff(a: DataFrame, b: DataFrame, kind: str = "shape_component") -> DataFrame:
    """Records of each document that differ below records of a kind, by place below the nth one of each stream."""

    def cut(rows: DataFrame) -> DataFrame:
        tops = R.ordinal(rows.where(tag(kind)), ["doc", "stream"], [F.col("ord")], "nth", 0).select("doc", "stream", F.col("ord").alias("top"), "nth", F.col("level").alias("base"))
        own = rows.withColumn("top", F.explode(F.concat("ancestors", F.array("ord")))).join(tops, ["doc", "stream", "top"])
        return own.select("doc", "stream", "nth", (F.col("ord") - F.col("top")).alias("at"), "tag_id", (F.col("level") - F.col("base")).alias("depth"), F.sha2("payload", 256).alias("digest"))

    return R.positional_diff(cut(a), cut(b), ["doc", "stream", "nth", "at"], ["tag_id", "depth", "digest"])


def layout_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of each document's directory that differ between two files of it, by path."""
    return R.positional_diff(a, b, ["doc", "path"], ["kind", "start", "size"])


def capacities(found: DataFrame) -> DataFrame:
    """(doc, path, capacity, needed, fits): whether each stream's `logical` bytes, deflated where the header asks, fit in the room of its `raw` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(deflate(b.as_py() or b"")) if packed else len(b.as_py() or b"") for b, packed in zip(batch.column(3), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], ["doc", "path", "capacity", "needed"])

    packed = F.coalesce("compressed", F.lit(False)) & (F.col("path").startswith("BodyText/") | (F.col("path") == "DocInfo"))
    rows = found.where("path is not null").join(file_header(found).select("doc", "compressed"), "doc", "left").select("doc", "path", F.octet_length("raw").cast("long").alias("capacity"), "logical", packed.alias("packed"))
    return rows.mapInArrow(run, "doc string, path string, capacity long, needed long").withColumn("fits", F.col("needed") <= F.col("capacity"))


def audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, streams, same, changed, added, removed): streams of files before and after a save, by digest."""
    x = before.where("path is not null").select("doc", "path", F.sha2("logical", 256).alias("x"))
    y = after.where("path is not null").select("doc", "path", F.sha2("logical", 256).alias("y"))
    a, b = F.col("x"), F.col("y")
    return x.join(y, ["doc", "path"], "full_outer").groupBy("doc").agg(F.count("*").alias("streams"), F.count_if(a == b).alias("same"), F.count_if(a != b).alias("changed"), F.count_if(a.isNull()).alias("added"), F.count_if(b.isNull()).alias("removed"))

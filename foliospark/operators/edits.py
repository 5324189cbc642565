"""Edits of document packages as rewrites of the node table.

Each takes and gives nodes (doc, part, pre, end, parent, depth, nth, paragraph,
ns, local, text, tail, attrs, ancestors, section_index). Structure is edited
part by part, attributes and texts are plain column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import markup_safe, occurrences
from foliospark.operators.relational import replace_within_budget
from foliospark.sources import packages as P
from foliospark.sources.shared import ROWS, ordered


def _renumber(rows: list[dict]) -> list[dict]:
    """Intervals, parents and ordinals from the order and depth of rows."""
    up: list[dict] = []
    count: list[int] = [0]
    top = -1
    for i, r in enumerate(rows):
        del up[r["depth"] :], count[r["depth"] + 1 :]
        r |= {"pre": i, "end": i, "parent": up[-1]["pre"] if up else None, "nth": count[-1], "ancestors": [u["pre"] for u in up]}
        count[-1] += 1
        count.append(0)
        if r["depth"] == 1 and r["local"] == "p":
            top += 1
        r["paragraph"] = top if top >= 0 and (r["depth"] > 1 or r["local"] == "p") else None
        up.append(r)
        for u in up:
            u["end"] = i
    return rows


def rewrite(nodes: DataFrame, edit: Callable[[list[dict]], list[dict]], section_index: int | None = None, part: str | None = None) -> DataFrame:
    """Edit the rows of each part (of the section or part, if one is named) in document order.

    A part is one task's work, as its order is; the input is read once, so
    edits can follow each other without their plans growing out of hand. Rows
    need `depth` and order only, the rest is numbered anew. Parts that aren't
    edited go through as they are.
    """
    names = nodes.columns
    own = {k: v for k, v in (("section_index", section_index), ("part", part)) if v is not None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[dict] = []  # rows of the part that is being read
        done: list[dict] = []
        schema = None

        def finish() -> None:
            shared = {k: held[0][k] for k in ("doc", "part", "section_index")}
            done.extend({**dict.fromkeys(names), **r, **shared} for r in _renumber(edit(list(held))))
            held.clear()

        def made() -> pa.RecordBatch:
            value = lambda r, n: list(r[n].items()) if n == "attrs" and r[n] is not None else r[n]
            out = pa.RecordBatch.from_arrays([pa.array([value(r, f.name) for r in done], f.type) for f in schema], schema=schema)
            done.clear()
            return out

        for batch in batches:
            schema, mine = batch.schema, batch
            for k, v in own.items():
                chosen = pc.fill_null(pc.equal(mine.column(k), pa.scalar(v, schema.field(k).type)), False)
                rest, mine = mine.filter(pc.invert(chosen)), mine.filter(chosen)
                if rest.num_rows:
                    yield rest
            for r in mine.select([n for n in names if n != "ancestors"]).to_pylist():
                if held and (held[0]["doc"], held[0]["part"]) != (r["doc"], r["part"]):
                    finish()
                held.append(r | {"attrs": dict(r["attrs"]) if r["attrs"] is not None else None})
            if len(done) >= ROWS:
                yield made()
        if held:
            finish()
        if done:
            yield made()

    return ordered(nodes.where("pre is not null"), ["doc", "part"], "pre").mapInArrow(run, nodes.schema)


def fragment(xml: str) -> list[dict]:
    """Rows of one XML element, at depth 1; its prefixes are those of NAMESPACES. It must have one root."""
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in P.NAMESPACES.items())
    rows, error = P.parse(f"<wrap {spaces}>{xml}</wrap>".encode())
    if error or sum(r[3] == 1 for r in rows) != 1:
        raise ValueError(error or "one root element is expected")
    return [{"depth": r[3], "ns": r[6], "local": r[7], "text": r[8], "tail": r[9], "attrs": r[10]} for r in rows if r[3] >= 1]


def _tops(rows: list[dict]) -> list[tuple[int, int]]:
    """[begin, end) of the top-level paragraphs."""
    return [(i, r["end"] + 1) for i, r in enumerate(rows) if r["depth"] == 1 and r["local"] == "p"]


def _put(rows: list[dict], index: int, new: list[dict]) -> list[dict]:
    """With rows before the paragraph `index`; negative counts from the end, beyond it is the end."""
    tops = _tops(rows)
    i = max(0, len(tops) + index) if index < 0 else min(index, len(tops))
    at = tops[i][0] if i < len(tops) else tops[-1][1] if tops else len(rows)
    return [*rows[:at], *(dict(r) for r in new), *rows[at:]]


def insert_paragraph_xml(nodes: DataFrame, section_index: int, index: int, xml: str) -> DataFrame:
    """Put an element before the paragraph `index` of a section of every document."""
    new = fragment(xml)
    return rewrite(nodes, lambda rows: _put(rows, index, new), section_index)


def paragraph_xml(text: str, para: str = "0", style: str = "0", char: str = "0") -> str:
    from xml.sax.saxutils import escape

    return f'<hp:p id="0" paraPrIDRef="{para}" styleIDRef="{style}" pageBreak="0" columnBreak="0" merged="0"><hp:run charPrIDRef="{char}"><hp:t>{escape(markup_safe(text))}</hp:t></hp:run></hp:p>'


def insert_paragraph(nodes: DataFrame, section_index: int, index: int, text: str) -> DataFrame:
    return insert_paragraph_xml(nodes, section_index, index, paragraph_xml(text))


def append_paragraph(nodes: DataFrame, section_index: int, text: str) -> DataFrame:
    return insert_paragraph(nodes, section_index, 1 << 30, text)


def delete_paragraph(nodes: DataFrame, section_index: int, paragraph: int) -> DataFrame:
    """Without that paragraph; the only paragraph of a section stays."""

    def edit(rows: list[dict]) -> list[dict]:
        tops = _tops(rows)
        if len(tops) < 2 or not 0 <= paragraph < len(tops):
            return rows
        a, b = tops[paragraph]
        return rows[:a] + rows[b:]

    return rewrite(nodes, edit, section_index)


def copy_paragraph(nodes: DataFrame, section_index: int, paragraph: int, index: int, keep: bool = True) -> DataFrame:
    """Copy (or move) a paragraph to before the paragraph `index`, as numbered before."""

    def edit(rows: list[dict]) -> list[dict]:
        tops = _tops(rows)
        if not 0 <= paragraph < len(tops):
            return rows
        a, b = tops[paragraph]
        out = _put([r | {"_own": a <= i < b} for i, r in enumerate(rows)], index, [r | {"_own": False} for r in rows[a:b]])
        return [r for r in out if keep or not r["_own"]]

    return rewrite(nodes, edit, section_index)


def move_paragraph(nodes: DataFrame, section_index: int, paragraph: int, index: int) -> DataFrame:
    return copy_paragraph(nodes, section_index, paragraph, index, keep=False)


def _edit_paragraph(nodes: DataFrame, section_index: int, paragraph: int, change: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Rewrite the rows of one top-level paragraph; a paragraph that isn't there changes nothing."""

    def edit(rows: list[dict]) -> list[dict]:
        tops = _tops(rows)
        i = len(tops) + paragraph if paragraph < 0 else paragraph
        if not 0 <= i < len(tops):
            return rows
        a, b = tops[i]
        return rows[:a] + change(rows[a:b]) + rows[b:]

    return rewrite(nodes, edit, section_index)


def _under(rows: list[dict], depth: int) -> list[list[dict]]:
    """Subtrees of the elements at a depth, in order."""
    out: list[list[dict]] = []
    for r in rows:
        if r["depth"] == depth:
            out.append([r])
        elif r["depth"] > depth and out:
            out[-1].append(r)
    return out


def set_paragraph_text(nodes: DataFrame, section_index: int, paragraph: int, text: str, char: str = "0") -> DataFrame:
    """A paragraph's own text; runs that hold section properties or controls stay, without texts of their own."""
    new = [r | {"depth": r["depth"] + 1} for r in fragment(f'<hp:run charPrIDRef="{char}"><hp:t/></hp:run>')]
    new[1]["text"] = text

    def change(rows: list[dict]) -> list[dict]:
        kept = []
        for run in _under(rows, 2):
            inner = _under(run, 3)
            if run[0]["local"] == "run" and any(x[0]["local"] in ("secPr", "ctrl") for x in inner):
                kept += run[:1] + [r for x in inner if x[0]["local"] != "t" for r in x]
        return rows[:1] + kept + [dict(r) for r in new]

    return _edit_paragraph(nodes, section_index, paragraph, change)


def replace_paragraph_xml(nodes: DataFrame, section_index: int, paragraph: int, xml: str) -> DataFrame:
    new = fragment(xml)
    return _edit_paragraph(nodes, section_index, paragraph, lambda rows: [dict(r) for r in new])


def append_run_xml(nodes: DataFrame, section_index: int, paragraph: int, xml: str) -> DataFrame:
    """A new last run of a paragraph (-1: the last one)."""
    new = [r | {"depth": r["depth"] + 1} for r in fragment(xml)]
    return _edit_paragraph(nodes, section_index, paragraph, lambda rows: rows + [dict(r) for r in new])


def _controls(rows: list[dict]) -> list[tuple[int, int]]:
    """[begin, end) of a paragraph's controls: what stands in its runs but texts and section properties."""
    out = []
    for i, r in enumerate(rows):
        if r["depth"] == 3 and r["local"] not in ("t", "secPr"):
            j = i + 1
            while j < len(rows) and rows[j]["depth"] > 3:
                j += 1
            out.append((i, j))
    return out


def _in_run(control: list[dict]) -> list[dict]:
    return [r | {"depth": r["depth"] + 1} for r in fragment('<hp:run charPrIDRef="0"/>')] + [dict(r) for r in control]


def _with_control(rows: list[dict], at: int, control: list[dict]) -> list[dict]:
    """A run of its own for a control, before the run of the control `at`, or last."""
    found = _controls(rows)
    if at >= len(found):
        return rows + _in_run(control)
    i = found[at][0]
    while rows[i]["depth"] > 2:
        i -= 1
    return rows[:i] + _in_run(control) + rows[i:]


def insert_control_xml_at(nodes: DataFrame, section_index: int, paragraph: int, control: int, xml: str) -> DataFrame:
    new = [r | {"depth": r["depth"] + 2} for r in fragment(xml)]
    return _edit_paragraph(nodes, section_index, paragraph, lambda rows: _with_control(rows, control, new))


def delete_control(nodes: DataFrame, section_index: int, paragraph: int, control: int) -> DataFrame:
    """Without one control of a paragraph; one that isn't there changes nothing."""

    def change(rows: list[dict]) -> list[dict]:
        found = _controls(rows)
        return rows[: found[control][0]] + rows[found[control][1] :] if control < len(found) else rows

    return _edit_paragraph(nodes, section_index, paragraph, change)


def copy_control(nodes: DataFrame, section_index: int, paragraph: int, control: int, to_paragraph: int, to_control: int, keep: bool = True) -> DataFrame:
    """Copy (or move) a control of a section to before the control `to_control` of another of its paragraphs."""

    def edit(rows: list[dict]) -> list[dict]:
        tops = _tops(rows)
        if not (0 <= paragraph < len(tops) and 0 <= to_paragraph < len(tops)):
            return rows
        parts = [rows[a:b] for a, b in tops]
        found = _controls(parts[paragraph])
        if control >= len(found):
            return rows
        i, j = found[control]
        own = parts[paragraph][i:j]
        if not keep:
            parts[paragraph] = parts[paragraph][:i] + parts[paragraph][j:]
        parts[to_paragraph] = _with_control(parts[to_paragraph], to_control, own)
        out, at = [], 0
        for (a, b), new in zip(tops, parts, strict=True):
            out += rows[at:a] + new
            at = b
        return out + rows[at:]

    return rewrite(nodes, edit, section_index)


def move_control(nodes: DataFrame, section_index: int, paragraph: int, control: int, to_paragraph: int, to_control: int) -> DataFrame:
    return copy_control(nodes, section_index, paragraph, control, to_paragraph, to_control, keep=False)


HPF, HEADER = "Contents/content.hpf", "Contents/header.xml"


def _add_child(rows: list[dict], parent: str, new: list[dict]) -> list[dict]:
    """With rows as the last child of the first element of a name; without such an element, as they are."""
    at = next((i for i, r in enumerate(rows) if r["local"] == parent), None)
    if at is None:
        return rows
    depth, end = rows[at]["depth"] + 1, at + 1
    while end < len(rows) and rows[end]["depth"] >= depth:
        end += 1
    return rows[:end] + [r | {"depth": r["depth"] + depth - 1} for r in new] + rows[end:]


def _sections_of(rows: list[dict]) -> list[int]:
    return [int(m[1]) for r in rows if r["local"] == "item" and (m := re.match(P.SECTION, (r["attrs"] or {}).get("href") or ""))]


def _count_sections(nodes: DataFrame) -> DataFrame:
    """The declared number of sections is that of the parts."""
    n = nodes.where("section_index is not null").groupBy("doc").agg(F.count_distinct("part").alias("_n"))
    rows = nodes.join(n, "doc", "left")
    head = (F.col("part") == HEADER) & (F.col("depth") == 0) & F.col("_n").isNotNull()
    declared = F.map_concat(F.map_filter("attrs", lambda k, _: k != "secCnt"), F.create_map(F.lit("secCnt"), F.col("_n").cast("string")))
    return rows.withColumn("attrs", F.when(head, declared).otherwise(F.col("attrs"))).select(*nodes.columns)


def add_section(nodes: DataFrame, clone_from: int = 0) -> DataFrame:
    """Clone a section of every document as its last one, with its manifest item, its place in the spine and the count."""
    top = nodes.where("section_index is not null").groupBy("doc").agg((F.max("section_index") + 1).alias("_next"))
    name = lambda c: F.concat(F.lit("Contents/section"), c.cast("string"), F.lit(".xml"))
    new = nodes.where(F.col("section_index") == clone_from).join(top, "doc").withColumn("section_index", F.col("_next")).withColumn("part", name(F.col("_next"))).select(*[F.col(c).cast(nodes.schema[c].dataType) for c in nodes.columns])

    def edit(rows: list[dict]) -> list[dict]:
        n = max(_sections_of(rows), default=-1) + 1
        ids = {(r["attrs"] or {}).get("id") for r in rows if r["local"] == "item"}
        ident = next(x for x in (f"section{n}" + (f"_{k}" if k else "") for k in range(len(ids) + 1)) if x not in ids)
        rows = _add_child(rows, "manifest", fragment(f'<opf:item id="{ident}" href="Contents/section{n}.xml" media-type="application/xml"/>'))
        return _add_child(rows, "spine", fragment(f'<opf:itemref idref="{ident}"/>'))

    return _count_sections(rewrite(nodes, edit, part=HPF).unionByName(new))


def remove_section(nodes: DataFrame, section_index: int) -> DataFrame:
    """Without a section, its manifest item and its place in the spine; a document's only section stays."""
    many = nodes.where("section_index is not null").groupBy("doc").agg(F.count_distinct("part").alias("_n"), F.max(F.when(F.col("section_index") == section_index, F.col("part"))).alias("_gone")).where("_n > 1 and _gone is not null").select("doc", "_gone")
    rows = nodes.join(many, "doc", "left").where("_gone is null or part <> _gone")
    items = rows.where((F.col("part") == HPF) & (F.col("local") == "item") & (F.col("attrs")["href"] == F.col("_gone"))).select("doc", F.col("attrs")["id"].alias("_id"), F.col("_gone").alias("_href"))
    rows = rows.drop("_gone").join(items, "doc", "left")
    a = lambda k: F.col("attrs")[k]
    goes = (F.col("part") == HPF) & (((F.col("local") == "item") & (a("href") == F.col("_href"))) | ((F.col("local") == "itemref") & (a("idref") == F.col("_id"))))
    return _count_sections(rewrite(rows.where(~F.coalesce(goes, F.lit(False))).select(*nodes.columns), lambda rows: rows, part=HPF))


#: Names of metadata and the names they are written under.
META = {"creator": "creator", "subject": "subject", "description": "description", "lastsaveby": "lastsaveby", "created": "CreatedDate", "modified": "ModifiedDate", "date": "date", "keyword": "keyword"}


def set_metadata(nodes: DataFrame, **values: str) -> DataFrame:
    """Set the title, the language and named metadata of every document: the first element of a name gets the value, or a new one is added."""
    if unknown := set(values) - {"title", "language", *META}:
        raise ValueError(f"unknown metadata: {sorted(unknown)}")

    def edit(rows: list[dict]) -> list[dict]:
        for key, value in values.items():
            tag, name = (key, None) if key in ("title", "language") else ("meta", META[key])
            at = next((i for i, r in enumerate(rows) if r["local"] == tag and (name is None or (r["attrs"] or {}).get("name") == name)), None)
            if at is None:
                new = fragment(f"<opf:{tag}/>" if name is None else f'<opf:meta name="{name}"/>')
                new[0]["text"] = value
                rows = _add_child(rows, "metadata", new)
            else:
                rows[at]["text"] = value
        return rows

    return rewrite(nodes, edit, part=HPF)


def set_preview_text(parts: DataFrame, text: str) -> DataFrame:
    return put_part(parts, "Preview/PrvText.txt", text.encode())


def append_definition(nodes: DataFrame, tag: str, parent: str, **attrs: str) -> DataFrame:
    """A new definition (style, paraPr, charPr, memoPr) below `parent` in every header: its id is one more than the largest of its kind, unless given; `itemCnt` of the parent follows."""
    new = fragment(f"<hh:{tag}/>")

    def edit(rows: list[dict]) -> list[dict]:
        ids = [int(x) for r in rows if r["local"] == tag and (x := (r["attrs"] or {}).get("id") or "").isdigit()]
        rows = _add_child(rows, parent, [new[0] | {"attrs": {"id": str(max(ids, default=-1) + 1)} | attrs}])
        for r in rows:
            if r["local"] == parent and "itemCnt" in (r["attrs"] or {}):
                r["attrs"] = dict(r["attrs"]) | {"itemCnt": str(len(ids) + 1)}
        return rows

    return rewrite(nodes, edit, part=HEADER)


def delete_controls(nodes: DataFrame, *tags: str) -> DataFrame:
    """Without the elements of these names in sections, and all that is in them."""

    def edit(rows: list[dict]) -> list[dict]:
        out, until = [], -1
        for i, r in enumerate(rows):
            if i > until and r["local"] in tags and r["section_index"] is not None:
                until = r["end"]
            if i > until:
                out.append(r)
        return out

    return rewrite(nodes, edit)


def set_attributes(nodes: DataFrame, which: Column, **values: str) -> DataFrame:
    """Set attributes of the nodes that meet a condition (such as style references)."""
    new = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    kept = F.map_filter("attrs", lambda k, _: ~k.isin(*values))
    return nodes.withColumn("attrs", F.when(which, F.map_concat(kept, new)).otherwise(F.col("attrs")))


def apply_style(nodes: DataFrame, contains: str | None = None, pattern: str | None = None, **refs: str) -> DataFrame:
    """Set references of the top-level paragraphs whose text has a string and meets a pattern; without either, of none."""
    from foliospark.operators.nodes import paragraph_text

    if contains is None and pattern is None:
        return nodes
    cond = (F.contains("text", F.lit(contains)) if contains is not None else F.lit(True)) & (F.col("text").rlike(pattern) if pattern is not None else F.lit(True))
    hit = paragraph_text(nodes).where(cond).select("doc", "section_index", "paragraph", F.lit(True).alias("_hit"))
    rows = nodes.join(hit, ["doc", "section_index", "paragraph"], "left")
    return set_attributes(rows, F.coalesce("_hit", F.lit(False)) & (F.col("depth") == 1) & (F.col("local") == "p"), **refs).drop("_hit").select(*nodes.columns)


def update_text(nodes: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Texts through a column function; never across nodes."""
    return nodes.withColumn("text", F.when((F.col("local") == "t") & F.col("section_index").isNotNull(), change(F.col("text"))).otherwise(F.col("text")))


def replace_text(nodes: DataFrame, old: str, new: str, budget: int | None = None) -> DataFrame:
    """Replace in all texts of sections; with a budget only so many places of a document, in document order."""
    if budget is None:
        return update_text(nodes, lambda c: F.replace(c, F.lit(old), F.lit(new)))
    own = (F.col("local") == "t") & F.col("section_index").isNotNull()
    found = nodes.where(own).withColumn("_n", F.coalesce(occurrences(F.col("text"), old), F.lit(0))).withColumn("_at", F.struct("section_index", "pre"))
    share = replace_within_budget(found, "doc", "_at", "_n", budget).select("doc", "part", "pre", F.col("replaced").cast("int").alias("_k"))
    # The first k pieces are joined by the new text, the rest by the old one.
    parts = F.split("text", F.lit("\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"), -1)
    joined = F.concat(F.array_join(F.slice(parts, F.lit(1), F.col("_k") + 1), new), F.when(F.size(parts) > F.col("_k") + 1, F.concat(F.lit(old), F.array_join(F.slice(parts, F.col("_k") + 2, F.size(parts)), old))).otherwise(""))
    rows = nodes.join(share, ["doc", "part", "pre"], "left")
    return rows.withColumn("text", F.when(F.col("_k") > 0, joined).otherwise(F.col("text"))).select(*nodes.columns)


def count_replacements(nodes: DataFrame, old: str) -> DataFrame:
    return nodes.where((F.col("local") == "t") & F.col("section_index").isNotNull()).groupBy("doc").agg(F.sum(F.coalesce(occurrences(F.col("text"), old), F.lit(0))).cast("long").alias("n"))


def repair_layout(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without the line segments of paragraphs whose layout cache is stale."""
    from foliospark.operators.validate import paragraph_layout_cache

    stale = paragraph_layout_cache(parts, nodes).select("doc", F.col("part_path").alias("part"), F.col("paragraph_index").alias("paragraph"), F.lit(True).alias("_stale")).distinct()
    marked = nodes.join(stale, ["doc", "part", "paragraph"], "left")
    marked = marked.withColumn("local", F.when(F.col("_stale") & (F.col("local") == "linesegarray"), "stale").otherwise(F.col("local"))).select(*nodes.columns)
    return delete_controls(marked, "stale")


def put_part(parts: DataFrame, path: str, content: bytes) -> DataFrame:
    """Add a part at the end of every package, or replace it in its place."""
    new = parts.groupBy("doc").agg((F.max("entry_ord") + 1).alias("_next"), F.max(F.when(F.col("path") == path, F.col("entry_ord"))).alias("_at"))
    row = new.select("doc", F.coalesce("_at", "_next").alias("entry_ord"), F.lit(path).alias("path"), P.kind(F.lit(path), F.lit(content)).alias("kind"), F.lit(content).alias("content"), F.lit(path == "mimetype").alias("stored"), F.lit(1).cast("long").alias("copies"))
    return parts.where(F.col("path") != path).unionByName(row)


def remove_part(parts: DataFrame, path: str) -> DataFrame:
    return parts.where(F.col("path") != path)


#: XML of the controls that can be appended, by kind; values in braces are given.
CONTROLS = {
    "bookmark": '<hp:ctrl><hp:bookmark name="{name}"/></hp:ctrl>',
    "field": '<hp:ctrl><hp:fieldBegin id="{id}" fieldid="{id}" type="{type}" name="{name}"/></hp:ctrl>',
    "field_end": '<hp:ctrl><hp:fieldEnd beginIDRef="{id}" fieldid="{id}"/></hp:ctrl>',
    "hyperlink": '<hp:ctrl><hp:fieldBegin id="{id}" fieldid="{id}" type="HYPERLINK" name=""><hp:parameters cnt="2" name=""><hp:stringParam name="Command">{command};1;0;0;</hp:stringParam><hp:stringParam name="Path">{url}</hp:stringParam></hp:parameters></hp:fieldBegin></hp:ctrl>',
    "footnote": '<hp:ctrl><hp:footNote><hp:subList>{paragraph}</hp:subList></hp:footNote></hp:ctrl>',
    "endnote": '<hp:ctrl><hp:endNote><hp:subList>{paragraph}</hp:subList></hp:endNote></hp:ctrl>',
    "header": '<hp:ctrl><hp:header applyPageType="BOTH"><hp:subList>{paragraph}</hp:subList></hp:header></hp:ctrl>',
    "footer": '<hp:ctrl><hp:footer applyPageType="BOTH"><hp:subList>{paragraph}</hp:subList></hp:footer></hp:ctrl>',
    "memo": '<hp:ctrl><hp:hiddenComment><hp:subList>{paragraph}</hp:subList></hp:hiddenComment></hp:ctrl>',
    "auto_number": '<hp:ctrl><hp:autoNum num="{num}" numType="{type}"/></hp:ctrl>',
    "new_number": '<hp:ctrl><hp:newNum num="{num}" numType="{type}"/></hp:ctrl>',
    "equation": '<hp:equation><hp:sz/><hp:pos/><hp:outMargin/><hp:script>{script}</hp:script></hp:equation>',
    "picture": '<hp:pic><hp:sz/><hp:pos/><hp:outMargin/><hc:img binaryItemIDRef="{item}"/></hp:pic>',
    "shape": '<hp:{type}><hp:sz/><hp:pos/><hp:outMargin/></hp:{type}>',
    "ole": '<hp:ole binaryItemIDRef="{item}"><hp:sz/><hp:pos/><hp:outMargin/></hp:ole>',
    "form": '<hp:{type} name="{name}"><hp:sz/><hp:pos/><hp:outMargin/><hp:formCharPr/><hp:text>{text}</hp:text></hp:{type}>',
    "chart": '<hp:switch><hp:case><hp:chart chartIDRef="{part}"><hp:sz/><hp:pos/><hp:outMargin/></hp:chart></hp:case><hp:default><hp:ole binaryItemIDRef="{item}"><hp:rotationInfo/></hp:ole></hp:default></hp:switch>',
}


def control_xml(kind: str, **values: str) -> str:
    from xml.sax.saxutils import escape

    given = {k: v if k == "paragraph" else escape(markup_safe(v), {'"': "&quot;", "\n": "&#10;", "\t": "&#9;"}) for k, v in values.items()}
    if "url" in given:  # the command's own separators are escaped; the address stands whole beside it
        given["command"] = escape(markup_safe(values["url"]).replace(":", "\\:").replace(";", "\\;"))
    return CONTROLS[kind].format(**given)


def table_xml(rows: list[list[str]]) -> str:
    cell = lambda r, c, text: f'<hp:tc><hp:subList>{paragraph_xml(text)}</hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc>'
    lines = "".join("<hp:tr>" + "".join(cell(r, c, x) for c, x in enumerate(line)) + "</hp:tr>" for r, line in enumerate(rows))
    return f'<hp:tbl rowCnt="{len(rows)}" colCnt="{max(map(len, rows), default=0)}">{lines}</hp:tbl>'


def append_control(nodes: DataFrame, section_index: int, xml: str) -> DataFrame:
    """A new last paragraph that holds a control."""
    return insert_paragraph_xml(nodes, section_index, 1 << 30, f'<hp:p id="0" paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0">{xml}</hp:run></hp:p>')


def block_xml(kind: str, **values: str) -> str:
    """XML of a block by any of its names: the alias is resolved, what isn't given is empty or a default."""
    from foliospark.operators.convert import ALIASES

    name = re.sub(" +", "_", kind.strip().lower())
    name = ALIASES.get(name, name)
    if name == "table":
        return table_xml(values.get("rows") or [[""]])
    if name == "note":
        name = {"endNote": "endnote"}.get(values.get("which", ""), "footnote")
    if name not in CONTROLS:
        raise ValueError(f"unknown kind of block: {kind}")
    given = {"id": "1", "type": "rect" if name == "shape" else "edit" if name == "form" else "PAGE", "num": "1", "name": "", "url": "", "script": "", "item": "", "text": "", "part": "", "paragraph": paragraph_xml(values.get("text", ""))}
    return control_xml(name, **(given | {k: v for k, v in values.items() if v is not None}))


def append_block(nodes: DataFrame, kind: str, section_index: int = 0, **values) -> DataFrame:
    """A new last paragraph with a text or a control, by any of its names."""
    if re.sub(" +", "_", kind.strip().lower()) in ("paragraph", "text", "para"):
        return append_paragraph(nodes, section_index, values.get("text", ""))
    return append_control(nodes, section_index, block_xml(kind, **values))


def append_inline(nodes: DataFrame, kind: str, section_index: int = 0, paragraph: int = -1, **values) -> DataFrame:
    """The same in a run of a paragraph that is there."""
    xml = block_xml(kind, **values)
    return append_run_xml(nodes, section_index, paragraph, f'<hp:run charPrIDRef="0">{xml}</hp:run>')

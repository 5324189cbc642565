"""Edits as a table: a log of operations on many packages, applied at once and without touching anything else.

A log row names a document, its place in the order of that document's edits
(`seq`), an operation, a section and what the operation needs. A document's
edits are gathered into one row and meet its file by one join, however many
there are: a log that is small is sent to the files, and no file is moved.

Within a file only sections that a log names are parsed, by the byte spans of
their paragraphs. What isn't edited stays byte for byte: other parts, other
paragraphs, comments, processing instructions, white space, prefixes; zip
entries keep their order, dates and kinds of compression.
"""

from __future__ import annotations

import copy
import io
import json
import re
import zipfile
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import markup_safe
from foliospark.sources.packages import NAMESPACES, SECTION

#: What each operation needs besides its section; a log has a column for each of these.
OPERATIONS: dict[str, tuple[str, ...]] = {
    "insert_paragraph": ("at", "text"), "insert_xml": ("at", "xml"), "append_paragraph": ("text",), "delete_paragraph": ("paragraph",), "move_paragraph": ("paragraph", "at"), "copy_paragraph": ("paragraph", "at"),
    "set_text": ("paragraph", "text"), "replace_xml": ("paragraph", "xml"), "replace_text": ("old", "text"), "set_style": ("paragraph",), "insert_control": ("paragraph", "xml"), "delete_control": ("paragraph", "control"),
    "move_control": ("paragraph", "control", "to_paragraph"), "copy_control": ("paragraph", "control", "to_paragraph"),
    "append_row": ("table",), "merge_cells": ("table", "row", "col", "to_row", "to_col"), "set_cell": ("table", "row", "col", "text"),
}
COLUMNS = "doc string, seq int, op string, section int, paragraph int, at int, control int, to_section int, to_paragraph int, to_control int, table int, row int, col int, to_row int, to_col int, n int, text string, old string, xml string, attrs map<string,string>"
RESULT = "doc string, content binary, changed boolean, results array<struct<seq:int,ok:boolean,reason:string>>"
_TAG = re.compile(rb"""<[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")


@dataclass
class Span:
    """An element's bytes: [start, inner) is its start tag, [last, end) its end tag; both are one for an empty element."""

    depth: int
    local: str
    start: int
    inner: int
    last: int = -1
    end: int = -1
    text: list[str] = field(default_factory=list)
    text_end: int = -1  # where the text before the first child ends


def spans(raw: bytes) -> tuple[list[Span], dict[str, str]]:
    """The elements of a part in order, and the namespaces that its root declares."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or re.match(rb"""(\xef\xbb\xbf)?<\?xml[^>]*encoding=["'](?!utf-?8|us-ascii)""", raw, re.I):
        raise ValueError("the part isn't in UTF-8")
    found: list[Span] = []
    open_: list[Span] = []
    scope: dict[str, str] = {}
    parser = expat.ParserCreate(namespace_separator=" ")

    def start(name: str, _: dict) -> None:
        at = parser.CurrentByteIndex
        if open_ and open_[-1].text_end < 0:
            open_[-1].text_end = at
        open_.append(Span(len(open_), name.rpartition(" ")[2], at, _TAG.match(raw, at).end()))
        found.append(open_[-1])

    def end(_: str) -> None:
        e = open_.pop()
        at = parser.CurrentByteIndex
        e.last, e.end = (e.inner, e.inner) if raw[e.inner - 2 : e.inner] == b"/>" else (at, raw.index(b">", at) + 1)
        if e.text_end < 0:
            e.text_end = e.last

    def data(text: str) -> None:
        if open_ and open_[-1].text_end < 0:
            open_[-1].text.append(text)

    def declared(prefix: str | None, uri: str) -> None:
        if not open_:
            scope[prefix or ""] = uri

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartNamespaceDeclHandler = start, end, data, declared
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise ValueError(f"the part isn't well-formed: {e}") from e
    return found, scope


def _index(i: int, n: int, what: str, past: int = 0) -> int:
    """An index from the front, or from the end if it is negative; one that isn't there raises."""
    at = n + i if i < 0 else i
    if not 0 <= at < n + past:
        raise ValueError(f"there is no {what} {i}")
    return at


def _attr(tag: bytes, name: str) -> str | None:
    found = re.search(rb"\s" + name.encode() + rb"""\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)
    return (found[1] if found[1] is not None else found[2]).decode() if found else None


def _with_attrs(tag: bytes, values: dict[str, str]) -> bytes:
    """A start tag with attributes set: in their place, or first."""
    for k, v in sorted(values.items()):
        new = f" {k}={quoteattr(markup_safe(v))}".encode()
        found = re.search(rb"\s" + re.escape(k.encode()) + rb"""\s*=\s*("[^"]*"|'[^']*')""", tag)
        at = re.match(rb"<[^\s/>]+", tag).end()
        tag = tag[: found.start()] + new + tag[found.end() :] if found else tag[:at] + new + tag[at:]
    return tag


def _spliced(p: bytes, start: int, end: int, cuts: list[tuple[int, int, bytes]]) -> bytes:
    """Bytes [start, end) with ranges replaced."""
    out, at = [], start
    for a, b, new in sorted(cuts, key=lambda c: (c[0], c[1])):
        out += [p[at:a], new]
        at = b
    return b"".join([*out, p[at:end]])


@dataclass
class Cell:
    """A table's cell: its elements, and the places that it takes."""

    tc: Span
    address: Span | None
    span: Span | None
    row: int = 0
    col: int = 0
    row_span: int = 1
    col_span: int = 1


class Table:
    """A table in a paragraph's bytes; tables within its cells are no part of it."""

    def __init__(self, p: bytes, top: Span, found: list[Span]) -> None:
        self.p, self.top, self.found, self.cells = p, top, found, []
        own = self.within(top)
        self.rows = [e for e in own if e.local == "tr" and e.depth == top.depth + 1]
        number = lambda e, name, other: int(v) if e is not None and (v := _attr(p[e.start : e.inner], name) or "").isdigit() else other
        for tc in (e for e in own if e.local == "tc" and e.depth == top.depth + 2):
            address, span = (next((e for e in self.within(tc) if e.local == name and e.depth == tc.depth + 1), None) for name in ("cellAddr", "cellSpan"))
            self.cells.append(Cell(tc, address, span, number(address, "rowAddr", 0), number(address, "colAddr", 0), number(span, "rowSpan", 1), number(span, "colSpan", 1)))
        self.height = max([number(top, "rowCnt", 0), *(c.row + c.row_span for c in self.cells)])
        self.columns = max([number(top, "colCnt", 0), *(c.col + c.col_span for c in self.cells)])

    def within(self, e: Span, *names: str) -> list[Span]:
        return [x for x in self.found if e.start < x.start < e.end and (not names or x.local in names)]

    def at(self, row: int, col: int) -> Cell:
        """The cell that begins at a place."""
        found = [c for c in self.cells if (c.row, c.col) == (row, col)]
        if len(found) != 1:
            raise ValueError(f"{'no cell begins' if not found else 'cells overlap'} at {row}, {col}")
        return found[0]


class Section:
    """A section part as its paragraphs' bytes and what stands around them."""

    def __init__(self, raw: bytes) -> None:
        found, self.scope = spans(raw)
        root, tops = found[0], [e for e in found if e.depth == 1 and e.local == "p"]
        if root.last == root.inner == root.end:
            raise ValueError("the section is an empty element")
        self.open = raw[root.start : root.inner]
        self.close = b"</" + re.match(rb"<([^\s/>]+)", self.open)[1] + b">"
        self.head = raw[: tops[0].start] if tops else raw[: root.last]
        ends = [t.start for t in tops[1:]] + [tops[-1].end if tops else 0]
        self.items = [[raw[t.start : t.end], raw[t.end : e]] for t, e in zip(tops, ends, strict=True)]
        self.tail = raw[tops[-1].end :] if tops else raw[root.last :]
        prefix = next((p for p, uri in self.scope.items() if uri == NAMESPACES["hp"]), None)
        self.prefix = b"" if prefix == "" else f"{prefix or 'hp'}:".encode()

    def bytes(self) -> bytes:
        return self.head + b"".join(p + gap for p, gap in self.items) + self.tail

    def inside(self, p: bytes) -> list[Span]:
        """The elements of a paragraph; it is of depth 0 and starts at 0."""
        found = spans(self.open + p + self.close)[0][1:]
        shift = len(self.open)
        for e in found:
            e.depth, e.start, e.inner, e.last, e.end, e.text_end = e.depth - 1, e.start - shift, e.inner - shift, e.last - shift, e.end - shift, e.text_end - shift
        return found

    def declared(self, xml: bytes, scope: dict[str, str]) -> bytes:
        """XML from elsewhere: prefixes that mean something else here are declared in its first tag."""
        used = {m.decode() for m in re.findall(rb"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", xml)}
        if not _TAG.match(xml):
            raise ValueError("one element is expected")
        tag = _TAG.match(xml)[0]
        own = {m.decode() for m in re.findall(rb"xmlns:([\w.-]+)=", tag)}
        new = "".join(f" xmlns:{p}={quoteattr(scope[p])}" for p in sorted(used - own) if p in scope and self.scope.get(p) != scope[p])
        at = re.search(rb"<[^\s/>]+", xml).end()
        return xml[:at] + new.encode() + xml[at:]

    def fragment(self, xml: str) -> bytes:
        """XML that is given: one element, its prefixes those of NAMESPACES."""
        raw = self.declared(xml.strip().encode(), NAMESPACES)
        found = spans(self.open + raw + self.close)[0]
        if sum(e.depth == 1 for e in found) != 1 or found[1].start != len(self.open) or found[1].end != len(self.open + raw):
            raise ValueError("one element is expected")
        return raw

    def element(self, tag: str, inner: bytes, **attrs: str) -> bytes:
        name = self.prefix + tag.encode()
        given = "".join(f" {k}={quoteattr(markup_safe(v))}" for k, v in attrs.items())
        raw = b"<" + name + given.encode() + b">" + inner + b"</" + name + b">"
        return raw if self.prefix[:-1].decode() in self.scope else self.declared(raw, NAMESPACES)

    def run(self, inner: bytes, char: str = "0") -> bytes:
        return self.element("run", inner, charPrIDRef=char)

    def text(self, text: str) -> bytes:
        return self.element("t", escape(markup_safe(text)).encode())

    def paragraph(self, text: str) -> bytes:
        return self.element("p", self.run(self.text(text)), id="0", paraPrIDRef="0", styleIDRef="0", pageBreak="0", columnBreak="0", merged="0")

    def edited(self, p: bytes, cuts: list[tuple[int, int, bytes]], layout: bool = True) -> bytes:
        """A paragraph with byte ranges replaced, and without its line segments, which such edits make stale."""
        found = self.inside(p)
        if layout:
            gone = [(e.start, e.end) for e in found if e.depth == 1 and e.local == "linesegarray"]
            cuts = [c for c in cuts if not any(a <= c[0] and c[1] <= b for a, b in gone)] + [(a, b, b"") for a, b in gone]
        return _spliced(p, 0, len(p), cuts)

    def opened(self, p: bytes) -> tuple[bytes, bytes]:
        """A paragraph's start and end tags, also of an empty element."""
        top = self.inside(p)[0]
        name = re.match(rb"<([^\s/>]+)", p)[1]
        tag = p[: top.inner]
        return (tag[:-2].rstrip() + b">" if tag.endswith(b"/>") else tag), b"</" + name + b">"

    def controls(self, p: bytes) -> list[tuple[Span, Span]]:
        """What stands in runs but texts and section properties, each with its run."""
        out, run = [], None
        for e in self.inside(p):
            if e.depth == 1:
                run = e if e.local == "run" else None
            elif e.depth == 2 and run is not None and e.local not in ("t", "secPr"):
                out.append((e, run))
        return out

    # -- operations: each takes a log row ---------------------------------------------

    def at(self, r) -> int:
        return _index(r.paragraph, len(self.items), "paragraph")

    def put(self, i: int, p: bytes) -> None:
        self.items.insert(_index(i, len(self.items), "place", 1), [p, b""])

    def insert_paragraph(self, r) -> None:
        self.put(r.at, self.paragraph(r.text))

    def insert_xml(self, r) -> None:
        self.put(r.at, self.fragment(r.xml))

    def append_paragraph(self, r) -> None:
        self.put(len(self.items), self.paragraph(r.text))

    def delete_paragraph(self, r) -> None:
        if len(self.items) < 2:
            raise ValueError("a section's only paragraph stays")
        del self.items[self.at(r)]

    def move_paragraph(self, r) -> None:
        """To before the paragraph `at`, as numbered before."""
        i, to = self.at(r), _index(r.at, len(self.items), "place", 1)
        item = self.items.pop(i)
        self.items.insert(to - (to > i), item)

    def copy_paragraph(self, r) -> None:
        self.put(r.at, self.items[self.at(r)][0])

    def set_text(self, r) -> None:
        """A paragraph's own text; runs with section properties or controls stay, without texts of their own."""
        i = self.at(r)
        p, kept = self.items[i][0], []
        found = self.inside(p)
        for run in (e for e in found if e.depth == 1 and e.local == "run"):
            below = [e for e in found if e.depth == 2 and run.start < e.start < run.end]
            if any(e.local in ("secPr", "ctrl") for e in below):
                raw, shift = p[run.start : run.end], run.start
                for e in reversed([e for e in below if e.local == "t"]):
                    raw = raw[: e.start - shift] + raw[e.end - shift :]
                kept.append(raw)
        first, last = self.opened(p)
        self.items[i][0] = first + b"".join(kept) + self.run(self.text(r.text), (r.attrs or {}).get("charPrIDRef", "0")) + last

    def replace_xml(self, r) -> None:
        self.items[self.at(r)][0] = self.fragment(r.xml)

    def replace_text(self, r) -> None:
        """Replace within texts, in order, `n` times at most if given."""
        if not r.old:
            raise ValueError("there is nothing to replace")
        left = r.n if r.n is not None else -1
        for item in self.items:
            cuts = []
            for e in self.inside(item[0]):
                text = "".join(e.text)
                if e.local == "t" and left != 0 and (k := text.count(r.old)):
                    k = k if left < 0 else min(k, left)
                    left -= k if left > 0 else 0
                    cuts.append((e.inner, e.text_end, escape(markup_safe(text.replace(r.old, r.text, k))).encode()))
            if cuts:
                item[0] = self.edited(item[0], cuts)

    def set_style(self, r) -> None:
        """Attributes of a paragraph's start tag."""
        i = self.at(r)
        first, p = self.inside(self.items[i][0])[0], self.items[i][0]
        self.items[i][0] = _with_attrs(p[: first.inner], r.attrs or {}) + p[first.inner :]

    # -- tables -------------------------------------------------------------------------

    def table(self, r) -> tuple[int, Table]:
        """The nth table of the section in document order, and the paragraph that it stands in."""
        found = [(i, e) for i, (p, _) in enumerate(self.items) if b"tbl" in p for e in self.inside(p) if e.local == "tbl"]
        i, e = found[_index(r.table, len(found), "table")]
        return i, Table(self.items[i][0], e, self.inside(self.items[i][0]))

    def append_row(self, r) -> None:
        """A row like the last one, with the texts of a JSON list and empty cells after them; cells that span from above end there."""
        i, t = self.table(r)
        texts = json.loads(r.text) if r.text else []
        if not isinstance(texts, list) or len(texts) > t.columns:
            raise ValueError("the texts are no list, or more than there are columns")
        if not t.rows:
            raise ValueError("the table has no rows")
        last = t.rows[-1]
        if any(e.local != "t" and any(run.start < e.start < run.end and run.depth == e.depth - 1 for run in t.within(last, "run")) for e in t.within(last)):
            raise ValueError("the last row holds controls, which aren't cloned")
        own = sorted((c for c in t.cells if last.start < c.tc.start < last.end), key=lambda c: c.col)
        taken = {k for c in own for k in range(c.col, c.col + c.col_span)}
        like = own or t.cells[-1:]
        if not like:
            raise ValueError("the table has no cells")
        new = [(c, c.col, c.col_span) for c in own] + [(like[0], k, 1) for k in range(t.columns) if k not in taken]
        new.sort(key=lambda x: x[1])
        cells = b"".join(self.cell(t, c, str(texts[n]) if n < len(texts) and texts[n] is not None else "", {"rowAddr": str(t.height), "colAddr": str(col)}, {"rowSpan": "1", "colSpan": str(span)}) for n, (c, col, span) in enumerate(new))
        p = self.items[i][0]
        row = p[last.start : last.inner] + cells + p[last.last : last.end]
        self.items[i][0] = self.edited(p, [(t.top.start, t.top.inner, _with_attrs(p[t.top.start : t.top.inner], {"rowCnt": str(t.height + 1)})), (last.end, last.end, row)])

    def cell(self, t: Table, c: Cell, text: str, address: dict, span: dict | None) -> bytes:
        """A cell's bytes with a text in its first paragraph, the others empty, and other addresses."""
        p, cuts, first = t.p, [], True
        for e in t.within(c.tc, "p"):
            if not any(o.start < e.start < o.end for o in t.within(c.tc, "p")):
                name = re.match(rb"<([^\s/>]+)", p[e.start :])[1]
                tag = p[e.start : e.inner]
                tag = tag[:-2].rstrip() + b">" if tag.endswith(b"/>") else tag
                cuts.append((e.start, e.end, tag + self.run(self.text(text if first else "")) + b"</" + name + b">"))
                first = False
        cuts += [(e.start, e.inner, _with_attrs(p[e.start : e.inner], v)) for e, v in ((c.address, address), (c.span, span)) if e is not None and v]
        return _spliced(p, c.tc.start, c.tc.end, cuts)

    def set_cell(self, r) -> None:
        i, t = self.table(r)
        c = t.at(r.row, r.col)
        self.items[i][0] = self.edited(t.p, [(c.tc.start, c.tc.end, self.cell(t, c, r.text, {}, None))])

    def merge_cells(self, r) -> None:
        """Cells of a range become one, that of its first place; a cell that crosses the range's edge is refused."""
        i, t = self.table(r)
        if not (0 <= r.row <= r.to_row < t.height and 0 <= r.col <= r.to_col < t.columns):
            raise ValueError("the range isn't in the table")
        anchor, inside = t.at(r.row, r.col), []
        for c in t.cells:
            rows, cols = (c.row, c.row + c.row_span - 1), (c.col, c.col + c.col_span - 1)
            if rows[0] <= r.to_row and rows[1] >= r.row and cols[0] <= r.to_col and cols[1] >= r.col:
                if rows[0] < r.row or rows[1] > r.to_row or cols[0] < r.col or cols[1] > r.to_col:
                    raise ValueError(f"the cell at {c.row}, {c.col} crosses the edge of the range")
                inside.append(c)
        spans_ = {"rowSpan": str(r.to_row - r.row + 1), "colSpan": str(r.to_col - r.col + 1)}
        cuts = [(c.tc.start, c.tc.end, b"") for c in inside if c is not anchor]
        if anchor.span is not None:
            cuts.append((anchor.span.start, anchor.span.inner, _with_attrs(t.p[anchor.span.start : anchor.span.inner], spans_)))
        else:
            cuts.append((anchor.tc.last, anchor.tc.last, self.element("cellSpan", b"", **spans_)))
        self.items[i][0] = self.edited(t.p, cuts)

    def add_control(self, i: int, to: int | None, raw: bytes) -> None:
        """A run of its own for a control, before the run of the control `to`, or last."""
        p = self.items[i][0]
        found = self.controls(p)
        if to is None or to == len(found):
            first, last = self.opened(p)
            top = self.inside(p)[0]
            p = first + p[top.inner : top.last] + self.run(raw) + last
            self.items[i][0] = self.edited(p, [])
        else:
            run = found[_index(to, len(found), "control")][1]
            self.items[i][0] = self.edited(p, [(run.start, run.start, self.run(raw))])

    def take_control(self, r, keep: bool) -> bytes:
        i = self.at(r)
        p = self.items[i][0]
        found = self.controls(p)
        e, _ = found[_index(r.control, len(found), "control")]
        if not keep:
            self.items[i][0] = self.edited(p, [(e.start, e.end, b"")])
        return p[e.start : e.end]

    def insert_control(self, r) -> None:
        self.add_control(self.at(r), r.control, self.fragment(r.xml))

    def delete_control(self, r) -> None:
        self.take_control(r, keep=False)


def _between(a: Section, b: Section, r, keep: bool) -> None:
    """Move or copy a control to a paragraph of the same or another section; nothing happens where the target isn't there."""
    to = _index(r.to_paragraph, len(b.items), "paragraph")
    if r.to_control is not None:
        _index(r.to_control, len(b.controls(b.items[to][0])), "control", 1)
    raw = b.declared(a.take_control(r, keep), a.scope)
    after = r.to_control
    if not keep and a is b and to == a.at(r) and after is not None and after > r.control:
        after -= 1  # it has left its own paragraph
    b.add_control(to, after, raw)


def edit(content: bytes, rows: list) -> tuple[bytes, list[tuple[int, bool, str | None]]]:
    """A package with its log applied in order, and what became of each row."""
    told: list[tuple[int, bool, str | None]] = []
    try:
        source = zipfile.ZipFile(io.BytesIO(content))
        names = {i.filename for i in source.infolist()}
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        return content, [(r.seq, False, f"the package can't be read: {e}") for r in rows]
    found = sorted((int(m[1]), n) for n in names if (m := re.match(SECTION, n)))
    sections: dict[str, Section] = {}
    before: dict[str, bytes] = {}

    def section(i: int | None) -> Section:
        name = found[_index(i if i is not None else 0, len(found), "section")][1]
        if name not in sections:
            before[name] = source.read(name)
            sections[name] = Section(before[name])
        return sections[name]

    for r in rows:
        try:
            needs = OPERATIONS.get(r.op)
            if needs is None:
                raise ValueError(f"unknown operation {r.op}")
            if missing := [n for n in needs if getattr(r, n) is None]:
                raise ValueError(f"{r.op} needs {', '.join(missing)}")
            own = section(r.section)
            if r.op in ("move_control", "copy_control"):
                _between(own, own if r.to_section is None else section(r.to_section), r, r.op == "copy_control")
            else:
                getattr(own, r.op)(r)
            told.append((r.seq, True, None))
        except (ValueError, KeyError, zipfile.BadZipFile) as e:
            told.append((r.seq, False, str(e)))
    new = {n: raw for n, s in sections.items() if (raw := s.bytes()) != before[n]}
    if not new:
        return content, told
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = source.comment
        for info in source.infolist():
            z.writestr(copy.copy(info), new.get(info.filename, source.read(info)), info.compress_type)
    return out.getvalue(), told


def apply_log(files: DataFrame, log: DataFrame) -> DataFrame:
    """(doc, content, changed, results): packages (doc, content) with the edits of a log applied.

    `log` has `doc`, `seq` and `op` and any other of COLUMNS. `results` tells
    of every row of the log, by `seq`, whether it was applied, or why not; a
    row that can't be applied changes nothing, and those after it are applied.
    Rows of equal `seq` are applied in the order of their other columns. Log
    rows of documents that aren't there are dropped. A document is one row of
    `files`; its file and log are one task's work.
    """
    names = [c.split()[0] for c in re.sub(r"map<[^>]*>", "map", COLUMNS).split(", ")]
    kinds = dict(zip(names, [c.split(" ", 1)[1] for c in re.split(r", (?=\w+ )", COLUMNS)], strict=True))
    rows = log.select(*[(F.col(n) if n in log.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
    logs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", *[n for n in names if n not in ("doc", "seq", "attrs")], F.array_sort(F.map_entries("attrs")).alias("attrs")))).alias("rows"))
    untouched = files.join(rows.select("doc").distinct(), "doc", "left_anti").select("doc", "content", F.lit(False).alias("changed"), F.array().cast("array<struct<seq:int,ok:boolean,reason:string>>").alias("results"))

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("seq", pa.int32()), ("ok", pa.bool_()), ("reason", pa.string())]))
        for batch in batches:
            for i in range(batch.num_rows):
                given = [_Row(r) for r in batch.column(2)[i].as_py()]
                raw = batch.column(1)[i].as_py() or b""
                new, told = edit(raw, given)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([new], pa.binary()), pa.array([new != raw]), pa.array([[{"seq": s, "ok": o, "reason": w} for s, o, w in told]], kind)], ["doc", "content", "changed", "results"])

    touched = files.select("doc", "content").join(logs, "doc").select("doc", "content", "rows").mapInArrow(run, RESULT)
    return untouched.unionByName(touched)


class _Row:
    """A log row with its columns as attributes."""

    def __init__(self, values: dict) -> None:
        self.__dict__.update(values)
        self.attrs = {e["key"]: e["value"] for e in values["attrs"]} if values["attrs"] is not None else None

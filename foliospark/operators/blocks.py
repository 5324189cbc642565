"""Documents as typed blocks in order: drafts that append blocks, sections and definitions to many documents at once.

A document is rows (doc, section_index, paragraph, ord, kind, text, attrs), the
same for both formats. A draft gathers what is to be appended to every
document; blocks() makes the rows of all of it by one explode and one window,
however many appends and documents there are. Definitions (styles, numberings,
...) are blocks of section -1.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "doc string, section_index int, paragraph int, ord int, kind string, text string, attrs map<string,string>"
#: Kinds of blocks, and what an appended one has unless it is given.
DEFAULTS: dict[str, dict[str, str]] = {
    "paragraph": {}, "table": {"rowCnt": "1", "colCnt": "1"}, "picture": {"width": "7200", "height": "7200"}, "hyperlink": {}, "bookmark": {}, "field": {"editable": "false", "dirty": "false"},
    "auto_number": {"num": "1", "numType": "PAGE", "which": "newNum"}, "note": {"which": "footNote"}, "form": {"form_type": "INPUT"}, "memo": {}, "chart": {"chart_type": "BAR"}, "equation": {"width": "4800", "height": "2300"},
    "shape": {"which": "rect", "width": "12000", "height": "3200"}, "ole": {"width": "42001", "height": "13501"}, "header": {"applyPageType": "BOTH"}, "footer": {"applyPageType": "BOTH"},
}
DEFINITIONS = ("style", "paragraph_style", "character_style", "numbering", "bullet", "memo_shape")


def _attrs(values: dict) -> Column:
    pairs = [x for k, v in values.items() if v is not None for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(str(v)))]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")


class Draft:
    """Appends for every document of `docs` (doc, and columns that values may use), after the `blocks` that there are."""

    def __init__(self, docs: DataFrame, blocks: DataFrame | None = None) -> None:
        self.docs, self.rows, self.sections, self.defined = docs, [], 0, dict.fromkeys(DEFINITIONS, 0)
        self.base = blocks if blocks is not None else docs.sparkSession.createDataFrame([], SCHEMA)

    def append(self, kind: str, text: str | Column | None = None, section: int | Column = 0, **attrs) -> Draft:
        """A new last block of a section. Null attributes are left out, others take the kind's defaults; an unknown kind raises."""
        if kind not in DEFAULTS:
            raise ValueError(f"unknown kind of block: {kind}")
        return self._add(section, kind, text, DEFAULTS[kind] | attrs)

    def _add(self, section, kind: str, text, attrs: dict) -> Draft:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        self.rows.append(F.struct(F.lit(len(self.rows)).alias("seq"), as_column(section).cast("int").alias("section_index"), F.lit(kind).alias("kind"), as_column(text).cast("string").alias("text"), _attrs(attrs).alias("attrs")))
        return self

    def append_section(self) -> Column:
        """A new last section with an empty paragraph; its index, to append to."""
        self.sections += 1
        index = F.col("_last") + self.sections
        self._add(index, "paragraph", "", {})
        return index

    def define(self, kind: str, id: str | None = None, **attrs) -> Draft:
        """A new definition: its id is one more than the largest of its kind, unless given."""
        if kind not in DEFINITIONS:
            raise ValueError(f"unknown kind of definition: {kind}")
        fresh = (F.coalesce(F.try_element_at("_ids", F.lit(kind)), F.lit(-1)) + 1 + self.defined[kind]).cast("string")
        self.defined[kind] += id is None
        return self._add(-1, kind, None, {"id": fresh if id is None else id} | attrs)

    def append_table(self, rows: int, columns: int, texts: list[list[str]] | None = None, **more) -> Draft:
        """A table; its cells' texts are one JSON array of rows, padded with empty ones."""
        if rows < 1 or columns < 1:
            raise ValueError("a table has rows and columns")
        given = texts or []
        grid = [[given[r][c] if r < len(given) and c < len(given[r]) else "" for c in range(columns)] for r in range(rows)]
        return self.append("table", json.dumps(grid, ensure_ascii=False), rowCnt=rows, colCnt=columns, **more)

    def append_hyperlink(self, url: str | Column, shown: str | Column | None = None, **more) -> Draft:
        return self.append("hyperlink", url if shown is None else shown, url=url, **more)

    def append_bookmark(self, name: str | Column, **more) -> Draft:
        return self.append("bookmark", name=name, **more)

    def append_field(self, type: str, shown: str | Column | None = None, **more) -> Draft:
        return self.append("field", shown, type=type, **more)

    def append_mail_merge_field(self, name: str | Column, **more) -> Draft:
        return self.append_field("MAILMERGE", name=name, **more)

    def append_calculation_field(self, expression: str | Column, **more) -> Draft:
        """The expression is kept and never evaluated."""
        return self.append_field("FORMULA", expression=expression, **more)

    def append_cross_reference(self, bookmark: str | Column, **more) -> Draft:
        return self.append_field("CROSSREF", bookmark=bookmark, **more)

    def append_doc_property_field(self, name: str | Column, **more) -> Draft:
        return self.append_field("DOCPROPERTY", name=name, **more)

    def append_date_field(self, **more) -> Draft:
        return self.append_field("DATE", **more)

    def append_footnote(self, text: str | Column, **more) -> Draft:
        return self.append("note", text, which="footNote", **more)

    def append_endnote(self, text: str | Column, **more) -> Draft:
        return self.append("note", text, which="endNote", **more)

    def append_paragraph(self, text: str | Column, **more) -> Draft:
        return self.append("paragraph", text, **more)

    def blocks(self) -> DataFrame:
        """All blocks: those there were, then those appended, numbered anew by section; each appended one is a paragraph of its own."""
        if not self.rows:
            return self.base
        ident = F.try_element_at("attrs", F.lit("id")).try_cast("int")
        kinds = self.base.where("section_index = -1").groupBy("doc", "kind").agg(F.max(ident).alias("most")).where("most is not null")
        ids = kinds.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("kind", "most"))).alias("_ids"))
        last = self.base.where("section_index >= 0").groupBy("doc").agg(F.max("section_index").alias("_last"))
        facts = self.docs.join(last, "doc", "left").join(ids, "doc", "left").withColumn("_last", F.coalesce("_last", F.lit(0))).withColumn("_ids", F.coalesce("_ids", F.create_map().cast("map<string,int>")))
        new = facts.select("doc", F.explode(F.array(*self.rows)).alias("r")).select("doc", "r.section_index", F.lit(None).cast("int").alias("paragraph"), F.lit(0).alias("ord"), "r.kind", "r.text", "r.attrs", "r.seq")
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows = self.base.select(*names, F.lit(-1).alias("seq")).unionByName(new.select(*names, "seq"))
        order = Window.partitionBy("doc", "section_index").orderBy("seq", "ord")
        whole = Window.partitionBy("doc", "section_index")
        paragraph = F.coalesce(F.col("paragraph"), F.coalesce(F.max("paragraph").over(whole), F.lit(-1)) + F.sum(F.when(F.col("seq") >= 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.select("doc", "section_index", paragraph.cast("int").alias("paragraph"), (F.row_number().over(order) - 1).alias("ord"), "kind", "text", "attrs")

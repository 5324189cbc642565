"""Queries on the structure of built documents: paths, contents of blocks, logged edits, kept bytes, tokens of texts, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import convert
from foliospark.operators import nodes as N
from foliospark.operators import profiles
from foliospark.operators import relational as R
from foliospark.operators import xpath as X
from foliospark.operators.contents import package_blocks
from foliospark.operators.editlog import apply_log
from foliospark.plans.catalogue import query, table
from foliospark.plans.documents import _BASE, _NBASE, _read, _records, packages
from foliospark.sources import binary as B
from foliospark.sources import packages as P
from foliospark.sources.shared import kept

#: Expressions on sections, and SQL over the turns `d` for their results: paragraph (for their order) and value.
PATHS = {
    "./hp:p/@id": "select *, turn::varchar as v from d",
    ".//hp:tbl/hp:tr[2]/hp:tc[1]//hp:t/text()": "select *, 'c' as v from d where k = 2",
    "./hp:p[.//hp:equation]/@id": "select *, turn::varchar as v from d where k = 18",
    ".//hp:ole[ancestor::hp:default[parent::hp:switch[hp:case/hp:chart]]]/@binaryItemIDRef": "select *, 'pic1' as v from d where k = 10",
    ".//hp:bookmark/ancestor::hp:p[1]/@id": "select *, turn::varchar as v from d where k = 11",
    "./hp:p[.//hp:tbl]/following-sibling::hp:p[1]/@id": "select b.*, b.turn::varchar as v from d a join d b on a.doc = b.doc and b.section_index = a.section_index and b.paragraph = a.paragraph + 1 where a.k = 2",
    "./hp:p[.//hp:pic]/preceding-sibling::hp:p[1]/hp:run[1]/hp:t/text()": "select b.*, b.text as v from d a join d b on a.doc = b.doc and b.section_index = a.section_index and b.paragraph = a.paragraph - 1 where a.k = 3 and b.text <> ''",
    ".//hp:fieldBegin[@type='HYPERLINK' or @type='CROSSREF']/@id": "select *, n::varchar as v from d where k in (12, 15)",
    ".//hp:script[contains(text(), '1')]/text()": "select *, 'x+' || n as v from d where k = 18 and contains(n::varchar, '1')",
    ".//hp:footNote//hp:t/text() | .//hp:endNote//hp:t/text()": "select *, 'in ' || n as v from d where k in (5, 6)",
    ".//hp:tc[hp:cellAddr[@rowAddr = '0' and @colAddr = '1']]/hp:subList/hp:p/hp:run/hp:t/text()": "select *, 'b' as v from d where k = 2",
    "./hp:p[last()]/@id": "select *, turn::varchar as v from d qualify paragraph = max(paragraph) over (partition by doc, section_index)",
    "./hp:p[position() > 1 and not(hp:run/hp:ctrl)]/@id": "select *, turn::varchar as v from d where paragraph > 0 and k not in (0, 1, 5, 6, 7, 11, 12, 13, 14, 15, 16, 17)",
    "count(./hp:p[hp:run/hp:ctrl])": "select doc, section_index, 0 as paragraph, count(*) filter (k in (0, 1, 5, 6, 7, 11, 12, 13, 14, 15, 16, 17))::varchar as v from d group by all",
    "string-length(./hp:p[1]/hp:run/hp:t)": "select *, length(text)::varchar as v from d where paragraph = 0",
}
_quoted = {e: e.replace("'", "''") for e in PATHS}
_paths = " union all ".join(f"select '{_quoted[e]}' as expression, doc, section_index, paragraph, v from ({sql})" for e, sql in PATHS.items())


@query(f"{_BASE}, r as ({_paths}) select expression, doc, section_index, row_number() over (partition by expression, doc, section_index order by paragraph) - 1 as ord, v as value from r")
def package_xpath(spark, sf) -> DataFrame:
    """Paths of many shapes over the sections of built packages: axes, positions, conditions, unions, counts."""
    _, nodes = _read(packages(spark, sf))
    sections = nodes.where("section_index is not null")
    number = F.regexp_extract("part", r"section(\d+)", 1).cast("int").alias("section_index")
    found = [X.evaluate(sections, e).select(F.lit(e).alias("expression"), "doc", number, F.col("ord").cast("long").alias("ord"), "value") for e in PATHS]
    return reduce(DataFrame.unionByName, found)


# -- blocks with their contents, from one format to the other -------------------------------------

#: Kinds of blocks by number, with the name that each is told by: `#` is the turn's number. Names hold what the formats reserve.
_BLOCKS = (
    ("paragraph", ""), ("table", ""), ("hyperlink", "http://x.org/a;b?c=#&d=1"), ("bookmark", "m;=%#"), ("field", "f=;#"), ("note", "footNote"), ("note", "endNote"), ("form", "q;#"), ("memo", "a=#;"), ("chart", '["a","b;="]'), ("auto_number", "#"), ("header", "BOTH"), ("footer", "EVEN"),
    ("equation", ""), ("shape", "rect"), ("picture", ""), ("ole", ""),
)
_NAMED = {"hyperlink": "url", "bookmark": "name", "field": "name", "note": "which", "form": "name", "memo": "author", "chart": "categories", "auto_number": "num", "header": "applyPageType", "footer": "applyPageType", "shape": "which"}


def turn_blocks(spark, sf) -> DataFrame:
    """Blocks of a document for each conversation, its turns their texts; the kind follows from conversation and turn."""
    turns = table(spark, sf, "conversations").withColumns({"n": F.expr("conv_id * 10 + turn"), "k": F.expr(f"cast((conv_id + turn) % {len(_BLOCKS)} as int)")})
    kind, number = F.get(F.array(*[F.lit(k) for k, _ in _BLOCKS]), F.col("k")), F.col("n").cast("string")
    name = F.replace(F.get(F.array(*[F.lit(n) for _, n in _BLOCKS]), F.col("k")), F.lit("#"), number)
    grid = F.to_json(F.array(F.array("text", number), F.array(F.lit("b;="), F.lit(""))))
    text = F.when(kind == "table", grid).when(kind.isin("hyperlink", "field"), F.concat(F.lit("shown "), number)).when(~kind.isin("bookmark", "auto_number", "picture", "ole"), F.col("text"))
    key = F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv])[kind]
    drawn = F.when(kind.isin("picture", "ole"), F.base64(F.encode("text", "UTF-8")))
    more = {"rowCnt": F.when(kind == "table", "2"), "colCnt": F.when(kind == "table", "2"), "type": F.when(kind == "field", "MAILMERGE"), "data": drawn, "extension": F.when(drawn.isNotNull(), "bin")}
    pairs = F.filter(F.array(F.struct(key.alias("key"), name.alias("value")), *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in more.items()]), lambda e: e.key.isNotNull() & e.value.isNotNull())
    place = F.floor(F.col("turn") / 2).cast("int")
    return turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc"), (F.col("turn") % 2).cast("int").alias("section_index"), place.alias("paragraph"), place.alias("ord"), kind.alias("kind"), text.alias("text"), F.map_from_entries(pairs).alias("attrs"))


def _told(blocks: DataFrame, stage: str) -> DataFrame:
    at = lambda k: F.try_element_at("attrs", F.lit(k))
    name = F.coalesce(*[F.when(F.col("kind") == k, at(a)) for k, a in _NAMED.items()], F.when(F.col("kind").isin("picture", "ole"), F.sha2(F.unbase64(at("data")), 256)), F.lit(""))
    rows = R.ordinal(blocks.where("kind <> 'paragraph' or text <> ''"), ["doc", "section_index"], [F.col("ord")], "nth", 0)
    return rows.select(F.lit(stage).alias("stage"), "doc", F.col("section_index").cast("long").alias("section_index"), F.col("nth").cast("long").alias("nth"), "kind", F.coalesce("text", F.lit("")).alias("text"), name.alias("name"))


_rows = ", ".join(f"({i}, '{k}', '{n}')" for i, (k, n) in enumerate(_BLOCKS))
_texts = "case when kind = 'table' then to_json([[text, n::varchar], ['b;=', '']])::varchar when kind in ('hyperlink', 'field') then 'shown ' || n when kind in ('bookmark', 'auto_number', 'picture', 'ole') then '' else text end"


@query(
    f"with b(k, kind, name) as (values {_rows}), d as (select 'c' || conv_id as doc, (turn % 2)::bigint as section_index, (turn // 2)::bigint as paragraph, text, conv_id * 10 + turn as n, kind, replace(name, '#', (conv_id * 10 + turn)::varchar) as name from conversations join b on k = (conv_id + turn) % {len(_BLOCKS)}) "
    f", r as (select 'package' as stage, doc, section_index, paragraph, kind, {_texts} as text, case when kind in ('picture', 'ole') then sha256(text) else name end as name from d "
    f"union all select 'binary', doc, section_index, paragraph, kind, case when kind in ('hyperlink', 'field') then '' else {_texts} end, name from d union all select 'binary', doc, section_index, paragraph, 'paragraph', 'shown ' || n, '' from d where kind in ('hyperlink', 'field')) "
    "select stage, doc, section_index, row_number() over (partition by stage, doc, section_index order by paragraph, kind <> 'paragraph') - 1 as nth, kind, text, name from r"
)
def package_conversion(spark, sf) -> DataFrame:
    """Turns as blocks of every kind, written as packages, read, written as binary documents, and read: texts, cells, addresses, names and data on either way."""
    made = kept(convert.to_packages(turn_blocks(spark, sf)), "files")
    found = kept(package_blocks(*_read(made)), "blocks")
    native = convert.binary_blocks(kept(B.records(B.streams(convert.to_binary(found))), "records"))
    # The picture's bytes are told of the package; a binary document keeps them in a stream.
    return _told(found, "package").unionByName(_told(native, "binary").withColumn("name", F.when(F.col("kind").isin("picture", "ole"), "").otherwise(F.col("name"))))


# -- logged edits -----------------------------------------------------------------------------------


def edit_log(spark, sf) -> DataFrame:
    """Edits that differ by document; some name what isn't there."""
    number = F.col("conv_id").cast("string")
    names = ("seq", "op", "section", "paragraph", "at", "control", "to_section", "to_paragraph", "text", "old", "xml")

    def row(seq: int, op: str, section: int, **given):
        value = lambda n: given.get(n, {"seq": seq, "op": op, "section": section}.get(n))
        kind = lambda n: "string" if n in ("op", "text", "old", "xml") else "int"
        return F.struct(*[(v if hasattr(v := value(n), "alias") else F.lit(v)).cast(kind(n)).alias(n) for n in names])

    first = F.array(row(1, "insert_paragraph", 0, at=0, text=F.concat(F.lit("begun "), number)), row(2, "set_text", 0, paragraph=0, text=F.concat(F.lit("set; <&> "), number)), row(3, "move_paragraph", 0, paragraph=0, at=-1), row(4, "append_paragraph", 0, text="end"), row(5, "copy_paragraph", 0, paragraph=0, at=1))
    second = F.array(row(1, "delete_paragraph", 0, paragraph=0), row(2, "insert_paragraph", 0, at=1, text="mid"), row(3, "replace_text", 0, old="the", text="THE"), row(4, "insert_control", 0, paragraph=0, xml='<hp:ctrl><hp:bookmark name="log"/></hp:ctrl>'))
    third = F.array(row(1, "append_paragraph", 1, text="only second"), row(2, "copy_control", 0, paragraph=0, control=0, to_section=1, to_paragraph=-1), row(3, "set_text", 1, paragraph=99, text="nowhere"))
    docs = table(spark, sf, "conversations").select("conv_id").distinct()
    case = F.when(F.col("conv_id") % 4 == 0, first).when(F.col("conv_id") % 4 == 1, second).when(F.col("conv_id") % 4 == 2, third)
    return docs.select(F.concat(F.lit("c"), number).alias("doc"), F.explode(case).alias("r")).select("doc", "r.*")


_SHOWN = "case when k in (0, 1, 5, 6, 7) then 'in ' || n when k = 2 then n || 'bc' || conv_id when k between 12 and 15 then 'shown ' || n else '' end"


@query(
    f"{_BASE}, s as (select doc, conv_id, section_index, list(text || {_SHOWN} order by paragraph) as p, max(case when section_index = 0 and paragraph = 0 then case when k between 12 and 15 then '' else {_SHOWN} end end) as c, max(case when section_index = 0 and paragraph = 0 then k end) as k0 from d group by all), "
    "g as (select doc, max(c) as c, max(k0) as k0, count(*) as n, max(case when section_index = 0 then len(p) end) as first from s group by doc), "
    "x as (select s.doc, conv_id, section_index, g.k0, n, first, case when conv_id % 4 = 0 and section_index = 0 then list_concat(list_concat(p[1:len(p) - 1], ['set; <&> ' || conv_id]), list_concat(p[len(p):len(p)], ['end'])) "
    "when conv_id % 4 = 1 and section_index = 0 then list_transform(list_concat(list_concat(case when len(p) > 1 then p[2:2] else p end, ['mid']), p[3:]), lambda t: replace(t, 'the', 'THE')) "
    "when conv_id % 4 = 2 and section_index = 1 then list_concat(p, ['only second' || g.c]) else p end as q from s join g on s.doc = g.doc), "
    "y as (select *, case when conv_id % 4 = 0 and section_index = 0 then list_concat(q[1:1], q) else q end as r, case conv_id % 4 when 0 then 0 when 1 then (first = 1)::int when 2 then case when n = 1 then 3 else 1 + (k0 = 28)::int end else 0 end as failed, "
    "7 + n - case conv_id % 4 when 3 then 0 when 2 then (n > 1)::int else 1 end as kept from x) "
    "select doc, section_index, unnest(range(len(r))) as paragraph, unnest(r) as text, failed::bigint as failed, kept::bigint as kept from y"
)
def package_edit_log(spark, sf) -> DataFrame:
    """A log of other edits for each document, applied at once: the texts, the edits that couldn't be applied, and the parts that stayed byte for byte."""
    files = kept(packages(spark, sf), "files")
    done = kept(apply_log(files, edit_log(spark, sf)), "edited")
    digest = lambda df: P.entries(df).select("doc", "path", F.sha2("content", 256).alias("digest"))
    same = digest(files).join(digest(done), ["doc", "path", "digest"]).groupBy("doc").agg(F.count("*").alias("kept"))
    failed = done.select("doc", F.size(F.filter("results", lambda r: ~r.ok)).cast("long").alias("failed"))
    texts = N.paragraph_text(_read(done)[1]).select("doc", F.col("section_index").cast("long").alias("section_index"), F.col("paragraph").cast("long").alias("paragraph"), "text")
    return texts.join(failed, "doc").join(same, "doc")


@query(
    f"{_BASE}, f as (select doc, conv_id, arg_min(n, paragraph) as n from d where section_index = 0 and k = 2 group by all) "
    "select doc, r.row::int as \"row\", r.col::int as \"column\", r.rs::int as row_span, r.cs::int as col_span, r.t as text, 1::bigint as failed from (select doc, unnest([{'row': 0, 'col': 0, 'rs': 1, 'cs': 2, 't': n::varchar}, {'row': 1, 'col': 0, 'rs': 1, 'cs': 1, 't': 'c'}, {'row': 1, 'col': 1, 'rs': 1, 'cs': 1, 't': 'z<'}, "
    "{'row': 2, 'col': 0, 'rs': 1, 'cs': 1, 't': 'x;'}, {'row': 2, 'col': 1, 'rs': 1, 'cs': 1, 't': ''}]) as r from f)"
)
def package_table_edits(spark, sf) -> DataFrame:
    """A row appended to the first table of every document, cells merged, a cell set; a merge that crosses a span is refused."""
    files = kept(packages(spark, sf), "files")
    steps = [("merge_cells", 0, 0, 0, 1, None), ("append_row", None, None, None, None, '["x;"]'), ("set_cell", 1, 1, None, None, "z<"), ("merge_cells", 0, 1, 1, 1, None)]
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(op).alias("op"), *[F.lit(v).cast("int").alias(n) for n, v in zip(("row", "col", "to_row", "to_col"), at, strict=True)], F.lit(text).cast("string").alias("text")) for i, (op, *at, text) in enumerate(steps)])
    log = files.select("doc", F.lit(0).alias("section"), F.lit(0).alias("table"), F.explode(rows).alias("r")).select("doc", "section", "table", "r.*")
    done = kept(apply_log(files, log), "edited")
    failed = done.where("changed").select("doc", F.size(F.filter("results", lambda r: ~r.ok)).cast("long").alias("failed"))
    _, nodes = _read(done)
    tables = nodes.where("local = 'tbl' and section_index = 0").groupBy("doc", "part").agg(F.min("pre").alias("table"))
    return N.cells(nodes).join(tables, ["doc", "part", "table"], "left_semi").join(failed, "doc").select("doc", "row", "column", "row_span", "col_span", "text", "failed")


# -- tokens of binary texts, differences ------------------------------------------------------------

#: Controls that stand in a paragraph's text, by kind of block; `@` marks what a field shows.
_MARKS = {"table": "tbl ", "hyperlink": "%hlk", "bookmark": "bokm", "field": "%mai", "chart": "gso ", "auto_number": "nwno", "header": "head", "footer": "foot", "shape": "gso ", "picture": "gso ", "ole": "gso "}
_mark = "case when kind = 'note' then case when name = 'endNote' then 'en  ' else 'fn  ' end " + " ".join(f"when kind = '{k}' then '{v}'" for k, v in _MARKS.items()) + " end"
_entry = lambda kind, value, matched: f"{{'kind': '{kind}', 'value': {value}, 'matched': {matched}}}"


@query(
    f"with b(k, kind, name) as (values {_rows}), d as (select 'c' || conv_id as doc, (turn % 2)::bigint as section_index, (turn // 2)::bigint as nth, text, conv_id * 10 + turn as n, kind, name from conversations join b on k = (conv_id + turn) % {len(_BLOCKS)}), "
    f"t as (select doc, section_index, nth, case when kind = 'paragraph' then [{_entry('text', 'text', 'null::boolean')}] when kind in ('hyperlink', 'field') then [{_entry('control', _mark, 'true')}, {_entry('text', chr(39) + 'shown ' + chr(39) + ' || n', 'null')}, {_entry('end', chr(39) * 2, 'null')}, {_entry('text', chr(39) * 2, 'null')}] "
    f"else [{_entry('control', _mark, 'true')}, {_entry('text', chr(39) * 2, 'null')}] end as ts from d where kind not in ('equation', 'form', 'memo')) "
    "select doc, section_index, nth, unnest(range(len(ts))) as token, unnest(ts).kind as kind, unnest(ts).value as value, unnest(ts).matched as matched from t"
)
def binary_tokens(spark, sf) -> DataFrame:
    """Texts of top-level paragraphs as characters and controls, each control with its record."""
    records = kept(B.records(B.streams(convert.to_binary(kept(turn_blocks(spark, sf), "blocks")))), "records")
    at = ["doc", "section_index", "paragraph"]
    tops = R.ordinal(B.paragraphs(records).where("level = 0").select(*at), ["doc", "section_index"], [F.col("paragraph")], "nth", 0)
    tokens = kept(B.text_tokens(records), "tokens")
    found = B.inline_controls(tokens, B.controls(records)).select(*at, "token", F.col("ord").isNotNull().alias("matched"))
    value = F.when(F.col("kind") == "control", F.col("control_id")).otherwise(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")))
    rows = tokens.join(tops, at).join(found, [*at, "token"], "left")
    return rows.select("doc", F.col("section_index").cast("long").alias("section_index"), F.col("nth").cast("long").alias("nth"), F.col("token").cast("long").alias("token"), "kind", value.alias("value"), "matched")


@query(
    f"{_BASE}, s as (select distinct doc, conv_id, section_index from d) select doc, 'BodyText/Section' || section_index as path, case when conv_id % 3 = 0 and section_index = 0 then 'changed' else 'removed' end as status, case when conv_id % 3 = 0 and section_index = 0 then 1 else 0 end::bigint as records "
    "from s where (conv_id % 3 = 0 and section_index = 0) or (conv_id % 3 = 1 and section_index = 1) union all select distinct doc, 'BodyText/Section9', 'added', 0::bigint from s where conv_id % 3 = 2"
)
def binary_diffs(spark, sf) -> DataFrame:
    """Two versions of every document: a record changed in some, a stream removed or added in others; each told of its own document."""
    streams, records = _records(spark, sf)
    number = F.substring("doc", 2, 20).cast("int")
    first = records.groupBy("doc", "stream").agg(F.min(F.when(B.tag("para_text"), F.col("ord"))).alias("at"))
    later = records.join(first, ["doc", "stream"]).withColumn("payload", F.when((F.col("ord") == F.col("at")) & (F.col("stream") == "BodyText/Section0") & (number % 3 == 0), F.encode(F.lit("other\r"), "UTF-16LE")).otherwise(F.col("payload")))
    rest = streams.where("path not like 'BodyText/%'").select("doc", "path", "logical")
    bodies = B.encode(later.where("stream like 'BodyText/%'").select("doc", "stream", "ord", "tag_id", "level", "payload")).where(~((number % 3 == 1) & (F.col("path") == "BodyText/Section1")))
    new = streams.select("doc").distinct().where(number % 3 == 2).select("doc", F.lit("BodyText/Section9").alias("path"), F.lit(b"new").alias("logical"))
    after = kept(rest.unionByName(bodies).unionByName(new), "after")
    changed = B.record_diff(records, later).groupBy("doc", F.col("stream").alias("path")).agg(F.count("*").alias("records"))
    return B.stream_diff(streams, after).join(changed, ["doc", "path"], "left").select("doc", "path", "status", F.coalesce("records", F.lit(0)).alias("records"))


# -- profiles ---------------------------------------------------------------------------------------

_PROFILE = {"table": "tbl ", "footnote": "fn  ", "page": "pgnp"}


@query(
    f"{_NBASE}, z as (select *, case when k in (0, 6) then 4 when k >= 17 then 5 else 3 end as size from d), y as (select *, sum(size) over (partition by doc, section_index order by paragraph) - size + 2 as ord from z), "
    "o as (select *, case k when 0 then 'table' when 2 then 'footnote' else 'page' end as feature from y where k in (0, 2, 4)), "
    "b as (select feature, arg_min(doc, (size, section_index, ord, doc)) as doc, arg_min(section_index, (size, section_index, ord, doc)) as section_index, arg_min(text, (size, section_index, ord, doc)) as text, arg_min(size, (size, section_index, ord, doc)) as records from o group by feature), "
    "w as (select doc, section_index from o group by all having count(distinct feature) = 3), n as (select doc, count(*) filter (k = 0) as a, count(*) filter (k = 2) as c, count(*) filter (k = 4) as e from o where doc in (select doc from w) group by doc), "
    "t as (select doc from n order by a desc, c desc, e desc, doc limit 1), f as (select doc, section_index, text, size, row_number() over (order by (select count(*) from w v where v.doc = z.doc)) as i from z where doc in (select doc from t) and paragraph = 0 and (doc, section_index) in (select doc, section_index from w)) "
    "select feature, doc, section_index, records::bigint as records, text from b where (select count(*) from t) > 0 union all select 'base', doc, section_index, size::bigint, text from f where i = 1"
)
def binary_profile(spark, sf) -> DataFrame:
    """The smallest example of each feature in a collection, and the first paragraph of the donor's section that has all of them."""
    streams, records = _records(spark, sf)
    profile = kept(profiles.build(streams, records, _PROFILE), "profile")
    text = F.element_at(F.filter("records", lambda r: r.tag_id == B.TAGS["para_text"]), 1)["payload"]
    return profile.select("feature", "doc", "section_index", F.size("records").cast("long").alias("records"), F.replace(F.decode(text, "UTF-16LE"), F.lit("\r"), F.lit("")).alias("text"))

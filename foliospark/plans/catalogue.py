"""One query an operator over the given tables, with the SQL that gives the same rows.

`documents.text` plays a section (its lines are paragraphs), `pages.html`
markup, `conversations` ordered blocks of a document, `orders` and `lineitem`
containers and controls, `labels` a manifest of `documents`, `events.props`
control metadata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import numbers, text
from foliospark.operators import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- text and selectors ------------------------------------------------------------


@query("select doc_id, i - 1 as paragraph, p as text from (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)")
def paragraph_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("paragraph", "text"))


@query("select doc_id, count(*) as paragraphs, count(*) filter (p = '') as blank, sum(length(p))::bigint as chars, count(*) filter (contains(p, 'License')) as hits from (select doc_id, unnest(string_split(text, chr(10))) as p from documents) group by doc_id")
def paragraph_stats(spark, sf):
    p = paragraph_split(spark, sf)
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("text") == "").alias("blank"), F.sum(F.length("text")).alias("chars"), F.count_if(F.contains("text", F.lit("License"))).alias("hits"))


@query("select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id")
def section_text(spark, sf):
    return R.joined_text(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", "\n")


_worth = lambda at, values: "case substr(t, " + at + ", 1) " + " ".join(f"when '{c}' then {v}" for c, v in values.items()) + " else 0 end"
_score = f"abs(j - near) * 10 - case when j > 0 then {_worth('j', text.BEFORE)} else 0 end - {_worth('j + 1', text.AFTER)}"


@query(
    "with recursive c as (select conv_id, turn, t, ls, length(t) as n, list_sum(ls) as total, len(ls) as m from (select conv_id, turn, replace(text, chr(10), ' ') as t, list_transform(string_split(text, chr(10)), lambda x: length(x)) as ls from conversations)), "
    "r as (select conv_id, turn, 0::bigint as i, 0::bigint as cut from c union all "
    "select conv_id, turn, i + 1, case when cut >= most then cut else list_sort(list_transform(range(greatest(cut, near - win), least(most, near + win) + 1), lambda j: {'score': " + _score + ", 'j': j}))[1].j end from "
    "(select r.conv_id, r.turn, i, cut, t, n - (m - (i + 1)) as most, greatest(8, n // 12) as win, least(greatest(round_even(n * (list_sum(ls[1:i + 1]) / total), 0)::bigint, cut), n - (m - (i + 1))) as near from r join c using (conv_id, turn) where i + 1 < m)) "
    "select conv_id, turn, i::int as ord, substr(t, cut + 1, coalesce(lead(cut) over (partition by conv_id, turn order by i), n) - cut) as piece from r join c using (conv_id, turn)"
)
def proportional_split(spark, sf):
    """Each turn's text without its line breaks, dealt to as many paragraphs as it had lines."""
    c = table(spark, sf, "conversations")
    lengths = F.transform(text.paragraphs(F.col("text")), lambda x: F.length(x))
    return c.select("conv_id", "turn", F.posexplode(text.distributed(F.replace("text", F.lit("\n"), F.lit(" ")), lengths)).alias("ord", "piece"))


@query("select page_id, i - 1 as ord, u as url from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as u, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) as i from pages)")
def hyperlinks(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("ord", "url"))


@query("select tag, count(*) as n from (select unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as tag from pages) group by tag")
def tag_counts(spark, sf):
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return table(spark, sf, "pages").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("select doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::int as n, md5(replace(text, 'the', 'THE')) as replaced_md5 from documents")
def replace_count(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.occurrences(F.col("text"), "the").alias("n"), F.md5(F.replace("text", F.lit("the"), F.lit("THE")).cast("binary")).alias("replaced_md5"))


@query("select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from documents")
def normalise_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.strip(F.col("text")).alias("text"))


@query("select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as memo_key from conversations")
def memo_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.squeeze(F.col("text")).alias("memo_key"))


@query("select doc_id, sha256(text) as digest from documents")
def stream_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def metadata_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("select doc_id, i - 1 as paragraph from (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where contains(p, 'License') and regexp_matches(p, '[0-9]')")
def style_batch(spark, sf):
    p = paragraph_split(spark, sf)
    return p.where(F.contains("text", F.lit("License")) & F.col("text").rlike("[0-9]")).select("doc_id", "paragraph")


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_metadata(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select page_id, regexp_replace(replace(split_part(url, '://', 2), chr(92), '/'), '^/+|/+$', '', 'g') as path from pages")
def path_normalise(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.normal_path(F.split_part("url", F.lit("://"), F.lit(2))).alias("path"))


@query("select page_id, string_split(url, '/')[1] as scheme, len(string_split(url, '/'))::int as parts, list_extract(string_split(url, '/'), -1) as last from pages")
def kv_parameters(spark, sf):
    parts = F.split("url", "/", -1)
    return table(spark, sf, "pages").select("page_id", F.element_at(parts, 1).alias("scheme"), F.size(parts).alias("parts"), F.element_at(parts, -1).alias("last"))


# -- scalar numbers ------------------------------------------------------------------


@query("select o_orderkey, (o_orderkey & 1023)::bigint as tag_id, ((o_orderkey >> 10) & 1023)::bigint as level, ((o_orderkey >> 20) & 4095)::bigint as size from orders")
def int_codec(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numbers.record_header(F.col("o_orderkey")).alias("h")).select("o_orderkey", "h.*")


@query("select o_orderkey, [((o_orderkey >> i) & 1)::int for i in range(16)] as flags from orders")
def bit_flags(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numbers.bit_flags(F.col("o_orderkey")).alias("flags"))


@query("select p_partkey, '#' || lpad(upper(hex(p_partkey & 255)), 2, '0') || lpad(upper(hex((p_partkey >> 8) & 255)), 2, '0') || lpad(upper(hex((p_partkey >> 16) & 255)), 2, '0') as color from part")
def colorref(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numbers.color(F.col("p_partkey")).alias("color"))


@query("select p_partkey, case when p_partkey % 702 < 26 then chr((65 + p_partkey % 702)::int) else chr((64 + (p_partkey % 702) // 26)::int) || chr((65 + (p_partkey % 702) % 26)::int) end as name from part")
def column_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numbers.column_name(F.col("p_partkey") % 702).alias("name"))


# -- joins, sets and closures -----------------------------------------------------------


@query("select o_orderkey from orders anti join lineitem on o_orderkey = l_orderkey")
def unreferenced_containers(spark, sf):
    return R.unreferenced(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem"), {"o_orderkey": "l_orderkey"})


@query("select coalesce(l.doc_id, d.doc_id) as doc_id, case when l.doc_id is null then 'undeclared' when d.doc_id is null then 'missing' else 'ok' end as status from (select distinct doc_id from labels) l full outer join (select distinct doc_id from documents) d on l.doc_id = d.doc_id")
def manifest_closure(spark, sf):
    return R.closure(table(spark, sf, "labels"), table(spark, sf, "documents"), "doc_id")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, occurrence from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as occurrence from lineitem) where occurrence > 1")
def duplicate_ids(spark, sf):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")]
    return R.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("occurrence").cast("long").alias("occurrence"))


@query("select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as turn, a.text as base_text, b.text as other_text from conversations a full outer join (select conv_id - 1 as conv_id, turn, text from conversations where conv_id > 0) b on a.conv_id = b.conv_id and a.turn = b.turn where a.text is distinct from b.text")
def full_outer_diff(spark, sf):
    c = table(spark, sf, "conversations")
    return R.positional_diff(c, c.where("conv_id > 0").withColumn("conv_id", F.col("conv_id") - 1), ["conv_id", "turn"], ["text"])


@query("select conv_id, coalesce(min(turn) filter (a is distinct from b), count(*))::bigint as prefix from (select coalesce(x.conv_id, y.conv_id) as conv_id, coalesce(x.turn, y.turn) as turn, x.role as a, y.role as b from conversations x full outer join (select conv_id - 1 as conv_id, turn, role from conversations where conv_id > 0) y on x.conv_id = y.conv_id and x.turn = y.turn) group by conv_id")
def common_prefix(spark, sf):
    c = table(spark, sf, "conversations")
    return R.common_prefix(c, c.where("conv_id > 0").withColumn("conv_id", F.col("conv_id") - 1), ["conv_id"], "turn", ["role"])


@query("select a.conv_id, a.turn, min(b.turn) as end_turn from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn > a.turn and b.role = 'assistant' where a.role = 'user' group by a.conv_id, a.turn")
def field_pairs(spark, sf):
    return R.field_pairs(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "end_turn")


@query("select n_name as name from (select n_name, n_regionkey % 2 as k from nation union all select r_name, 0 from region) except all select n_name from nation where n_regionkey < 3")
def missing_tokens(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return R.missing_items(n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name"))), n.where("n_regionkey < 3").select(F.col("n_name").alias("name")))


@query("select l_orderkey from lineitem where l_returnflag in ('A', 'N', 'R') group by l_orderkey having count(distinct l_returnflag) = 3")
def section_intersect(spark, sf):
    return R.covered_by_all(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("select p.p_partkey, p.p_size from part p where p.p_size not in (select distinct s_nationkey from supplier)")
def feature_coverage(spark, sf):
    return R.unreferenced(table(spark, sf, "part").select("p_partkey", "p_size"), table(spark, sf, "supplier"), {"p_size": "s_nationkey"})


@query("select o.o_orderkey, count(l.l_orderkey) as actual, (o.o_orderkey % 7)::bigint as declared from orders o left join lineitem l on o.o_orderkey = l.l_orderkey group by o.o_orderkey having count(l.l_orderkey) <> o.o_orderkey % 7")
def declared_vs_actual(spark, sf):
    actual = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "orders").join(actual, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("actual"), (F.col("o_orderkey") % 7).alias("declared")).where("actual <> declared")


@query("select r_name, kind, coalesce(n, 0)::bigint as n from region cross join (select distinct c_mktsegment as kind from customer) left join (select n_regionkey, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey group by all) on n_regionkey = r_regionkey and c_mktsegment = kind")
def case_matrix(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    counts = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"))
    # Two small dimensions of the cases: 5 containers by the kinds there are.
    cases = table(spark, sf, "region").crossJoin(F.broadcast(c.select(F.col("c_mktsegment").alias("kind")).distinct()))
    return cases.join(F.broadcast(counts), (cases.r_regionkey == counts.n_regionkey) & (cases.kind == counts.kind), "left").select("r_name", cases.kind, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("select conv_id, coalesce(min(back) filter (a is distinct from b) - 1, count(*))::bigint as suffix from (select coalesce(x.conv_id, y.conv_id) as conv_id, coalesce(x.back, y.back) as back, x.role as a, y.role as b from (select conv_id, role, row_number() over (partition by conv_id order by turn desc) as back from conversations) x full outer join (select conv_id - 1 as conv_id, role, row_number() over (partition by conv_id order by turn desc) as back from conversations where conv_id > 0) y on x.conv_id = y.conv_id and x.back = y.back) where conv_id < (select max(conv_id) from conversations) group by conv_id")
def common_suffix(spark, sf):
    c = table(spark, sf, "conversations")
    return R.common_suffix(c, c.where("conv_id > 0").withColumn("conv_id", F.col("conv_id") - 1), ["conv_id"], "turn", ["role"])


@query("select a.conv_id, a.turn, coalesce(sum(length(b.text)), 0)::bigint as extent from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn >= a.turn and b.turn < a.turn + 1 + length(a.text) % 3 group by a.conv_id, a.turn")
def span_extents(spark, sf):
    c = table(spark, sf, "conversations")
    cells = c.select("conv_id", "turn", (1 + F.length("text") % 3).alias("span"))
    return R.span_extents(cells, c.select("conv_id", F.col("turn").alias("i"), F.length("text").alias("size")), ["conv_id"], "turn", "span", "i", "size").select("conv_id", "turn", F.col("extent").cast("long").alias("extent"))


@query("select p_partkey, chr(39) || replace(p_name, chr(39), chr(39) || chr(39)) || chr(39) || '!$' || chr((65 + p_size % 26)::int) || '$2:$' || chr((65 + p_size % 26)::int) || '$' || (greatest(p_size, 1) + 1) as formula, trim(p_name) as sheet from part")
def chart_ranges(spark, sf):
    formula = numbers.a1_range(F.col("p_name"), F.col("p_size") % 26, F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", formula.alias("formula"), numbers.sheet_anchor(formula).alias("sheet"))


@query("select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events")
def flat_metadata(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(text.flat_paths(F.col("props"))).alias("p")).select("event_id", "p.path", "p.value")


@query("select conv_id, turn from conversations c where role = 'assistant' or not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn < c.turn and p.role = 'system')")
def outside_fields(spark, sf):
    """A system turn opens a field that nothing closes: all user turns after it are skipped."""
    c = table(spark, sf, "conversations")
    opened = R.outside_open_fields(c.where("role <> 'assistant'"), ["conv_id"], "turn", F.col("role") == "system", F.lit(False))
    return opened.select("conv_id", "turn").unionByName(c.where("role = 'assistant'").select("conv_id", "turn"))


# -- ordinals, trees, windows ------------------------------------------------------------------


@query("select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as ordinal from conversations")
def note_ordinal(spark, sf):
    return R.ordinal(table(spark, sf, "conversations"), ["conv_id", "role"], [F.col("turn")]).select("conv_id", "turn", "role", F.col("ordinal").cast("long").alias("ordinal"))


@query("select conv_id, turn, role, case when role = 'system' then null when role = 'user' then 5 + row_number() over (partition by conv_id % 10, role order by conv_id, turn) - 1 else 5 + row_number() over (partition by conv_id, role order by turn) - 1 end as number from conversations")
def note_number(spark, sf):
    c = table(spark, sf, "conversations").withColumn("doc", F.col("conv_id") % 10)
    how = F.when(F.col("role") == "system", "ON_PAGE").when(F.col("role") == "user", "CONTINUOUS").otherwise("SECTION")
    return R.note_numbers(c, "doc", "conv_id", "role", ["turn"], F.lit(5), how).select("conv_id", "turn", "role", "number")


@query('select conv_id, turn as start, lead(turn) over (partition by conv_id order by turn) - 1 as "end" from conversations')
def paragraph_ranges(spark, sf):
    return R.ranges(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "start", "end")


@query("with t as (select conv_id, turn, length(text) % 5 as lv from conversations) select a.conv_id, a.turn, a.lv::int as level, max(b.turn) as parent from t a left join t b on a.conv_id = b.conv_id and b.turn < a.turn and b.lv < a.lv group by a.conv_id, a.turn, a.lv")
def record_tree_parent(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 5).alias("level"))
    return R.parents(c, "conv_id", "turn", "level", depth=8)


@query('with t as (select conv_id, turn, length(text) % 5 as lv from conversations) select a.conv_id, a.turn, coalesce(min(b.turn) - 1, max(m.last)) as "end" from t a join (select conv_id, max(turn) as last from t group by conv_id) m on m.conv_id = a.conv_id left join t b on a.conv_id = b.conv_id and b.turn > a.turn and b.lv <= a.lv group by a.conv_id, a.turn')
def record_tree_interval(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 5).alias("level"))
    return R.interval_ends(c, "conv_id", "turn", "level", depth=8).select("conv_id", "turn", "end")


@query("select a.conv_id, a.turn from conversations a where a.turn = 0 or exists (select 1 from conversations b where b.conv_id = a.conv_id and b.role = 'system' and abs(b.turn - a.turn) <= 1)")
def minimal_window(spark, sf):
    return R.near_hits(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "system", 1, F.col("turn") == 0).select("conv_id", "turn")


@query("with t as (select conv_id, turn, (length(text) - length(replace(text, 'the', ''))) // 3 as n from conversations) select conv_id, turn, greatest(0, least(n, 10 - coalesce(sum(n) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)))::bigint as replaced from t")
def replace_budget(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", text.occurrences(F.col("text"), "the").alias("n"))
    return R.replace_within_budget(c, "conv_id", "turn", "n", 10).select("conv_id", "turn", "replaced")


# -- aggregates and picks ------------------------------------------------------------------------


@query("select l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, rank from (select *, row_number() over (partition by l_suppkey order by l_quantity desc, l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_shipdate) as rank from lineitem) where rank <= 3")
def best_donor_topk(spark, sf):
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")]]
    return R.top_k(table(spark, sf, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


@query("select o_orderkey, a, n, r from (select l_orderkey as o_orderkey, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1) where a > 0 and n > 0 and r > 0 order by -(a + n + r), o_orderkey limit 10")
def donor_combo(spark, sf):
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    donors = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(flag("A").alias("a"), flag("N").alias("n"), flag("R").alias("r"))
    return R.top_k(donors.where("a > 0 and n > 0 and r > 0"), [], [(-(F.col("a") + F.col("n") + F.col("r"))).asc(), F.col("o_orderkey")], 10)


@query("select n_regionkey, list_sort(list(distinct n_name)) as names from nation group by n_regionkey")
def covered_categories(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_set("n_name")).alias("names"))


@query("select conv_id, arg_max(turn, length(text) * 100000 - turn) as turn from conversations group by conv_id")
def arg_max_section(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).alias("turn"))


@query("select g.conv_id, g.r::int as r, g.c::int as c, coalesce(t.text, '') as text from (select distinct conv_id, r, c from conversations, range(2) a(r), range(2) b(c)) g left join (select conv_id, (turn // 2) % 3 as r, turn % 2 as c, arg_max(text, turn) as text from conversations where (turn // 2) % 3 < 2 group by all) t on t.conv_id = g.conv_id and t.r = g.r and t.c = g.c")
def table_matrix(spark, sf):
    cells = table(spark, sf, "conversations").select("conv_id", (F.floor(F.col("turn") / 2) % 3).cast("int").alias("r"), (F.col("turn") % 2).cast("int").alias("c"), "turn", "text")
    return R.matrix(cells, "conv_id", "r", "c", "turn", "text", 2, 2)


@query("select o_custkey, list(o_totalprice order by o_orderkey) as points from orders group by o_custkey")
def chart_series(spark, sf):
    return R.series(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("select l_orderkey, case when count(distinct l_linestatus) = 1 then min(l_linestatus) end as status, bool_and(l_quantity > 5) as all_large from lineitem group by l_orderkey")
def uniform_or_null(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(R.uniform("l_linestatus").alias("status"), F.bool_and(F.col("l_quantity") > 5).alias("all_large"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def duplicate_keys(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("select (max(try_cast(split_part(c_name, '#', 2) as bigint)) + 1)::bigint as next_id from customer")
def next_identifier(spark, sf):
    return table(spark, sf, "customer").select(F.split_part("c_name", F.lit("#"), F.lit(2)).alias("i")).agg(R.next_id("i").alias("next_id"))


@query("select event_type, count(*) as n, count(*) filter (value > 50) as over, round(min(value), 6) as low, round(max(value), 6) as high, count(distinct user_id) as users from events group by event_type")
def gate_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("over"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.countDistinct("user_id").alias("users"))


@query("select date_trunc('month', o_orderdate) as month, count(*) as n from orders group by 1")
def month_bucket(spark, sf):
    return table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_stats(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

"""Relational operators over document tables: closures, diffs, ordinals, trees, ranges, picks.

All are compositions of DataFrame operations; order is always an explicit
column, never the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- joins --------------------------------------------------------------------


def unreferenced(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of `left` to which no row of `right` refers (left anti)."""
    cond = reduce(lambda a, b: a & b, [left[x] == right[y] for x, y in on.items()])
    return left.join(right, cond, "left_anti")


def closure(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status) of all keys of both sides: ok, undeclared or missing."""
    d, a = declared.select(key).distinct().withColumn("_d", F.lit(True)), actual.select(key).distinct().withColumn("_a", F.lit(True))
    status = F.when(F.col("_d").isNull(), "undeclared").when(F.col("_a").isNull(), "missing").otherwise("ok")
    return d.join(a, key, "full_outer").select(key, status.alias("status"))


def positional_diff(base: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Positions at which two ordered tables differ: the keys and both sides' values, null where a side ends."""
    b = base.select(*keys, F.struct(*values).alias("base"))
    o = other.select(*keys, F.struct(*values).alias("other"))
    both = b.join(o, keys, "full_outer").where(~F.col("base").eqNullSafe(F.col("other")))
    return both.select(*keys, *[F.col(f"base.{v}").alias(f"base_{v}") for v in values], *[F.col(f"other.{v}").alias(f"other_{v}") for v in values])


def common_prefix(base: DataFrame, other: DataFrame, group: list[str], order: str, values: list[str]) -> DataFrame:
    """Length of the equal prefix of two ordered tables (positions from 0), a row a group."""
    b = base.select(*group, order, F.struct(*values).alias("base"))
    o = other.select(*group, order, F.struct(*values).alias("other"))
    both = b.join(o, [*group, order], "full_outer")
    differs = F.min(F.when(~F.col("base").eqNullSafe(F.col("other")), F.col(order)))
    return both.groupBy(*group).agg(F.coalesce(differs, F.count("*")).cast("long").alias("prefix"))


def common_suffix(base: DataFrame, other: DataFrame, group: list[str], order: str, values: list[str]) -> DataFrame:
    """Length of the equal suffix of two ordered tables, a row a group that both have, from distances to the end."""
    back = lambda df, name: df.select(*group, F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order))).alias("_back"), F.struct(*values).alias(name))
    both = back(base, "base").join(back(other, "other"), [*group, "_back"], "full_outer")
    differs = F.min(F.when(~F.col("base").eqNullSafe(F.col("other")), F.col("_back"))) - 1
    held = F.bool_or(F.col("base").isNotNull()) & F.bool_or(F.col("other").isNotNull())
    return both.groupBy(*group).agg(F.coalesce(differs, F.count("*")).cast("long").alias("suffix"), held.alias("_held")).where("_held").drop("_held")


def pair_by_key(left: DataFrame, right: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """Greedy one-to-one pairs of two ordered tables: (group, left order, right order), null where there is no partner.

    In order, a left row takes the first unused right row of an equal non-empty
    key, else the first unused one of all; right rows that are left over come
    last. A group's rows are one task's work, as each choice depends on those
    before.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    kinds = StructType([left.schema[g] for g in group] + [StructField("left_" + order, LongType()), StructField("right_" + order, LongType())])
    rows = left.select(*group, order, key, F.lit(0).alias("_side")).unionByName(right.select(*group, order, key, F.lit(1).alias("_side")))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        names = pdf[group].iloc[0].tolist()
        mine, theirs = (pdf[pdf["_side"] == k] for k in (0, 1))
        waiting: dict = {}
        unused = dict.fromkeys(theirs[order].tolist())
        for o, k in zip(theirs[order], theirs[key], strict=True):
            waiting.setdefault(k, []).append(o)
        for v in waiting.values():
            v.reverse()
        out = []
        for o, k in zip(mine[order], mine[key], strict=True):
            own = waiting.get(k, []) if k else []
            while own and own[-1] not in unused:
                own.pop()
            got = own.pop() if own else next(iter(unused), None)
            unused.pop(got, None)
            out.append((o, got))
        out += [(None, o) for o in unused]
        return pd.DataFrame({**{g: [v] * len(out) for g, v in zip(group, names, strict=True)}, "left_" + order: pd.array([a for a, _ in out], "Int64"), "right_" + order: pd.array([b for _, b in out], "Int64")})

    return rows.groupBy(*group).applyInPandas(run, kinds)


def forward_matches(tokens: DataFrame, items: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """(group, token order, item order): each token in order with the first item of its key after the last item matched; null if none.

    Order-preserving and greedy, so a group's rows are one task's work.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    kinds = StructType([tokens.schema[g] for g in group] + [StructField("token_" + order, LongType()), StructField("item_" + order, LongType())])
    rows = tokens.select(*group, order, key, F.lit(0).alias("_side")).unionByName(items.select(*group, order, key, F.lit(1).alias("_side")))

    def run(pdf):
        import bisect

        import pandas as pd

        pdf = pdf.sort_values(order)
        names = pdf[group].iloc[0].tolist()
        mine, theirs = (pdf[pdf["_side"] == k] for k in (0, 1))
        places: dict = {}
        for i, k in enumerate(theirs[key]):
            places.setdefault(k, []).append(i)
        orders, at, out = theirs[order].tolist(), 0, []
        for o, k in zip(mine[order], mine[key], strict=True):
            own = places.get(k, [])
            j = bisect.bisect_left(own, at)
            out.append((o, orders[own[j]] if j < len(own) else None))
            at = own[j] + 1 if j < len(own) else at
        return pd.DataFrame({**{g: [v] * len(out) for g, v in zip(group, names, strict=True)}, "token_" + order: pd.array([a for a, _ in out], "Int64"), "item_" + order: pd.array([b for _, b in out], "Int64")})

    return rows.groupBy(*group).applyInPandas(run, kinds)


def outside_open_fields(rows: DataFrame, group: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """Rows that lie in no open field: those between an opening and its closing row are skipped, both of these stay."""
    upto = Window.partitionBy(*group).orderBy(order)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    # The depth never falls below 0: a stray closing row opens nothing.
    marked = rows.withColumn("_sum", F.sum(step).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_floor", F.least(F.lit(0), F.min("_sum").over(upto.rowsBetween(Window.unboundedPreceding, 0))))
    marked = marked.withColumn("_depth", F.coalesce(F.lag(F.col("_sum") - F.col("_floor")).over(upto), F.lit(0)))
    return marked.where((F.col("_depth") == 0) | ((F.col("_depth") == 1) & closes)).drop("_sum", "_floor", "_depth")


def running_total(rows: DataFrame, group: list[str], order: str, value: Column, name: str = "total") -> DataFrame:
    """Sum of a value over the rows before each row of its group."""
    return rows.withColumn(name, F.coalesce(F.sum(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def span_extents(cells: DataFrame, sizes: DataFrame, group: list[str], at: str, span: str, index: str, size: str) -> DataFrame:
    """`extent` of each cell: the sum of the sizes from its place over its span, from two prefix sums instead of a range join."""
    upto = Window.partitionBy(*group).orderBy(index)
    ends = sizes.select(*group, (F.col(index) + 1).alias("_i"), F.sum(size).over(upto).alias("_sum"))
    last = ends.groupBy(*group).agg(F.max("_i").alias("_last"), F.max_by("_sum", "_i").alias("_all"))
    rows = cells.join(last, group, "left").withColumn("_to", F.least(F.col(at) + F.col(span), F.col("_last")))
    rows = rows.join(ends.select(*group, F.col("_i").alias("_to"), F.col("_sum").alias("_b")), [*group, "_to"], "left")
    rows = rows.join(ends.select(*group, F.col("_i").alias(at), F.col("_sum").alias("_a")), [*group, at], "left")
    return rows.withColumn("extent", F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.when(F.col(at) >= F.col("_last"), F.col("_all")), F.lit(0))).drop("_last", "_all", "_to", "_a", "_b")


def field_pairs(rows: DataFrame, group: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """Each opening row with the first closing row after it in its group (null if none): one sort, no join."""
    after = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.min(F.when(closes, F.col(order))).over(after)
    return rows.withColumn("end_" + order, nearest).where(opens)


def missing_items(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows that the actual rows lack, counted as multisets."""
    return expected.exceptAll(actual)


def covered_by_all(rows: DataFrame, group: str, item: str, wanted: list) -> DataFrame:
    """Groups that hold every wanted item."""
    return rows.where(F.col(item).isin(wanted)).groupBy(group).agg(F.countDistinct(item).alias("n")).where(F.col("n") == len(set(wanted))).select(group)


# -- ordinals, trees and ranges ---------------------------------------------------


def ordinal(rows: DataFrame, partition: list[str], order: list[Column], name: str = "ordinal", start: int = 1) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) + (start - 1))


def note_numbers(notes: DataFrame, doc: str, section: str, kind: str, order: list[str], start: Column, numbering: Column) -> DataFrame:
    """Numbers of notes: `start` plus the ordinal less one; by document, by section, or null for ON_PAGE."""
    by_doc = F.row_number().over(Window.partitionBy(doc, kind).orderBy(section, *order))
    by_section = F.row_number().over(Window.partitionBy(doc, kind, section).orderBy(*order))
    number = F.when(numbering == "ON_PAGE", F.lit(None)).when(numbering == "CONTINUOUS", start + by_doc - 1).otherwise(start + by_section - 1)
    return notes.withColumn("number", number.cast("long"))


def duplicates(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every occurrence of a key after its first."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("occurrence > 1")


def ranges(rows: DataFrame, group: str, order: str) -> DataFrame:
    """[start, end]: from each row to just before the next of its group; null for the last."""
    return rows.select("*", F.col(order).alias("start"), (F.lead(order).over(Window.partitionBy(group).orderBy(order)) - 1).alias("end"))


def parents(rows: DataFrame, group: str, order: str, level: str, depth: int = 32) -> DataFrame:
    """`parent`: the order of the nearest earlier row of the group with a smaller level, null for roots.

    One running maximum a level, all in one sort, so nothing is gathered; a
    level beyond `depth` raises.
    """
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = [F.max(F.when(F.col(level) < k, F.col(order))).over(before) for k in range(1, depth + 1)]
    found = F.when(F.col(level) == 0, F.lit(None)).when(F.col(level) > depth, F.raise_error(F.lit(f"levels beyond {depth}"))).otherwise(F.element_at(F.array(*running), F.greatest(F.col(level), F.lit(1)).cast("int")))
    return rows.withColumn("parent", found)


def interval_ends(rows: DataFrame, group: str, order: str, level: str, depth: int = 32) -> DataFrame:
    """`end`: the order of the last row of each row's subtree (itself for a leaf)."""
    after = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(order).over(Window.partitionBy(group))
    following = [F.min(F.when(F.col(level) <= k, F.col(order))).over(after) for k in range(depth + 1)]
    return rows.withColumn("end", F.coalesce(F.element_at(F.array(*following), (F.col(level) + 1).cast("int")) - 1, last))


def near_hits(rows: DataFrame, group: str, order: str, hit: Column, width: int, keep: Column | None = None) -> DataFrame:
    """Rows within `width` rows of a hit in their group, and those to keep anyway."""
    around = Window.partitionBy(group).orderBy(order).rowsBetween(-width, width)
    chosen = F.max(F.when(hit, 1).otherwise(0)).over(around) == 1
    return rows.withColumn("_near", chosen if keep is None else chosen | keep).where("_near").drop("_near")


def replace_within_budget(rows: DataFrame, group: str, order: str, found: str, budget: int) -> DataFrame:
    """`replaced`: how many of a row's occurrences a budget for the whole group still covers, in order."""
    before = F.coalesce(F.sum(found).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("replaced", F.greatest(F.lit(0), F.least(F.col(found), F.lit(budget) - before)).cast("long"))


# -- aggregates and picks -----------------------------------------------------------


def joined_text(rows: DataFrame, group: list[str], order: str, text: str, separator: str, name: str = "text") -> DataFrame:
    """A group's texts in order, with separators; nulls are left out."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda s: s[text]), separator).alias(name))


def top_k(rows: DataFrame, partition: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each partition (of all, without one), by a total order."""
    if not partition:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= k)


def matrix(cells: DataFrame, group: str, row: str, column: str, order: str, text: str, rows: int, columns: int) -> DataFrame:
    """A full grid for each group: the last text of each cell, empty where there is none, strays dropped."""
    inside = cells.where(F.col(row).between(0, rows - 1) & F.col(column).between(0, columns - 1))
    last = inside.groupBy(group, row, column).agg(F.max_by(text, order).alias(text))
    grid = cells.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias(row)).select(group, row, F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias(column))
    return grid.join(last, [group, row, column], "left").select(group, row, column, F.coalesce(text, F.lit("")).alias(text))


def series(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """A group's values in order, as an array."""
    return rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("points"))


def uniform(column: str) -> Column:
    """The value if all of a group are equal, else null."""
    return F.when(F.min(column).eqNullSafe(F.max(column)) & (F.count(column) == F.count("*")), F.min(column))


def next_id(ident: str) -> Column:
    """One more than the largest numeric id; others are ignored."""
    return F.coalesce(F.max(F.col(ident).try_cast("long")), F.lit(0)) + 1


def free_suffix(names: DataFrame, column: str, stem: str) -> DataFrame:
    """The smallest free name of stem, stem_1, stem_2, ...; gaps are filled. One row.

    Among n taken names one of n + 1 candidates is free.
    """
    taken = names.where(F.col(column).startswith(stem)).select(column).distinct()
    n = taken.agg(F.count("*").alias("n"))
    all_ = n.select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("i")).select("i", F.when(F.col("i") == 0, stem).otherwise(F.concat(F.lit(stem + "_"), F.col("i").cast("string"))).alias(column))
    return all_.join(taken, column, "left_anti").agg(F.min_by(column, "i").alias(column))

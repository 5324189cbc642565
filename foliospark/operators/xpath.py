"""XPath 1.0 over the node table, for many parts at once.

An expression is parsed once on the driver; every step is then a join of the
nodes that are reached so far with the table of all nodes. Child and parent are
equality joins on `parent`; descendants and ancestors are equality joins on the
list of ancestors; siblings and what follows or precedes compare with one
bound a parent or part. Positions in predicates are windows. Nothing compares
all pairs of nodes.

Supported: absolute and relative paths, all axes but namespace, names, `*`,
`prefix:*`, node(), text(), attributes, unions, predicates with positions,
paths, comparisons, and / or, + and -, and the functions in `FUNCTIONS`.
Relative paths start at the root element of each part, or at given nodes.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.packages import NAMESPACES

AXES = ("child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "following", "preceding", "attribute")
REVERSE = ("parent", "ancestor", "ancestor-or-self", "preceding-sibling", "preceding")
FUNCTIONS = ("position", "last", "count", "not", "true", "false", "boolean", "number", "string", "concat", "contains", "starts-with", "string-length", "normalize-space", "name", "local-name")
_TOKEN = re.compile(r"""\s*(\.\.|\.(?!\d)|//|/|::|@|\[|\]|\(|\)|\||,|!=|<=|>=|=|<|>|\+|-|\*|"[^"]*"|'[^']*'|\d+(?:\.\d*)?|[^\W\d][\w.-]*(?::(?!:)(?:\*|[^\W\d][\w.-]*))?)""")
_NODE = ("pre", "end", "parent", "depth", "ns", "local", "text", "tail", "attrs", "ancestors")
_KEY = ("doc", "part", "origin")


# -- reading an expression ----------------------------------------------------------


class _Reader:
    """Recursive descent: a tree of tuples, the first item of each its kind."""

    def __init__(self, expression: str, namespaces: dict[str, str]) -> None:
        self.tokens, self.spaces, at = [], namespaces, 0
        while expression[at:].strip():
            m = _TOKEN.match(expression, at)
            if not m:
                raise ValueError(f"can't read {expression[at:]!r} in {expression!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if wanted and token not in wanted:
            raise ValueError(f"{' or '.join(wanted)} is expected before {' '.join(self.tokens[self.at :]) or 'the end'}")
        self.at += 1
        return token

    def chain(self, kind: str, words: tuple[str, ...], below):
        left = below()
        while self.peek() in words:
            word = self.take()
            left = (kind, word, left, below())
        return left

    def whole(self):
        found = self.either()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r}")
        return found

    def either(self):
        return self.chain("logic", ("or",), lambda: self.chain("logic", ("and",), self.compared))

    def compared(self):
        return self.chain("compare", ("=", "!=", "<", "<=", ">", ">="), lambda: self.chain("sum", ("+", "-"), self.joined))

    def joined(self):
        paths = [self.primary()]
        while self.peek() == "|":
            self.take()
            paths.append(self.primary())
        if len(paths) == 1:
            return paths[0]
        if any(p[0] != "path" for p in paths):
            raise ValueError("only paths can be united")
        return ("union", paths)

    def primary(self):
        token = self.peek()
        if token[:1] in "\"'" and token:
            return ("text", self.take()[1:-1])
        if token[:1].isdigit():
            return ("number", float(self.take()))
        if token == "-":
            self.take()
            return ("sum", "-", ("number", 0.0), self.primary())
        if token == "(":
            self.take()
            found = self.either()
            self.take(")")
            return found
        if self.peek(1) == "(" and token not in ("node", "text"):
            if token not in FUNCTIONS:
                raise ValueError(f"unknown function {token}()")
            self.at += 2
            args = []
            while self.peek() != ")":
                args.append(self.either())
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            return ("call", token, args)
        return self.path()

    def path(self):
        absolute, steps, deep = False, [], False
        if self.peek() in ("/", "//"):
            absolute, deep = True, self.take() == "//"
            if not deep and (not self.peek() or self.peek() in ("]", ")", ",", "|")):
                raise ValueError("a path can't end at the root")
        while True:
            steps.append(self.step(deep))
            if self.peek() not in ("/", "//"):
                return ("path", absolute, steps)
            deep = self.take() == "//"

    def step(self, deep: bool):
        """(axis, test, predicates, by parent): after `//` a child is a descendant that is counted within its parent."""
        if self.peek() in (".", ".."):
            axis, test = ("self" if self.take() == "." else "parent"), ("node",)
        else:
            axis = "child"
            if self.peek() == "@":
                self.take()
                axis = "attribute"
            elif self.peek(1) == "::":
                axis = self.take()
                self.take("::")
                if axis not in AXES:
                    raise ValueError(f"unknown axis {axis}")
            test = self.test(axis)
        predicates = []
        while self.peek() == "[":
            self.take()
            predicates.append(self.either())
            self.take("]")
        if not deep:
            return axis, test, predicates, False
        if axis in ("child", "self", "attribute"):
            return {"child": "descendant", "self": "descendant-or-self", "attribute": "deep-attribute"}[axis] if test != ("text",) else "deep-text", test, predicates, True
        raise ValueError(f"// before {axis}:: isn't supported")

    def test(self, axis: str):
        token = self.take()
        if self.peek() == "(":
            self.take()
            self.take(")")
            if token not in ("node", "text"):
                raise ValueError(f"unknown test {token}()")
            return (token,)
        if token == "*":
            return ("name", None, None)
        if not re.match(r"[^\W\d]", token):
            raise ValueError(f"a name is expected, not {token!r}")
        prefix, _, local = token.rpartition(":")
        if prefix and prefix not in self.spaces:
            raise ValueError(f"unknown prefix {prefix}")
        return ("name", self.spaces[prefix] if prefix else "", None if local == "*" else local)


# -- steps as joins -----------------------------------------------------------------


def _positional(tree) -> bool:
    if not isinstance(tree, tuple):
        return False
    if tree[0] in ("number", "sum"):
        return True
    if tree[0] == "call":
        return tree[1] in ("position", "last") or tree[1] in ("not", "boolean") and any(map(_nested, tree[2]))
    return tree[0] in ("logic", "compare") and any(map(_nested, tree[2:]))


def _nested(tree) -> bool:
    """Whether a part of a predicate asks for the position."""
    return isinstance(tree, tuple) and (tree[0] == "call" and (tree[1] in ("position", "last") or any(map(_nested, tree[2]))) or tree[0] in ("logic", "compare", "sum") and any(map(_nested, tree[2:])))


def _tested(rows: DataFrame, test) -> DataFrame:
    if test[0] != "name":
        return rows
    _, ns, local = test
    if ns is not None:
        rows = rows.where(F.col("ns").isNull() if ns == "" else F.col("ns") == ns)
    return rows if local is None else rows.where(F.col("local") == local)


def _steps(nodes: DataFrame, rows: DataFrame, axis: str, test, by_parent: bool, positional: bool, nth: int | None) -> DataFrame:
    """Nodes reached from `rows` by an axis: their columns, the origin, and `from`, within which positions count."""
    found = _tested(nodes.select("doc", "part", *_NODE), test)
    if axis == "self":
        return _tested(rows, test).withColumn("from", F.col("pre"))
    own = rows.select(*_KEY, F.col("pre").alias("from"), F.col("parent").alias("_parent"), F.col("end").alias("_end"), F.col("ancestors").alias("_above"))
    join = lambda a, b, *on: a.join(b, ["doc", "part", *on]).select(*_KEY, "from", *_NODE)
    if axis == "child":
        return join(found.withColumn("_at", F.col("parent")), own.withColumn("_at", F.col("from")), "_at")
    if axis in ("descendant", "descendant-or-self"):
        above = F.array_append("ancestors", F.col("pre")) if axis.endswith("self") else F.col("ancestors")
        out = join(found.withColumn("_at", F.explode(above)), own.withColumn("_at", F.col("from")), "_at")
        return out.withColumn("from", F.col("parent")) if by_parent else out
    if axis in ("parent", "ancestor", "ancestor-or-self"):
        above = {"parent": F.array("_parent"), "ancestor": F.col("_above"), "ancestor-or-self": F.array_append("_above", F.col("from"))}[axis]
        return join(found.withColumn("_at", F.col("pre")), own.withColumn("_at", F.explode(above)), "_at")
    after = axis.startswith("following")
    if axis.endswith("-sibling"):
        if positional and nth is None:
            raise ValueError(f"{axis}:: takes a number as its position only")
        if positional:  # counts of the siblings that pass the test give the one of this number
            order = Window.partitionBy("doc", "part", "parent").orderBy("pre")
            ranked = found.where("parent is not null").withColumn("_rank", F.row_number().over(order))
            marks = ranked.select("doc", "part", "parent", "pre", F.lit(1).alias("_one")).unionByName(own.where("_parent is not null").select("doc", "part", F.col("_parent").alias("parent"), F.col("from").alias("pre"), F.lit(0).alias("_one")).distinct())
            before = marks.withColumn("_before", F.sum("_one").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("_one = 0")
            # A context node that passes the test itself is counted; it lies before what follows and is none of what precedes.
            self_ = found.select("doc", "part", "pre", F.lit(1).alias("_self"))
            before = before.join(self_, ["doc", "part", "pre"], "left").select("doc", "part", F.col("pre").alias("from"), (F.col("_before") + nth if after else F.col("_before") - F.coalesce("_self", F.lit(0)) - nth + 1).alias("_rank"))
            return ranked.join(own.join(before, ["doc", "part", "from"]).select(*_KEY, "from", F.col("_parent").alias("parent"), "_rank"), ["doc", "part", "parent", "_rank"]).select(*_KEY, "from", *_NODE)
        bound = own.where("_parent is not null").groupBy(*_KEY, F.col("_parent").alias("_at")).agg((F.min if after else F.max)("from").alias("from"))
        out = join(found.withColumn("_at", F.col("parent")), bound, "_at")
        return out.where(F.col("pre") > F.col("from") if after else F.col("pre") < F.col("from"))
    if positional:
        raise ValueError(f"{axis}:: takes no positions")
    bound = own.groupBy(*_KEY).agg((F.min("_end") if after else F.max("from")).alias("from"))
    out = join(found, bound)
    return out.where(F.col("pre") > F.col("from") if after else F.col("end") < F.col("from"))


def _filtered(nodes: DataFrame, rows: DataFrame, predicates: list, reverse: bool) -> DataFrame:
    """Rows that pass all predicates; each counts positions anew."""
    group = Window.partitionBy(*_KEY, "from")
    for p in predicates:
        if _positional(p) or _nested(p):
            rows = rows.withColumn("_position", F.row_number().over(group.orderBy(F.desc("pre") if reverse else F.asc("pre")))).withColumn("_last", F.count("*").over(group))
        rows, value, kind = _value(nodes, rows, p)
        rows = rows.where(F.col("_position") == value if kind == "number" else _truth(value, kind)).select(*_KEY, "from", *_NODE)
    return rows


def _walk(nodes: DataFrame, rows: DataFrame, tree) -> DataFrame:
    """(doc, part, origin, kind, pre, at, value): what a path reaches from `rows`; `at` orders elements, texts and attributes."""
    _, absolute, steps = tree
    if absolute:
        rows = rows.select(*_KEY).distinct()
    fresh = absolute
    for i, (axis, test, predicates, by_parent) in enumerate(steps):
        last = i + 1 == len(steps)
        if axis in ("attribute", "deep-attribute") or test == ("text",):
            if not last or predicates:
                raise ValueError("attributes and texts end a path")
            if fresh or axis.startswith("deep"):
                rows = _all(nodes, rows, fresh)
            if axis not in ("attribute", "deep-attribute", "child", "descendant", "deep-text"):
                raise ValueError(f"{axis}::text() isn't supported")
            if axis == "descendant":
                rows = _all(nodes, rows, False)
            return _attributes(rows, test) if axis.endswith("attribute") else _texts(nodes, rows)
        first = predicates[0] if predicates else None
        nth = int(first[1]) if first and first[0] == "number" and len(predicates) == 1 and axis.endswith("-sibling") else None
        positional = any(map(_positional, predicates)) or any(map(_nested, predicates))
        if fresh:
            if axis not in ("child", "descendant", "descendant-or-self"):
                raise ValueError(f"{axis}:: can't start at the root")
            found = _tested(nodes.select("doc", "part", *_NODE), test)
            if axis == "child":
                found = found.where("depth = 0")
            rows = found.join(rows, ["doc", "part"]).withColumn("from", F.col("parent") if by_parent or axis == "child" else F.lit(-1)).select(*_KEY, "from", *_NODE)
            fresh = False
        else:
            rows = _steps(nodes, rows, axis, test, by_parent, positional, nth)
        if nth is None:
            if predicates and not positional:
                rows = rows.dropDuplicates([*_KEY, "pre"])
            rows = _filtered(nodes, rows, predicates, axis in REVERSE)
        rows = rows.drop("from").dropDuplicates([*_KEY, "pre"])
    return rows.select(*_KEY, F.lit("element").alias("kind"), "pre", _at(F.col("pre"), 0, F.lit(0)).alias("at"), F.lit(None).cast("string").alias("value"))


def _at(place: Column, part: int, more: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), F.lit(part).alias("part"), more.cast("string").alias("more"))


def _all(nodes: DataFrame, rows: DataFrame, fresh: bool) -> DataFrame:
    """Rows and all that is in them."""
    if fresh:
        return nodes.select("doc", "part", *_NODE).join(rows, ["doc", "part"]).select(*_KEY, *_NODE)
    return _steps(nodes, rows, "descendant-or-self", ("node",), False, False, None).dropDuplicates([*_KEY, "pre"]).drop("from")


def _attributes(rows: DataFrame, test) -> DataFrame:
    if test[0] == "name" and test[2] is not None:
        name = test[2] if not test[1] else "{%s}%s" % (test[1], test[2])
        rows = rows.select(*_KEY, "pre", F.lit(name).alias("name"), F.col("attrs")[name].alias("value")).where("value is not null")
    else:
        rows = rows.select(*_KEY, "pre", F.explode("attrs").alias("name", "value"))
        if test[0] == "name" and test[1]:
            rows = rows.where(F.startswith("name", F.lit("{%s}" % test[1])))
    return rows.select(*_KEY, F.lit("attribute").alias("kind"), "pre", _at(F.col("pre"), 1, F.col("name")).alias("at"), "value")


def _texts(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts right below: an element's own before its first child, and the tails of its children."""
    own = rows.where("text <> ''").select(*_KEY, "pre", _at(F.col("pre"), 2, F.lit("")).alias("at"), F.col("text").alias("value"))
    tails = nodes.where("tail <> '' and parent is not null").select("doc", "part", F.col("parent").alias("pre"), _at(F.col("end"), 3, F.lpad((F.lit(1 << 20) - F.col("depth")).cast("string"), 8, "0")).alias("at"), F.col("tail").alias("value"))
    below = tails.join(rows.select(*_KEY, "pre"), ["doc", "part", "pre"]).select(*_KEY, "pre", "at", "value")
    return own.unionByName(below).select(*_KEY, F.lit("text").alias("kind"), "pre", "at", "value")


# -- values in predicates -----------------------------------------------------------


def _truth(value: Column, kind: str) -> Column:
    return {"boolean": value, "number": (value != 0) & ~F.isnan(value), "string": value != ""}[kind]


def _number(value: Column, kind: str) -> Column:
    if kind == "string":
        return F.coalesce(F.trim(value).try_cast("double"), F.lit(float("nan")))
    return value.cast("double")


def _string(value: Column, kind: str) -> Column:
    if kind == "number":
        return F.when(F.isnan(value), "NaN").when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def string_values(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, part, pre, value): all text inside each element of `rows`."""
    up = lambda above, at, text: nodes.where(F.col(text) != "").select("doc", "part", F.explode(above).alias("pre"), at.alias("at"), F.col(text).alias("piece"))
    depth = F.lpad((F.lit(1 << 20) - F.col("depth")).cast("string"), 8, "0")
    pieces = up(F.array_append("ancestors", F.col("pre")), _at(F.col("pre"), 2, F.lit("")), "text").unionByName(up(F.col("ancestors"), _at(F.col("end"), 3, depth), "tail"))
    mine = pieces.join(rows.select("doc", "part", "pre").distinct(), ["doc", "part", "pre"])
    return mine.groupBy("doc", "part", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s.piece), "").alias("value"))


def _reached(nodes: DataFrame, rows: DataFrame, tree, strings: bool) -> DataFrame:
    """(doc, part, pre, at, value): what a path in a predicate reaches from each of `rows`, by that row's `pre`."""
    here = rows.select("doc", "part", F.col("pre").alias("origin"), *_NODE).dropDuplicates(["doc", "part", "origin"])
    trees = tree[1] if tree[0] == "union" else [tree]
    if any(t[1] for t in trees):
        raise ValueError("a path in a predicate can't start at the root")
    if any(s[0] in ("following", "preceding") for t in trees for s in t[2]):
        raise ValueError("following:: and preceding:: can't stand in a predicate")
    found = reduce(DataFrame.unionByName, [_walk(nodes, here, t) for t in trees]).dropDuplicates([*_KEY, "kind", "pre", "at"])
    if strings:
        text = string_values(nodes, found.where("kind = 'element'")).withColumnRenamed("value", "_text")
        found = found.join(text, ["doc", "part", "pre"], "left").withColumn("value", F.when(F.col("kind") == "element", F.coalesce("_text", F.lit(""))).otherwise(F.col("value")))
    return found.select("doc", "part", F.col("origin").alias("pre"), "at", "value")


def _attribute(tree) -> Column | None:
    """A path that is one attribute of the node itself."""
    if tree[0] == "path" and not tree[1] and len(tree[2]) == 1:
        axis, test, predicates, _ = tree[2][0]
        if axis == "attribute" and test[0] == "name" and test[2] is not None and not predicates:
            return F.col("attrs")[test[2] if not test[1] else "{%s}%s" % (test[1], test[2])]
    return None


def _with(nodes: DataFrame, rows: DataFrame, tree, made: Column, strings: bool = True) -> tuple[DataFrame, Column]:
    """Rows with an aggregate of what a path reaches from each; null where it reaches nothing."""
    name = f"_v{len(rows.columns)}"
    got = _reached(nodes, rows, tree, strings).groupBy("doc", "part", "pre").agg(made.alias(name))
    return rows.join(got, ["doc", "part", "pre"], "left"), F.col(name)


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _compared(op: str, a: Column, ak: str, b: Column, bk: str) -> Column:
    if op in ("=", "!=") and "boolean" in (ak, bk):
        return _COMPARE[op](_truth(a, ak), _truth(b, bk))
    if op in ("=", "!=") and ak == bk == "string":
        return _COMPARE[op](a, b)
    return _COMPARE[op](_number(a, ak), _number(b, bk)) & ((op == "!=") | (~F.isnan(_number(a, ak)) & ~F.isnan(_number(b, bk))))


def _is_path(tree) -> bool:
    return tree[0] in ("path", "union")


def _value(nodes: DataFrame, rows: DataFrame, tree) -> tuple[DataFrame, Column, str]:
    """Rows (with columns that the value needs), the value of an expression on each row, and its kind; a path alone is whether it reaches anything."""
    kind = tree[0]
    if kind == "text":
        return rows, F.lit(tree[1]), "string"
    if kind == "number":
        return rows, F.lit(tree[1]), "number"
    if _is_path(tree):
        if (a := _attribute(tree)) is not None:
            return rows, a.isNotNull(), "boolean"
        rows, v = _with(nodes, rows, tree, F.lit(True), strings=False)
        return rows, F.coalesce(v, F.lit(False)), "boolean"
    if kind == "logic":
        rows, a, ak = _value(nodes, rows, tree[2])
        rows, b, bk = _value(nodes, rows, tree[3])
        return rows, (_truth(a, ak) | _truth(b, bk)) if tree[1] == "or" else (_truth(a, ak) & _truth(b, bk)), "boolean"
    if kind == "sum":
        rows, a = _text_or_number(nodes, rows, tree[2], "number")
        rows, b = _text_or_number(nodes, rows, tree[3], "number")
        return rows, a + b if tree[1] == "+" else a - b, "number"
    if kind == "compare":
        _, op, left, right = tree
        if _is_path(left) and _is_path(right):
            rows, a = _with(nodes, rows, left, F.collect_set("value"))
            rows, b = _with(nodes, rows, right, F.collect_set("value"))
            if op == "=":
                return rows, F.coalesce(F.arrays_overlap(a, b), F.lit(False)), "boolean"
            if op == "!=":
                return rows, F.coalesce((F.size(F.array_union(a, b)) > 1), F.lit(False)), "boolean"
            raise ValueError("two paths can be compared by = and != only")
        if _is_path(right):
            left, right, op = right, left, _TURNED.get(op, op)
        rows, b, bk = _value(nodes, rows, right)
        if not _is_path(left):
            rows, a, ak = _value(nodes, rows, left)
            return rows, _compared(op, a, ak, b, bk), "boolean"
        if bk == "boolean":
            rows, a, ak = _value(nodes, rows, left)
            return rows, _compared(op, a, ak, b, bk), "boolean"
        if (a := _attribute(left)) is not None:
            return rows, F.coalesce(_compared(op, a, "string", b, bk), F.lit(False)), "boolean"
        rows, held = _with(nodes, rows, left, F.collect_set("value"))
        return rows, F.coalesce(F.exists(held, lambda a: _compared(op, a, "string", b, bk)), F.lit(False)), "boolean"
    return _called(nodes, rows, tree[1], tree[2])


def _text_or_number(nodes: DataFrame, rows: DataFrame, tree, wanted: str) -> tuple[DataFrame, Column]:
    """An expression as a string or number; of a path the first node in document order counts."""
    if _is_path(tree):
        if (a := _attribute(tree)) is not None:
            v = F.coalesce(a, F.lit(""))
        else:
            rows, v = _with(nodes, rows, tree, F.min_by("value", "at"))
            v = F.coalesce(v, F.lit(""))
        kind = "string"
    else:
        rows, v, kind = _value(nodes, rows, tree)
    return rows, _string(v, kind) if wanted == "string" else _number(v, kind)


def _called(nodes: DataFrame, rows: DataFrame, name: str, args: list) -> tuple[DataFrame, Column, str]:
    if name in ("position", "last"):
        return rows, F.col(f"_{name}").cast("double"), "number"
    if name in ("true", "false"):
        return rows, F.lit(name == "true"), "boolean"
    if name == "count":
        if len(args) != 1 or not _is_path(args[0]):
            raise ValueError("count() takes a path")
        rows, v = _with(nodes, rows, args[0], F.count("*"), strings=False)
        return rows, F.coalesce(v, F.lit(0)).cast("double"), "number"
    if name in ("not", "boolean"):
        rows, v, kind = _value(nodes, rows, args[0])
        return rows, ~_truth(v, kind) if name == "not" else _truth(v, kind), "boolean"
    if name in ("name", "local-name"):
        if args:
            raise ValueError(f"{name}() takes no path here")
        prefix = F.create_map(*[F.lit(x) for k, v in NAMESPACES.items() for x in (v, k + ":")])[F.col("ns")]
        return rows, F.col("local") if name == "local-name" else F.concat(F.coalesce(prefix, F.lit("")), "local"), "string"
    values = []
    for a in args or [("path", False, [("self", ("node",), [], False)])]:
        rows, v = _text_or_number(nodes, rows, a, "number" if name == "number" else "string")
        values.append(v)
    made = {
        "string": lambda a: (a, "string"), "number": lambda a: (a, "number"), "concat": lambda *a: (F.concat(*a), "string"), "contains": lambda a, b: (F.contains(a, b), "boolean"), "starts-with": lambda a, b: (F.startswith(a, b), "boolean"),
        "string-length": lambda a: (F.length(a).cast("double"), "number"), "normalize-space": lambda a: (F.trim(F.regexp_replace(a, "[ \t\r\n]+", " ")), "string"),
    }
    try:
        value, kind = made[name](*values)
    except TypeError as e:
        raise ValueError(f"{name}() takes other arguments") from e
    return rows, value, kind


# -- the operators ------------------------------------------------------------------


def evaluate(nodes: DataFrame, expression: str, namespaces: dict[str, str] | None = None, origins: DataFrame | None = None) -> DataFrame:
    """(doc, part, origin, ord, kind, pre, value): the result of an expression on every part, or on every node of `origins` (doc, part, pre).

    `origin` is the node that the expression starts at (the root element of a
    part, 0, unless origins are given) and `ord` counts its results in document
    order. `kind` is element, attribute, text, number, string or boolean; `pre`
    is the element, or the one that has the attribute or text; elements have no
    `value`, all else has one, as text.
    """
    tree = _Reader(expression, namespaces or NAMESPACES).whole()
    nodes = nodes.where("pre is not null")
    start = nodes.where("depth = 0") if origins is None else nodes.join(origins.select("doc", "part", "pre").distinct(), ["doc", "part", "pre"])
    start = start.select("doc", "part", F.col("pre").alias("origin"), *_NODE)
    if _is_path(tree):
        found = reduce(DataFrame.unionByName, [_walk(nodes, start, t) for t in (tree[1] if tree[0] == "union" else [tree])])
        if tree[0] == "union":
            found = found.dropDuplicates([*_KEY, "kind", "pre", "at"])
        order = Window.partitionBy(*_KEY).orderBy("at")
        return found.select(*_KEY, (F.row_number().over(order) - 1).alias("ord"), "kind", "pre", "value")
    if _nested(tree):
        start = start.withColumn("_position", F.lit(1)).withColumn("_last", F.lit(1))
    rows, value, kind = _value(nodes, start, tree)
    return rows.select(*_KEY, F.lit(0).alias("ord"), F.lit(kind).alias("kind"), "pre", _string(value, kind).alias("value"))


def find_all(nodes: DataFrame, expression: str, namespaces: dict[str, str] | None = None, origins: DataFrame | None = None) -> DataFrame:
    """The nodes that an expression reaches, with all their columns, `origin` and `ord`; attributes and texts are passed over."""
    found = evaluate(nodes, expression, namespaces, origins).where("kind = 'element'").select(*_KEY, "ord", "pre")
    return found.join(nodes, ["doc", "part", "pre"])


def find(nodes: DataFrame, expression: str, namespaces: dict[str, str] | None = None, origins: DataFrame | None = None) -> DataFrame:
    """The first of find_all() from each origin."""
    found = find_all(nodes, expression, namespaces, origins)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*_KEY).orderBy("ord"))).where("_n = 1").drop("_n")

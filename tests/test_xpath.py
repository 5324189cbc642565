import random
import xml.etree.ElementTree as ET

import pytest

from foliospark.operators import xpath as X
from foliospark.sources import packages as P

HP = "{http://www.hancom.co.kr/hwpml/2011/paragraph}"
SPACES = {"hp": P.NAMESPACES["hp"]}


def tree(seed, size=60):
    """A random part: names a, b, c with attributes, texts and tails."""
    rng = random.Random(seed)
    root = ET.Element(HP + "a")
    made = [root]
    for i in range(size):
        up = rng.choice(made[-12:])
        e = ET.SubElement(up, HP + rng.choice("abc"), {k: str(rng.randint(0, 3)) for k in "xy" if rng.random() < 0.5})
        e.text = rng.choice([None, f"t{rng.randint(0, 3)}", " s  p "])
        e.tail = rng.choice([None, None, f"u{i}"])
        made.append(e)
    return root


class Part:
    """A part in memory, with what plain loops need."""

    def __init__(self, root):
        self.root, self.all = root, list(root.iter())
        self.pre = {e: i for i, e in enumerate(self.all)}
        self.up = {c: e for e in self.all for c in e}

    def above(self, e):
        while e in self.up:
            e = self.up[e]
            yield e

    def sibs(self, e):
        return list(self.up[e]) if e in self.up else [e]


@pytest.fixture(scope="module")
def data(spark):
    parts = {f"d{i}": Part(tree(i)) for i in range(6)} | {"one": Part(ET.fromstring(f'<a xmlns="{P.NAMESPACES["hp"]}"/>'))}
    rows = [(d, f"Contents/section{k}.xml", "section", ET.tostring(p.root)) for d, p in parts.items() for k in (0, 1)]
    nodes = P.nodes(spark.createDataFrame(rows, "doc string, path string, kind string, content binary")).cache()
    return parts, nodes


def elements(nodes, expression, **more):
    got = {}
    for r in sorted(X.evaluate(nodes, expression, **more).collect(), key=lambda r: (r.doc, r.part, r.origin, r.ord)):
        assert r.kind == "element" and r.value is None
        got.setdefault((r.doc, r.part), []).append(r.pre)
    return got


def values(nodes, expression, **more):
    got = {}
    for r in sorted(X.evaluate(nodes, expression, **more).collect(), key=lambda r: (r.doc, r.part, r.origin, r.ord)):
        got.setdefault((r.doc, r.part), []).append(r.value)
    return got


def by_part(parts, f):
    return {(d, f"Contents/section{k}.xml"): out for d, p in parts.items() for k in (0, 1) if (out := f(p))}


@pytest.mark.parametrize("expression", ["./hp:a", "hp:b/hp:c", ".//hp:b", ".//hp:a/hp:b", ".//hp:b[1]", ".//hp:c[last()]", ".//hp:a[@x]", ".//hp:b[@x='1']", ".//hp:b[hp:c]", ".//hp:c/..", "./*", ".//*", ".//hp:a[2]/hp:b[@y]"])
def test_paths_as_in_the_standard_library(data, expression):
    parts, nodes = data
    assert elements(nodes, expression) == by_part(parts, lambda p: sorted({p.pre[e] for e in p.root.findall(expression, SPACES)}))


def is_(*names):
    return lambda e: e.tag in [HP + n for n in names]


BRUTE = {
    "//hp:b/ancestor::hp:a": lambda p: [a for a in p.all if is_("a")(a) and any(is_("b")(e) for e in a.iter() if e is not a)],
    ".//hp:c/ancestor::hp:a[1]": lambda p: {next(a for a in p.above(e) if is_("a")(a)) for e in p.all if is_("c")(e) and any(is_("a")(a) for a in p.above(e))},
    ".//hp:c/ancestor-or-self::*[2]": lambda p: {next(p.above(e)) for e in p.all if is_("c")(e)},
    ".//hp:b/following-sibling::hp:c": lambda p: {s for e in p.all if is_("b")(e) and e in p.up for s in p.sibs(e)[p.sibs(e).index(e) + 1 :] if is_("c")(s)},
    ".//hp:b/following-sibling::hp:b[1]": lambda p: {n[0] for e in p.all if is_("b")(e) and e in p.up if (n := [s for s in p.sibs(e)[p.sibs(e).index(e) + 1 :] if is_("b")(s)])},
    ".//hp:a/preceding-sibling::*[2]": lambda p: {n[1] for e in p.all if is_("a")(e) and e in p.up if len(n := p.sibs(e)[: p.sibs(e).index(e)][::-1]) > 1},
    ".//hp:b/preceding-sibling::hp:c[1]": lambda p: {n[0] for e in p.all if is_("b")(e) and e in p.up if (n := [s for s in p.sibs(e)[: p.sibs(e).index(e)][::-1] if is_("c")(s)])},
    ".//hp:c/preceding-sibling::hp:a": lambda p: {s for e in p.all if is_("c")(e) and e in p.up for s in p.sibs(e)[: p.sibs(e).index(e)] if is_("a")(s)},
    "./hp:b/following::hp:a": lambda p: {a for e in p.root if is_("b")(e) for a in p.all[p.pre[e] + len(list(e.iter())) :] if is_("a")(a)},
    "./*[last()]/preceding::hp:c": lambda p: {c for e in list(p.root)[-1:] for c in p.all if is_("c")(c) and p.pre[c] < p.pre[e] and c not in list(p.above(e))},
    ".//hp:a | .//hp:c[@y]": lambda p: [e for e in p.all[1:] if is_("a")(e) or is_("c")(e) and "y" in e.attrib],
    ".//hp:a[count(*) > 1 and not(hp:b)]": lambda p: [e for e in p.all[1:] if is_("a")(e) and len(e) > 1 and not any(map(is_("b"), e))],
    ".//hp:a[.//hp:c[@x='2'] or @y = 3]": lambda p: [e for e in p.all[1:] if is_("a")(e) and (any(is_("c")(c) and c.get("x") == "2" for c in list(e.iter())[1:]) or e.get("y") == "3")],
    ".//*[text()='t1']": lambda p: [e for e in p.all[1:] if "t1" in [e.text, *(c.tail for c in e)]],
    ".//*[hp:b/@x >= 2]": lambda p: [e for e in p.all[1:] if any(is_("b")(c) and int(c.get("x", -1)) >= 2 for c in e)],
    ".//*[contains(., 't2')]": lambda p: [e for e in p.all[1:] if "t2" in "".join(e.itertext())],
    ".//*[normalize-space(text()) = 's p']": lambda p: [e for e in p.all[1:] if " ".join(next((t for t in [e.text, *(c.tail for c in e)] if t), "").split()) == "s p"],
    ".//*[position() = 2 and local-name() = 'b']": lambda p: [e for e in p.all[1:] if is_("b")(e) and p.sibs(e).index(e) == 1],
    ".//*[position() = last() - 1]": lambda p: [e for e in p.all[1:] if len(p.sibs(e)) > 1 and p.sibs(e)[-2] is e],
    ".//hp:b[2][@x]": lambda p: [e for e in p.all[1:] if is_("b")(e) and [s for s in p.sibs(e) if is_("b")(s)].index(e) == 1 and "x" in e.attrib],
    ".//hp:b[@x][2]": lambda p: [e for e in p.all[1:] if is_("b")(e) and "x" in e.attrib and [s for s in p.sibs(e) if is_("b")(s) and "x" in s.attrib].index(e) == 1],
    ".//*[name() = 'hp:c' and string-length(@y) = 1]": lambda p: [e for e in p.all[1:] if is_("c")(e) and "y" in e.attrib],
    "descendant::hp:c[3]": lambda p: [e for e in p.all[1:] if is_("c")(e)][2:3],
    "(.//hp:a)": lambda p: [e for e in p.all[1:] if is_("a")(e)],
    ".//hp:a[@x != @y]": lambda p: [e for e in p.all[1:] if is_("a")(e) and {"x", "y"} <= set(e.attrib) and e.get("x") != e.get("y")],
    ".//hp:c[parent::hp:b[ancestor::hp:a]]": lambda p: [e for e in p.all[1:] if is_("c")(e) and is_("b")(p.up[e]) and any(map(is_("a"), p.above(p.up[e])))],
    "//hp:a[starts-with(@x, '1') and boolean(@y)]": lambda p: [e for e in p.all if is_("a")(e) and e.get("x") == "1" and "y" in e.attrib],
    "/hp:a/hp:b": lambda p: [e for e in p.root if is_("b")(e)],
    "/*": lambda p: [p.root],
}


@pytest.mark.parametrize("expression", BRUTE)
def test_paths_by_plain_loops(data, expression):
    parts, nodes = data
    want = by_part(parts, lambda p: sorted(p.pre[e] for e in BRUTE[expression](p)))
    assert elements(nodes, expression) == want and (want or expression == ".//hp:a/preceding-sibling::*[2]")


def test_attributes_texts_and_values(data):
    parts, nodes = data
    assert values(nodes, ".//hp:b/@x") == by_part(parts, lambda p: [e.get("x") for e in p.all[1:] if is_("b")(e) and "x" in e.attrib])
    assert values(nodes, ".//@y") == by_part(parts, lambda p: [e.get("y") for e in p.all if "y" in e.attrib])
    assert values(nodes, ".//hp:c/@*") == by_part(parts, lambda p: [v for e in p.all[1:] if is_("c")(e) for _, v in sorted(e.attrib.items())])
    assert values(nodes, ".//text()") == by_part(parts, lambda p: [t for t in p.root.itertext() if t])
    assert values(nodes, "./hp:b/text()") == by_part(parts, lambda p: [t for e in p.root if is_("b")(e) for t in [e.text, *(c.tail for c in e)] if t])
    assert values(nodes, "count(.//hp:b)") == by_part(parts, lambda p: [str(sum(map(is_("b"), p.all[1:])))])
    assert values(nodes, "string(.//hp:b[1]/@x)") == by_part(parts, lambda p: [next((e.get("x") for e in p.all[1:] if is_("b")(e) and e is next(filter(is_("b"), p.sibs(e))) and "x" in e.attrib), "")])
    assert set(values(nodes, "not(.//hp:nothing)")[("one", "Contents/section0.xml")]) == {"true"}
    assert values(nodes, "concat('n', count(*), 1.5)")[("one", "Contents/section0.xml")] == ["n01.5"]
    assert values(nodes, ".//hp:nothing") == {} and values(nodes, "..") == {}


def test_from_nodes(data):
    """From every c, each with its own results."""
    parts, nodes = data
    origins = nodes.where("local = 'c'")
    got = {(r.doc, r.part, r.origin, r.pre) for r in X.evaluate(nodes, "./hp:b | ../hp:a[1]", origins=origins).collect()}
    want = set()
    for d, p in parts.items():
        for e in filter(is_("c"), p.all):
            hits = [c for c in e if is_("b")(c)] + [s for s in p.sibs(e) if is_("a")(s)][:1]
            want |= {(d, f"Contents/section{k}.xml", p.pre[e], p.pre[h]) for k in (0, 1) for h in hits}
    assert got == want
    first = {(r.doc, r.part): (r.pre, r.local) for r in X.find(nodes, ".//hp:b").collect()}
    assert first == {(d, f"Contents/section{k}.xml"): (min(p.pre[e] for e in p.all[1:] if is_("b")(e)), "b") for d, p in parts.items() for k in (0, 1) if any(map(is_("b"), p.all[1:]))}
    assert X.find_all(nodes, ".//@x").count() == 0


@pytest.mark.parametrize("bad", ["", "a[", "//", "foo(1)", "zz:a", "a//", "a[1", "a b", "bad::a", "count(1)", "hp:a/@x/hp:b", ".//hp:a[/hp:b]", "'open", "following::hp:a[1]", "contains('a')", "/"])
def test_bad_expressions(data, bad):
    with pytest.raises(ValueError):
        X.evaluate(data[1], bad)

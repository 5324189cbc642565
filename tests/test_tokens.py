import struct

import pytest
from pyspark.sql import functions as F

from foliospark.sources import binary as B

T = B.TAGS


def control(code, name):
    return struct.pack("<8H", code, *struct.unpack("<2H", name[::-1].encode("latin-1")), 0, 0, 0, 0, code)


END = struct.pack("<8H", 4, 0, 0, 0, 0, 0, 0, 4)


def units(text):
    return text.encode("utf-16-le")


def plain(raw):
    """The same by one unit after another."""
    u = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
    out, text, i = [], [], 0

    def close():
        if text:
            out.append(("text", struct.pack(f"<{len(text)}H", *text).decode("utf-16-le", "ignore")))
            text.clear()

    while i < len(u):
        if u[i] >= 32 or u[i] in (9, 10, 13):
            text.append(u[i])
        if u[i] < 32 and i + 7 < len(u) and not any(u[i + 3 : i + 7]):
            close()
            name = struct.pack("<2H", *u[i + 1 : i + 3])[::-1].decode("latin-1")
            out.append(("end", None) if name == "\0" * 4 else ("control", name))
            i += 8
        else:
            i += 1
    close()
    return out


TEXTS = [
    b"", units("a\r"), control(11, "tbl ") + units("\r"), units("x") + control(3, "%hlk") + units("shown") + END + units("y\r"), control(3, "%for") + units("a") + control(3, "%mai") + units("b") + END + units("c") + END + units("\r"),
    units("tab\tline\nend\r"), struct.pack("<3H", 5, 6, 7) + units("stray"), control(9, "\0\0\0\0") + units("z"), control(11, "gso ") * 3, control(11, "gso ")[:10], units("\U0001f600") + b"\x00\xd8" + units("k"), units("odd")[:-1], struct.pack("<8H", 2, 1, 1, 1, 0, 0, 0, 2) + units("no control"), control(0x0D, "bokm") + units("w"),
]


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for d in "ab":
        ord_ = 0
        for t in TEXTS:
            out.append((d, "BodyText/Section0", 0, ord_, T["para_header"], 0, b"\0" * 24))
            out.append((d, "BodyText/Section0", 0, ord_ + 1, T["para_text"], 1, t))
            ord_ += 2
    return spark.createDataFrame(out, "doc string, stream string, section_index int, ord int, tag_id int, level int, payload binary").cache()


def test_tokens_by_units(rows):
    got = {}
    for r in B.text_tokens(rows).where("doc = 'b'").orderBy("paragraph", "token").collect():
        got.setdefault(r.paragraph, []).append((r.kind, r.control_id if r.kind == "control" else r.text))
        assert (r.units == 8) == (r.kind != "text") or r.kind == "text"
    assert got == {i: want for i, t in enumerate(TEXTS) if (want := plain(t))}


def test_controls_and_fields(spark, rows):
    tokens = B.text_tokens(rows).cache()
    records = [("a", 0, 2, 100, "tbl "), ("a", 0, 8, 200, "gso "), ("a", 0, 8, 201, "tbl "), ("a", 0, 8, 202, "gso "), ("a", 0, 4, 300, "%mai"), ("b", 0, 4, 300, "%for"), ("b", 0, 4, 301, "%mai")]
    found = spark.createDataFrame(records, "doc string, section_index int, paragraph long, ord int, control_id string")
    got = {(r.doc, r.paragraph, r.token): r.ord for r in B.inline_controls(tokens, found).collect()}
    assert (got["a", 2, 0], got["b", 2, 0]) == (100, None)
    assert [got["a", 8, i] for i in range(3)] == [200, 202, None]
    assert (got["a", 4, 0], got["a", 4, 2]) == (None, 300) and (got["b", 4, 0], got["b", 4, 2]) == (300, 301)
    shown = {(r.paragraph, r.token): r.text for r in B.shown_texts(tokens).where("doc = 'a'").collect()}
    assert shown == {(3, 1): "shown", (4, 0): "ac", (4, 2): "b"}
    assert B.text_tokens(rows.where(F.lit(False))).count() == 0


def test_diffs_keep_documents_apart(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc string, path string, logical binary")
    before = make([(d, p, b"x") for d in "ab" for p in ("one", "two")] + [("gone", "one", b"x")])
    after = make([("a", "one", b"y"), ("a", "two", b"x"), ("b", "one", b"x"), ("b", "three", b"x"), ("new", "one", b"x")])
    got = {(r.doc, r.path, r.status) for r in B.stream_diff(before, after).collect()}
    assert got == {("a", "one", "changed"), ("b", "two", "removed"), ("b", "three", "added"), ("gone", "one", "removed"), ("new", "one", "added")}
    rec = lambda rows: spark.createDataFrame(rows, "doc string, stream string, ord int, tag_id int, level int, payload binary, ancestors array<int>")
    x = rec([(d, "s", i, T["shape_component"] if i == 0 else 5, min(i, 1), b"p", [0] if i else []) for d in "ab" for i in range(3)])
    y = x.withColumn("payload", F.when((F.col("doc") == "b") & (F.col("ord") == 2), F.lit(b"q")).otherwise(F.col("payload")))
    assert [(r.doc, r.ord) for r in B.record_diff(x, y).collect()] == [("b", 2)]
    assert [(r.doc, r.at) for r in B.subtree_diff(x, y).collect()] == [("b", 2)]
    lay = lambda rows: spark.createDataFrame(rows, "doc string, path string, kind string, start int, size int")
    assert [(r.doc, r.path) for r in B.layout_diff(lay([("a", "p", "s", 1, 2), ("b", "p", "s", 1, 2)]), lay([("a", "p", "s", 1, 2), ("b", "p", "s", 3, 2)])).collect()] == [("b", "p")]

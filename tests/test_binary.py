import random
import struct

import pytest
from fixtures import T, compound_file, docinfo, picture, section, table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from foliospark.sources import binary as B
from foliospark.sources import compound


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.dictionaries(st.text("abcXYZ0", min_size=1, max_size=8).map(lambda s: "S" + s), st.binary(max_size=9000), max_size=12))
def test_compound_round_trip(streams):
    streams = {k.lower() if i % 2 else f"Dir/{k.lower()}": v for i, (k, v) in enumerate(streams.items())}
    assert compound.Reader(compound.write(streams)).streams() == streams


def test_large_compound():
    streams = {"big": random.Random(1).randbytes(9_000_000), "small": b"x"}
    assert compound.Reader(compound.write(streams)).streams() == streams


@pytest.mark.parametrize("raw", [b"", b"\xd0\xcf\x11\xe0", compound.MAGIC + b"\0" * 504, compound.MAGIC + b"\xff" * 2000])
def test_broken_compound(raw):
    with pytest.raises((compound.CompoundError, struct.error)):
        compound.Reader(raw)


def load(spark, **files):
    found = B.streams(spark.createDataFrame(list(files.items()), "doc string, content binary")).cache()
    return found, B.records(found).cache()


@pytest.fixture(scope="module")
def good(spark):
    return load(spark, a=compound_file(), plain=compound_file(compressed=False))


def test_header(good):
    h = {r.doc: r for r in B.file_header(good[0]).collect()}
    assert (h["a"].signature, h["a"].version, h["a"].compressed, h["plain"].compressed) == ("HWP Document File", "5.1.0.1", True, False)


def test_tree_and_text(good):
    rows = good[1].where("doc = 'a' and section_index = 0").orderBy("ord").collect()
    for r in rows:
        want = max((q.ord for q in rows if q.ord < r.ord and q.level < r.level), default=None)
        assert r.parent == want
        after = [q.ord for q in rows if q.ord > r.ord and q.level <= r.level]
        assert r.end == (min(after) - 1 if after else len(rows) - 1)
    texts = {(r.doc, r.section_index, r.paragraph): r for r in B.paragraphs(good[1]).collect()}
    assert texts["a", 0, 0].text == "hello\r" and texts["a", 0, 2].text == "ab\U0001f600" and texts["a", 0, 2].raw_text != texts["a", 0, 2].text and texts["a", 0, 3].text == "cell"
    assert {r.doc: r.text for r in B.document_text(B.paragraphs(good[1])).collect()} == {d: "hello\nwo\nrld\nab\U0001f600\ncell\nsecond" for d in ("a", "plain")}


def test_controls_and_docinfo(good):
    c = B.controls(good[1]).where("doc = 'a'").cache()
    assert sorted((r.section_index, r.paragraph, r.kind) for r in c.collect()) == [(0, 2, "table"), (0, 4, "picture"), (1, 1, "line")]
    assert B.select(c, "pictures").count() == 1 and B.select(c, "shapes").count() == 1 and B.select(c, "lines").count() == 1 and B.select(c, "fields").count() == 0
    r = good[1].where("doc = 'a'")
    assert B.id_mappings(r).first().counts["para_shapes"] == 1
    assert B.document_properties(r).first().section_count == 2
    d = B.bin_data(r).first()
    assert (d.kind, d.storage_id, d.extension, d.abs_path) == (1, 1, "png", None)
    s = B.styles(r).first()
    assert (s.name, s.english_name, s.type, s.lang_id, s.para_shape_id, s.char_shape_id) == ("바탕글", "Normal", "PARA", 1042, 3, 4)
    f = B.face_names(r).first()
    assert (f.name, f.has_substitute, f.has_default) == ("Font", True, False)
    got = B.counts(r).first()
    assert got.control_counts == {"tbl ": 1, "gso ": 2} and got.tag_counts[T["table"]] == 1


def test_lint(spark, good):
    assert B.lint(*good).collect() == []
    bad = {
        "docinfo_mapping": compound_file(docinfo=docinfo(shapes=0)), "binary_closure": compound_file(**{"BinData/BIN0009.png": b"x"}), "docinfo_reference": compound_file(sections=[section(["x"]).replace(struct.pack("<IIHBB", 2, 0, 0, 0, 0), struct.pack("<IIHBB", 2, 0, 9, 8, 0))]),
        "payload_sanity": compound_file(sections=[picture(size=10)]), "control_subtree": compound_file(sections=[section(["x"], B.record_bytes(T["ctrl_header"], 1, b" lbt"))]), "binary_media_type": compound_file(**{"BinData/BIN0001.png": b"", "BinData/BIN0001.gif": b"y"}),
    }
    got = {(r.doc, r.kind) for r in B.lint(*load(spark, **bad)).collect()}
    assert {(k, k) for k in bad if k != "binary_media_type"} <= got


def test_truncated_and_wide(spark):
    raw = B.record_bytes(1, 0, b"x" * 5000) + B.record_bytes(2, 1, b"abc")[:-1]
    assert [(r[1], r[3], r[4]) for r in B.parse_records(raw)] == [(1, 5000, 8)]
    assert [r[1] for r in B.parse_records(raw, strict=False)] == [1, 2]
    found = B.streams(spark.createDataFrame([("bad", b"nothing"), ("none", None)], "doc string, content binary"))
    assert found.where("error is not null").count() == 2 and B.records(found).count() == 0


def test_many_sections_sort_as_text(spark):
    _, rows = load(spark, m=compound_file(sections=[section([str(i)]) for i in range(12)]))
    order = {r.stream: r.section_index for r in rows.where("section_index is not null").select("stream", "section_index").distinct().collect()}
    assert order["BodyText/Section10"] == 2 and order["BodyText/Section2"] == 4


def test_rebuild_and_diff(spark, good):
    found, rows = good
    new = B.encode(rows).unionByName(found.where("path not like 'BodyText/%' and path <> 'DocInfo'").select("doc", "path", "logical"))
    again, rows2 = load(spark, **{r.doc: bytes(r.content) for r in B.rebuild(new).collect()})
    a, b = (x.where("doc = 'a'") for x in (found, again))
    assert B.stream_diff(a, b).count() == 0
    other, rows3 = load(spark, a=compound_file(sections=[section(["hello", "changed"], table("cell"))]))
    assert {(r.path, r.status) for r in B.stream_diff(a, other).collect()} == {("BodyText/Section0", "changed"), ("BodyText/Section1", "removed")}
    diff = B.record_diff(rows.where("doc = 'a'"), rows3).where("stream = 'BodyText/Section0'").collect()
    assert min(r.ord for r in diff) == 2
    assert [r.doc for r in B.best_donor(B.counts(rows.unionByName(rows3.withColumn("doc", __import__("pyspark.sql.functions").sql.functions.lit("z")))), 2).collect()] == ["a", "plain"]

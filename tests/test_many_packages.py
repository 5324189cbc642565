"""Edits of many small packages: a part or package must cost its rows, not a table of its own."""

import time

import pytest
from fixtures import package
from pyspark.sql import functions as F

from foliospark.operators import edits as E
from foliospark.operators import nodes as N
from foliospark.sources import packages as P

DOCS, SECONDS = 400, 25


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("many") / "nodes")
    files = spark.range(DOCS).select(F.concat(F.lit("d"), "id").alias("doc"), F.lit(package()).alias("content"))
    P.nodes(P.parts(P.entries(files))).where("pre is not null").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def quick():
    began = time.monotonic()
    yield
    assert time.monotonic() - began < SECONDS


def test_metadata(nodes, quick):
    found = N.metadata(E.set_metadata(nodes, title="new title", keyword="some words")).select("title", "language", "keyword").collect()
    assert [tuple(r) for r in found] == [("new title", "ko", "some words")] * DOCS


def test_text(nodes, quick):
    found = N.paragraph_text(E.set_paragraph_text(nodes, 0, 0, "set")).where("section_index = 0 and paragraph < 2").groupBy("paragraph", "text").count().orderBy("paragraph").collect()
    assert [(r.paragraph, r["count"]) for r in found] == [(0, DOCS), (1, DOCS)] and found[0].text.endswith("set")


def written(edited):
    return P.parts(P.entries(P.assemble(P.serialize(edited).select("doc", F.lit(0).alias("entry_ord"), "path", "content"))))


def test_paragraphs(nodes, quick):
    edited = E.insert_paragraph(E.move_paragraph(nodes, 0, 0, 1 << 20), 0, 0, "begun")
    again = P.nodes(written(edited))
    texts = N.paragraph_text(again).where("section_index = 0").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("paragraph", "text"))).alias("p"))
    found = texts.select(F.transform("p", lambda x: x.text).alias("p")).collect()
    assert len(found) == DOCS and all((r.p[0], r.p[-1]) == ("begun", "Title") for r in found)


def test_sections(nodes, quick):
    again = P.nodes(written(E.add_section(nodes, 0)))
    found = again.where("section_index is not null and depth = 0").groupBy("doc").agg(F.sort_array(F.collect_list("section_index")).alias("s")).collect()
    assert [r.s for r in found] == [[0, 10, 11]] * DOCS

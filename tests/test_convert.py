import json

from fixtures import compound_file, package
from pyspark.sql import functions as F

from foliospark.operators import contract, convert
from foliospark.operators import nodes as N
from foliospark.operators import validate as V
from foliospark.sources import binary as B
from foliospark.sources import packages as P


def test_formats_agree(spark, tmp_path):
    def table(df):
        """Written and read again, as one would between steps."""
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    records = table(B.records(B.streams(spark.createDataFrame([("a", compound_file())], "doc string, content binary"))))
    blocks = table(convert.binary_blocks(records))
    assert [(r.section_index, r.kind) for r in blocks.orderBy("section_index", "ord").collect()] == [(0, "paragraph")] * 3 + [(0, "table"), (0, "paragraph"), (0, "picture"), (1, "paragraph"), (1, "paragraph"), (1, "shape")]
    made = convert.to_packages(blocks, blocks.select("doc", F.lit("T & t").alias("title")).distinct())
    parts = table(P.parts(P.entries(made)))
    nodes = table(P.nodes(parts))
    assert V.validate(parts, nodes, "basic").count() == 0
    texts = [r.text for r in N.paragraph_text(nodes).orderBy("section_index", "paragraph").collect()]
    # Controls stand in paragraphs of their own.
    assert [x for x in texts if x] == ["hello", "wo\nrld", "ab\U0001f600", "second"]
    assert {"table", "picture", "shape"} <= {r.kind for r in N.blocks(nodes).collect()}
    assert N.metadata(nodes).first().title == "T & t"
    again = table(B.records(B.streams(convert.to_binary(table(N.blocks(nodes))))))
    assert B.document_text(B.paragraphs(again)).first().text == "hello\nwo\nrld\nab\U0001f600\nsecond"
    script = convert.scripts(blocks).first().script
    compile(script, "s", "exec")
    assert script.splitlines()[1] == "doc.append('paragraph', 'hello', section=0)"


def test_kinds(spark):
    got = spark.createDataFrame([(" Para ",), ("hidden comment",), ("table",), ("IMG",)], "k string").select(convert.canonical_kind(F.col("k")).alias("k")).collect()
    assert [r.k for r in got] == ["paragraph", "memo", "table", "picture"]


def test_contract(spark, tmp_path):
    samples = [{"category": "text", "path": "a", "format": "hwpx", "expected_title": "My title", "expected_texts": ["Title"], "required_features": ["table"], "min_sections": 2}, {"category": "form", "path": "gone", "format": "hwpx", "expected_texts": [], "required_features": ["form"]}]
    (tmp_path / "c.json").write_text(json.dumps({"corpus_samples": samples}, indent=1))
    P.parts(P.entries(spark.createDataFrame([("a", package())], "doc string, content binary"))).write.parquet(str(tmp_path / "parts"))
    parts = spark.read.parquet(str(tmp_path / "parts"))
    P.nodes(parts).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    sections = P.sections(parts).groupBy("doc").agg(F.count("*").cast("int").alias("sections"))
    docs = N.metadata(nodes).join(N.document_text(nodes), "doc").join(sections, "doc").join(N.features(nodes), "doc").withColumnRenamed("doc", "path")
    results = contract.check_samples(contract.read_contract(spark, str(tmp_path / "c.json")), docs).cache()
    assert {r.path: r.ok for r in results.collect()} == {"a": True, "gone": False}
    r = contract.report(results, ["text", "form", "table"]).first()
    assert (r.samples, r.failures, r.covered, r.missing) == (2, 1, ["form", "text"], ["table"])
    metrics = spark.createDataFrame([("failures", 1.0), ("cases", 80.0)], "metric string, value double")
    got = {g.metric: g.ok for g in contract.gate(metrics, {"failures": (None, 0.0), "cases": (72.0, None), "none": (None, 1.0)}).collect()}
    assert got == {"failures": False, "cases": True, "none": False}

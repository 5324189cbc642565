from fixtures import compound_file, picture, section, table

from foliospark.operators import profiles as F_
from foliospark.sources import binary as B

FEATURES = {"table": "tbl ", "picture": "gso "}


def load(spark, **files):
    streams = B.streams(spark.createDataFrame(list(files.items()), "doc string, content binary")).cache()
    return streams, B.records(streams).cache()


def test_profile_from_a_collection(spark, tmp_path):
    both = compound_file(sections=[section(["only text"]), section(["first", "second"], table("cell") + picture() + table("more"))])
    apart = compound_file(sections=[section(["x"], table("t")), section(["y"], picture())])
    streams, records = load(spark, both=both, apart=apart, plain=compound_file(sections=[section(["nothing"])]))
    profile = F_.build(streams, records, FEATURES)
    got = {r.feature: r for r in profile.collect()}
    assert sorted(got) == ["base", "picture", "table"] and (got["base"].doc, got["base"].section_index, got["base"].target) == ("both", 1, True)
    assert bytes(got["base"].records[1].payload).decode("utf-16-le") == "first\r" and [r.ord for r in got["base"].records] == [0, 1]
    # Equal paragraphs: the first section, then the first record, decides.
    assert (got["table"].doc, got["table"].section_index, got["picture"].doc, got["picture"].section_index) == ("apart", 0, "both", 1) or (got["picture"].doc, got["picture"].section_index) == ("apart", 1)
    F_.save(profile, str(tmp_path / "p"))
    again = F_.load(spark, str(tmp_path / "p"))
    key = lambda r: r.feature
    assert sorted(again.collect(), key=key) == sorted(profile.collect(), key=key)
    grown = B.records(B.encode(F_.append_feature(records, again, "table")))
    n = len(got["table"].records)
    count = lambda df: {(r.doc, r.stream): r["count"] for r in df.groupBy("doc", "stream").count().collect()}
    was, now = count(records), count(grown)
    assert {k for k in was if now[k] != was[k]} == {("both", "BodyText/Section1"), ("apart", "BodyText/Section1")} and all(now[k] - was[k] == n for k in was if now[k] != was[k])


def test_no_donor(spark):
    streams, records = load(spark, apart=compound_file(sections=[section(["x"], table("t")), section(["y"], picture())]))
    assert F_.build(streams, records, FEATURES).count() == 0
    (only,) = F_.build(streams, records, {}).collect()
    assert (only.feature, only.doc, only.section_index) == ("base", "apart", 0)
    assert {r.feature for r in F_.build(streams, records, {"table": "tbl "}).collect()} == {"base", "table"}

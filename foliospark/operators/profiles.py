"""Profiles: from a collection of binary documents, a donor and the smallest example of each feature, kept as a table.

A profile is rows (feature, doc, section_index, records): for each feature the
paragraph that shows it best, and as `base` the first paragraph of the section
of the donor that holds all features. It is written and read as JSON, and its
paragraphs can be appended to other documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.numbers import control_id
from foliospark.operators import relational as R
from foliospark.sources import binary as B

#: Features that a profile has unless others are asked for, by the id of their control.
FEATURES = {"table": "tbl ", "picture": "gso ", "hyperlink": "%hlk"}
SCHEMA = "feature string, doc string, section_index int, target boolean, records array<struct<ord:int,tag_id:int,level:int,payload:binary>>"
_PLACE = ["doc", "section_index", "start", "end"]


def occurrences(records: DataFrame, features: dict[str, str]) -> DataFrame:
    """(feature, doc, section_index, ord, level, start, end): controls of the features, with the records of their top-level paragraphs."""
    body = records.where("section_index is not null")
    name = F.create_map(*[F.lit(x) for f, c in features.items() for x in (c, f)]).cast("map<string,string>")[control_id(F.col("payload"))]
    found = body.where(B.tag("ctrl_header")).withColumn("feature", name).where("feature is not null")
    tops = body.where(B.tag("para_header") & (F.col("level") == 0)).select("doc", "section_index", F.col("ord").alias("start"), "end")
    return found.withColumn("start", F.get("ancestors", F.lit(0))).drop("end").join(tops, ["doc", "section_index", "start"]).select("feature", "doc", "section_index", "ord", "level", "start", "end")


def best_sources(found: DataFrame) -> DataFrame:
    """The occurrence of each feature in the shortest paragraph, then of the lowest level, the first section and record, and the first document."""
    key = F.struct((F.col("end") - F.col("start")).alias("length"), "level", "section_index", "ord", "doc", "start", "end")
    return found.groupBy("feature").agg(F.min(key).alias("b")).select("feature", "b.doc", "b.section_index", "b.ord", "b.level", "b.start", "b.end")


def donor(streams: DataFrame, found: DataFrame, features: dict[str, str]) -> DataFrame:
    """(doc, section_index): the document with most controls of the features, in their order, then by name, of those that have all of them in one section; and its largest such section.

    Without features it is section 0 of the first document.
    """
    if not features:
        return streams.agg(F.min("doc").alias("doc")).where("doc is not null").select("doc", F.lit(0).alias("section_index"))
    n = [F.count_if(F.col("feature") == f).alias(f"n{i}") for i, f in enumerate(features)]
    sections = found.groupBy("doc", "section_index").agg(F.count_distinct("feature").alias("kinds"))
    whole = sections.where(F.col("kinds") == len(features)).select("doc", "section_index")
    best = R.top_k(found.groupBy("doc").agg(*n).join(whole.select("doc").distinct(), "doc", "left_semi"), [], [*[F.desc(f"n{i}") for i in range(len(features))], F.col("doc")], 1)
    number = F.regexp_extract("path", r"^BodyText/Section(\d+)$", 1).try_cast("int")
    sizes = streams.select("doc", number.alias("section_index"), F.octet_length("logical").alias("size")).where("section_index is not null")
    return whole.join(best.select("doc"), "doc").join(sizes, ["doc", "section_index"]).groupBy("doc").agg(F.max_by("section_index", F.struct("size", -F.col("section_index"))).alias("section_index"))


def build(streams: DataFrame, records: DataFrame, features: dict[str, str] | None = None) -> DataFrame:
    """(feature, doc, section_index, target, records) of a profile; empty where no document has all features in one section.

    Features that no document has are left out. Sections are numbered as their
    streams are. A row's records are one paragraph's.
    """
    features = FEATURES if features is None else features
    found = occurrences(records, features)
    base = donor(streams, found, features).select(F.lit("base").alias("feature"), "doc", "section_index", F.lit(True).alias("target"))
    body = records.where("section_index is not null")
    first = body.where(B.tag("para_header") & (F.col("level") == 0)).groupBy("doc", "section_index").agg(F.min_by(F.struct(F.col("ord").alias("start"), "end"), "ord").alias("f"))
    base = base.join(first, ["doc", "section_index"]).select("feature", "target", "doc", "section_index", "f.start", "f.end")
    rows = base.unionByName(best_sources(found).select("feature", F.lit(False).alias("target"), *_PLACE))
    own = body.select("doc", "section_index", "ord", "tag_id", "level", "payload", F.coalesce(F.get("ancestors", F.lit(0)), F.col("ord")).alias("start"))
    held = own.join(rows.drop("end"), ["doc", "section_index", "start"]).groupBy("feature", "doc", "section_index", "target").agg(F.array_sort(F.collect_list(F.struct((F.col("ord") - F.col("start")).cast("int").alias("ord"), "tag_id", "level", "payload"))).alias("records"))
    # Without a donor there is no profile.
    known = held.agg(F.max("target").alias("_whole")).where("_whole")
    return held.join(F.broadcast(known)).drop("_whole")


def save(profile: DataFrame, folder: str) -> None:
    """Write a profile as JSON; payloads are base64."""
    text = F.transform("records", lambda r: F.struct(r.ord.alias("ord"), r.tag_id.alias("tag_id"), r.level.alias("level"), F.base64(r.payload).alias("payload")))
    profile.withColumn("records", text).coalesce(1).write.mode("overwrite").json(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA.replace("payload:binary", "payload:string")).json(folder)
    return rows.withColumn("records", F.transform("records", lambda r: F.struct(r.ord.alias("ord"), r.tag_id.alias("tag_id"), r.level.alias("level"), F.unbase64(r.payload).alias("payload"))))


def append_feature(records: DataFrame, profile: DataFrame, feature: str) -> DataFrame:
    """(doc, stream, ord, tag_id, level, payload): documents with the feature's paragraph after the last record of the profile's section; documents without that section stay as they are."""
    target = profile.where("target").select("section_index")
    template = profile.where(F.col("feature") == feature).select(F.explode("records").alias("r")).select(F.col("r.ord").alias("at"), "r.tag_id", "r.level", "r.payload")
    ends = records.groupBy("doc", "stream", "section_index").agg((F.max("ord") + 1).alias("n")).join(F.broadcast(target), "section_index")
    # A profile is a handful of paragraphs, whatever the collection.
    new = ends.join(F.broadcast(template)).select("doc", "stream", (F.col("n") + F.col("at")).cast("int").alias("ord"), "tag_id", "level", "payload")
    return records.select("doc", "stream", "ord", "tag_id", "level", "payload").unionByName(new)

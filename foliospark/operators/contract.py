"""Corpus contracts: what samples must hold, checked against documents, and gates over the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "category string, path string, format string, expected_title string, expected_texts array<string>, required_features array<string>, min_sections int"


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a contract in JSON, a row each."""
    rows = spark.read.schema(f"required_corpus_categories array<string>, corpus_samples array<struct<{SAMPLE.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", "true").json(path)
    return rows.select(F.explode("corpus_samples").alias("s")).select("s.*")


def check_samples(samples: DataFrame, documents: DataFrame) -> DataFrame:
    """Each sample with what it lacks. `documents` has (path, title, text, sections, features); a missing one lacks all."""
    d = documents.select("path", F.col("title").alias("_title"), "text", "sections", "features")
    rows = samples.join(d, "path", "left")
    none = F.array().cast("array<string>")
    texts = F.filter(F.coalesce("expected_texts", none), lambda x: ~F.coalesce(F.contains(F.col("text"), x), F.lit(False)))
    features = F.array_except(F.coalesce("required_features", none), F.coalesce("features", none))
    title = F.col("expected_title").isNotNull() & ~F.col("expected_title").eqNullSafe(F.col("_title"))
    few = F.coalesce(F.col("sections"), F.lit(0)) < F.coalesce(F.col("min_sections"), F.lit(0))
    out = rows.select("category", "path", F.col("text").isNull().alias("missing"), texts.alias("missing_texts"), features.alias("missing_features"), title.alias("wrong_title"), few.alias("too_few_sections"))
    ok = ~(F.col("missing") | F.col("wrong_title") | F.col("too_few_sections")) & (F.size("missing_texts") == 0) & (F.size("missing_features") == 0)
    return out.withColumn("ok", ok)


def report(results: DataFrame, categories: list[str]) -> DataFrame:
    """One row: samples, failures, categories covered and missing."""
    covered = F.sort_array(F.collect_set("category"))
    rows = results.agg(F.count("*").alias("samples"), F.count_if(~F.col("ok")).alias("failures"), covered.alias("covered"))
    return rows.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>"), F.col("covered"))))


def gate(metrics: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(metric, value, ok) of metrics (metric, value) against (least, most); a metric not there fails."""
    spark = metrics.sparkSession
    want = spark.createDataFrame([(m, lo, hi) for m, (lo, hi) in limits.items()], "metric string, least double, most double")
    rows = F.broadcast(want).join(metrics.select("metric", F.col("value").cast("double").alias("value")), "metric", "left")
    ok = F.col("value").isNotNull() & (F.col("least").isNull() | (F.col("value") >= F.col("least"))) & (F.col("most").isNull() | (F.col("value") <= F.col("most")))
    return rows.select("metric", "value", ok.alias("ok"))

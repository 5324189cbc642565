"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by a key (the hash of their text, so equal texts are
neighbours). A size-weighted sample of keys gives quantile boundaries; records
are range-partitioned by them; a range that holds more than its share, such as
one text with a third of all rows, is subdivided by a second hash. Exact byte
and row totals of the ranges then give every record its global offset, and so
its shard: equal slices of the total size, cut at the nearest record.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def weigh(text: Column, base: int = 8) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(base).cast("long")


def _constant(values, kind: str) -> Column:
    """A constant array, by one literal however long it is; of no values, an empty one."""
    values = list(values)
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def splitters(keys: DataFrame, ranges: int, total: int, per_range: int = 64) -> list[int]:
    """Quantile boundaries of `_key` from a size-weighted sample.

    A record is sampled with a probability proportional to its size, decided by
    a hash of the record and its place in the input. The sample has about
    `per_range` keys a range; only the boundaries reach the driver.
    """
    if ranges < 2:
        return []
    draw = F.pmod(F.xxhash64(F.lit("draw"), "_tie", "_row"), F.lit(1 << 32)).cast("double") / float(1 << 32)
    sample = keys.where(draw < F.col("_size") * (per_range * ranges / max(1, total)))
    marks = _constant([i / ranges for i in range(1, ranges)], "double")
    found = sample.agg(F.percentile_approx("_key", marks, 20 * ranges).alias("q")).first()[0]
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Index of the range of `key`: the boundaries below or at it, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    found = _constant(bounds, "long")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(found, at + step - 1) <= key, at + step).otherwise(at))


def shard(docs: DataFrame, shards: int = 24, text: str = "text", ident: str = "doc_id", range_rows: int = 100_000, most_ranges: int = 16_384) -> DataFrame:
    """Every row of `docs` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in its shard).

    Law `bytes`: shards differ in size by no more than about one record. Equal
    rows are interchangeable. A null text weighs the base size; a null ident
    is ordered first; an empty table gives an empty result; fewer records than
    shards leave shards empty. Columns: ident, size, text_crc32, law, shard,
    slot. Other columns of `docs` are not read.

    Ranges hold about `range_rows` rows, more where there would be over
    `most_ranges` of them: a range is sorted by one task, which spills, and
    only so many boundaries and totals pass through the driver. How ranges fall
    decides about the order of equal keys at most.
    """
    keys = docs.select(
        F.col(ident).alias("_id"),
        weigh(F.col(text)).alias("_size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("_crc"),
        F.xxhash64(F.col(text)).alias("_key"),
        F.xxhash64(F.col(ident), F.col(text)).alias("_tie"),
        F.monotonically_increasing_id().alias("_row"),
    )
    keys = scratch.cut(keys, "keys")
    n, total = keys.agg(F.count("*"), F.sum("_size")).first()
    total = total or 0
    ranges = min(most_ranges, max(8, math.ceil(n / range_rows)))
    placed = keys.withColumn("_range", range_of(F.col("_key"), splitters(keys, ranges, total)))
    # Overfull ranges are subdivided by the second hash, into as many parts as they hold shares.
    sums = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    share = max(1, math.ceil(1.5 * n / ranges))
    parts = {r._range: -(-r._n // share) for r in sums.where(F.col("_n") > share).collect()}
    part = F.coalesce(F.get(_constant([parts.get(r, 1) for r in range(max(parts) + 1)], "long"), F.col("_range")), F.lit(1)) if parts else F.lit(1)
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("_tie", "_row"), part.cast("long")).cast("int"))
    here = Window.partitionBy("_range", "_part").orderBy("_key", "_tie")
    within = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a range, bounded by the number of ranges: its totals become offsets.
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range", "_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows")).select(
        "_range", "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_from"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first")
    )
    ordered = placed.select("*", F.sum("_size").over(within).alias("_upto"), F.row_number().over(here).alias("_nth")).join(offsets, ["_range", "_part"])
    middle = F.col("_from") + F.col("_upto") - F.col("_size") / 2
    dealt = ordered.select(
        "_id", "_size", "_crc", (F.col("_first") + F.col("_nth") - 1).cast("long").alias("_rank"),
        F.least(F.lit(shards - 1), F.floor(middle * shards / max(1, total))).cast("int").alias("shard"),
    )
    dealt = scratch.cut(dealt, "dealt")
    firsts = dealt.groupBy("shard").agg(F.min("_rank").alias("_base"))
    return dealt.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(ident), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_base")).alias("slot")
    )

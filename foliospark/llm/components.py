"""Connected components by alternating large-star and small-star rounds.

(Kiveris et al., "Connected Components in MapReduce and Beyond".) Every round
is two group-bys on a table of edges that never grows; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller and own) neighbours of every node to its least neighbour.

    The least neighbour comes from an aggregate joined back, never from a
    gathered list, so a node with very many links stays many rows.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(`node`, `component`) of every node of the edges (a, b): the least node it can reach.

    Self-links and nulls are ignored, repeated links count once; no edges give
    no rows. Raises if `rounds` do not suffice.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.cut(now, "links")
    seen = None
    for _ in range(rounds):
        now = scratch.cut(_star(_star(now, large=True), large=False), "links")
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"no fixed point after {rounds} rounds")

"""Mixing sources to target weights by entropy balancing.

Document rates start from one copy each and are tilted as little as possible
(in relative entropy) so that every source's expected words meet its target.
The optimum is an exponential tilt, rate = cap * e / (cap - 1 + e) with
e = exp(multiplier of the source * relative size of the document); the
multipliers solve the convex dual by Newton steps whose sums are grouped
aggregates. Rates are then rounded into whole copies.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: dict, weights=WEIGHTS, cap: float = 3.0) -> dict:
    """Words each source gives: shares by weight, at most cap times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = float(sum(sizes.values())), {}, list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def _rate(x, cap: float):
    """Rate at the tilt x: 1 at 0, between 0 and cap."""
    return F.lit(cap) / (1 + (cap - 1) * F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def multipliers(spread: DataFrame, wanted: dict, known: dict, cap: float, steps: int = 80) -> dict:
    """Solve the dual for every source at once; one grouped aggregate a Newton step.

    `spread` has (s, size, n): how many documents of a source have a size;
    `known` has (words, documents) of a source. A step that leaves the bracket
    of the root is replaced by its middle.
    """
    spark = spread.sparkSession
    low, high, at = {}, {}, {}
    for s, t in wanted.items():
        at[s] = 0.0 if 0 < t < cap * known[s][0] * (1 - 1e-12) else math.inf if t > 0 else -math.inf
    todo = {s for s in at if at[s] == 0}
    for _ in range(steps):
        if not todo:
            break
        now = spark.createDataFrame([(s, at[s], known[s][0] / known[s][1]) for s in sorted(todo)], "s int, at double, mean double")
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("at") * x, cap)
        # Decimal sums don't depend on the order of rows, as sums of doubles do: reruns agree to the last bit.
        total = lambda v: F.sum(v.cast("decimal(38,10)")).cast("double")
        sums = spread.join(F.broadcast(now), "s").groupBy("s").agg(
            total(F.col("n") * F.col("size") * r).alias("f"), total(F.col("n") * F.col("size") * x * r * (1 - r / cap)).alias("g")
        )
        for row in sums.collect():
            s, gap = row.s, row.f - wanted[row.s]
            if abs(gap) <= 1e-9 * wanted[s]:
                todo.discard(s)
                continue
            (high if gap > 0 else low)[s] = at[s]
            step = at[s] - gap / row.g if row.g > 0 else math.nan
            if s in low and s in high:
                at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
                if high[s] - low[s] < 1e-13 * max(1, abs(at[s])):
                    todo.discard(s)
            else:
                reach = max(1.0, 2 * abs(at[s]))
                at[s] -= math.copysign(min(reach, abs(step - at[s])) if math.isfinite(step) else reach, gap)
    return at


def _choices(words, rows, most: int):
    """Rows (words, record, record) of no, one or two of the records `rows`; -1 where there is none."""
    none = np.full(len(rows), -1)
    out = [[[0, -1, -1]], np.stack([words[rows], rows, none], 1)]
    if most > 1:
        a, b = np.triu_indices(len(rows), 1)
        out.append(np.stack([words[rows[a]] + words[rows[b]], rows[a], rows[b]], 1))
    return np.concatenate(out).astype(np.int64)


def _fill(pdf):
    """Of the records at the cut, in their order, take those that still fit, then the one that ends nearest."""
    pdf = pdf.sort_values(["p", "h"], kind="stable")
    left, took, sizes = pdf["need"].iloc[0], [False] * len(pdf), pdf["words"].tolist()
    for i, w in enumerate(sizes):
        if w <= left:
            took[i] = True
            left -= w
    rest = [i for i, t in enumerate(took) if not t]
    if rest and abs(left - sizes[best := min(rest, key=lambda i: (abs(left - sizes[i]), i))]) < left:
        took[best] = True
        left -= sizes[best]
    # Exchange up to two taken for up to two untaken records, those that end nearest, while that helps.
    words, taken = np.array(sizes), np.array(took)
    for most in (1, 2):
        for _ in range(16):
            outs, ins = _choices(words, np.flatnonzero(taken), most), _choices(words, np.flatnonzero(~taken), most)
            outs = outs[np.argsort(outs[:, 0], kind="stable")]
            at = np.searchsorted(outs[:, 0], ins[:, 0] - left)
            at = np.stack([np.maximum(0, at - 1), np.minimum(at, len(outs) - 1)])
            ends = np.abs(left - ins[:, 0] + outs[at, 0])
            side, i = np.unravel_index(int(ends.argmin()), ends.shape)
            if ends[side, i] >= abs(left) - 1e-6:
                break
            gone, come = outs[at[side, i]], ins[i]
            taken[gone[1:][gone[1:] >= 0]], taken[come[1:][come[1:] >= 0]] = False, True
            left += gone[0] - come[0]
    took = taken.tolist()
    return pdf.loc[took, ["s", "h"]]


def mix(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", weights=WEIGHTS, cap: int = 3, bin_rows: int = 1024, most_sources: int = 100_000) -> DataFrame:
    """Every row of `docs` with the copies the mix takes of it.

    Columns: all of `docs`' ident, `size` (words), `source_size`, `target` (of
    its source), `rate` (tilted, 0 to cap), `copies`, `taken` (copies * size).
    Nulls: a null text has no words, a null source is a source of its own and
    comes last, a null ident is a record like any other. Rows equal in ident
    and text are taken alike. An empty table gives an empty result. A few
    numbers a source reach the driver and are broadcast, so more than
    `most_sources` raise: group hosts into sources first. Different sizes of a
    source are aggregated; rows never reach the driver.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    base = scratch.cut(docs.select(F.col(ident).alias("_id"), F.col(source).alias("_source"), words.alias("size"), F.xxhash64(F.col(ident), F.col(text)).alias("h")), "sizes")
    known = {r[0]: (r[1], r[2]) for r in base.groupBy("_source").agg(F.sum("size"), F.count("*")).limit(most_sources + 1).collect()}
    if len(known) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    wanted = targets({k: v[0] for k, v in known.items()}, weights, cap)
    names = list(known)
    facts = [(i, k, known[k][0], float(wanted[k]), known[k][0] / known[k][1]) for i, k in enumerate(names)]
    facts = F.broadcast(spark.createDataFrame(facts, "s int, _source string, source_size long, target double, mean double"))
    rows = base.join(facts, base["_source"].eqNullSafe(facts["_source"])).drop("_source")
    spread = scratch.cut(rows.where("size > 0").groupBy("s", "size").agg(F.count("*").alias("n")), "spread")
    at = multipliers(spread, {i: wanted[k] for i, k in enumerate(names)}, {i: known[k] for i, k in enumerate(names)}, cap)
    tilt = F.broadcast(spark.createDataFrame([(s, v, max(1, -(-known[names[s]][1] // bin_rows))) for s, v in at.items()], "s int, at double, bins int"))
    rate = F.when(F.col("at") == math.inf, F.lit(float(cap))).when(F.col("at") == -math.inf, F.lit(0.0)).otherwise(_rate(F.col("at") * F.col("size") / F.greatest("mean", F.lit(1e-9)), cap))
    u = F.pmod(F.xxhash64(F.lit("round"), "h"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    frac = F.col("rate") - F.col("whole")
    # Below one half with the probability of the fraction: the expected cut of the order is at one half.
    p = F.when(F.col("u") < frac, F.col("u") / frac / 2).otherwise(0.5 + (F.col("u") - frac) / (1 - frac) / 2)
    rows = rows.join(tilt, "s").withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int")).withColumn("u", u).withColumn("p", p)
    rows = scratch.cut(rows.withColumn("bin", F.least(F.col("bins") - 1, F.floor(F.col("p") * F.col("bins"))).cast("int")).drop("u", "bins", "at", "mean"), "rates")
    may = (F.col("whole") < cap) & (F.col("size") > 0)
    # Words still to take of a source go to whole bins in order, and to records of the bin at the cut.
    need = rows.groupBy("s").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    upto = Window.partitionBy("s").orderBy("bin")
    bins = rows.where(may).groupBy("s", "bin").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    bins = bins.join(F.broadcast(need), "s")
    bins = scratch.cut(bins.select("s", "bin", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), (F.col("upto") <= F.col("need")).alias("full")), "bins")
    cuts = bins.where(~F.col("full") & (F.col("need") > 0)).groupBy("s").agg(F.min("bin").alias("bin"), F.max("need").alias("need"))
    at_cut = rows.where(may).join(F.broadcast(cuts), ["s", "bin"]).groupBy("s", "h", "p", "need").agg(F.sum("size").alias("words"))
    filled = at_cut.groupBy("s").applyInPandas(_fill, "s int, h long").withColumn("fills", F.lit(1))
    fulls = cuts.select("s", F.col("bin").alias("cut"))
    lasts = need.select("s", F.col("need").alias("_need"))
    out = rows.join(F.broadcast(fulls), "s", "left").join(F.broadcast(lasts), "s").join(filled, ["s", "h"], "left")
    more = F.when(~may | (F.col("_need") <= 0), 0).when(F.col("cut").isNull() | (F.col("bin") < F.col("cut")), 1).when(F.col("bin") == F.col("cut"), F.coalesce("fills", F.lit(0))).otherwise(0)
    copies = (F.col("whole") + more).cast("int")
    return out.select(F.col("_id").alias(ident), F.col("h").alias("row_hash"), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeat(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """The rows of `docs` as many times as mix() takes them, with all their columns."""
    taken = mix(docs, text, ident, source, weights, cap).where("copies > 0").groupBy(F.col("row_hash").alias("_h")).agg(F.max("copies").alias("_copies"))
    # The columns of `docs` are in one struct, so that none can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(ident), F.col(text)).alias("_h")).join(taken, "_h")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), "_copies")).alias("copy"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])

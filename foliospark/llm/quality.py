"""Quality classifier by hierarchical empirical Bayes.

Two pieces of evidence come from a document itself: a logistic regression on
the make-up of its text (is it well-formed?) and words that mark unwanted
texts. A site says more: the mean evidence of its host and path, shrunk
towards the global mean, the more so the fewer documents it has; the strength
of the shrinkage is estimated from the spread of all sites. A document's
log-odds are its own plus those by which its path departs from the whole.

Only the document model is fitted on a sample: at most `sample` labelled
documents, the first by a hash of their id. The sites' statistics are grouped
aggregates over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACED, flat, hashes, mix, pieces, powers, prefix, spans

#: Labelled documents used to fit, at most.
SAMPLE = 8000
#: Bytes of the beginnings of longer words that can be marks as well, for words that vary by ending.
STEMS = (4, 5, 6, 7, 8)
#: Site tables up to this many rows are broadcast; larger ones are joined by shuffle.
SITES = 50_000

_CLASSES = np.zeros(256, np.int64)
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 4
for _i, _c in enumerate(b" \n.,!?|*#$%&-_<>/:;\"'@"):
    _CLASSES[_c] = 5 + _i
_N_CLASSES = 27
FEATURES = _N_CLASSES + 4


def describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each document, and the hash, beginnings (a row for each of STEMS) and document of each of its words (stripped of edge marks)."""
    n = len(offsets) - 1
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc_of * _N_CLASSES + _CLASSES[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    size = np.maximum(counts.sum(axis=1), 1)
    low, starts, ends, doc = spans(data, offsets, SPACED)
    h = hashes(low, starts, ends)
    words = np.bincount(doc, minlength=n)
    alike = np.zeros(len(h), bool)
    alike[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n)
    lengths = np.bincount(doc, ends - starts, minlength=n)
    some = np.maximum(words, 1)
    features = np.column_stack([np.sqrt(counts / size[:, None]), np.log1p(words), np.bincount(doc, alike, minlength=n) / some, np.log(some / np.maximum(distinct, 1)), lengths / some])
    return features, *_bare(low, starts, ends), doc


def _bare(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words without ASCII marks at their edges, and of their beginnings; 0 where there is none."""
    solid = np.isin(_CLASSES[low], (1, 2, 3, 4)) & (low != 0)
    at = np.flatnonzero(solid)
    out, stems = np.zeros(len(starts), np.uint64), np.zeros((len(STEMS), len(starts)), np.uint64)
    if not len(at):
        return out, stems
    first = at[np.minimum(np.searchsorted(at, starts), len(at) - 1)]
    last = at[np.maximum(np.searchsorted(at, ends) - 1, 0)] + 1
    fine = (first >= starts) & (last <= ends) & (first < last)
    p, inverse = prefix(low), powers(len(low) + 1)[1]
    part = lambda i, j: mix((p[j] - p[i]) * inverse[i])
    out[fine] = part(first[fine], last[fine])
    for k, size in enumerate(STEMS):
        long = np.flatnonzero(fine & (last - first > size))
        stems[k, long] = mix(part(first[long], first[long] + size) + np.uint64(size))
    return out, stems


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last of the constant) by Newton steps; of one class only, a constant of its smoothed log-odds."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not 0 < y.sum() < len(y):
        return w
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    form: np.ndarray  # weights of the features
    marks: np.ndarray  # sorted word hashes
    odds: np.ndarray  # their log-odds
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of beginnings
    stem_odds: np.ndarray = field(default_factory=lambda: np.zeros(0))  # their log-odds
    marked: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -5.0]))  # weights of a document's marks and stems, constant

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each document to be well-formed, and to be unwanted."""
        features, h, stems, doc = describe(data, offsets)
        form = _sigmoid((features - self.mean) / self.scale @ self.form[:-1] + self.form[-1])
        best = np.zeros(len(h))
        for row in stems:
            np.maximum(best, _looked_up(self.stems, self.stem_odds, row), out=best)
        return form, _sigmoid(self.sums(h, best, doc, len(offsets) - 1) @ self.marked[:-1] + self.marked[-1])

    def sums(self, h: np.ndarray, best: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of the marks in each document, each place counted, to a limit; and those of the stems (the best of a word), for its length."""
        marks = np.minimum(np.bincount(doc, _looked_up(self.marks, self.odds, h), minlength=n), 12.0)
        return np.column_stack([marks, np.bincount(doc, best, minlength=n) / np.sqrt(np.bincount(doc, minlength=n) + 20.0)])


def _looked_up(table: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The value of each hash in a sorted table, 0 where it isn't."""
    if not len(table):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, values[at], 0.0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text, quality, toxic to: features, words and their contexts, a document a row; with the first of a piece, its distinct words and their beginnings."""
    for batch in batches:
        data, offsets = flat(batch.column(0))
        for i, j in pieces(offsets):
            x, h, stems, doc = describe(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            around = np.zeros(len(h) + 2, np.uint64)
            around[1:-1] = h
            context = mix(mix(around[:-2] + np.uint64(3) * around[2:]) + h)
            cuts = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v.view(np.int64))) for v in (h, context)]
            keys, at = np.unique(h, return_index=True)
            whole = pa.array(np.where(np.arange(j - i + 1) > 0, len(keys), 0).astype(np.int32))
            lists += [pa.ListArray.from_arrays(whole, pa.array(v.view(np.int64))) for v in (keys, *(row[at] for row in stems))]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64())), *lists], ["quality", "toxic", "x", "words", "contexts", "keys", *_STEM_NAMES])


_STEM_NAMES = [f"stem{k}" for k in STEMS]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", sample: int = SAMPLE, prior: float = 4.0, least: float = 0.8) -> Model:
    """Fit on at most `sample` labelled documents. Labels: ident, quality and toxic (0 or 1); nulls are left out.

    A word marks unwanted texts if it stands there in at least 5 different
    contexts and in most of all it has; contexts rather than documents are
    counted, so copies of one text count once. So does a beginning of words,
    with the contexts of all words that have it. What is kept is bounded by the
    sample. Of documents of one id the first by text is taken.
    """
    from . import scratch

    known = labels.where(F.col(ident).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(ident).alias("_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")).select("_text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    rows = scratch.cut(rows.mapInArrow(_sampled, "quality int, toxic int, x array<double>, words array<long>, contexts array<long>, keys array<long>, " + ", ".join(f"{c} array<long>" for c in _STEM_NAMES)), "sample")
    table = rows.select("quality", "toxic", "x").toArrow()
    y, t = (np.array(table[c].to_numpy(), np.float64) for c in ("quality", "toxic"))
    x = np.array(table["x"].combine_chunks().flatten() if len(table) else [], np.float64).reshape(-1, FEATURES)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    form = logistic((x - mean) / scale, y) if len(x) else np.append(np.zeros(FEATURES), 4.0)
    seen = rows.select("toxic", F.explode(F.arrays_zip("words", "contexts")).alias("w")).select("toxic", "w.words", "w.contexts")
    seen = seen.groupBy("contexts", "words").agg(F.max("toxic").alias("toxic"))
    whole = seen.agg(F.avg("toxic")).first()[0] or 0.0
    of_word = seen.where("words <> 0").groupBy("words").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))

    def best(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Those of (words, a, n) that are marks: sorted hashes and log-odds."""
        share = (F.col("a") + prior * whole) / (F.col("n") + prior)
        found = counts.select("words", "a", share.alias("p")).where((F.col("a") >= 5) & (F.col("p") >= max(least, 2 * whole)))
        found = found.toArrow()
        h, p = found["words"].to_numpy().astype(np.int64).view(np.uint64), np.clip(found["p"].to_numpy().astype(np.float64), 1e-6, 1 - 1e-6)
        order = np.argsort(h)
        return h[order], (np.log(p / (1 - p)) - math.log(max(whole, 1e-6)) if len(p) else p)[order]

    stems = rows.select(F.explode(F.arrays_zip("keys", *_STEM_NAMES)).alias("k")).select("k.*").distinct()
    stems = scratch.cut(stems.select("keys", F.explode(F.array_remove(F.array(*_STEM_NAMES), 0)).alias("stem")), "stems")
    of_stem = stems.join(of_word, F.col("keys") == F.col("words")).groupBy(F.col("stem").alias("words")).agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    model = Model(mean, scale, form, *best(of_word), *best(of_stem))
    if len(model.marks) + len(model.stems) and 0 < t.sum() < len(t):
        # The sample's words that have marked beginnings, with the best of these.
        table = docs.sparkSession.createDataFrame(list(zip(model.stems.view(np.int64).tolist(), model.stem_odds.tolist(), strict=True)), "stem long, odds double")
        having = stems.join(F.broadcast(table), "stem").groupBy("keys").agg(F.max("odds").alias("odds")).toArrow()
        order = np.argsort(having["keys"].to_numpy().view(np.uint64))
        shared = docs.sparkSession.sparkContext.broadcast((model, having["keys"].to_numpy().view(np.uint64)[order], having["odds"].to_numpy()[order]))

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, keys, odds = shared.value
            for b in batches:
                lists = b.column(1)
                words = lists.flatten().to_numpy().view(np.uint64)
                doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                sums = known.sums(words, _looked_up(keys, odds, words), doc, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["toxic", "s", "r"])

        got = rows.select("toxic", "words").mapInArrow(marked, "toxic int, s double, r double").toArrow()
        sums = np.column_stack([got[c].to_numpy().astype(np.float64) for c in ("s", "r")])
        model.marked = logistic(sums, got["toxic"].to_numpy().astype(np.float64), ridge=0.1)
    else:
        model.marked = np.array([0.0, 0.0, math.log((t.sum() + 0.5) / (len(t) - t.sum() + 0.5)) if len(t) else -4.0])
    return model


def _evidence(docs: DataFrame, model: Model, text: str, names: list[str], **more) -> DataFrame:
    """`row` (the columns `names` as the struct `kept`, and `more`), with the probabilities `form` and `marked`. The text is read once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inside = text in names
    packed = docs.select(F.struct(F.struct(*names).alias("kept"), *[c.alias(k) for k, c in more.items()]).alias("row"), *([] if inside else [F.col(text).alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0).field("kept").field(names.index(text)) if inside else batch.column(1))
            got = [shared.value.evidence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets)]
            form, marked = (np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form), pa.array(marked)], ["row", "form", "marked"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, form double, marked double")


def sites(evidence: DataFrame) -> DataFrame:
    """(host, path, host_rate, path_rate, global_rate) from `host`, `path` and the evidence `p` of all documents.

    Rates are posterior means: a path's is shrunk to its host's, a host's to
    the global one, with strengths from the moments of the groups' means.
    """
    paths = evidence.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    from . import scratch

    paths = scratch.cut(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))

    def strength(means, rate: float) -> float:
        """Documents that the prior counts for: what is left of the variance between groups beyond chance."""
        r = means.select(F.col("s").alias("s"), F.col("n").alias("n")).where("n > 1").agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - rate, F.lit(2))), F.sum(F.pow("n", F.lit(2)))).first()
        n, k, between, squares = r
        if not n or k < 2 or not 0 < rate < 1:
            return 100.0
        chance = rate * (1 - rate)
        spread = max(0.0, (between - (k - 1) * chance) / max(1e-9, n - squares / n))
        return float(min(1e6, max(1.0, chance / max(spread, 1e-9) - 1)))

    total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    rate = (total[0] or 0.0) / total[1] if total[1] else 0.5
    th, tp = strength(hosts.select(F.col("hs").alias("s"), F.col("hn").alias("n")), rate), strength(paths, rate)
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("hs") + th * rate) / (F.col("hn") + th)).alias("host_rate"))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"]))
    return joined.select("host", "path", "host_rate", ((F.col("s") + tp * F.col("host_rate")) / (F.col("n") + tp)).alias("path_rate"), F.lit(float(rate)).alias("global_rate"))


def classify(docs: DataFrame, labels: DataFrame, host, path, text: str = "text", ident: str = "doc_id", keep: list[str] | None = None, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The columns `keep` (all) of `docs` with form, marked, host_rate, path_rate, posterior and `accepted`.

    `host` and `path` are column expressions; nulls are sites of their own. A
    null text is empty. Without labels nothing is known and all is accepted.
    Columns of these names in `docs` are replaced.
    """
    added = ("form", "marked", "host_rate", "path_rate", "posterior", "accepted")
    names = [c for c in keep or docs.columns if c not in added]
    model = fit(docs, labels, text, ident, sample)
    p = F.col("form") * (1 - F.col("marked"))
    from . import scratch

    # The text is scored once; the sites' statistics and the result read what was written.
    scored = scratch.cut(_evidence(docs, model, text, names, host=host, path=path), "scored")
    narrow = scored.select("row.host", "row.path", p.alias("p"))
    table = scratch.cut(sites(narrow), "sites").withColumnsRenamed({"host": "_host", "path": "_path"})
    if table.count() <= SITES:
        table = F.broadcast(table)
    scored = scored.join(table, F.col("row.host").eqNullSafe(F.col("_host")) & F.col("row.path").eqNullSafe(F.col("_path")), "left")
    logit = lambda x: F.log(F.greatest(x, F.lit(1e-9)) / F.greatest(1 - x, F.lit(1e-9)))
    odds = logit(p) + logit(F.col("path_rate")) - logit(F.col("global_rate"))
    posterior = 1 / (1 + F.exp(-odds))
    return scored.select(*[F.col("row")["kept"][c].alias(c) for c in names], "form", "marked", "host_rate", "path_rate", posterior.alias("posterior"), (posterior >= least).alias("accepted"))

"""Exact repeats of long strings from a logarithmic family of sparse suffix arrays.

The suffixes indexed are those that start at anchors: places whose short string
(gram) has the least hash among all within some window of the wanted length
(winnowing). Anchors depend on content alone, so equal windows have equal
anchors at equal places, and a repeat of that length always shows as two
indexed suffixes with the same first units. An array is kept in the order of
the hash of those first units rather than of the units, which serves merging
and scanning as well and ships 8 bytes instead of 400. With each goes a hash of
its whole context: all units that any window around the anchor can reach.

New batches get an array; an arriving array is merge-scanned against each level
there is, and the suffixes that start alike are recorded; levels of equal size
merge, so each entry is merged a logarithmic number of times. Suffixes with
equal contexts repeat wholly. Where suffixes start alike in different contexts,
one suffix of each context is laid beside the others and every window is
compared. A window holds at least half of what can be reached on the left of
the gram, or more than half on the right, so only contexts that have this half
in common with another are laid beside it: a line that very many texts share
brings none of them together.

Where a text repeats itself at a short period, as `the the the`, each window of
the run is found in the run already. Its span is known at once, and one period
of it is indexed for other texts' sake.

Units are the bytes of a text, or the hashes of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .words import BYTES, SPACED, flat, hashes, mix, pieces, powers, spans

#: Bytes of text for which batches double: their number grows with the logarithm of the input.
BATCH = 1 << 28


@dataclass(frozen=True)
class Unit:
    """What strings are made of, the length that counts as a repeat, and the length of a gram, all in units."""

    words: bool
    length: int
    gram: int

    @property
    def reach(self) -> int:
        """Units on either side of an anchor's gram that windows around it can hold."""
        return self.length - self.gram

    @property
    def half(self) -> int:
        """Windows hold at least so many units before the gram (side 0), or more than `reach - half` after it (side 1)."""
        return self.reach - self.reach // 2

    def arrays(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For pieces of the texts i to j of a string column: their units end to end, and the offsets of the texts in these."""
        data, offsets = flat(column)
        for i, j in pieces(offsets):
            own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if self.words:
                low, starts, ends, doc = spans(own, off, SPACED)
                own, off = hashes(low, starts, ends), np.searchsorted(doc, np.arange(j - i + 1))
            yield i, j, own, off

    def stored(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Units and offsets of a binary column of contexts."""
        data, offsets = flat(column)
        return (data.view(np.uint64), offsets // 8) if self.words else (data, offsets)


def text_bytes(length: int = 400) -> Unit:
    return Unit(False, length, min(64, length))


def text_words(length: int = 51) -> Unit:
    return Unit(True, length, -(-length // 3))


def _sums(units: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of units; length + 1 entries."""
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((BYTES[units] if units.dtype == np.uint8 else units) * powers(len(units))[0], out=out[1:])
    return out


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, in three passes."""
    n = len(x)
    rows = np.full(-(-n // w) * w, ~np.uint64(0), np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _runs(at: np.ndarray, g: np.ndarray, doc: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of the runs in which each window has an equal one a period before or after, from the places of equal grams."""
    step = np.diff(at)
    fine = (g[at[1:]] == g[at[:-1]]) & (step <= unit.gram) & (doc[1:] == doc[:-1])
    new = np.ones(len(step), bool)
    new[1:] = ~fine[1:] | ~fine[:-1] | (step[1:] != step[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(step)) - 1
    begin, end, period = at[first], at[last + 1] + unit.gram, step[first]
    keep = fine[first] & (end - begin >= unit.length + period)
    return begin[keep], end[keep], period[keep]


def anchors(units: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Anchors of texts that lie end to end, and spans of runs that repeat themselves.

    Of anchors: the text, the start in it, hashes of the gram, of the context,
    and of the halves before and after, 0 where the text ends before. Of runs:
    the text, and where in it they begin and end. The anchor of a window is its
    least gram; of several, the first unless that is at the window's very
    start, else the last.
    """
    n, w, none = len(units), unit.reach + 1, np.zeros(0, np.int64)
    if n < unit.length:
        return (none, none, *[none.astype(np.uint64)] * 4), (none,) * 3
    p, inverse = _sums(units), powers(n + 1)[1]
    g = mix((p[unit.gram :] - p[: -unit.gram]) * inverse[: n - unit.gram + 1])
    place, low = np.arange(len(g), dtype=np.uint64), np.uint64((1 << 31) - 1)
    high = g & ~low
    first = (_slide(high | place, w) & low).astype(np.int64)
    last = (low - (_slide(high | (low - place), w) & low)).astype(np.int64)
    start = np.arange(len(first))
    # Windows that reach into the next text choose no anchor.
    live = start + unit.length <= np.repeat(offsets[1:], np.diff(offsets))[: len(first)]
    own = (none,) * 3
    tied = live & (first != last)
    if tied.any():
        at = np.unique(np.concatenate((first[tied], last[tied])))
        doc = np.searchsorted(offsets, at, "right") - 1
        begin, end, period = _runs(at, g, doc, unit)
        edge = np.zeros(len(live) + 1, np.int64)
        np.add.at(edge, begin + period, 1)
        np.add.at(edge, end - unit.length + 1, -1)
        live &= np.cumsum(edge[:-1]) == 0
        doc = np.searchsorted(offsets, begin, "right") - 1
        own = doc, begin - offsets[doc], end - offsets[doc]
    chosen = np.zeros(len(g), bool)
    chosen[np.where(first - start >= unit.gram, first, last)[live]] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(offsets, at, "right") - 1
    a, b = np.maximum(at - unit.reach, offsets[doc]), np.minimum(at + unit.length, offsets[doc + 1])
    context = mix((p[b] - p[a]) * inverse[a]) + (at - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b - a).astype(np.uint64)
    halves = []
    for i, j in ((at - unit.half, at + unit.gram), (at, at + unit.gram + unit.reach - unit.half + 1)):
        inside = (i >= offsets[doc]) & (j <= offsets[doc + 1])
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        halves.append(np.where(inside, mix((p[j] - p[i]) * inverse[i]) | np.uint64(1), np.uint64(0)))
    return (doc, at - offsets[doc], g[at], mix(context), *halves), own


def _anchored(unit: Unit):
    """Anchors of each text; a span of its own has no key, and begins `at` and ends `n`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "key", "context", "before", "after", "at", "n"]
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for i, _, units, offsets in unit.arrays(batch.column(1)):
                (doc, at, *hashed), (of, begin, end) = anchors(units, offsets, unit)
                yield pa.RecordBatch.from_arrays([pa.array(rows[doc + i]), *(pa.array(h.view(np.int64)) for h in hashed), pa.array(at.astype(np.int32)), pa.array(np.diff(offsets)[doc].astype(np.int32))], names)
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[of + i]), *[pa.nulls(len(of), pa.int64())] * 4, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names)

    return run


class Family:
    """Levels of sorted (key, context, copies) arrays, and the keys by which an array met itself or another."""

    def __init__(self, space: scratch.Space) -> None:
        self.space = space
        self.levels: list[tuple[int, DataFrame]] = []
        self.met: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """Index a batch of anchored suffixes, scan it against every level, then merge while two levels are of one size."""
        rank, array = 0, self.space.cut(suffixes.groupBy("key", "context").agg(F.count("*").alias("copies")).sortWithinPartitions("key"), "level")
        self.met.append(self.space.cut(array.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key"), "met"))
        for _, level in self.levels:
            self.met.append(self.space.cut(array.select("key").distinct().join(level.select("key"), "key", "left_semi"), "met"))
        while self.levels and self.levels[-1][0] == rank:
            _, older = self.levels.pop()
            both = older.unionByName(array).groupBy("key", "context").agg(F.sum("copies").alias("copies"))
            rank, array = rank + 1, self.space.cut(both.sortWithinPartitions("key"), "level")
        self.levels.append((rank, array))

    def repeats(self) -> DataFrame:
        """(key, context, copies, contexts) of all suffixes that start like another."""
        keys = self.met[0]
        for t in self.met[1:]:
            keys = keys.unionByName(t)
        keys = keys.distinct()
        whole = None
        for _, level in self.levels:
            part = level.join(keys, "key", "left_semi")
            whole = part if whole is None else whole.unionByName(part)
        if len(self.levels) > 1:
            whole = whole.groupBy("key", "context").agg(F.sum("copies").alias("copies"))
        return whole.join(whole.groupBy("key").agg(F.count("*").alias("contexts")), "key")


def _windows(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int):
    """Of contexts laid end to end: hashes of all windows, their context and their start in it."""
    p = _sums(units)
    many = lengths - length + 1
    which = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    a = starts[which] + at
    return (p[a + length] - p[a]) * powers(len(units) + 1)[1][a], which, at


def _spans_of(which: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge windows (sorted by which, begin) that touch: (which, from, to) of each run."""
    if not len(which):
        return which, begin, begin
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (begin[1:] > begin[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(which)) - 1
    return which[first], begin[first], begin[last] + length


def _context(unit: Unit):
    """(row, text, places) to a row for each anchor and side: the units of all windows of that side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, j, units, offsets in unit.arrays(batch.column(1)):
                for k in range(i, j):
                    row, own = batch.column(0)[k].as_py(), units[offsets[k - i] : offsets[k - i + 1]]
                    for s in batch.column(2)[k].as_py():
                        at = s["at"]
                        a, b = (max(0, at - unit.reach), at - unit.half + unit.length) if s["side"] == 0 else (max(0, at - unit.half + 1), at + unit.length)
                        if min(b, len(own)) - a >= unit.length:
                            out.append((s["met"], row, at, a, s["contexts"], own[a:b].tobytes()))
                    if len(out) > 4000:
                        yield pack(out)
                        out = []
            if out:
                yield pack(out)

    def pack(out: list) -> pa.RecordBatch:
        met, row, at, a, contexts, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(a, pa.int32()), pa.array(contexts, pa.int64()), pa.array(b, pa.binary())], ["met", "row", "at", "a", "contexts", "units"])

    return run


def _known(part, unit: Unit) -> tuple[np.ndarray, ...]:
    """Of contexts (met, row, at, a, units): all windows, each known by where contexts met and by where the anchor stands in it; their context; their start in the text."""
    met, at, a = (part.column(i).to_numpy() for i in (0, 2, 3))
    units, offsets = unit.stored(part.column(4))
    h, which, start = _windows(units, offsets[:-1], np.diff(offsets), unit.length)
    back = (at[which] - a[which] - start).astype(np.uint64)
    return mix(h + mix(met.view(np.uint64)[which] + back * np.uint64(0xD6E8FEB86659FD93))), which, a[which] + start


def _compare(unit: Unit, chunk: int = 4096):
    """Contexts sorted by where they meet, all that meet together: spans of windows that another of them has too."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        full, which, begin = _known(t, unit)
        order = np.argsort(full)
        same = full[order][1:] == full[order][:-1]
        again = np.zeros(len(full), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        w, begin, end = _spans_of(which[again], begin[again], unit.length)
        return pa.RecordBatch.from_arrays([pa.array(t.column(1).to_numpy()[w]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["row", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, chunk):
                part = batch.slice(k, chunk)
                held.append(part)
                size += part.num_rows
                keys = part.column(0).to_numpy()
                rest = int((keys == keys[-1]).sum())
                if size >= chunk and rest < part.num_rows:
                    held[-1] = part.slice(0, part.num_rows - rest)
                    yield solve(held)
                    held, size = [part.slice(part.num_rows - rest)], rest
        if held:
            yield solve(held)

    return run


def _exploded(unit: Unit):
    """Contexts of which very many meet: a row for each window, to be counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                full, which, begin = _known(part, unit)
                yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(part.column(1).to_numpy()[which]), pa.array(begin.astype(np.int32))], ["w", "row", "begin"])

    return run


def batches_for(size: int) -> int:
    """Batches for so many bytes of text: 1, and one more for each doubling from BATCH on."""
    return max(1, (size // BATCH).bit_length())


def repeated_spans(docs: DataFrame, unit: Unit, space: scratch.Space, text: str = "text", row: str = "_row", batches: int = 2, hot: int = 4096) -> DataFrame:
    """(`row`, `begin`, `end`), in units: spans that lie in a string of the unit's length found elsewhere too; spans may overlap.

    `row` is a long that names a row; rows of equal name must have equal texts.
    The result reads tables of `space`.
    """
    index = space.cut(docs.select(F.col(row).alias("row"), F.col(text)).mapInArrow(_anchored(unit), "row long, key long, context long, before long, after long, at int, n int"), "anchors")
    family = Family(space)
    for b in range(batches):
        family.add(index.where(F.col("key").isNotNull() & (F.pmod(F.col("row"), F.lit(batches)) == b)).select("key", "context"))
    found = space.cut(index.where("key is not null").join(family.repeats(), ["key", "context"]), "found")
    # Equal contexts: each of their windows is found elsewhere.
    runs = index.where("key is null").select("row", F.col("at").alias("begin"), F.col("n").alias("end"))
    whole = found.where("copies > 1").select("row", F.greatest(F.lit(0), F.col("at") - unit.reach).alias("begin"), F.least("n", F.col("at") + unit.length).alias("end"))
    # Different contexts of one key: one of each, where its half on a side meets that of another, is laid beside the others.
    ones = found.where("contexts > 1").groupBy("key", "context").agg(F.min(F.struct("row", "at", "before", "after")).alias("r")).select("key", "r.*")
    meets = lambda side, h: F.when(F.col(h) != 0, F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), "key", h).alias("met")))
    sides = ones.select("row", "at", F.explode(F.array_compact(F.array(meets(0, "before"), meets(1, "after")))).alias("s")).select("row", "at", "s.*")
    live = sides.join(sides.groupBy("met").agg(F.count("*").alias("contexts")).where("contexts > 1"), "met")
    asked = live.groupBy("row").agg(F.collect_list(F.struct("met", "side", "at", "contexts")).alias("asked"))
    texts = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).join(asked, "row").select("row", "text", "asked")
    beside = space.cut(texts.mapInArrow(_context(unit), "met long, row long, at int, a int, contexts long, units binary"), "contexts")
    shape = ["met", "row", "at", "a", "units"]
    few = beside.where(F.col("contexts") <= hot).select(*shape).repartition("met").sortWithinPartitions("met")
    found_spans = runs.unionByName(whole).unionByName(few.mapInArrow(_compare(unit), "row long, begin int, end int"))
    many = beside.where(F.col("contexts") > hot)
    if not many.isEmpty():
        windows = space.cut(many.select(*shape).mapInArrow(_exploded(unit), "w long, row long, begin int"), "windows")
        again = windows.groupBy("w").agg(F.count("*").alias("k")).where("k > 1").select("w")
        found_spans = found_spans.unionByName(windows.join(again, "w").select("row", "begin", (F.col("begin") + unit.length).alias("end")))
    return found_spans


def _covered(found) -> int:
    """Places under the spans of one text."""
    if not found.is_valid or not len(found):
        return 0
    begin, end = (found.values.field(k).to_numpy() for k in ("begin", "end"))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    return int((end - np.maximum(begin, np.append(begin[:1], end[:-1]))).clip(0).sum())


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, text, spans, word spans) to what is left of each text."""
    for batch in batches:
        data, offsets = flat(batch.column(1))
        found, n_bytes = batch.column(2), np.diff(offsets)
        removed, runs, digests, kept = [], [], [], []
        for i in range(batch.num_rows):
            raw = data[offsets[i] : offsets[i + 1]]
            if found[i].is_valid and len(found[i]):
                values = found[i].values
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, values.field("begin").to_numpy(), 1)
                np.add.at(edge, values.field("end").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                raw = raw[~gone]
            else:
                removed.append(0)
                runs.append(0)
            raw = raw.tobytes()
            kept.append(raw)
            digests.append(hashlib.sha256(raw).hexdigest())
        words = [_covered(x) for x in batch.column(3)]
        columns = [pa.array(n_bytes), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()), pa.array(words, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["keys", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "repeated_words"])


def dedupe(docs: DataFrame, text: str = "text", ident: str = "doc_id", length: int = 400, passage: int = 51, batches: int | None = None, hot: int = 4096) -> DataFrame:
    """Every row of `docs` without the bytes that lie in a `length`-byte string found elsewhere too.

    Columns: ident, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, as
    a cut can part a character), repeated_words (words, lower-cased A-Z, in a
    run of at least `passage` words found elsewhere too; nothing is removed for
    these) and repeats (whether there are any). A null text is empty; a
    repeated row counts as another place, so both lose their bytes; an empty
    table gives an empty result. Of other columns none is read.
    """
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_row", F.xxhash64("text", "id"))
    if batches is None:
        batches = batches_for(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    whole, kinds = None, (text_bytes(length), text_words(passage))
    for unit in kinds:
        # What a unit needs is dropped before the next one starts; only its spans stay.
        with scratch.Space(docs.sparkSession) as space:
            long = rows.where(F.octet_length("text") >= (2 * unit.length - 1 if unit.words else unit.length)).select("_row", "text")
            found = repeated_spans(long, unit, space, batches=batches, hot=hot)
            found = scratch.cut(found.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("words" if unit.words else "spans")), "spans")
        whole = found if whole is None else whole.join(found, "row", "full_outer")
    joined = rows.join(whole, rows["_row"] == whole["row"], "left").select(F.struct("id").alias("keys"), "text", "spans", "words")
    kind = docs.schema[ident].dataType.simpleString()
    out = joined.mapInArrow(_cut_out, f"keys struct<id:{kind}>, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, repeated_words long")
    return out.select(F.col("keys.id").alias(ident), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "repeated_words", (F.col("repeated_words") > 0).alias("repeats"))

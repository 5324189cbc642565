"""Language-model scoring from a log-frequency Bloom filter.

Counts of word n-grams are quantised on a logarithmic scale; an n-gram of
level q is put into the filter q times, as (n-gram, 1) to (n-gram, q). Its level
is read back by probing (n-gram, 1), (n-gram, 2), ... until a probe fails, so an
error can only raise it, and rarely (Talbot and Osborne, 2007).

The filter holds all words and all pairs of adjacent words of the training
documents. It grows with them, so it is never in one place: it is cut into
segments by ranges of the hash, as many as the bytes of the text need, each in
proportion to what is put into it. Documents are taken in chunks; a chunk asks
each segment once for its distinct n-grams and says how often it has them to
learn from. One task per segment adds these counts up, builds the filter,
probes it, and answers each chunk in the order it was asked, so answers carry
no hashes. Then each chunk is scored from its answers. Words are counted by
their whole hashes, pairs by as many bits as the size of the text needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .words import SPACED, flat, hashes, mix, pieces, spans

#: The token after the last word of every text.
END = 0x0E4D
#: Levels are 1 + floor(log2(count) * STEPS).
STEPS = 2
PROBES = 4
#: Tokens of a chunk, unless one document has more.
CHUNK = 1 << 21
#: Bytes of text for which there is one more segment.
SEGMENT = 1 << 23
#: Tasks that segments are dealt to, at most; a task answers one after another.
TASKS = 1 << 14
#: Bits of a pair's hash beyond the logarithm of the bytes of text: two pairs share a hash with a chance of 2**-SPARE.
SPARE = 18


def tokens(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of documents (i, j): hashes of all tokens, ends included, and their document from i."""
    data, offsets = flat(column)
    for i, j in pieces(offsets):
        off = offsets[i : j + 1] - offsets[i]
        low, starts, ends, doc = spans(data[offsets[i] : offsets[j]], off, SPACED)
        h, n = hashes(low, starts, ends), j - i
        sizes = np.bincount(doc, minlength=n)
        out = np.full(len(h) + n, END, np.uint64)
        out[np.arange(len(h)) + doc] = h
        yield i, j, out, np.repeat(np.arange(n), sizes + 1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(c, 1)) * STEPS + 1e-9).astype(np.int64)


def count_of(q: np.ndarray) -> np.ndarray:
    """The middle of a level's counts, on their scale; 0 for level 0."""
    return np.where(q > 0, np.where(q == 1, 1.0, 2.0 ** ((q - 0.5) / STEPS)), 0.0)


def probes(h: np.ndarray, q, bits: int) -> np.ndarray:
    """The bits of (n-gram, level) in its segment, a row a probe."""
    x = mix(h + np.asarray(q, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    y = mix(x) | np.uint64(1)
    return np.stack([((x + np.uint64(i) * y) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)])


@dataclass
class Filter:
    """One segment, a byte a bit while it is in use."""

    table: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, c: np.ndarray, bits_a_gram: int) -> Filter:
        """Of n-grams and their counts; bits in proportion to the insertions, a level each."""
        q = level(c)
        table = np.zeros(max(64, -(-int(q.sum() * bits_a_gram / 2) // 64) * 64), bool)
        live, i = np.arange(len(h)), 1
        while len(live):
            for a in probes(h[live], i, len(table)):
                table[a] = True
            i += 1
            live = live[q[live] >= i]
        return cls(table)

    def levels(self, h: np.ndarray, most: int = 80) -> np.ndarray:
        """Levels of n-grams, by probes until the first that fails."""
        out = np.zeros(len(h), np.int64)
        live = np.arange(len(h))
        for q in range(1, most + 1):
            if not len(live):
                break
            live = live[self.table[probes(h[live], q, len(self.table))].all(axis=0)]
            out[live] = q
        return out


def planes(v: np.ndarray) -> bytes:
    """Numbers by their first bytes, second bytes, ...: those of high places are mostly 0 and pack well."""
    raw = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplaned(packed: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(packed[8:], n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n // size).T).view(kind).ravel()


def _sorted_planes(h: np.ndarray) -> bytes:
    """planes() of the steps between sorted hashes."""
    return planes(np.diff(h, prepend=np.uint64(0)))


def _unsorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unplaned(packed, np.uint64), dtype=np.uint64)


def edges(segments: int) -> np.ndarray:
    """The least hash of each segment but the first."""
    return np.array([(i << 64) // segments for i in range(1, segments)], np.uint64)


def ranges(h: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted hashes: the segments that hold any, and where the hashes of each begin and end."""
    part = np.searchsorted(least, h, "right")
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    return part[begin], begin, np.append(begin[1:], len(h))[: len(begin)]


def _pairs(t: np.ndarray, lengths: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that aren't the first of their document, and the hashes of the pairs that end there."""
    inner = np.ones(len(t), bool)
    inner[np.cumsum(lengths)[:-1]] = False
    inner[0] = False
    second = np.flatnonzero(inner)
    return second, pair(t[second - 1], t[second]) >> np.uint64(shift)


def _ask(batches: Iterator[pa.RecordBatch], segments: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Chunks of documents (row, text, learn): their tokens as places in the chunk's words, and what they ask each segment.

    `part` is -2 for the tokens and the documents' lengths, -1 for documents,
    else a segment, of which words (a) and pairs (c) are asked, with the times
    to learn each (b, d).
    """
    bounds = edges(segments)
    held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
    size, chunk = 0, TaskContext.get().partitionId() << 32
    names = ["chunk", "part", "seq", "row", "a", "b", "c", "d"]

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.concat_arrays([r for r, *_ in held])
        lengths = np.concatenate([s for _, s, _, _ in held])
        learn = np.repeat(np.concatenate([k for *_, k in held]), lengths)
        t = np.concatenate([t for _, _, t, _ in held])
        words, at = np.unique(t, return_inverse=True)
        second, h = _pairs(t, lengths, shift)
        counts = np.bincount(at[learn], minlength=len(words))
        at = planes(at.astype(np.uint32))
        del t
        grams, back = np.unique(h, return_inverse=True)
        twos = np.bincount(back[learn[second]], minlength=len(grams))
        del h, back, second, learn
        # Only segments that are asked something get a row: a chunk has no more rows than n-grams, however many segments there are.
        data, cuts = [], [ranges(h, least) for h, least in ((words, bounds), (grams, bounds >> np.uint64(shift)))]
        live = np.union1d(cuts[0][0], cuts[1][0])
        for h, c, (part, begin, end) in ((words, counts, cuts[0]), (grams, twos, cuts[1])):
            own = np.zeros((len(live), 2), np.int64)
            own[np.searchsorted(live, part)] = np.stack([begin, end], axis=1)
            data += [[_sorted_planes(h[i:j]) for i, j in own.tolist()], [planes(c[i:j].astype(np.uint32)) for i, j in own.tolist()]]
        n, m = len(rows), len(live) + 1
        first = [pa.array([at, *data[0]], pa.binary()), pa.array([planes(lengths.astype(np.uint32)), *data[1]], pa.binary()), *[pa.array([None, *x], pa.binary()) for x in data[2:]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array([-2, *live.tolist()], pa.int32()), pa.array([0] * m, pa.int32()), pa.nulls(m, rows.type), *first], names)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(n, dtype=np.int32)), rows, *[pa.nulls(n, pa.binary())] * 4], names)

    for batch in batches:
        learn = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, t, doc in tokens(batch.column(1)):
            held.append((batch.column(0).slice(i, j - i), np.bincount(doc, minlength=j - i), t, learn[i:j]))
            size += len(t)
            if size >= CHUNK:
                yield from out()
                held, size, chunk = [], 0, chunk + 1
    if held:
        yield from out()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, a table for each value of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        begins = [*np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist(), len(key)] if len(key) else [0]
        for i, j in zip(begins, begins[1:], strict=False):
            if held and held[-1].column(0)[0].as_py() != key[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _answer(batches: Iterator[pa.RecordBatch], bits_a_gram: int) -> Iterator[pa.RecordBatch]:
    """All that is asked of a segment (part, chunk, a, b, c, d): levels of words, their counts, levels of pairs; and its sums."""
    names = ["chunk", "part", "a", "b", "c", "total", "distinct"]
    for t in _runs(batches):
        part, chunks, n = t["part"][0].as_py(), t["chunk"].to_numpy(), len(t)
        asked = []
        for h, c in (("a", "b"), ("c", "d")):
            lists = [_unsorted(x.as_py()) for x in t[h]]
            cuts = np.cumsum([0, *map(len, lists)])
            grams, back = np.unique(np.concatenate(lists), return_inverse=True)
            del lists
            counts = np.bincount(back, np.concatenate([unplaned(x.as_py(), np.uint32) for x in t[c]]), minlength=len(grams)).astype(np.int64)
            asked.append((grams, counts, back.astype(np.int32), list(zip(cuts, cuts[1:], strict=False))))
        model = Filter.of(*(np.concatenate([x[i][x[1] > 0] for x in asked]) for i in (0, 1)), bits_a_gram)
        cut = lambda v, k: pa.array([planes(v[asked[k][2][i:j]]) for i, j in asked[k][3]], pa.binary())
        one, two = (model.levels(x[0]).astype(np.uint8) for x in asked)
        exact = asked[0][1]
        sums = [pa.array([int(x), *[0] * (n - 1)], pa.int64()) for x in (exact.sum(), (exact > 0).sum())]
        yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array([part] * n, pa.int32()), cut(one, 0), cut(exact, 0), cut(two, 1), *sums], names)
        del t, asked, model, one, two, exact


def _score(batches: Iterator[pa.RecordBatch], total: int, distinct: int, shift: int, mixing: float) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of each chunk, from rows sorted by (chunk, part, seq): tokens, documents, words (0) and answers (1)."""
    low = total + 0.1 * (distinct + 1)
    for t in _runs(batches):
        begin, end = np.searchsorted(t["part"].to_numpy(), [-1, 0]).tolist()
        n = end - begin
        at, lengths = (unplaned(t[c][0].as_py(), np.uint32).astype(np.int64) for c in ("a", "b"))
        answers = t.slice(end)
        told = answers["seq"].to_numpy() == 1
        words = np.concatenate([_unsorted(x.as_py()) for x in answers.filter(pa.array(~told))["a"]])
        answers = answers.filter(pa.array(told))
        single, exact, twos = (np.concatenate([unplaned(x.as_py(), kind) for x in answers[c]]) for c, kind in (("a", np.uint8), ("b", np.int64), ("c", np.uint8)))
        single, doc = count_of(single.astype(np.int64)), np.repeat(np.arange(n), lengths)
        # The model: pairs interpolated with single words, both read from the filter.
        p = ((single + 0.1) / low)[at]
        second, h = _pairs(words[at], lengths, shift)
        back = np.unique(h, return_inverse=True)[1]
        p[second] = mixing * np.minimum(count_of(twos.astype(np.int64))[back] / np.maximum(single[at[second - 1]], 1.0), 1.0) + (1 - mixing) * p[second]
        del h, back, second
        base = np.log10((exact + 0.1) / low)
        rows = t["row"].slice(begin, n).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [
                rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows,
                pa.array(lengths),
                pa.array(np.bincount(doc, (exact > 0)[at], minlength=n).astype(np.int64)),
                pa.array(np.bincount(doc, base[at], minlength=n)),
                pa.array(np.bincount(doc, np.log10(p), minlength=n)),
            ],
            ["row", "n_tokens", "n_known", "base_score", "score"],
        )


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, t, _ in tokens(batch.column(0)):
            h, c = np.unique(t, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])


def train(docs: DataFrame, text: str = "text", bits_a_gram: int = 12):
    """(Filter of all words in one segment, DataFrame of their exact counts), to look at the model of a few documents."""
    counts = docs.select(F.col(text)).mapInArrow(_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    found = counts.toArrow()
    return Filter.of(found["h"].to_numpy().view(np.uint64), found["c"].to_numpy(), bits_a_gram), counts


def score(docs: DataFrame, training, text: str = "text", mixing: float = 0.4, bits_a_gram: int = 12, segment: int = SEGMENT) -> DataFrame:
    """Every row of `docs` with n_tokens, n_known, train_tokens, base_score and score.

    `training` is a condition on `docs`; where it is true the row is learned
    from. Both scores are sums of log10 over the words and the end: base_score
    of (count + 0.1) / (N + 0.1 * (V + 1)) with exact counts, score of the
    interpolated model. A null text is empty, so it is one end. Without any
    training row N and V are 0. All other columns of `docs` but the text are
    kept; columns of these names are replaced.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    narrow = [c for c in docs.columns if c not in (*added, text)]
    # A row without other columns still needs a field.
    whole = docs.select(F.struct(*(narrow or [F.lit(None).cast("int").alias("_none")])).alias("row"), F.col(text).alias("_text"), F.coalesce(training, F.lit(False)).alias("_learn"))
    kind = whole.schema["row"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    segments, shift = 1 + size // segment, max(0, 64 - SPARE - max(30, size.bit_length()))
    # Chunks must not change when a task runs again: they are written.
    chunks = whole.mapInArrow(lambda it: _ask(it, segments, shift), f"chunk long, part int, seq int, row {kind}, a binary, b binary, c binary, d binary")
    chunks = scratch.cut(chunks, "chunks")
    asked = chunks.where("part >= 0").select("part", "chunk", "a", "b", "c", "d").repartition(min(segments, TASKS), "part").sortWithinPartitions("part")
    answers = scratch.cut(asked.mapInArrow(lambda it: _answer(it, bits_a_gram), "chunk long, part int, a binary, b binary, c binary, total long, distinct long"), "answers")
    total, distinct = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    told = answers.select("chunk", "part", F.lit(1).alias("seq"), F.lit(None).cast(kind).alias("row"), "a", "b", "c")
    own = F.col("part") < 0
    rows = chunks.select("chunk", "part", "seq", "row", "a", F.when(own, F.col("b")).alias("b"), F.lit(None).cast("binary").alias("c")).unionByName(told)
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "part", "seq")
    out = rows.mapInArrow(lambda it: _score(it, total, distinct, shift, mixing), f"row {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in narrow], "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

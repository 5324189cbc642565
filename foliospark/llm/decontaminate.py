"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that is as many words long as some benchmark item
gets a SimHash of its weighted shingles. Item fingerprints are indexed by
blocks of bits, one more than the Hamming radius, so a window within the
radius of an item agrees with it on a whole block and is found. Candidates
are verified by the exact similarity of their weighted shingles.

A window of which less than the least similarity (by weight) are shingles of
any items can't be that similar to one of them, whatever its fingerprint; such
windows are passed over before fingerprints are made, which loses nothing and
spares most of the corpus. At a similarity of 0.8 fingerprints differ in 10 of
64 bits on average, so the radius is wide and its blocks are short: what
selects is this bound, the index guarantees, and the exact similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LETTERS, flat, hashes, pieces, shingles, spans

#: Bits by which fingerprints of windows and items may differ.
RADIUS = 20


@dataclass
class Items:
    """The benchmark: an item a row; a bounded table that every worker holds."""

    ids: list
    sizes: np.ndarray  # words of each item
    fps: np.ndarray
    blocks: dict[int, list[dict[int, list[int]]]]  # by words of the item, then block: its bits -> items
    known: np.ndarray  # sorted shingles of all items
    weights: np.ndarray  # of the shingles in `known`
    of: list[dict[int, float]]  # shingle -> its weight times its repeats, an item each
    shingle: int
    maybe: np.ndarray  # by the low bits of a shingle: whether any of `known` has them

    def places(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles are known, and their places in `known`."""
        hit = self.maybe[(s & np.uint64(len(self.maybe) - 1)).astype(np.int64)]
        at = np.zeros(len(s), np.int64)
        look = np.flatnonzero(hit)
        at[look] = np.minimum(np.searchsorted(self.known, s[look]), len(self.known) - 1)
        hit[look] = self.known[at[look]] == s[look]
        return hit, at


def block_bits(fps: np.ndarray, radius: int) -> np.ndarray:
    """The fingerprints' bits in radius + 1 blocks; a row a block."""
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return np.stack([(fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)])


def simhash(values: np.ndarray, weights: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the weighted shingles of each of n groups, sorted by group."""
    signs = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
    signs *= weights[:, None].astype(np.float32)
    sums = np.zeros((n, 64), np.float32)
    if len(group):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sums[group[first]] = np.add.reduceat(signs, first, axis=0)
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _words(texts: list[str]) -> list[np.ndarray]:
    data, offsets = flat(pa.array(texts, pa.string()))
    low, starts, ends, doc = spans(data, offsets, LETTERS)
    h = hashes(low, starts, ends)
    return np.split(h, np.searchsorted(doc, np.arange(1, len(texts))))


def index(items: list[tuple], shingle: int = 5, radius: int = RADIUS) -> Items:
    """Index (id, text) items. Items of no words are left out; of fewer words than a shingle, all are one shingle.

    A shingle's weight is its inverse frequency among the items, so phrases
    that many items share count less.
    """
    found = [(i, w) for (i, _), w in zip(items, _words([t or "" for _, t in items]), strict=True) if len(w)] if items else []
    ids = [i for i, _ in found]
    own = [shingles(w, min(shingle, len(w))) for _, w in found]
    known, df = np.unique(np.concatenate([np.unique(s) for s in own]), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, int))
    weights = 1.0 / df
    of, fps = [], np.zeros(len(ids), np.uint64)
    for k, s in enumerate(own):
        v, n = np.unique(s, return_counts=True)
        w = weights[np.searchsorted(known, v)]
        of.append(dict(zip(v.tolist(), (w * n).tolist(), strict=True)))
        fps[k] = simhash(v, w * n, np.zeros(len(v), np.int64), 1)[0]
    sizes = np.array([len(w) for _, w in found], np.int64)
    blocks: dict[int, list[dict[int, list[int]]]] = {}
    for k, row in enumerate(block_bits(fps, radius).T.tolist()):
        tables = blocks.setdefault(int(sizes[k]), [{} for _ in row])
        for table, bits in zip(tables, row, strict=True):
            table.setdefault(bits, []).append(k)
    maybe = np.zeros(1 << max(12, (16 * len(known)).bit_length()), bool)
    maybe[(known & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
    return Items(ids, sizes, fps, blocks, known, weights, of, shingle, maybe)


def leaks(h: np.ndarray, items: Items, radius: int, least: float) -> list[tuple]:
    """(item index, first word, words, similarity) of the best window of each item found in a document's words.

    Of items longer than the document, the window is all of it.
    """
    best: dict[int, tuple] = {}
    if not len(h):
        return []
    by_k: dict[int, tuple] = {}
    for size in sorted(items.blocks):
        k = min(items.shingle, size)
        if k > len(h):
            break
        if k not in by_k:
            s = shingles(h, k)
            hit, at = items.places(s)
            weight = np.where(hit, items.weights[at], 1.0)
            sums = [np.concatenate(([0.0], np.cumsum(x))) for x in (weight, np.where(hit, weight, 0.0))]
            by_k[k] = s, weight, *sums
        s, weight, every, known = by_k[k]
        many = min(size, len(h)) - k + 1
        starts = np.flatnonzero(known[many:] - known[:-many] >= (every[many:] - every[:-many]) * least - 1e-9)
        for part in np.array_split(starts, -(-len(starts) * many // 100_000)) if len(starts) else []:
            _windows(part, s, weight, many, size, items, radius, least, best)
    return [(k, *v) for k, v in sorted(best.items())]


def _windows(starts, s, weight, many, size, items: Items, radius: int, least: float, best: dict) -> None:
    words = many + min(items.shingle, size) - 1
    cells = starts[:, None] + np.arange(many)[None, :]
    order = np.argsort(s[cells], axis=1, kind="stable")
    cells = np.take_along_axis(cells, order, axis=1)
    values, weights = s[cells], weight[cells]
    group = np.repeat(np.arange(len(starts)), many)
    fps = simhash(values.ravel(), weights.ravel(), group, len(starts))
    pairs: set[tuple[int, int]] = set()
    for table, row in zip(items.blocks[size], block_bits(fps, radius), strict=True):
        for w, bits in enumerate(row.tolist()):
            pairs.update((w, item) for item in table.get(bits, ()))
    for w, item in sorted(pairs):
        if int(fps[w] ^ items.fps[item]).bit_count() > radius:
            continue
        mine: dict[int, float] = {}
        for v, x in zip(values[w].tolist(), weights[w].tolist(), strict=True):
            mine[v] = mine.get(v, 0.0) + x
        theirs = items.of[item]
        shared = sum(min(x, theirs.get(v, 0.0)) for v, x in mine.items())
        like = shared / (sum(mine.values()) + sum(theirs.values()) - shared)
        if like >= least and like > best.get(item, (0, 0, 0.0))[2]:
            best[item] = (int(starts[w]), words, like)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = RADIUS, most_bytes: int = 8 << 20, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `docs` with `leaks`: array of (item, first_word, words, similarity), a benchmark item each, empty if clean.

    Null and empty texts are clean; null or wordless items match nothing;
    repeated items are all named. The benchmark is held by every worker, in
    some 64 times the bytes of its text; its size is checked first, and beyond
    `most_bytes` this raises.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes; pass over it in parts of at most {most_bytes}")
    kind = benchmark.schema[item].dataType.simpleString()
    shared = spark.sparkContext.broadcast(index([tuple(r) for r in benchmark.select(item, item_text).collect()], shingle, radius))
    names = [c for c in keep or docs.columns if c != "leaks"]
    inside = text in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        shape = pa.list_(pa.struct([("item", id_type), ("first_word", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())]))
        for batch in batches:
            data, offsets = flat(batch.column(0).field(names.index(text)) if inside else batch.column(1))
            out: list[list] = []
            for i, j in pieces(offsets):
                low, starts, ends, doc = spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LETTERS)
                h = hashes(low, starts, ends)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                # Documents without any item's shingle, of all sizes there are, end here.
                maybe = np.zeros(j - i, bool)
                for k in {min(items.shingle, x) for x in items.blocks}:
                    s = shingles(h, k)
                    maybe[doc[np.flatnonzero(items.places(s)[0])]] = True
                for d in range(j - i):
                    got = leaks(h[cuts[d] : cuts[d + 1]], items, radius, least) if maybe[d] else []
                    out.append([{"item": items.ids[k], "first_word": a, "words": n, "similarity": x} for k, a, n, x in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, shape)], ["row", "leaks"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(benchmark.schema[item].dataType)
    packed = docs.select(F.struct(*names).alias("row"), *([] if inside else [F.col(text).alias("text")]))
    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, leaks array<struct<item:{kind},first_word:int,words:int,similarity:double>>")
    return out.select("row.*", "leaks")

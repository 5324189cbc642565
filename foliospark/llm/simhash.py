"""SimHash near-duplicates with pivot distance tables.

Fingerprints are the bit majorities of the XXH64 of word shingles. To link all
fingerprints within a Hamming radius, the distances of each to a table of
reference fingerprints (pivots) are precomputed: by the triangle inequality a
pair whose coordinates differ by more than the radius in any pivot cannot link
and is discarded; the survivors are verified.

A pivot table alone would compare every pair with every pair. So that it need
not, only fingerprints that agree on enough whole blocks of bits meet: with
more blocks than the radius, two fingerprints within it differ in at most
`radius` blocks and so agree on all of the others (pigeonhole), whichever they
are. No pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .words import SPACED, flat, hashes, mix, pieces, shingles, spans

#: The reference fingerprints.
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def fingerprint(text: bytes, words: int = 4, seed: int = 42, lanes: int = 1) -> tuple[int, ...]:
    """SimHash of the shingles of a text, repeats included, 64 bits a lane; 0 without words.

    The first lane takes the hashes as they are, further ones take them mixed anew.
    """
    tokens = text.lower().split()  # bytes: lowers A-Z, parts at space and \\x09-\\x0D only
    if not tokens:
        return (0,) * lanes
    line = b" ".join(tokens)
    words = min(words, len(tokens))
    ends = np.empty(len(tokens), np.int64)
    np.cumsum([len(t) + 1 for t in tokens], out=ends)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    h = xxhash.xxh64_intdigest
    found = np.array([h(line[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)
    n, out = len(found), []
    for _ in range(lanes):
        ones = np.zeros(64, np.int64)
        for i in range(0, n, 4096):
            ones += np.unpackbits(found[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big"))
        found = mix(found)
    return tuple(out)


def fingerprints(docs: DataFrame, text: str = "text", ident: str = "doc_id", words: int = 4, lanes: int = 1) -> DataFrame:
    """(ident, `fp`, `other`) of every row, signed longs; `other` is the second of two lanes, else 0. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words, lanes=lanes) for t in batch.column(1).cast(pa.binary())]
            columns = [np.array([f[i] if i < lanes else 0 for f in fps], np.uint64).view(np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], [ident, "fp", "other"])

    return docs.select(F.col(ident), F.col(text)).mapInArrow(run, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, fp long, other long")


def block_keys(fp, blocks: int, radius: int):
    """Array of (which blocks, their bits) that pairs within the radius must share one of."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.struct(F.lit(k).alias("which"), fp.bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))).alias("bits")) for k, c in enumerate(combinations(range(blocks), blocks - radius))])


def blocks_for(n: int, radius: int, least: int, run: int = 4096) -> int:
    """Blocks for n fingerprints: `least`, or more where chance alone would make runs longer than `run`.

    With more blocks a pair has to agree on more bits. Any number finds all
    pairs, so this decides about work only.
    """
    blocks = max(least, radius + 1)
    while blocks < 64 and n / 2.0 ** (64 * (blocks - radius) / blocks) > run:
        blocks += 1
    return blocks


def close(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius, of one group of fingerprints, by their pivot tables.

    Sorted by the first coordinate, a row need only meet the rows whose first
    coordinate is at most `radius` larger; the other coordinates discard most
    of these, and the rest are verified.
    """
    tables = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(tables[:, 0], kind="stable")
    tables, sorted_fps = tables[order], fps[order]
    reach = np.searchsorted(tables[:, 0], tables[:, 0] + radius, "right")
    left, right = [], []
    for i in range(0, len(fps), 256):
        j = min(len(fps), i + 256)
        window = slice(i, int(reach[j - 1]))
        near = np.ones((j - i, window.stop - i), bool)
        for p in range(1, tables.shape[1]):
            near &= np.abs(tables[i:j, p, None] - tables[None, window, p]) <= radius
        a, b = np.nonzero(near)
        keep = b > a
        a, b = a[keep] + i, b[keep] + i
        keep = np.bitwise_count(sorted_fps[a] ^ sorted_fps[b]) <= radius
        left.append(order[a[keep]])
        right.append(order[b[keep]])
    return np.concatenate(left), np.concatenate(right)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among n nodes: each node with its component's first."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, r) for x in range(n) if (r := find(x)) != x]


def _links(batches: Iterator[pa.RecordBatch], radius: int, total: int, small: int = 24) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (which, bits, tile) in rows sorted by these; a run may span batches."""
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table) -> pa.RecordBatch:
        which, bits, tile, node, fp, other = (t.column(i).to_numpy() for i in range(6))
        fp, other = fp.view(np.uint64), other.view(np.uint64)
        apart = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64) + np.bitwise_count(other[i] ^ other[j])
        new = np.ones(len(fp), bool)
        new[1:] = (which[1:] != which[:-1]) | (bits[1:] != bits[:-1]) | (tile[1:] != tile[:-1])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(fp)))
        run = np.repeat(np.arange(len(begins)), sizes)
        # Runs of a few rows, all at once: row i against rows i + 1, i + 2, ...
        out_a, out_b = [], []
        light = np.repeat(sizes <= small, sizes)
        tables = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
        for lag in range(1, int(sizes[sizes <= small].max(initial=1))):
            i = np.flatnonzero(light[:-lag] & (run[:-lag] == run[lag:]))
            i = i[np.abs(tables[i] - tables[i + lag]).max(axis=1, initial=0) <= radius]
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= radius]
            i = i[apart(i, i + lag) <= total]
            out_a.append(node[i])
            out_b.append(node[i + lag])
        for g in np.flatnonzero(sizes > small):
            s = slice(begins[g], begins[g] + sizes[g])
            a, b = close(fp[s], radius)
            fine = apart(a + begins[g], b + begins[g]) <= total
            a, b = a[fine], b[fine]
            pairs = np.array(_forest(a, b, int(sizes[g])), np.int64).reshape(-1, 2)
            out_a.append(node[s][pairs[:, 0]])
            out_b.append(node[s][pairs[:, 1]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(i)[-1].as_py() for i in range(3)]
        same = np.ones(batch.num_rows, bool)
        for i in range(3):
            same &= batch.column(i).to_numpy(zero_copy_only=False) == last[i]
        at = batch.num_rows - int(same.sum())
        if at:
            held[-1] = batch.slice(0, at)
            yield solve(pa.Table.from_batches(held))
            held = [batch.slice(at)]
    if held:
        yield solve(pa.Table.from_batches(held))


def link(points: DataFrame, radius: int = 4, blocks: int = 6, tile: int = 4096, total: int = 128) -> DataFrame:
    """Links (a, b) that connect all points (`node`, `fp`, `other`) within the radius by `fp`, and within `total` by both lanes.

    Within a run of fingerprints that share blocks, the links of a spanning
    forest are returned, so a group of n alike gives n - 1 links a run and not
    n * n / 2. Runs of more than `tile` points are cut into tiles, and every
    pair of tiles is met by itself, so that no task holds a whole hot run.
    """
    keyed = points.select("node", "fp", "other", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("k")).select("k.which", "k.bits", "node", "fp", "other")
    counts = keyed.groupBy("which", "bits").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counts, ["which", "bits"])
    met = met.select("which", "bits", F.explode(_tiles(F.col("n"), F.col("fp"), tile)).alias("tile"), "node", "fp", "other")
    met = met.repartition("which", "bits", "tile").sortWithinPartitions("which", "bits", "tile")
    return met.mapInArrow(lambda it: _links(it, radius, total), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """(ident, `fp`, `component`) of every row: the least ident reachable over links of the radius.

    Null and empty texts have fingerprint 0 and link like any other. A null
    ident never names a component unless all of its component are null;
    repeated rows stay repeated. An empty table gives an empty result.
    """
    fps = scratch.cut(fingerprints(docs, text, ident, words), "fps")
    # One node a distinct fingerprint, named by it.
    classes = scratch.cut(fps.groupBy("fp").agg(F.min(ident).alias("least")), "classes")
    points = classes.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("other"))
    joined = components(link(points, radius, blocks_for(classes.count(), radius, blocks)))
    named = classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    names = named.groupBy("c").agg(F.min("least").alias("component"))
    named = named.join(names, "c").select("fp", "component")
    return fps.join(named, "fp").select(ident, "fp", "component")


#: Hash functions of the least shingle hashes by which texts meet, and how many of these make a band.
LEAST = mix(np.arange(101, 125, dtype=np.uint64)) | np.uint64(1)
BAND = 3


def _majority(found: np.ndarray) -> np.uint64:
    ones = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found)).view(">u8")[0]


def shingle_sets(column, words: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the different shingles of each text; fewer words are one shingle, no words none."""
    data, offsets = flat(column)
    for i, j in pieces(offsets):
        low, starts, ends, doc = spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED)
        h = hashes(low, starts, ends)
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.unique(shingles(h[a:b], min(words, b - a))) if b > a else np.zeros(0, np.uint64)


def _described(words: int):
    """(r, text) to r, a node for each set of shingles, its size, a SimHash of two lanes, and keys by which sets meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bands = len(LEAST) // BAND
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((4, n), np.uint64)
            bands = np.zeros((n, n_bands), np.uint64)
            for k, s in enumerate(shingle_sets(batch.column(1), words)):
                if len(s):
                    least = np.full(len(LEAST), ~np.uint64(0))
                    for i in range(0, len(s), 4096):
                        np.minimum(least, (s[i : i + 4096, None] * LEAST[None, :]).min(axis=0), out=least)
                    three = mix(least).reshape(n_bands, BAND)
                    bands[k] = mix(three[:, 0] + three[:, 1] * np.uint64(3) + three[:, 2] * np.uint64(5) + np.arange(n_bands, dtype=np.uint64))
                    out[:, k] = xxhash.xxh64_intdigest(s.tobytes()), len(s), _majority(s), _majority(mix(s))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out), lists], ["r", "node", "n", "fp", "other", "bands"])

    return run


def _sets(words: int):
    """(node, text) to node and its shingles, as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return run


def survivors(fps: np.ndarray, others: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints of two lanes within the radius: pivot tables discard, the distance verifies."""
    tables = (np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]) + np.bitwise_count(others[:, None] ^ PIVOTS[None, ::-1])).astype(np.int16)
    for i in range(0, len(fps), 256):
        j = min(len(fps), i + 256)
        near = np.ones((j - i, len(fps) - i), bool)
        for p in range(tables.shape[1]):
            near &= np.abs(tables[i:j, p, None] - tables[None, i:, p]) <= radius
        a, b = np.nonzero(near)
        keep = b > a
        a, b = a[keep] + i, b[keep] + i
        keep = np.bitwise_count(fps[a] ^ fps[b]).astype(np.int64) + np.bitwise_count(others[a] ^ others[b]) <= radius
        yield a[keep], b[keep]


def _verified(batches: Iterator[pa.RecordBatch], similarity: float, radius: int) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of each run of equal (band, tile), by the exact similarity of shingles; rows sorted by these."""

    def links(t: pa.Table) -> pa.RecordBatch:
        band, tile, node, n, fp, other = (t.column(i).to_numpy() for i in range(6))
        raw = t.column(6)
        new = np.ones(len(node), bool)
        new[1:] = (band[1:] != band[:-1]) | (tile[1:] != tile[:-1])
        begins = [*np.flatnonzero(new).tolist(), len(node)]
        out: list[tuple[int, int]] = []
        for begin, end in zip(begins, begins[1:], strict=False):
            if end - begin < 2:
                continue
            root = list(range(end - begin))
            held: dict[int, np.ndarray] = {}

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            def own(x: int, begin=begin, held=held) -> np.ndarray:
                if x not in held:
                    held[x] = np.frombuffer(raw[begin + x].as_buffer(), np.uint32)
                return held[x]

            for a, b in survivors(fp[begin:end].view(np.uint64), other[begin:end].view(np.uint64), radius):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    i, j = find(x), find(y)
                    small, large = sorted((int(n[begin + x]), int(n[begin + y])))
                    if i == j or small < similarity * large:
                        continue
                    p, q = own(x), own(y)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both >= similarity * (len(p) + len(q) - both):
                        root[max(i, j)] = min(i, j)
                        out.append((int(node[begin + x]), int(node[begin + y])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = [batch.column(i).to_numpy() for i in (0, 1)]
        at = batch.num_rows - int(((keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1])).sum())
        if at:
            held[-1] = batch.slice(0, at)
            yield links(pa.Table.from_batches(held))
            held = [batch.slice(at)]
    if held:
        yield links(pa.Table.from_batches(held))


def _tiles(n: Column, own: Column, tile: int) -> Column:
    """Tile pairs (i, j), i <= j, that hold a row: all are 0 in runs of at most `tile` rows."""
    tiles = F.ceil(n / tile).cast("int")
    mine = F.pmod(F.xxhash64(own), tiles.cast("long")).cast("int")
    return F.when(n <= tile, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.least(j, mine) * tiles + F.greatest(j, mine)))


def keep_one(docs: DataFrame, text: str = "text", ident: str = "doc_id", words: int = 5, similarity: float = 0.8, radius: int = 36, tile: int = 4096) -> DataFrame:
    """One row of each near-duplicate group of `docs`, with all its columns: that of the least ident (nulls last).

    Texts link if the Jaccard similarity of their sets of shingles (of words,
    lower-cased A-Z) is at least `similarity`, which is verified exactly but
    for collisions of 32-bit hashes. Pairs meet in one of 8 bands of 3 least
    hashes: at a similarity of 0.8 all but 0.3 % do, at 0.9 all but 3 in a
    million. Of these, pivot tables discard those whose fingerprints of two
    lanes differ in more than `radius` of 128 bits: at 0.8 the mean is 19, and
    36 is 4 deviations away. Texts of equal sets link; texts without words are
    one group. Of repeated rows one stays.
    """
    spark = docs.sparkSession
    rid = F.xxhash64(F.col(ident), F.col(text))
    described = docs.select(F.struct(rid.alias("rid"), F.col(ident).alias("id")).alias("r"), F.col(text).alias("t"))
    kind = described.schema["r"].dataType.simpleString()
    first = F.min(F.struct(F.col("r.id").isNull().alias("unknown"), F.col("r.id").alias("id"), F.col("r.rid").alias("rid")))
    with scratch.Space(spark) as space:
        described = described.mapInArrow(_described(words), f"r {kind}, node long, n long, fp long, other long, bands array<long>")
        described = space.cut(described, "described")
        # One node for each set of shingles; what hangs on the set is the same in all its rows.
        classes = space.cut(described.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "other", "bands")], first.alias("first")), "classes")
        banded = classes.where("n > 0").select("node", "n", "fp", "other", F.explode("bands").alias("band"))
        met = space.cut(banded.join(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "band"), "met")
        # Sets of those that met others only, from one text each.
        live = classes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("first.rid").alias("rid"))
        texts = docs.select(rid.alias("rid"), F.col(text).alias("t")).join(live, "rid").select("node", "t")
        sets = space.cut(texts.mapInArrow(_sets(words), "node long, shingles binary").dropDuplicates(["node"]), "sets")
        runs = met.select("band", F.explode(_tiles(F.col("size"), F.col("node"), tile)).alias("tile"), "node", "n", "fp", "other").join(sets, "node")
        runs = runs.select("band", "tile", "node", "n", "fp", "other", "shingles").repartition("band", "tile").sortWithinPartitions("band", "tile")
        joined = components(runs.mapInArrow(lambda it: _verified(it, similarity, radius), "a long, b long"))
        kept = classes.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("first").alias("first"))
        kept = scratch.cut(kept.select(F.col("first.rid").alias("rid")), "kept")
    # The columns of `docs` are in one struct, so that none can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), rid.alias("rid")).join(kept, "rid", "left_semi")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("rid").orderBy("rid"))).where("nth = 1")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])

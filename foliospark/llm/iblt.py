"""Document fingerprints as invertible Bloom lookup tables.

A text is cut into paragraphs (lines, the sentences of a line, and long
sentences where their words say so), each a 64-bit digest that also counts its
earlier repeats, so a text is a set of digests. Every digest is added to three
cells of a table; a cell holds a count, the exclusive or of its digests and
that of their checks. A table has cells in proportion to its text's paragraphs,
and more where these don't suffice to peel it: sizes double until every digest
of the text is recovered from its table alone. Sizes are powers of two, so a
table folds to any smaller size.

The tables of two texts are folded to one size and subtracted cell by cell, and
peeling cells that hold a single digest recovers what differs. Where that gets
stuck, the texts differ in more than the smaller table has room for; then each
table is peeled alone. So the fingerprints give every likeness by themselves.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .sharding import range_of
from .words import mix

#: Cells of a third of the smallest table; a power of two.
LEAST = 8


#: Characters beyond which a sentence is cut further.
LONG = 200


def paragraphs(text: str) -> list[str]:
    """Lines with their breaks, cut further after sentences; joined they are the text."""
    found = [p for p in text.replace("\n", "\n\0").replace(". ", ". \0").split("\0") if p]
    if all(len(p) <= LONG for p in found):
        return found
    return [q for p in found for q in (_pieces(p) if len(p) > LONG else [p])]


def _pieces(sentence: str) -> list[str]:
    """A long sentence cut after words of certain hashes, so that an edit moves no later cut; at the latest after 32 words, and words after 256 characters."""
    out, begin, at, n = [], 0, 0, 0
    for m in re.finditer(r"\s{0,256}\S{1,256}\s?|\s{1,256}", sentence):
        at, n = m.end(), n + 1
        if n == 32 or not zlib.crc32(m[0].strip().encode("utf-8", "surrogatepass")) % 16:
            out.append(sentence[begin:at])
            begin, n = at, 0
    return [*out, sentence[begin:]] if begin < len(sentence) else out


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of many texts, and the text each belongs to, sorted by both."""
    h, found, sizes = xxhash.xxh3_64_intdigest, [], []
    for t in texts:
        own = paragraphs(t)
        sizes.append(len(own))
        found += map(h, own)
    doc = np.repeat(np.arange(len(texts)), sizes)
    d = np.array(found, np.uint64)
    order = np.lexsort((d, doc))
    doc, d = doc[order], d[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(new)
    nth = np.arange(len(d)) - np.repeat(begins, np.diff(np.append(begins, len(d))))
    return doc, mix(d + mix(nth.astype(np.uint64) + np.uint64(1)))


def cells_of(d: np.ndarray, third: int) -> np.ndarray:
    """The three cells of each digest in a table of three thirds; a smaller third has the same cells but for the high bits."""
    return np.stack([(mix(d ^ np.uint64(0xA5A5_0000 + i)) & np.uint64(third - 1)).astype(np.int64) + third * i for i in range(3)])


def third_for(n: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The third that a table of n digests starts with: half as many cells as digests, more where few digests may meet in all three."""
    want = np.maximum.reduce([np.full(len(n), least), n / 2 + 2, np.cbrt(33.0 * n * n)])
    return 1 << np.ceil(np.log2(want)).astype(np.int64)


def check_of(d: np.ndarray) -> np.ndarray:
    return mix(d + np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF)


def _xor_into(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    if len(at):
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
        begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[begins]] ^= np.bitwise_xor.reduceat(values, begins)


def tables(doc: np.ndarray, d: np.ndarray, n: int, third: int) -> list[np.ndarray]:
    """Counts, digests and checks of the cells of n tables, a row each; `doc` says which one each digest goes to."""
    cells = 3 * third
    keys, checks = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    at = (cells_of(d, third) + doc * cells).ravel()
    _xor_into(keys, at, np.tile(d, 3))
    _xor_into(checks, at, np.tile(check_of(d), 3))
    return [x.reshape(n, cells) for x in (np.bincount(at, minlength=n * cells).astype(np.int64), keys, checks)]


def folded(found: list[np.ndarray], third: int) -> list[np.ndarray]:
    """Tables at a smaller size."""
    n, cells = found[0].shape
    parts = [x.reshape(n, 3, cells // 3 // third, third) for x in found]
    return [(np.add if i == 0 else np.bitwise_xor).reduce(x, axis=2).reshape(n, 3 * third) for i, x in enumerate(parts)]


def subtract(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]]


#: A stored cell.
CELL = np.dtype([("n", ">u2"), ("k", ">u8"), ("c", ">u4")])


def stored(found: list[np.ndarray]) -> list[str]:
    """Fingerprints: the cells of each table of some that are of one size, in base 64."""
    raw = np.zeros(found[0].shape, CELL)
    for name, values in zip("nkc", found, strict=True):
        raw[name] = values
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def loaded(fingerprint: str) -> list[np.ndarray]:
    """The table that stored() wrote, as one row."""
    raw = np.frombuffer(base64.b64decode(fingerprint), CELL)[None, :]
    return [raw["n"].astype(np.int64), raw["k"].astype(np.uint64), raw["c"].astype(np.uint64)]


def peel(found: list[np.ndarray], n: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of n subtracted tables, all peeled together: (table, digest) of what only the first and only the second held, and which got stuck."""
    counts, keys, checks = (x.ravel().copy() for x in found)
    size = len(counts) // max(n, 1)
    got: tuple[list, list] = ([], [])
    look = np.arange(len(counts))
    for _ in range(size + 1):  # a table gives no more digests than it has cells, but one that isn't a text's could go on
        if not len(look):
            break
        look = look[np.abs(counts[look]) == 1]
        look = look[check_of(keys[look]) == checks[look]]
        # A digest may be alone in two or three of its cells at once.
        which, key, s = look // size, keys[look], counts[look]
        order = np.lexsort((key, which))
        which, key, s = which[order], key[order], s[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (which[1:] != which[:-1])
        which, key, s = which[first], key[first], s[first]
        for k, side in ((0, s > 0), (1, s < 0)):
            got[k].append((which[side], key[side]))
        at = (cells_of(key, size // 3) + which * size).ravel()
        np.add.at(counts, at, -np.tile(s, 3))
        _xor_into(keys, at, np.tile(key, 3))
        _xor_into(checks, at, np.tile(check_of(key), 3))
        look = np.unique(at)
    stuck = np.zeros(n, bool)
    stuck[np.flatnonzero((counts != 0) | (keys != 0) | (checks != 0)) // size] = True
    return [tuple(np.concatenate([x[i] for x in side]) if side else np.zeros(0, (np.int64, np.uint64)[i]) for i in (0, 1)) for side in got], stuck


@dataclass
class Tables:
    """Tables of many texts by size, and the digests that each gives when it is peeled alone."""

    third: np.ndarray  # of each text
    place: np.ndarray  # of each text among those of its size
    found: dict[int, list[np.ndarray]]
    doc: np.ndarray  # what was peeled, sorted by text
    d: np.ndarray

    def at(self, texts: np.ndarray, third: int) -> list[np.ndarray]:
        """The tables of some texts of one size, folded."""
        size = int(self.third[texts[0]])
        return folded([x[self.place[texts]] for x in self.found[size]], third)

    def sizes(self, texts: np.ndarray) -> np.ndarray:
        """How many digests each of some texts of one size has."""
        return self.found[int(self.third[texts[0]])][0][self.place[texts]].sum(axis=1) // 3


def build(doc: np.ndarray, d: np.ndarray, n: int, least: int = LEAST) -> Tables:
    """A table for each of n texts, of the first size from which it can be peeled."""
    third = third_for(np.bincount(doc, minlength=n), least)
    place, found, got = np.zeros(n, np.int64), {}, []
    for size in iter_sizes(third):
        mine = np.flatnonzero(third == size)
        row = np.full(n, -1)
        row[mine] = np.arange(len(mine))
        own = row[doc] >= 0
        made = tables(row[doc[own]], d[own], len(mine), size)
        ((which, key), _), stuck = peel(made, len(mine))
        third[mine[stuck]] = size * 2
        fine = np.flatnonzero(~stuck)
        place[mine[fine]] = np.arange(len(fine))
        found[size] = [x[fine] for x in made]
        keep = ~stuck[which]
        got.append((mine[which[keep]], key[keep]))
    which, key = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, (np.int64, np.uint64)[i]) for i in (0, 1))
    order = np.lexsort((key, which))
    return Tables(third, place, found, which[order], key[order])


def iter_sizes(third: np.ndarray) -> Iterator[int]:
    """Sizes from the smallest up, also those that come to be asked for on the way."""
    size = 0
    while len(more := third[third > size]):
        size = int(more.min())
        yield size


def likeness(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared paragraphs of all paragraphs of each pair of texts, from their tables alone; 1 for two empty texts."""
    out = np.ones(len(a))
    for ta, tb in sorted({*zip(t.third[a].tolist(), t.third[b].tolist(), strict=True)}):
        pairs = np.flatnonzero((t.third[a] == ta) & (t.third[b] == tb))
        x, y, third = a[pairs], b[pairs], min(ta, tb)
        ((only_a, _), (only_b, _)), stuck = peel(subtract(t.at(x, third), t.at(y, third)), len(pairs))
        sizes_a, sizes_b = t.sizes(x), t.sizes(y)
        shared = sizes_a - np.bincount(only_a, minlength=len(pairs))
        union = shared + np.bincount(only_a, minlength=len(pairs)) + np.bincount(only_b, minlength=len(pairs))
        for i in np.flatnonzero(stuck):  # each table is peeled alone
            first, second = (t.d[slice(*np.searchsorted(t.doc, [k, k + 1]))] for k in (x[i], y[i]))
            shared[i] = len(np.intersect1d(first, second, assume_unique=True))
            union[i] = sizes_a[i] + sizes_b[i] - shared[i]
        out[pairs] = np.where(union == 0, 1.0, shared / np.maximum(union, 1))
    return out


def compare(first: str, second: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Of two fingerprints: the digests only in the first, those only in the second, and the likeness."""
    a, b = loaded(first), loaded(second)
    third = min(a[0].shape[1], b[0].shape[1]) // 3
    ((_, x), (_, y)), stuck = peel(subtract(folded(a, third), folded(b, third)), 1)
    if stuck[0]:
        (((_, own), _), no), (((_, other), _), nor) = (peel(f, 1) for f in (a, b))
        if no[0] or nor[0]:
            raise ValueError("not a fingerprint")
        x, y = np.setdiff1d(own, other), np.setdiff1d(other, own)
    shared = int(a[0].sum()) // 3 - len(x)
    union = shared + len(x) + len(y)
    return x, y, shared / union if union else 1.0


def neighbours(docs: DataFrame, text: str = "text", ident: str = "doc_id", rows: int = 4096, most: int = 4096) -> DataFrame:
    """(`block`, `tail`, `id`, `h`, `text`): documents in blocks of descending ident.

    The first document of each block also comes last (`tail`) in the block
    before it, and the very first in the last block, so that every document
    finds its successor in its own block. The text is shuffled once; of idents,
    the driver sees at most `most` boundaries. Nulls come last; equal idents are
    ordered by the hash of their text. Idents must be integers, or this raises:
    others have to be numbered first.
    """
    if docs.schema[ident].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{ident} must be an integer column")
    ids = scratch.cut(docs.select(F.col(ident).alias("id"), F.xxhash64(F.col(text)).alias("h")), "ids")
    blocks = min(most, max(1, ids.count() // rows))
    bounds: list[int] = []
    if blocks > 1:
        marks = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
        bounds = sorted(set(ids.agg(F.percentile_approx("id", marks, 20 * blocks)).first()[0] or []))
    block = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(range_of(F.col("id"), bounds)).cast("int")
    firsts = ids.withColumn("block", block).groupBy("block").agg(F.max(F.struct(F.coalesce("id", F.lit(0)).alias("id"), "h")).alias("f"))
    order = Window.orderBy(F.desc("block"))
    # One row a block. The block above each; above the first, by the wrap, the last.
    firsts = firsts.select("block", F.col("f.id").alias("fid"), F.col("f.h").alias("fh"), F.coalesce(F.lag("block").over(order), F.min("block").over(Window.partitionBy())).alias("above"))
    rows_ = docs.select(F.col(ident).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("block", block)
    rows_ = rows_.join(F.broadcast(firsts), "block")
    own = F.struct("block", F.lit(0).alias("tail"))
    copy = F.struct(F.col("above").alias("block"), F.lit(1).alias("tail"))
    is_first = (F.coalesce("id", F.lit(0)) == F.col("fid")) & (F.col("h") == F.col("fh"))
    return rows_.select(F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("p"), "id", "h", "text").select("p.block", "p.tail", "id", "h", "text")


def _pairs(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """(idents, texts) with one text more than idents: each ident's text and then its successor's.

    Rows come sorted by block, tails last; several equal tails count once.
    """
    ids: list = []
    texts: list[str] = []
    size, now, done = 0, None, True
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for block, tail, ident, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[4], strict=True):
            if block != now:
                now, done, ids, texts, size = block, False, [], [], 0
            if done:
                continue
            text = text.as_py()
            texts.append(text)
            size += len(text)
            if tail:
                yield ids, texts
                done = True
            else:
                if size > limit and ids:
                    yield ids, texts
                    ids, texts, size = [], [text], len(text)
                ids.append(ident)


def fingerprint_pairs(docs: DataFrame, text: str = "text", ident: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses recovered from them.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document by descending ident. Columns: ident,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text is empty; a single document is its own successor;
    an empty table gives an empty result. compare() gives the same likeness
    for any two of the returned strings.
    """
    kind = docs.schema[ident].dataType.simpleString()
    rows = neighbours(docs, text, ident).repartition("block").sortWithinPartitions("block", "tail", F.desc_nulls_last("id"), F.desc("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pairs(batches):
            n = len(ids)
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
            t = build(*digests(texts + edited), 2 * n + 1, least)
            prints = np.empty(2 * n + 1, object)
            for size, found in t.found.items():
                prints[t.third == size] = stored(found)
            every = np.arange(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array([len(x) for x in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(prints[:n].tolist(), pa.string()),
                    pa.array(prints[n + 1 :].tolist(), pa.string()),
                    pa.array(likeness(t, every, every + n + 1)),
                    pa.array(likeness(t, every, every + 1)),
                ],
                [ident, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[ident].dataType)
    return rows.mapInArrow(run, f"`{ident}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Ranked lexical search by Block-Max WAND.

The index is cut into shards of documents; a shard is built by one task from
what it reads, so texts are never shuffled. A term's postings in a shard are
cut into blocks of 128: deltas of the documents' places and counts, as bytes of
a width that fits the block. A block tells its first and last document and its
maximum impact, the most that one occurrence of the term in a query can add to
a document's score before the term's weight.

A search takes the posting lists of its terms shard by shard. Between two
neighbouring ends of blocks, every list stands in one block: such a window is
where all shallow pointers stay. The bound of a window is the sum of the
weighted maxima of the blocks that its pointers stand in, found from the
blocks' heads alone. Lists with fewer postings than there are windows are
walked by document instead, as their blocks span too many windows to bound
any. Windows are taken in ascending order of document, the threshold is the
least of the best documents so far, and blocks are decompressed only where the
bound of a window passes it. The threshold starts from heads too: where k
blocks of a list have a maximum of at least x, k documents score that much.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, words

#: Postings of a block; bytes of text and documents of a shard; bytes of items that are searched at a time.
BLOCK, SHARD_BYTES, SHARD_DOCS, ITEM_BYTES = 128, 16 << 20, 1 << 18, 4 << 20
#: Fixed value: what separates terms.
SEPARATORS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Index:
    """Posting lists (rows with a term) and shards' documents (rows without), and the corpus counts in their impacts."""

    table: DataFrame
    path: str
    n_docs: int
    n_terms: int


def norm(length, n_docs: int, n_terms: int):
    """A document's m, from its number of terms."""
    return 75 + (25 * length * n_docs) // max(1, n_terms)


def impact(count, m):
    """What an occurrence in the query adds for a document, before the term's weight."""
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_docs = n_terms = 0
    for batch in batches:
        data, offsets = words.flat(batch.column(0))
        for i, j in words.pieces(offsets):
            cut = offsets[i : j + 1]
            _, starts, _, doc = words.spans(data[cut[0] : cut[-1]], cut - cut[0], words.LETTERS)
            n_terms += len(starts)
            n_docs += len(np.unique(doc))
    yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], ["n_docs", "n_terms"])


def corpus_counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    row = docs.select(F.col(text).alias("text")).mapInArrow(_count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes that hold each value: 1, 2 or 4."""
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        some = width > k
        out[at[some] + k] = (values[some] >> (8 * k)) & 0xFF


class _Shard:
    """Documents gathered by a task until they make a shard."""

    def __init__(self) -> None:
        self.idents, self.lengths, self.terms, self.docs, self.bytes, self.n = [], [], [], [], 0, 0

    def add(self, idents: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        low, starts, ends, doc = words.spans(data, offsets, words.LETTERS)
        lengths = np.bincount(doc, minlength=len(idents))
        kept = np.flatnonzero(lengths)
        place = np.cumsum(lengths > 0) - 1
        upto = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=upto[1:])
        text = low[low != 0]  # the words' bytes, one after another
        self.terms.append(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(text)]))
        self.docs.append((place[doc] + self.n).astype(np.int32))
        self.idents.append(idents.take(pa.array(kept)))
        self.lengths.append(lengths[kept])
        self.n += len(kept)
        self.bytes += len(data)

    def rows(self, name: int, n_docs: int, n_terms: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        idents = pa.concat_arrays(self.idents)
        order = pc.sort_indices(idents, null_placement="at_start").to_numpy()
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        lengths = np.concatenate(self.lengths)[order]
        m = norm(lengths, n_docs, n_terms)
        yield _rows(kind, [name], [None], [self.n], [None] * 5, [idents.take(pa.array(order))], [lengths])
        coded = pa.chunked_array(self.terms).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        names = coded.dictionary.take(pa.array(by_name))
        code = np.empty(len(by_name), np.int64)
        code[by_name] = np.arange(len(by_name))
        keys = code[coded.indices.to_numpy()] * self.n + rank[np.concatenate(self.docs)]
        self.__init__()  # the gathered words are let go
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        count = np.diff(first, append=len(keys))
        term, doc = np.divmod(keys[first], len(lengths))
        score = impact(count, m[doc])
        lists = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(lists, append=len(term))
        nth = np.arange(len(term)) - np.repeat(lists, df)
        heads = np.flatnonzero(nth % BLOCK == 0)
        size = np.diff(heads, append=len(term))
        delta = np.diff(doc, prepend=0)
        delta[heads] = 0
        top = np.maximum.reduceat(score, heads)
        wide, high = _width(np.maximum.reduceat(delta, heads)), _width(np.maximum.reduceat(count, heads))
        begin = np.concatenate([[0], np.cumsum(size * (wide + high))])
        out = np.zeros(begin[-1], np.uint8)
        block = np.repeat(np.arange(len(heads)), size)
        inside = nth % BLOCK
        _put(out, begin[block] + inside * wide[block], delta, wide[block])
        _put(out, (begin[:-1] + size * wide)[block] + inside * high[block], count, high[block])
        of = np.searchsorted(heads, lists)  # the first block of each list
        upto = np.append(of, len(heads))
        cuts = pa.array(begin[upto])
        lists_of = lambda x: pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(x.astype(np.int32)))
        data = pa.Array.from_buffers(pa.large_binary(), len(df), [None, cuts.buffers()[1], pa.py_buffer(out)]).cast(pa.binary())
        columns = [lists_of(doc[heads]), lists_of(doc[heads + size - 1]), lists_of(top), lists_of(wide * 8 + high), data]
        yield _rows(kind, [name] * len(df), names.cast(pa.binary()).cast(pa.string()), df, columns, [None] * len(df), [None] * len(df))


def _rows(kind, shard, term, df, columns, idents, lengths) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    made = [c if isinstance(c, pa.Array) else pa.array([c] * len(shard), t) for c, t in zip(columns, (ints, ints, ints, ints, pa.binary()), strict=True)]
    one = lambda x, t: pa.array(x, t) if x[0] is None else pa.ListArray.from_arrays(pa.array([0, len(x[0])], pa.int32()), x[0] if isinstance(x[0], pa.Array) else pa.array(x[0], pa.int64()))
    arrays = [pa.array(shard, pa.int64()), term if isinstance(term, pa.Array) else pa.array(term, pa.string()), pa.array(df, pa.int32()), *made, one(idents, pa.list_(kind)), one(lengths, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, ["shard", "term", "df", "firsts", "lasts", "tops", "widths", "data", "idents", "lengths"])


def build(docs: DataFrame, text: str = "text", ident: str = "doc_id", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """Index every document, in a table below the shared folder.

    A text without terms, empty or null has no entry. Every row is a document,
    rows of equal ident too. Only the two columns named are read. A shard holds
    `shard_bytes` of text or `shard_docs` documents, or one longer document.
    """
    n_docs, n_terms = corpus_counts(docs, text)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, shard, arrow = TaskContext.get().partitionId() << 32, _Shard(), None
        for batch in batches:
            arrow = batch.column(0).type
            data, offsets = words.flat(batch.column(1))
            for i, j in words.pieces(offsets):
                cut = offsets[i : j + 1]
                if shard.n and (shard.bytes + cut[-1] - cut[0] > shard_bytes or shard.n + j - i > shard_docs):
                    yield from shard.rows(name, n_docs, n_terms, arrow)
                    name, shard = name + 1, _Shard()
                shard.add(batch.column(0).slice(i, j - i), data[cut[0] : cut[-1]], cut - cut[0])
        if shard.n:
            yield from shard.rows(name, n_docs, n_terms, arrow)

    schema = f"shard long, term string, df int, firsts array<int>, lasts array<int>, tops array<int>, widths array<int>, data binary, idents array<{kind}>, lengths array<long>"
    path = scratch.place(docs.sparkSession, "postings")
    docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, schema).write.parquet(path)
    return Index(docs.sparkSession.read.schema(schema).parquet(path), path, n_docs, n_terms)


class _List:
    """A term's postings in a shard; blocks are decompressed when they are first asked for."""

    def __init__(self, firsts, lasts, tops, widths, data, df: int) -> None:
        self.firsts, self.lasts, self.tops, self.data = firsts, lasts, tops.astype(np.int64), data
        self.wide, self.high = widths >> 3, widths & 7
        self.size = np.full(len(firsts), BLOCK)
        self.df, self.size[-1] = df, df - BLOCK * (len(firsts) - 1)
        self.begin = np.concatenate([[0], np.cumsum(self.size * (self.wide + self.high))])
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if b not in self.held:
            n, w, h, at = int(self.size[b]), int(self.wide[b]), int(self.high[b]), int(self.begin[b])
            doc = np.cumsum(np.frombuffer(self.data, f"<u{w}", n, at), dtype=np.int64) + int(self.firsts[b])
            count = np.frombuffer(self.data, f"<u{h}", n, at + n * w).astype(np.int64)
            self.held[b] = doc, impact(count, m[doc])
        return self.held[b]

    def blocks(self, some, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(b, m) for b in some]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def best(lists: list[tuple[int, _List]], m: np.ndarray, k: int, score: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents (highest score first, then lowest place) of a shard and their scores.

    `lists` has the weight of each term, times its occurrences in the item, and
    its postings; `score` is zeros, one a document, and is left so.
    """
    heads = len(np.unique(np.concatenate([x.lasts for _, x in lists])))
    dense = [(w, x) for w, x in lists if x.df > heads]
    ends = np.unique(np.concatenate([np.array([len(m) - 1]), *(x.lasts for _, x in dense)]))
    bound = np.zeros(len(ends), np.int64)
    stands, known = [], []
    low = 0  # what documents must pass: one less than k documents are sure to have
    for w, x in lists:
        if len(x.tops) >= k:
            low = max(low, w * int(np.partition(x.tops, len(x.tops) - k)[len(x.tops) - k]) - 1)
        if x.df > heads:
            at = np.searchsorted(x.lasts, ends)
            there = at < len(x.lasts)
            there[there] = x.firsts[at[there]] <= ends[there]
            bound[there] += w * x.tops[at[there]]
            stands.append(np.where(there, at, -1))
        else:
            doc, add = x.blocks(range(len(x.tops)), m)
            window = np.searchsorted(ends, doc)
            first = np.flatnonzero(np.diff(window, prepend=-1))
            bound[window[first]] += w * np.maximum.reduceat(add, first)
            known.append((w, doc, add, window))
            if x.df >= k:
                low = max(low, w * int(np.partition(add, x.df - k)[x.df - k]) - 1)
    docs, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(ends):
        chosen = at + np.flatnonzero(bound[at : at + step] > low)
        at, step = at + step, step * 2
        if not len(chosen):
            continue
        inside = np.zeros(len(ends), bool)
        inside[chosen] = True
        seen = []
        for w, doc, add, window in known:
            here = inside[window]
            score[doc[here]] += w * add[here]
            seen.append(doc[here])
        for (w, x), stand in zip(dense, stands, strict=True):
            blocks = np.unique(stand[chosen])
            blocks = blocks[blocks >= 0].tolist()
            if blocks:
                doc, add = x.blocks(blocks, m)
                here = inside[np.searchsorted(ends, doc)]
                score[doc[here]] += w * add[here]
                seen.append(doc[here])
        found = np.unique(np.concatenate(seen))
        got = score[found]
        score[found] = 0
        found, got = found[got > low], got[got > low]
        docs, scores = np.concatenate([docs, found]), np.concatenate([scores, got])
        if len(docs) > k:
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
        if len(docs) == k:
            low = max(low, int(scores.min()))  # later documents stand behind those of equal score
    order = np.lexsort((docs, -scores))
    return docs[order], scores[order]


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, key, term, n): the terms of each item and their occurrences; rows of equal item and text are one item, told apart by `key` from others of equal item."""
    rows = items.select(F.col(item).alias("item"), F.sha2(F.concat_ws("", F.lit("."), F.col(text)), 256).alias("key"), F.col(text).alias("text")).dropDuplicates(["item", "key"])
    term = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(SEPARATORS), F.lit(0))).alias("term")
    return rows.select("item", "key", term).groupBy("item", "key", "term").agg(F.count("*").alias("n"))


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def _search(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """The best of each shard for a batch of items: (item, key, doc, score). The batch's size is bounded, so it may be sent to all tasks."""
    spark, kind = index.table.sparkSession, index.table.schema["idents"].dataType.elementType.simpleString()
    known = F.broadcast(terms.select("term").distinct())
    lists = index.table.where(F.col("term").isNotNull()).join(known, "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum("df").alias("df"))
    rows = terms.join(df, "term").select("item", "key", "term", (F.col("n") * weight(F.col("df"), index.n_docs)).alias("w")).where("w > 0").orderBy("item", "key", "term").collect()
    keys = list(dict.fromkeys((r["item"], r["key"]) for r in rows))
    number = {x: i for i, x in enumerate(keys)}
    queries: list[list[tuple[str, int]]] = [[] for _ in keys]
    for r in rows:
        queries[number[r["item"], r["key"]]].append((r["term"], r["w"]))
    shared = spark.sparkContext.broadcast(queries)
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        head = group.filter(pc.is_null(group["term"]))
        held = group.filter(pc.is_valid(group["term"]))
        idents = head["idents"].chunk(0).flatten()
        lengths = head["lengths"].chunk(0).flatten().to_numpy()
        m, score = norm(lengths, n_docs, n_terms), np.zeros(len(lengths), np.int64)
        lists = {}
        if held.num_rows:
            at = held["firsts"].chunk(0).offsets.to_numpy()
            flat = [held[c].chunk(0).values.to_numpy() for c in ("firsts", "lasts", "tops", "widths")]
            for i, (term, data, df) in enumerate(zip(held["term"].to_pylist(), held["data"], held["df"].to_pylist(), strict=True)):
                lists[term] = _List(*(x[at[i] : at[i + 1]] for x in flat), data.as_buffer(), df)
        number, docs, scores = [], [], []
        for i, query in enumerate(shared.value):
            if there := [(w, lists[t]) for t, w in query if t in lists]:
                doc, got = best(there, m, k, score)
                number.append(np.full(len(doc), i))
                docs.append(doc)
                scores.append(got)
        one = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return pa.table([pa.array(one(number)), idents.take(pa.array(one(docs))), pa.array(one(scores))], ["number", "doc", "score"])

    heads = index.table.where(F.col("term").isNull())
    found = heads.unionByName(lists.select(*heads.columns)).groupBy("shard").applyInArrow(run, f"number long, doc {kind}, score long")
    names = spark.createDataFrame([(i, *x) for i, x in enumerate(keys)], f"number long, item {terms.schema['item'].dataType.simpleString()}, key string")
    return found.join(F.broadcast(names), "number").select("item", "key", "doc", "score")


def search(index: Index, items: DataFrame, k: int = 20, item: str = "item_id", text: str = "text", ident: str = "doc_id", most: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, ident, score) of each item's k best documents, scores above 0 only, equal scores by ascending ident (null first).

    Items go to all tasks in batches of about `most` bytes of terms, however
    many there are; a single larger item is a batch. Items without terms or
    null have no rows. Two rows of equal item and text are one item; of equal
    item but other texts, each has its ranks.
    """
    terms = scratch.cut(item_terms(items, item, text), "items")
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    batches = max(1, -(-size // most))
    found = None
    for b in range(batches):
        some = terms if batches == 1 else terms.where(F.pmod(F.xxhash64("item", "key"), F.lit(batches)) == b)
        part = _search(index, some, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item", "key").orderBy(F.desc("score"), F.col("doc").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item").alias(item), "rank", F.col("doc").alias(ident), "score")

"""Token counts by a separator scan of flat, unindexed token files.

A token file is a run of little-endian ids; each document ends with the
end-of-document id, and nothing says where. Files are cut into blocks of a
fixed number of bytes with no regard to documents. A block is searched for
separators at once (vectorised) and yields the lengths of the documents that
end in it; the ids after its last separator belong to a document that ends in
a later block. A prefix scan over the blocks' summaries stitches these: it
numbers the documents and carries the open lengths to the block that closes
them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: The end-of-document id; of the 50k vocabularies it is the free one.
END = 50256
BLOCK = 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


#: Fixed value: the pattern by which the byte-level vocabularies split text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space runs too long for the pattern, whose look-ahead steps back one character at a time.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a public vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(found: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=found, special_tokens={})


def encode(tokenizer, text: str) -> list[int]:
    """Ids of a text of any length.

    By the pattern a run of white space is one piece, but for its last
    character if a word follows. Long runs are cut out there and encoded as the
    pieces they are.
    """
    out, at = [], 0
    for m in _BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += tokenizer.encode_ordinary(text[at : m.start()])
        out += tokenizer._encode_single_piece(text[m.start() : end])
        at = end
    return out + tokenizer.encode_ordinary(text[at:])


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, text: str = "text", ident: str = "doc_id", end: int = END, dtype: str = "<u2", pattern: str = PATTERN) -> DataFrame:
    """Tokenise `docs` into flat files below `folder`, one a task; return (file, nth, ident) of every document.

    A file's name has the task's attempt, so one that runs again never writes
    into what another reads; only files named in the result count. The
    vocabulary is read by the driver and broadcast; its size is that of a
    tokenizer's file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tokenizer, n, sink = TaskContext.get(), None, 0, None
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        store, base = _store(folder)
        try:
            for batch in batches:
                if sink is None:
                    store.create_dir(base, recursive=True)
                    sink, tokenizer = store.open_output_stream(f"{base}/{name}"), encoder(shared.value, pattern)
                for t in batch.column(1):
                    t = t.as_py()
                    sink.write(np.array([*(encode(tokenizer, t) if t else ()), end], dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], ["file", "nth", ident])
                n += batch.num_rows
        finally:
            if sink is not None:
                sink.close()

    return scratch.cut(docs.select(ident, text).mapInArrow(run, f"file string, nth long, `{ident}` {kind}"), "written")


def blocks(spark: SparkSession, folder: str, names: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(file, block, from, to) of the files of a folder (of those in `names`, by `file`); the folder is listed, the files aren't opened."""
    store, base = _store(folder)
    found = [(i.base_name, i.size) for i in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.is_file]
    files = spark.createDataFrame(found, "file string, size long").where("size > 0")
    if names is not None:
        files = files.join(names.select("file").distinct(), "file", "left_semi")
    return files.select("file", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("block", "from"), "size").select("file", "block", "from", F.least(F.col("from") + block, "size").alias("to"))


def _search(folder: str, end: int, dtype: str):
    kind = np.dtype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for file, block, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with store.open_input_file(f"{base}/{file}") as f:
                    ids = np.frombuffer(f.read_at(b - a, a), kind, (b - a) // kind.itemsize)
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                tail = len(ids) - 1 - (int(at[-1]) if len(at) else -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([tail], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(lengths))], ["file", "block", "ends", "tail", "lengths"]
                )

    return run


def token_counts(spark: SparkSession, folder: str, names: DataFrame | None = None, end: int = END, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, nth, n_tokens) of every document in the token files of a folder.

    Ids after a file's last separator are a document too, if there are any.
    Empty files and folders have no documents; two separators in a row stand
    for an empty document. `block` must be a multiple of the id's size.
    """
    if block % np.dtype(dtype).itemsize:
        raise ValueError("a block must hold whole ids")
    cuts = blocks(spark, folder, names, block)
    found = scratch.cut(cuts.repartition(F.col("file"), F.col("block")).mapInArrow(_search(folder, end, dtype), "file string, block int, ends long, tail long, lengths array<long>"), "found")
    # The scan: a file's blocks in order, a narrow row each. What is open before a block is what gathered since the last one with an end.
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "block", "ends", "tail").withColumn("nth", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    scan = scan.withColumn("closed", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(before))
    group = Window.partitionBy("file", F.coalesce("closed", F.lit(0))).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Within a group the first block is the one after an end: add the tail that this end left.
    scan = scan.withColumn("left", F.when(F.lag("ends").over(order) > 0, F.lag("tail").over(order)).otherwise(F.lit(0)))
    here = F.when(F.col("ends") == 0, F.col("tail")).otherwise(0)
    upto = Window.partitionBy("file", F.coalesce("closed", F.lit(0))).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    scan = scan.withColumn("open", F.sum("left").over(upto) + F.coalesce(F.sum(here).over(group), F.lit(0)))
    last = Window.partitionBy("file")
    scan = scan.withColumn("is_last", F.col("block") == F.max("block").over(last))
    joined = found.join(scan.select("file", "block", "nth", "open", "is_last"), ["file", "block"])
    rest = F.when(F.col("is_last"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))).otherwise(0)
    closed = joined.select("file", "nth", "open", F.posexplode("lengths").alias("i", "n")).select("file", (F.col("nth") + F.col("i")).alias("nth"), (F.col("n") + F.when(F.col("i") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))
    return closed.unionByName(joined.where(rest > 0).select("file", (F.col("nth") + F.col("ends")).alias("nth"), rest.alias("n_tokens")))


def count_documents(docs: DataFrame, vocabulary: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, file, nth, n_tokens) of every row: tokenised into flat files, then counted from these alone.

    A null or empty text has no tokens; a text that spells a special token is
    ordinary text; a null ident and repeated rows stay.
    """
    spark = docs.sparkSession
    folder = scratch.place(spark, "tokens")
    written = write_tokens(docs, folder, vocabulary, text, ident)
    return written.join(token_counts(spark, folder, written), ["file", "nth"]).select(ident, "file", "nth", "n_tokens")

"""Token ids in Parquet list columns.

A row is a document: its ident, the ids in its part before it, its number of
ids and the ids as a list. Rows stand in ascending order of ident over all
parts, one file a part. Ids are dictionary-coded, idents and offsets are
delta-coded; row groups, pages and the pages' rows are bounded, and Parquet's
column and offset indexes let a reader of some documents skip the pages of all
others. Readers of lengths never touch the ids.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: The end id of the dealt format, words held at a time and the longest one held, the largest tokenizer file that is broadcast, the most parts whose totals are, bytes of texts encoded at a time (one text at least).
END, HELD, LONG, LARGEST, PARTS, BATCH = 2, 1 << 17, 64, 64 << 20, 1 << 17, 6 << 20
#: Parquet settings: bytes and rows of a row group and of a page, encodings by column.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": 16 << 20,
    "parquet.block.row.count.limit": 1 << 16,
    "parquet.page.size": 64 << 10,
    "parquet.page.row.count.limit": 256,
    "parquet.dictionary.page.size": 1 << 20,
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


#: Words of Latin letters, ASCII digits and other signs but the apostrophe, and how the pattern below splits them once they are lowered. Up to U+024F nothing is changed by composition, and digits, letters and the rest are told alike by all versions of Unicode.
PLAIN, PIECES = "[!-&(-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]+", r"\pL+|\pN|[^\pL\pN\n]+"
#: The steps before the merges of the tokenizer whose words can be taken one by one: normaliser and pattern.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _by_words(settings: dict) -> bool:
    """Whether a tokenizer makes any white space one space, lowers, drops what its pattern doesn't match and merges the rest."""
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    last = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex")
    return (settings.get("normalizer") or {}).get("normalizers") == NORMAL and len(steps) == 2 and steps[0] == split and last


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


class Encoder:
    """Ids of texts, equal words of a batch encoded once.

    If the tokenizer works by words (see `_by_words`), no token spans a space
    or a line feed, and a text's ids are those of its words one after another.
    In plain words its pattern finds runs of letters, digits and runs of all
    else, which go to the library's merges; all other words go through all of
    the library. Both are held from batch to batch. For tokenizers of other
    kinds whole texts do.
    """

    def __init__(self, json_text: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        settings = json.loads(json_text)
        self.tokenizer, self.words = Tokenizer.from_str(json_text), _by_words(settings)
        self.model, self.added = self.tokenizer.model, {t["content"][0] for t in settings.get("added_tokens") or []}
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.held: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        seen = piece if piece.isascii() else self.bytes.pre_tokenize_str(piece)[0][0]
        return array("i", [t.id for t in self.model.tokenize(seen)]).tobytes()

    @staticmethod
    def _known(keys: pa.Array, held: dict[str, bytes], learn: Callable[[str], bytes]) -> pa.ListArray:
        """What `learn` makes of each of these keys, all of them distinct; it is asked only for those that aren't held."""
        own = keys.to_numpy(zero_copy_only=False).tolist()
        new = [k for k in own if k not in held]
        if len(held) + len(new) > HELD:  # what was met again lately stays
            for k in held.keys() - set(own):
                del held[k]
        held.update(zip(new, map(learn, new), strict=True))
        data = [held[k] for k in own]
        for k in [k for k in new if len(k) > LONG]:
            del held[k]
        return _lists(np.cumsum([0, *map(len, data)]) // 4, np.frombuffer(b"".join(data), np.int32))

    def _plain(self, words: pa.Array) -> pa.ListArray:
        """The ids of each of these plain words, of which there is one at least: each piece gets a line, and an empty one ends a word."""
        lines = pc.binary_join(_lists(np.array([0, len(words)]), words.cast(pa.string())), "\n")[0].as_py().lower()
        parts = pc.split_pattern(pc.replace_substring_regex(pa.array([lines]), PIECES, "\\0\n"), "\n").flatten().dictionary_encode()
        ids = self._known(parts.dictionary, self.pieces, self._merged).take(parts.indices)
        ends = np.flatnonzero(pc.equal(parts.indices, pc.index(parts.dictionary, "")).to_numpy(zero_copy_only=False))
        return _lists(np.concatenate([[0], ids.offsets.to_numpy()[ends]]), ids.values)

    def _distinct(self, words: pa.Array) -> pa.ListArray:
        """The ids of each of these words, all of them distinct."""
        plain = pc.match_substring_regex(words, f"^{PLAIN}$")
        for sign in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, sign))
        first = plain.to_numpy(zero_copy_only=False)
        rest = self._known(words.filter(pc.invert(plain)), self.held, self._whole)
        if not first.any():
            return rest
        place = np.where(first, np.cumsum(first) - 1, first.sum() + np.cumsum(~first) - 1)
        return pa.concat_arrays([self._plain(words.filter(plain)), rest]).take(pa.array(place))

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; none may be null."""
        if not self.words:
            ids = [self._whole(t) for t in texts.to_pylist()]
            return _lists(np.cumsum([0, *map(len, ids)]) // 4, np.frombuffer(b"".join(ids), np.int32))
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids = self._distinct(words.dictionary).take(words.indices)
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return _lists(ids.offsets.to_numpy()[upto], ids.values)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes (32 bits each, lowest first)."""
        return [x.values.to_numpy().tobytes() for x in self.lists(pa.array(texts, pa.string()))]


#: A worker's last encoder, kept from task to task with its words.
_LAST: dict[str, Encoder] = {}


def _encoder(json_text: str) -> Encoder:
    if json_text not in _LAST:
        _LAST.clear()
        _LAST[json_text] = Encoder(json_text)
    return _LAST[json_text]


def portions(texts: pa.Array, most: int = BATCH) -> Iterator[pa.Array]:
    """Runs of these texts of about so many bytes, one text at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    cuts = (np.flatnonzero(np.diff(total // most)) + 1).tolist()
    return (texts.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True) if a < b)


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", ident: str = "doc_id", end: int | None = END, layout: dict | None = None) -> None:
    """Encode every whole text and write the table in ascending order of ident.

    Rows are dealt by ranges of ident, then of a hash of the text, then of
    their place in the input, so that one ident may hold any share of the rows.
    A null ident comes first; rows of equal ident come in the order of that
    hash; a null text is empty and has the end id alone. Other columns aren't
    read. The tokenizer's file is read by the driver and broadcast
    (`LARGEST` at most; anything larger is refused).
    """
    with open(tokenizer, encoding="utf-8") as f:
        settings = f.read()
    if len(settings) > LARGEST:
        raise ValueError(f"{tokenizer} is larger than {LARGEST} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(settings)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, offset = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            encoder = encoder or _encoder(shared.value)
            at = 0
            for texts in portions(batch.column(1)):
                lists = encoder.lists(pc.fill_null(texts, ""))
                ids, upto = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
                if end is not None:
                    ids, upto = np.insert(ids, upto[1:], end), upto + np.arange(len(upto))
                n = np.diff(upto)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0).slice(at, len(n)), pa.array(offset + upto[:-1]), pa.array(n.astype(np.int32)), _lists(upto, ids)], ["part", "ident", "offset", "n_tokens", "ids"])
                offset, at = offset + int(upto[-1]), at + len(n)

    rows = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("ident").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("ident", "text")
    coded = rows.mapInArrow(run, f"part int, ident {kind}, offset long, n_tokens int, ids array<int>").withColumnRenamed("ident", ident)
    settings = LAYOUT | {f"parquet.enable.dictionary#{ident}": "false"} | (layout or {})
    coded.write.options(**{k: str(v) for k, v in settings.items()}).parquet(path)


def read(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """The rows of a table; a condition on idents reaches the page indexes."""
    rows = spark.read.parquet(path)
    return rows if wanted is None else rows.where(wanted)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids of all parts before each; a row a file, from the lengths alone.

    Parts are as many as files, so their totals go through one task, as the
    list of files goes through the driver.
    """
    totals = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return scratch.cut(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "starts")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        at = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n = np.diff(at).astype(np.int64)
        if (n != batch.column(3).to_numpy()).any():
            raise ValueError("a list of ids is not as long as its row says")
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(sums, pa.int64())], ["part", "ident", "offset", "n_tokens", "ids_crc32"])


def summary(spark: SparkSession, path: str, ident: str = "doc_id") -> DataFrame:
    """(ident, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all before it, the checksum is of its ids as little-endian 32-bit integers."""
    rows = read(spark, path)
    kind = rows.schema[ident].dataType.simpleString()
    told = rows.select("part", F.col(ident).alias("ident"), "offset", "n_tokens", "ids").mapInArrow(_checksums, f"part int, ident {kind}, offset long, n_tokens long, ids_crc32 long")
    base = starts(spark, path)
    if base.count() <= PARTS:
        base = F.broadcast(base)
    return told.join(base, "part").select(F.col("ident").alias(ident), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def tokens(spark: SparkSession, path: str, wanted: Column, ident: str = "doc_id") -> DataFrame:
    """(ident, ids) of some documents; pages of others are skipped by the indexes."""
    return read(spark, path, wanted).select(ident, "ids")

"""Fill-in-the-middle rearrangement of documents, cut at code points.

Code points come from the tokenizers library: a Split pre-tokenizer with a
one-character pattern and isolated matches returns one (start, end) pair a code
point, with no training and no vocabulary. The length of that offset array is
n; the offsets of two ranks cut the text in three.

A match looks at one code point only, so the offsets of a text are those of its
pieces one after another. Texts are cut into short pieces, and equal pieces are
matched once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Where texts are cut into pieces: after common letters and spaces, so that few pieces differ; anywhere in what has none.
CUTS = re.compile(r"[^ aeiou]{0,8}[ aeiou]|[^ aeiou]{1,8}")
#: Pieces held at a time, code points after which a batch is given back.
HELD, BATCH = 1 << 17, 8 << 20


class Units:
    """Cuts texts into code points by isolated matches, and equal pieces of texts once."""

    def __init__(self) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(r"[\s\S]"), behavior="isolated")
        self.held: dict[str, int] = {}

    def offsets(self, piece: str) -> list[tuple[int, int]]:
        """(start, end) of each unit of a piece; the matches must cover it."""
        found = [at for _, at in self.split.pre_tokenize_str(piece)]
        if found[-1][1] != len(piece):
            raise ValueError("the matches don't cover a text")
        return found

    def pieces(self, text: str) -> tuple[list[str], np.ndarray]:
        """The pieces of a text, and the number of units before each and in all."""
        parts = CUTS.findall(text)
        if len(self.held) > HELD:
            self.held.clear()
        for p in set(parts).difference(self.held):
            self.held[p] = len(self.offsets(p))
        before = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(self.held.__getitem__, parts), np.int64, len(parts)), out=before[1:])
        return parts, before

    def offset(self, parts: list[str], before: np.ndarray, rank: int) -> int:
        """Where the unit of a rank starts, or the end of the text."""
        if rank >= before[-1]:
            return sum(map(len, parts))
        at = int(np.searchsorted(before, rank, "right")) - 1
        return sum(map(len, parts[:at])) + self.offsets(parts[at])[rank - int(before[at])][0]


def _check(marks: tuple[str, str, str]) -> None:
    if len(set(marks)) != 3 or not all(re.fullmatch("<[^<>]+>", m) for m in marks):
        raise ValueError("marks must differ and be one word in angle brackets each, so that they can be told apart in any output")


def rearrange(docs: DataFrame, text: str = "text", ident: str = "doc_id", seed: str = "1", plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(ident, n, form, prefix_chars, middle_chars, output) of every row.

    Cuts and form follow from the SHA-256 of `seed`, a colon and the ident in
    decimal: its first two 32-bit groups modulo n + 1 are the cuts, the third
    leaves `plain` in 100 texts as they are, the fourth writes `spm` in 100 of
    the others suffix first. Texts that are empty or hold a mark stay plain.

    A null text counts as empty, a null ident as no digits; repeated rows stay,
    and rows of equal ident and text get the same output. Only the two columns
    named are read, so other columns' names don't matter. Rows are independent:
    nothing is shuffled.
    """
    _check(marks)
    kind = docs.schema[ident].dataType.simpleString()
    pre, suf, mid = marks

    def one(units: Units, key, t: str) -> tuple:
        parts, before = units.pieces(t)
        n = int(before[-1])
        digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
        if not n or h3 % 100 >= 100 - plain or any(m in t for m in marks):
            return n, "plain", None, None, t
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = units.offset(parts, before, low), units.offset(parts, before, high)
        prefix, middle, suffix = t[:a], t[a:b], t[b:]
        if h4 % 100 < spm:
            return n, "spm", low, high - low, f"{suf}{suffix}{pre}{prefix}{mid}{middle}"
        return n, "psm", low, high - low, f"{pre}{prefix}{suf}{suffix}{mid}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            idents, rows, size, done = batch.column(0), [], 0, 0
            for i, (key, t) in enumerate(zip(idents, batch.column(1), strict=True)):
                rows.append(one(units, key.as_py(), t.as_py() or ""))
                size += len(rows[-1][4])
                if size >= BATCH or i + 1 == batch.num_rows:
                    n, form, prefix, middle, output = zip(*rows, strict=True)
                    long = pa.int64()
                    yield pa.RecordBatch.from_arrays([idents.slice(done, len(rows)), pa.array(n, long), pa.array(form, pa.string()), pa.array(prefix, long), pa.array(middle, long), pa.array(output, pa.string())], ["ident", "n", "form", "prefix_chars", "middle_chars", "output"])
                    rows, size, done = [], 0, i + 1

    out = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, f"ident {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("ident", ident)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, rebuilt from an output and its form alone."""
    _check(marks)
    pre, suf, mid = (rf"\Q{m}\E" for m in marks)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.split(output, first, 2)[1]
        rest = F.split(head, second, 2)
        tail = F.split(rest[1], mid, 2)
        return rest[0], tail[0], tail[1]

    prefix, suffix, middle = parts(pre, suf)
    suffix2, prefix2, middle2 = parts(suf, pre)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)

"""Scalar functions on integers, bits and little-endian bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian(raw: Column, at: int | Column, size: int) -> Column:
    """The unsigned integer of `size` bytes at the 0-based offset `at`, as long; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    piece = F.substring(raw, at + 1, F.lit(size))
    return F.when(F.octet_length(piece) == size, F.conv(_reversed_hex(piece, size), 16, 10).cast("long"))


def _reversed_hex(piece: Column, size: int) -> Column:
    h = F.hex(piece)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def control_id(payload: Column) -> Column:
    """The four characters of a control's id, stored in reverse."""
    return F.reverse(F.decode(F.substring(payload, 1, 4), "ISO-8859-1"))


def bit_flags(value: Column, bits: int = 16) -> Column:
    """The bits of an integer, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(value, i).cast("int"))


def color(value: Column) -> Column:
    """A colour stored as red, green, blue from the lowest byte, as #RRGGBB; all bits set is none."""
    part = lambda shift: F.lpad(F.hex(F.shiftright(value, shift).bitwiseAND(255)), 2, "0")
    return F.when(value == 0xFFFFFFFF, F.lit("none")).otherwise(F.concat(F.lit("#"), part(0), part(8), part(16)))


def record_header(value: Column) -> Column:
    """Tag, level and size of a record header of 32 bits; a size of 4095 is continued in the next four bytes."""
    return F.struct(value.bitwiseAND(0x3FF).alias("tag_id"), F.shiftright(value, 10).bitwiseAND(0x3FF).alias("level"), F.shiftright(value, 20).bitwiseAND(0xFFF).alias("size"))


def column_name(index: Column) -> Column:
    """Spreadsheet column name of a 0-based index: A to Z, AA, ...; any index of up to seven letters."""
    n = index.cast("long") + 1
    state = F.aggregate(
        F.sequence(F.lit(0), F.lit(6)), F.struct(n.alias("n"), F.lit("").alias("s")),
        lambda a, _: F.when(a.n <= 0, a).otherwise(F.struct(F.floor((a.n - 1) / 26).cast("long").alias("n"), F.concat(F.chr((a.n - 1) % 26 + 65), a.s).alias("s"))),
    )
    return state.s


def utf16_field(raw: Column, at: int | Column) -> Column:
    """A UTF-16LE text with its length in units before it."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.decode(F.substring(raw, at + 3, (little_endian(raw, at, 2) * 2).cast("int")), "UTF-16LE")


def integer_or(value: Column, default: int) -> Column:
    """An integer literal, else the default."""
    return F.coalesce(F.trim(value).try_cast("long"), F.lit(default))


def a1_range(sheet: Column, column: Column, points: Column) -> Column:
    """The absolute range of a chart series: its column from row 2, one row a point and at least one."""
    name = column_name(column)
    return F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'!$"), name, F.lit("$2:$"), name, F.lit("$"), (F.greatest(points, F.lit(1)) + 1).cast("string"))


def sheet_anchor(formula: Column) -> Column:
    """The sheet that a formula names before its `!`, without quotes; null if it names none."""
    text = F.trim(formula)
    name = F.trim(F.substring_index(text, "!", 1))
    quoted = name.startswith("'") & name.endswith("'") & (F.length(name) >= 2)
    bare = F.when(quoted, F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit("''"), F.lit("'"))).otherwise(name)
    return F.when(F.contains(text, F.lit("!")), F.nullif(bare, F.lit("")))


def rescaled(value: Column, old: Column, new: Column) -> Column:
    """A length that grows with its frame from `old` to `new`, half to even; as it is where the old frame has no size."""
    return F.when((old > 0) & new.isNotNull(), F.bround(value * new / old).cast("long")).otherwise(value.cast("long"))

"""Payloads of binary records as structs: columns of built-in functions, no Python on the rows.

Fixed layouts are tables of (name, offset, kind); texts and lists whose place
depends on what comes before are found by folding over their counts. A field
that a payload is too short for is null, unless the layout says that missing
bytes count as zeros. A null payload gives nulls, but for the names and marks
that stand for a code that is missing. What depends on other fields is bound by
`let`, as lambdas would repeat it.

`decode` takes the records of a kind from `binary.records`; DECODERS names the kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numbers import little_endian
from foliospark.functions.text import noted
from foliospark.sources.binary import tag

#: Names of codes in records.
LINE_STYLES = {0: "SOLID"}
END_CAPS = {0: "ROUND", 1: "FLAT"}
ARROWS = {0: "NORMAL"}
ARROW_SIZES = dict(enumerate(f"{a}_{b}" for a in ("SMALL", "MEDIUM", "LARGE") for b in ("SMALL", "MEDIUM", "LARGE")))
OUTLINES = {0: "NORMAL", 1: "OUTER", 2: "INNER"}
TAB_TYPES = {0: "LEFT", 1: "RIGHT", 2: "CENTER", 3: "DECIMAL"}
TAB_LEADERS = {0: "NONE", 1: "SOLID", 2: "DOT", 3: "DASH", 4: "LONG_DASH"}
ALIGNMENTS = {0: "JUSTIFY", 1: "LEFT", 2: "RIGHT", 3: "CENTER", 4: "DISTRIBUTE", 5: "DISTRIBUTE_SPACE"}
EFFECTS = {0: "REAL_PIC", 1: "GRAY_SCALE"}
PAGES = {0: "BOTH", 1: "EVEN", 2: "ODD"}
POSITIONS = dict(enumerate(("NONE", "TOP_LEFT", "TOP_CENTER", "TOP_RIGHT", "BOTTOM_LEFT", "BOTTOM_CENTER", "BOTTOM_RIGHT", "OUTSIDE_TOP", "OUTSIDE_BOTTOM", "INSIDE_TOP", "INSIDE_BOTTOM")))
NUMBER_TYPES = dict(enumerate((
    "DIGIT", "CIRCLED_DIGIT", "ROMAN_CAPITAL", "ROMAN_SMALL", "LATIN_CAPITAL", "LATIN_SMALL", "CIRCLED_LATIN_CAPITAL", "CIRCLED_LATIN_SMALL", "HANGUL_SYLLABLE", "CIRCLED_HANGUL_SYLLABLE",
    "HANGUL_JAMO", "CIRCLED_HANGUL_JAMO", "HANGUL_PHONETIC", "IDEOGRAPH", "CIRCLED_IDEOGRAPH", "DECAGON_CIRCLE_HANGUL", "DECAGON_CIRCLE_HANJA",
)))
NOTE_LINES = {1: "SOLID", 2: "DOT", 3: "DASH"}
NOTE_WIDTHS = dict(enumerate(f"{w} mm" for w in ("0.1", "0.12", "0.15", "0.2", "0.25", "0.3", "0.4", "0.5", "0.6", "0.7", "1.0", "1.5", "2.0", "3.0", "4.0", "5.0")))
NOTE_NUMBERINGS = {0: "CONTINUOUS", 1: "ON_SECTION", 2: "ON_PAGE"}
FOOTNOTE_PLACES = {0: "EACH_COLUMN", 1: "MERGED_COLUMN", 2: "RIGHT_MOST_COLUMN"}
ENDNOTE_PLACES = {0: "END_OF_DOCUMENT", 1: "END_OF_SECTION"}
SCRIPTS = ("hangul", "latin", "hanja", "japanese", "other", "symbol", "user")
#: A component that starts so is a connecting line's.
CONNECT_LINE = b"loc$loc$"

Fields = dict[str, Column]


# -- scalars ---------------------------------------------------------------------------------


def signed(raw: Column, at: int | Column, size: int) -> Column:
    """The two's-complement integer of `size` bytes at `at`; null past the end."""
    v = little_endian(raw, at, size)
    return F.when(v >= 1 << (8 * size - 1), v - (1 << 8 * size)).otherwise(v)


def blue_first(value: Column) -> Column:
    """A colour whose lowest byte is blue, as #RRGGBB."""
    return F.concat(F.lit("#"), F.lpad(F.hex(value.bitwiseAND(0xFFFFFF)), 6, "0"))


def blue_first_or_none(value: Column) -> Column:
    return F.when(value == 0xFFFFFFFF, F.lit("none")).otherwise(blue_first(value))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def padded(raw: Column, size: int) -> Column:
    """The first `size` bytes, zeros where there are none."""
    return F.rpad(raw, size, F.lit(b"\0"))


def bits(value: Column, at: int, width: int = 1) -> Column:
    return F.shiftright(value, at).bitwiseAND((1 << width) - 1)


def flag(value: Column, at: int) -> Column:
    return bits(value, at) == 1


def named(value: Column, names: dict[int, str], other: str | None = None) -> Column:
    """A code's name, else `other`, else CODE_n."""
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return F.coalesce(F.element_at(table, value.try_cast("int")), F.lit(other) if other else F.concat(F.lit("CODE_"), value.cast("string")))


def flags(value: Column, width: int = 32) -> Column:
    """Whether each bit is set, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(value, i) == 1)


def numbers(raw: Column, size: int) -> Column:
    """All whole unsigned integers of `size` bytes."""

    def found(raw: Column) -> Column:
        n = F.floor(F.octet_length(raw) / size).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: little_endian(raw, i * size, size))).when(n == 0, F.array().cast("array<bigint>"))

    return let(raw, found)


def rest(raw: Column, at: int | Column) -> Column:
    """Bytes from `at` on; null if there are none."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(raw) > at, F.substring(raw, at.cast("int") + 1, F.octet_length(raw)))


def utf16(raw: Column) -> Column:
    """UTF-16LE text; surrogates without their other half are dropped, as strings can't hold them."""
    # Units are four hex digits, their high byte last; every match begins where the one before ended.
    digits = F.hex(raw)
    pairs = F.regexp_replace(digits, r"\G(?:(..D[89AB]..D[C-F]|..(?!D[89A-F])..)|..D[89A-F])", "$1")
    return F.decode(F.when(digits.rlike("D[89A-F]"), F.unhex(pairs)).otherwise(raw), "UTF-16LE")


def text(raw: Column, at: int | Column, units: Column) -> Column:
    """`units` UTF-16LE units from `at`, or the whole ones there are."""
    at = (F.lit(at) if isinstance(at, int) else at).cast("int")
    there = F.floor((F.octet_length(raw) - at) / 2)
    return F.coalesce(F.when(there > 0, utf16(F.substring(raw, at + 1, (F.least(units, there) * 2).cast("int")))), F.when(raw.isNotNull(), F.lit("")))


def counted(raw: Column, at: int | Column) -> tuple[Column, Column]:
    """A text after its length in units, and where it ends (where it begins if there is no length)."""
    at = (F.lit(at) if isinstance(at, int) else at).cast("int")
    units = little_endian(raw, at, 2)
    end = F.when(units.isNull(), at).otherwise(F.least(at + 2 + units * 2, F.octet_length(raw))).cast("int")
    return text(raw, at + 2, F.coalesce(units, F.lit(0))), end


def whole_text(raw: Column) -> Column:
    """All of a payload as text without NULs; null if nothing is left."""
    return F.nullif(F.replace(text(raw, 0, F.octet_length(raw)), F.lit("\0"), F.lit("")), F.lit(""))


def laid_out(raw: Column, layout: str) -> Fields:
    """Fields by a layout: words `name@offset:kind`; kinds u1 u2 u4, i1 i2 i4, and c (blue-first colour)."""
    out = {}
    for word in layout.split():
        name, _, place = word.partition("@")
        at, _, kind = place.partition(":")
        out[name] = blue_first(little_endian(raw, int(at), 4)) if kind == "c" else (signed if kind[0] == "i" else little_endian)(raw, int(at), int(kind[1]))
    return out


def struct(fields: Fields) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _raw(p: Column) -> Fields:
    return {"u16_values": numbers(p, 2), "u32_values": numbers(p, 4)}


def _points(p: Column, names: tuple[str, ...], at: int) -> Fields:
    return {n: struct(laid_out(p, f"x@{at + 8 * i}:i4 y@{at + 8 * i + 4}:i4")) for i, n in enumerate(names)}


def _by_script(p: Column, at: int, kind: str) -> Column:
    step = int(kind[1])
    return struct(laid_out(p, " ".join(f"{s}@{at + step * i}:{kind}" for i, s in enumerate(SCRIPTS))))


def _if_long(p: Column, size: int, value: Column) -> Column:
    return F.when(F.octet_length(p) >= size, value)


# -- lines and fills -------------------------------------------------------------------------


def line_flags(value: Column) -> Column:
    codes = {"line_style": (0, 6, LINE_STYLES), "end_cap": (6, 4, END_CAPS), "head_style": (10, 6, ARROWS), "tail_style": (16, 6, ARROWS), "head_size": (22, 4, ARROW_SIZES), "tail_size": (26, 4, ARROW_SIZES)}
    out = {}
    for name, (at, width, names) in codes.items():
        out[f"{name}_code"] = bits(value, at, width)
        out[name] = named(bits(value, at, width), names)
    return struct(out | {"head_fill": flag(value, 30), "tail_fill": flag(value, 31)})


def line_info(p: Column) -> Fields:
    v = padded(p, 11)
    out = laid_out(v, "color@0:c width@4:u2 attributes@6:u4")
    return out | {"attribute_flags": line_flags(out["attributes"]), "outline_style_code": little_endian(v, 10, 1), "outline_style": named(little_endian(v, 10, 1), OUTLINES)}


def border_line(p: Column, at: int = 0) -> Column:
    v = padded(F.substring(p, at + 1, 6), 6)
    out = laid_out(v, "style_code@0:u1 width_code@1:u1 color@2:c")
    return struct(out | {"style": named(out["style_code"], LINE_STYLES)})


def shape_fill(p: Column) -> Fields:
    kind = little_endian(p, 0, 4)
    solid = lambda c: F.when(flag(kind, 0), c)
    return {
        "fill_type": kind, "color_pattern": flag(kind, 0), "image_fill": flag(kind, 1), "gradation_fill": flag(kind, 2),
        **{n: solid(c) for n, c in laid_out(p, "face_color@4:c hatch_color@8:c pattern_flags@12:u4 pattern_alpha@16:u1").items()},
        "tail": F.when(flag(kind, 0), rest(p, 17)).otherwise(rest(p, 4)), **_raw(p),
    }


# -- document information --------------------------------------------------------------------


def face_name(p: Column) -> Fields:
    size = F.octet_length(p)
    kinds = ("family_type", "serif_style", "weight", "proportion", "contrast", "stroke_variation", "arm_style", "letterform", "midline", "x_height")

    def name(head: Column) -> Column:
        found, end = counted(p, 1)
        marks = {"has_substitute_font": flag(head, 7), "has_font_information": flag(head, 6), "has_default_font": flag(head, 5), "has_metric_font": flag(head, 4)}
        return struct({"flags": head, "name": found, **marks, "end": end})

    def substitute(a: Column) -> Column:
        there = a["has_substitute_font"] & (a["end"] < size)
        found, end = counted(p, a["end"] + 1)
        return struct({"a": a, "type": F.when(there, little_endian(p, a["end"], 1)), "name": F.when(there, found), "end": F.when(there, end).otherwise(a["end"])})

    def information(b: Column) -> Column:
        there = b["a"]["has_font_information"] & (b["end"] + 10 <= size)
        info = F.when(there, F.struct(*[little_endian(p, b["end"] + i, 1).alias(k) for i, k in enumerate(kinds)]))
        return struct({"b": b, "info": info, "end": F.when(there, b["end"] + 10).otherwise(b["end"])})

    def default(c: Column) -> Column:
        a, (found, end) = c["b"]["a"], counted(p, c["end"])
        there = a["has_default_font"]
        return struct({
            **{n: a[n] for n in ("flags", "name", "has_substitute_font", "has_font_information", "has_default_font", "has_metric_font")}, "substitute_font_type": c["b"]["type"],
            "substitute_font_name": c["b"]["name"], "font_information": c["info"], "default_font_name": F.when(there, found), "tail": let(F.when(there, end).otherwise(c["end"]), lambda e: rest(p, e)),
        })

    head = F.coalesce(little_endian(p, 0, 1), F.when(p.isNotNull(), F.lit(0)))
    found = let(let(let(let(head, name), substitute), information), default)
    return {n: found[n] for n in ("flags", "name", "has_substitute_font", "has_font_information", "has_default_font", "has_metric_font", "substitute_font_type", "substitute_font_name", "font_information", "default_font_name", "tail")}


def border_fill(p: Column) -> Fields:
    v = F.coalesce(little_endian(p, 0, 2), F.when(p.isNotNull(), F.lit(0)))
    sides = {s: _if_long(p, 32, border_line(p, 2 + 6 * i)) for i, s in enumerate(("left", "right", "top", "bottom", "diagonal"))}
    fill = little_endian(p, 32, 2)
    inner = F.coalesce(rest(p, 34), F.lit(b""))
    marks = {"three_d": flag(v, 0), "shadow": flag(v, 1), "slash": bits(v, 2, 3), "backslash": bits(v, 5, 3), "crooked_slash": flag(v, 8), "crooked_backslash": flag(v, 9), "counter_slash": flag(v, 10)}
    return {"border_flags": v, **marks, **sides, "fill_flags": fill, "color_pattern": flag(fill, 0), "image_fill": flag(fill, 1), "gradation_fill": flag(fill, 2), "fill": _if_long(p, 34, let(inner, lambda x: struct(shape_fill(x)))), **_raw(p)}


def char_shape(p: Column) -> Fields:
    v = F.coalesce(little_endian(p, 46, 4), F.when(p.isNotNull(), F.lit(0)))
    effects = {"emboss": 13, "engrave": 14, "superscript": 15, "subscript": 16, "use_font_space": 29, "use_kerning": 30}
    colors = {n: blue_first_or_none(little_endian(p, at, 4)) for n, at in (("text_color", 54), ("shade_color", 60), ("shadow_color", 64))}
    return {
        "font_refs": _by_script(padded(p, 14), 0, "u2"), "ratios": _if_long(p, 28, _by_script(p, 14, "u1")), "spacings": _if_long(p, 28, _by_script(p, 21, "i1")),
        "relative_sizes": _if_long(p, 42, _by_script(p, 28, "u1")), "position_offsets": _if_long(p, 42, _by_script(p, 35, "i1")),
        "base_size": _if_long(p, 50, little_endian(p, 42, 4)), "attributes": little_endian(p, 46, 4), "attribute_bits": F.when(little_endian(p, 46, 4).isNotNull(), flags(v)),
        **{n: flag(v, i) for n, i in effects.items()}, "shadow_offset": _if_long(p, 54, struct(laid_out(p, "x@50:i2 y@52:i2"))), **colors,
        "border_fill_id": little_endian(p, 68, 4), "tail": F.when(F.octet_length(p) > 72, rest(p, 72)).otherwise(F.when(F.octet_length(p) < 72, rest(p, 68))), **_raw(p),
    }


def tab_def(p: Column) -> Fields:
    v = little_endian(padded(p, 4), 0, 4)
    there = F.floor((F.octet_length(p) - 8) / 8)
    n = F.least(F.coalesce(little_endian(p, 4, 4), F.lit(0)), F.greatest(there, F.lit(0))).cast("int")

    def stop(i: Column) -> Column:
        kind, leader = little_endian(p, 12 + 8 * i, 1), little_endian(p, 13 + 8 * i, 1)
        return struct({"position": signed(p, 8 + 8 * i, 4), "tab_type": kind, "tab_type_name": named(kind, TAB_TYPES), "leader_type": leader, "leader_type_name": named(leader, TAB_LEADERS), "reserved": little_endian(p, 14 + 8 * i, 2)})

    tabs = F.slice(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), stop), F.lit(1), n)
    return {"attributes": v, "auto_tab_left": flag(v, 0), "auto_tab_right": flag(v, 1), "tabs": tabs, "tail": _if_long(p, 8, rest(p, 8 + 8 * n))}


def numbering(p: Column) -> Fields:
    """Up to seven levels, each with a text; then a word and the numbers they start with."""
    size = F.octet_length(p)
    level_type = "array<struct<para_head:bigint,width_adjust:bigint,text_offset:bigint,char_pr_id:bigint,format_length:bigint,format:string>>"

    def step(a: Column, _: Column) -> Column:
        at = a["at"]
        ref, (form, end) = signed(p, at + 8, 4), counted(p, at + 12)
        level = struct({"para_head": little_endian(p, at, 4), "width_adjust": signed(p, at + 4, 2), "text_offset": signed(p, at + 6, 2), "char_pr_id": F.when(ref >= 0, ref), "format_length": little_endian(p, at + 12, 2), "format": form})
        return F.when(at + 14 > size, a).otherwise(F.struct(end.alias("at"), F.concat(a["levels"], F.array(level)).cast(level_type).alias("levels")))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(F.lit(0).alias("at"), F.array().cast(level_type).alias("levels")), step)

    def remains(d: Column) -> Column:
        at = d["at"]
        left = F.coalesce(rest(p, F.when(at + 2 <= size, at + 2).otherwise(at)), F.when(p.isNotNull(), F.lit(b"")))
        return struct({"levels": d["levels"], "unknown_short": little_endian(padded(F.coalesce(rest(p, at), F.lit(b"")), 2), 0, 2), "left": left})

    def starts(d: Column) -> Column:
        found = numbers(d["left"], 4)
        return struct({"levels": d["levels"], "unknown_short": d["unknown_short"], "start_numbers": found, "tail": rest(d["left"], F.floor(F.octet_length(d["left"]) / 4) * 4)})

    found = let(let(done, remains), starts)
    return {n: found[n] for n in ("levels", "unknown_short", "start_numbers", "tail")} | _raw(p)


def bullet(p: Column) -> Fields:
    ref, char = signed(p, 8, 4), _if_long(p, 14, text(p, 12, F.lit(1)))
    char = F.when(char == "", F.lit("")).otherwise(char)
    head = laid_out(p, "flags@0:u4 width_adjust@4:i2 text_offset@6:i2")
    return head | {"flag_bits": F.when(head["flags"].isNotNull(), flags(head["flags"])), "char_pr_id": F.when(ref >= 0, ref), "bullet_char": char, "tail": rest(p, 14), **_raw(p)}


def para_shape(p: Column) -> Fields:
    v = little_endian(padded(p, 4), 0, 4)
    marks = {"snap_to_grid": 7, "break_keep_word": 8, "widow_orphan": 9, "keep_with_next": 10, "keep_lines": 11, "page_break_before": 12, "line_wrap_squeeze": 15, "auto_space_latin": 23, "auto_space_digit": 24}
    first, later = signed(p, 24, 4), signed(p, 50, 4)
    ref = little_endian(p, 30, 2)
    return {
        "attributes": v, "alignment_code": bits(v, 0, 3), "alignment": named(bits(v, 0, 3), ALIGNMENTS), **{n: flag(v, i) for n, i in marks.items()},
        "margins": _if_long(p, 24, struct(laid_out(p, "intent@4:i4 left@8:i4 right@12:i4 prev@16:i4 next@20:i4"))), "line_spacing_primary": first, "tab_def_id": little_endian(p, 28, 2),
        "numbering_bullet_id": ref, "border_fill_id": little_endian(p, 32, 2), "border_offsets": _if_long(p, 42, struct(laid_out(p, "left@34:u2 right@36:u2 top@38:u2 bottom@40:u2"))),
        **laid_out(p, "attribute2@42:u4 attribute3@46:u4"), "line_spacing": F.coalesce(later, first), "heading_type": F.when(ref > 0, "NUMBER").otherwise("NONE"), "u32_values": numbers(p, 4),
    }


# -- lists, memos, objects -------------------------------------------------------------------


def list_header(p: Column) -> Fields:
    v = little_endian(p, 4, 4)
    return {"paragraph_count": little_endian(p, 0, 4), "property_flags": v, "property_bits": F.when(v.isNotNull(), flags(v)), **_raw(p)}


def properties(p: Column) -> Column:
    """Own notes kept as a text `NAME_META;key=value;...`, as a map; empty where there are none."""
    found = text(p, 0, F.octet_length(p))
    return F.when(found.rlike(r"^[A-Z_]+_META(;|$)"), noted(F.regexp_replace(found, r"^[A-Z_]+_META;?", ""))).otherwise(F.create_map().cast("map<string,string>"))


def memo_shape(p: Column) -> Fields:
    noted = properties(p)
    return {"width": noted["width"].try_cast("int"), "line_width": noted["lineWidth"].try_cast("int"), **{n: noted[k] for n, k in (("line_type", "lineType"), ("line_color", "lineColor"), ("fill_color", "fillColor"), ("active_color", "activeColor"), ("memo_type", "memoType"))}, "properties": noted, "text": whole_text(p), **_raw(p)}


def opaque(p: Column) -> Fields:
    """Payloads read as text and numbers only: forms, memo lists, charts."""
    return {"raw": p, "text": whole_text(p), **_raw(p)}


def track_change(p: Column) -> Fields:
    v = little_endian(p, 0, 4)
    return {"flags": v, "flag_bits": F.when(v.isNotNull(), flags(v)), "text": whole_text(p), **_raw(p)}


def track_change_author(p: Column) -> Fields:
    name, end = counted(p, 0)
    return {"name": name, "tail": rest(p, end), **_raw(p)}


# -- shapes ----------------------------------------------------------------------------------


def shape_component(p: Column) -> Fields:
    """Bounds, line, fill and rotation; a centre only where it isn't the middle of the bounds."""
    bounds = laid_out(padded(p, 36), "x@20:u4 y@24:u4 width@28:u4 height@32:u4")
    turn = laid_out(p, "angle@40:u2 x@42:i4 y@46:i4")
    turn = {n: F.coalesce(_if_long(p, 50, c), F.lit(0)) for n, c in turn.items()}
    moved = (turn["x"] != F.floor(bounds["width"] / 2)) | (turn["y"] != F.floor(bounds["height"] / 2))
    line = laid_out(p, "line_color@196:c line_width@200:u2")
    return {
        "reference_bounds": struct(bounds), **{n: _if_long(p, 202, c) for n, c in line.items()}, "fill_color": _if_long(p, 217, blue_first(little_endian(p, 213, 4))),
        "angle": F.when((turn["angle"] != 0) | moved, turn["angle"]), "center": F.when(moved, F.struct(turn["x"].alias("x"), turn["y"].alias("y"))),
        "is_connect_line": F.startswith(p, F.lit(CONNECT_LINE)),
    }


def line(p: Column) -> Fields:
    v = padded(p, 20)
    return _points(v, ("start", "end"), 0) | {"attributes": little_endian(v, 16, 4), **_raw(p)}


def rectangle(p: Column) -> Fields:
    return {"corner_radius": little_endian(padded(p, 4), 0, 4), "raw": p, **_raw(p)}


def ellipse(p: Column) -> Fields:
    v = padded(p, 60)
    return {"arc_flags": signed(v, 0, 4), **_points(v, ("center", "axis1", "axis2", "start", "end", "start_2", "end_2"), 4), **_raw(p)}


def arc(p: Column) -> Fields:
    v = padded(p, 28)
    return {"arc_type": signed(v, 0, 4), **_points(v, ("center", "axis1", "axis2"), 4), **_raw(p)}


def polygon(p: Column) -> Fields:
    """All x, then all y; points are those that have both."""
    n = little_endian(padded(p, 2), 0, 2).cast("int")
    there = F.greatest(F.floor((F.octet_length(p) - 2) / 4), F.lit(0)).cast("int")
    xs = F.least(n, there)
    ys = F.least(n, there - xs)
    at = lambda i: struct({"x": signed(p, 2 + 4 * i, 4), "y": signed(p, 2 + 4 * (xs + i), 4)})
    return {"point_count": n, "points": F.slice(F.transform(F.sequence(F.lit(0), F.greatest(ys - 1, F.lit(0))), at), F.lit(1), ys), "tail": rest(p, 2 + 4 * (xs + ys)), **_raw(p)}


def textart(p: Column) -> Fields:
    n = little_endian(p, 32, 2)
    return {"text": F.when(F.octet_length(p) >= 34 + n * 2, F.replace(text(p, 34, n), F.lit("\r"), F.lit(""))).otherwise(F.when(p.isNotNull(), F.lit("")))}


def picture(p: Column) -> Fields:
    """Crop and adjustment of a picture; null where they change nothing."""
    edges = laid_out(p, "left@44:u4 top@48:u4 right@52:u4 bottom@56:u4")
    wide, high = little_endian(p, 28, 4), little_endian(p, 32, 4)
    whole = (edges["left"] == 0) & (edges["top"] == 0) & (((edges["right"] == 0) & (edges["bottom"] == 0)) | ((wide > 0) & (high > 0) & (edges["right"] == wide) & (edges["bottom"] == high)))
    tone = {n: F.coalesce(c, F.lit(0)) for n, c in laid_out(p, "contrast@68:u1 bright@69:u1 effect_code@70:u1 alpha@90:u1").items()}
    plain = (tone["contrast"] == 0) & (tone["bright"] == 0) & (tone["effect_code"] == 0) & (tone["alpha"] == 0)
    return {"crop": F.when((F.octet_length(p) >= 60) & ~whole, struct(edges)), "adjustment": F.when(~plain, struct(tone | {"effect": named(tone["effect_code"], EFFECTS)}))}


# -- sections --------------------------------------------------------------------------------


def page_def(p: Column) -> Fields:
    return laid_out(padded(p, 40), "page_width@0:u4 page_height@4:u4 left@8:u4 right@12:u4 top@16:u4 header@20:u4 footer@24:u4 bottom@28:u4 gutter@32:u4")


def page_border_fill(p: Column) -> Fields:
    out = laid_out(padded(p, 14), "flags@0:u4 left@4:u2 right@6:u2 top@8:u2 bottom@10:u2 border_fill_id@12:u2")
    v = out.pop("flags")
    return {"text_border": F.when(flag(v, 0), "PAPER").otherwise("BORDER"), "header_inside": flag(v, 1), "footer_inside": flag(v, 2), "fill_area": F.when(flag(v, 4), "BORDER").otherwise("PAPER"), **out}


def note_shape(p: Column, endnotes: bool = False) -> Fields:
    v = padded(p, 26)
    a = little_endian(v, 0, 4)
    char = lambda at: F.rtrim(text(v, at, F.lit(1)), F.lit("\0"))
    places = (ENDNOTE_PLACES, "END_OF_DOCUMENT") if endnotes else (FOOTNOTE_PLACES, "EACH_COLUMN")
    return {
        "number_type": named(bits(a, 0, 8), NUMBER_TYPES, "DIGIT"), "user_char": char(4), "prefix_char": char(6), "suffix_char": char(8), "superscript": flag(a, 12),
        "numbering": named(bits(a, 10, 2), NOTE_NUMBERINGS, "CONTINUOUS"), "new_number": little_endian(v, 10, 2), "line_length": (little_endian if endnotes else signed)(v, 12, 2),
        "line_type": named(little_endian(v, 20, 1), NOTE_LINES, "SOLID"), "line_width": named(little_endian(v, 21, 1), NOTE_WIDTHS, "0.12 mm"), "line_color": blue_first(little_endian(v, 22, 4)),
        **laid_out(v, "above_line@14:u2 below_line@16:u2 between_notes@18:u2"), "place": named(bits(a, 8, 2), *places), "beneath_text": flag(a, 13),
    }


def section_definition(p: Column) -> Fields:
    out = laid_out(padded(p, 30), "attributes@4:u4 space_columns@8:u2 line_grid@10:u2 char_grid@12:u2 tab_stop@14:u4 numbering_shape_id@18:u2 page@20:u2 pic@22:u2 tbl@24:u2 equation@26:u2 language@28:u2")
    hidden = {"hide_first_header": 0, "hide_first_footer": 1, "hide_first_master_page": 2, "hide_first_page_number": 5, "hide_first_empty_line": 19, "manuscript_format": 22}
    return out | {n: flag(out["attributes"], i) for n, i in hidden.items()}


def page_starts_on(p: Column) -> Fields:
    return {"starts_on": named(bits(little_endian(padded(p, 8), 4, 4), 0, 2), PAGES, "BOTH")}


def page_hiding(p: Column) -> Fields:
    v = little_endian(padded(p, 8), 4, 4)
    return {n: flag(v, i) for i, n in enumerate(("first_header", "first_footer", "first_master_page", "border", "fill", "first_page_number"))}


def page_number(p: Column) -> Fields:
    v = little_endian(padded(p, 8), 4, 4)
    side = F.when(F.octet_length(p) >= 16, text(p, 14, F.lit(1)))
    return {"position": named(bits(v, 8, 4), POSITIONS, "BOTTOM_CENTER"), "format": named(bits(v, 0, 8), NUMBER_TYPES, "DIGIT"), "side_char": F.coalesce(F.nullif(side, F.lit("")), F.lit("-"))}


def header_footer(p: Column) -> Fields:
    return {"apply_page_type": F.coalesce(named(little_endian(p, 4, 4), PAGES, "BOTH"), F.lit("BOTH"))}


# -- controls --------------------------------------------------------------------------------


def graphic(p: Column) -> Fields:
    """Layout, margins and description of a graphic control."""
    byte = lambda i: little_endian(p, i, 1)
    flow, margins = bits(byte(7), 0, 2), laid_out(p, "left@28:u2 right@30:u2 top@32:u2 bottom@34:u2")
    layout = {
        "text_wrap": F.when(flag(byte(6), 5), "TOP_AND_BOTTOM").otherwise("SQUARE"), "text_flow": F.when(flow == 1, "LEFT_ONLY").when(flow == 2, "RIGHT_ONLY").otherwise("BOTH_SIDES"),
        "treat_as_char": flag(byte(4), 0), "vert_rel_to": F.when(flag(byte(4), 4), "PARA").otherwise("PAPER"), "horz_rel_to": F.when(flag(byte(5), 1), "COLUMN").otherwise("PAPER"),
        "vert_align": F.when(flag(byte(4), 5), "CENTER"), "horz_align": F.when(flag(byte(5), 3), "RIGHT"), "vert_offset": signed(p, 8, 4), "horz_offset": signed(p, 12, 4),
    }
    any_margin = (F.octet_length(p) >= 36) & (margins["left"] + margins["right"] + margins["top"] + margins["bottom"] > 0)
    about = F.when(F.octet_length(p) >= 46, text(p, 46, little_endian(p, 44, 2))).otherwise(F.when(p.isNotNull(), F.lit("")))
    return {"layout": _if_long(p, 16, struct(layout)), "margins": F.when(any_margin, struct(margins)), "description": about}


def bookmark_data(p: Column) -> Fields:
    return {"name": F.when(F.octet_length(p) >= 12, text(p, 12, little_endian(p, 10, 2))).otherwise(F.when(p.isNotNull(), F.lit("")))}


def hyperlink_command(p: Column) -> Fields:
    return {"command": F.when(F.octet_length(p) >= 11, text(p, 11, little_endian(p, 9, 2))).otherwise(F.when(p.isNotNull(), F.lit("")))}


#: Records decoded by their tag alone: tag -> fields of a payload.
DECODERS: dict[str, Callable[[Column], Fields]] = {
    "face_name": face_name, "border_fill": border_fill, "char_shape": char_shape, "tab_def": tab_def, "numbering": numbering, "bullet": bullet, "para_shape": para_shape, "list_header": list_header,
    "memo_shape": memo_shape, "form_object": opaque, "memo_list": opaque, "chart_data": opaque, "track_change": track_change, "track_change_author": track_change_author,
    "shape_component": shape_component, "line": line, "rectangle": rectangle, "ellipse": ellipse, "arc": arc, "polygon": polygon, "curve": opaque, "container": opaque, "textart": textart,
    "picture": picture, "page_def": page_def, "page_border_fill": page_border_fill, "footnote_shape": note_shape, "ctrl_data": bookmark_data,
}
#: Controls decoded by their kind (see `binary.controls`).
CONTROL_DECODERS: dict[str, Callable[[Column], Fields]] = {
    "section": section_definition, "page_number": page_number, "header": header_footer, "footer": header_footer, "hyperlink": hyperlink_command,
    **dict.fromkeys(("table", "picture", "chart", "ole", "container", "textart", "line", "rectangle", "ellipse", "arc", "polygon", "curve", "shape", "equation"), graphic),
}
#: Controls decoded by their id where no kind names them.
ID_DECODERS: dict[str, Callable[[Column], Fields]] = {"pgct": page_starts_on, "pghd": page_hiding}


def decode(rows: DataFrame, name: str) -> DataFrame:
    """(doc, stream, ord, decoded fields) of the records of a kind."""
    return rows.where(tag(name)).select("doc", "stream", "ord", *[c.alias(n) for n, c in DECODERS[name](F.col("payload")).items()])


def decode_controls(found: DataFrame, kind: str) -> DataFrame:
    """(doc, section_index, paragraph, ord, decoded fields) of controls of a kind, or of an id of four characters."""
    fields = ID_DECODERS[kind] if kind in ID_DECODERS else CONTROL_DECODERS[kind]
    which = F.col("control_id") == kind if kind in ID_DECODERS else F.col("kind") == kind
    return found.where(which).select("doc", "section_index", "paragraph", "ord", *[c.alias(n) for n, c in fields(F.col("payload")).items()])

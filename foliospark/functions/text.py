"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def paragraphs(text: Column) -> Column:
    """The lines of a section's text; an empty text has one empty line."""
    return F.split(text, "\n", -1)


def occurrences(text: Column, old: str) -> Column:
    """How often `old` stands in `text`, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int")


def strip(text: Column) -> Column:
    """Without white space (of all of Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends: the key by which memos are matched."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def xml_safe(text: Column) -> Column:
    """Without carriage returns and characters that XML 1.0 can't hold, stripped."""
    return strip(F.regexp_replace(text, r"[\r\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", ""))


#: Fixed value: characters that XML 1.0 can't hold, and carriage returns, which its parsers turn into line feeds.
UNSAFE = re.compile("[\r\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def markup_safe(text: str) -> str:
    """Without characters that would make a part unreadable; for texts that are written as XML within a task."""
    return UNSAFE.sub("", text)


def reserved(text: Column) -> Column:
    """With `%`, `;` and `=` as %25, %3B and %3D, so that it can stand in `k=v;k=v`."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(";"), F.lit("%3B")), F.lit("="), F.lit("%3D"))


def unreserved(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%3D"), F.lit("=")), F.lit("%3B"), F.lit(";")), F.lit("%25"), F.lit("%"))


def noted(text: Column) -> Column:
    """key_values(), and where a pair `escaped=1` says so, keys and values as they were before reserved()."""

    def plain(found: Column) -> Column:
        others = F.filter(F.map_entries(found), lambda e: e.key != "escaped")
        return F.when(F.map_contains_key(found, "escaped"), F.map_from_entries(F.transform(others, lambda e: F.struct(unreserved(e.key), unreserved(e.value))))).otherwise(found)

    return F.get(F.transform(F.array(key_values(text)), plain), F.lit(0))  # the map is made once


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the last."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def normal_path(path: Column) -> Column:
    """Forward slashes, none at the ends."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^/+|/+$", "")


def local_name(name: Column) -> Column:
    """Of `{uri}local` or `prefix:local`, the local name."""
    return F.regexp_extract(name, r"([^}:]*)$", 1)


def key_values(text: Column, outer: str = ";", inner: str = "=") -> Column:
    """Map of `k=v;k=v`: cut at the first `=`, entries without a key dropped, the last of equal keys wins."""
    entry = lambda e: F.struct(F.substring_index(e, inner, 1).alias("k"), F.when(F.contains(e, F.lit(inner)), F.substring(e, F.instr(e, inner) + len(inner), F.length(e))).otherwise(F.lit("")).alias("v"))
    entries = F.filter(F.transform(F.split(text, outer, -1), entry), lambda e: e.k != "")
    # Of equal keys only the last entry is kept, so that no session setting about duplicates matters.
    n = F.size(entries)
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e.k.alias("k"), e.v.alias("v"), F.exists(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda o: o.k == e.k).alias("again"))), lambda e: ~e.again)
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e.k, e.v)))


def base64_lines(raw: Column, width: int = 76) -> Column:
    """Base64 in lines of so many characters."""
    return F.regexp_extract_all(F.replace(F.replace(F.base64(raw), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")), F.lit(f".{{1,{width}}}"), F.lit(0))


def hyperlink_parts(command: Column) -> Column:
    """Parts of a hyperlink command: cut at `;` but not at `\\;`, `\\:` and `\\;` unescaped, one trailing empty part dropped."""
    parts = F.transform(F.split(command, r"(?<!\\);", -1), lambda p: F.replace(F.replace(p, F.lit("\\:"), F.lit(":")), F.lit("\\;"), F.lit(";")))
    n = F.size(parts)
    return F.when((n > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, n - 1)).otherwise(parts)


def bool_like(value: Column) -> Column:
    """Whether a flag is null or one of the accepted literals."""
    # The accepted literals.
    return value.isNull() | F.lower(strip(value)).isin("0", "1", "true", "false", "yes", "no", "y", "n", "on", "off")


def json_list(value: Column) -> Column:
    """A JSON array of strings without nulls; anything else gives an empty array."""
    return F.coalesce(F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def same_length_replace(text: Column, old: str, new: str) -> Column:
    """Replace by a text of as many UTF-16 units, as records of a fixed size need; other lengths raise."""
    if len(old.encode("utf-16-le")) != len(new.encode("utf-16-le")) or not old:
        raise ValueError("old and new text must have one length, not 0")
    return F.replace(text, F.lit(old), F.lit(new))


def normal_map(values: Column) -> Column:
    """A map of texts without its nulls."""
    return F.map_filter(values, lambda _, v: v.isNotNull())


def sub_map(values: Column, prefix: str) -> Column:
    """The entries whose keys have a prefix, without it."""
    return F.transform_keys(F.map_filter(values, lambda k, _: k.startswith(prefix)), lambda k, _: F.substring(k, len(prefix) + 1, 1 << 30))


def flat_paths(json: Column) -> Column:
    """(path, value) of the scalars in a JSON object of two levels, keys joined by dots, in order; other values as JSON text."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    one = lambda o, k: F.call_function("get_json_object", o, F.concat(F.lit("$['"), k, F.lit("']")))

    def level(k: Column) -> Column:
        inner = F.json_object_keys(one(json, k))
        below = F.transform(inner, lambda j: F.struct(F.concat(k, F.lit("."), j).alias("path"), one(one(json, k), j).alias("value")))
        return F.when(inner.isNull(), F.array(F.struct(k.alias("path"), one(json, k).alias("value")))).otherwise(below)

    return F.array_sort(F.flatten(F.transform(keys, level)))


def filled_json(row: Column) -> Column:
    """A struct as JSON, without its nulls."""
    return F.to_json(row)


def carried_json(comment: Column, prefix: str, kind: str) -> Column:
    """What a comment carries as JSON after its prefix, as a struct or map of this type; null if it has none or can't be read."""
    return F.when(F.startswith(comment, F.lit(prefix)), F.from_json(F.substring(comment, len(prefix) + 1, 1 << 30), kind))


#: How many characters away from its target a cut may be worth, by the character before it and the one after it; ten count as one.
BEFORE, AFTER = {")": 40, "]": 40, ",": 30, " ": 10}, {"[": 25, "(": 10, " ": 5}
#: No place farther away than this is worth more than the target itself; the window of places is wider for every text.
REACH = (max(BEFORE.values()) + max(AFTER.values())) // 10


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _snapped(text: Column, target: Column, least: Column, most: Column) -> Column:
    """The best place to cut near `target`: nearest, but rather at brackets, commas and spaces; of equal ones the first."""
    worth = lambda c, values: F.coalesce(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[c], F.lit(0))

    def best(at: Column) -> Column:
        near, base, around = at["near"], at["base"], at["around"]
        score = lambda i: F.abs(i - near) * 10 - F.when(i > 0, worth(F.substring(around, i - base, F.lit(1)), BEFORE)).otherwise(0) - worth(F.substring(around, i + 1 - base, F.lit(1)), AFTER)
        places = F.sequence(F.greatest(least, near - REACH), F.least(most, near + REACH))
        return F.array_min(F.transform(places, lambda i: F.struct(score(i).alias("score"), i.alias("at"))))["at"]

    # `around` holds the characters that places are judged by, `base` how many stand before them.
    around = lambda near: _bound(F.greatest(near - REACH - 1, F.lit(0)), lambda base: F.struct(near.alias("near"), base.alias("base"), F.substring(text, base + 1, F.lit(2 * REACH + 2)).alias("around")))
    return F.when(least >= most, least).otherwise(_bound(_bound(F.least(F.greatest(target, least), most), around), best))


def distributed(text: Column, lengths: Column) -> Column:
    """A new text for paragraphs that had texts of these lengths: its lines if it has any, else pieces in proportion.

    Cuts are made in order, none before the one before it, and leave a
    character for each paragraph that is left where the text has as many.
    Targets are rounded half to even. Paragraphs that were all empty leave the
    text to the first; without paragraphs it is one piece.
    """

    def dealt(given: Column) -> Column:
        text, lengths, n, m, total = (given[k] for k in ("text", "lengths", "n", "m", "total"))

        def step(a: Column, i: Column) -> Column:
            def cut(x: Column) -> Column:
                target = F.bround(n * (x["upto"] / total), 0).cast("int")
                return F.struct(F.array_append(a["cuts"], _snapped(text, target, x["last"], n - (m - i))).alias("cuts"), x["upto"].alias("upto"))

            return _bound(F.struct((a["upto"] + F.get(lengths, i - 1)).alias("upto"), F.element_at(a["cuts"], -1).alias("last")), cut)

        first = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).cast("long").alias("upto"))
        cuts = F.aggregate(F.sequence(F.lit(1), m - 1), first, step, lambda a: a["cuts"])
        pieces = _bound(cuts, lambda cuts: F.transform(cuts, lambda c, i: F.substring(text, c + 1, F.coalesce(F.get(cuts, i + 1), n) - c)))
        rest = F.array_repeat(F.lit(""), m - 1)
        return F.when(F.contains(text, F.lit("\n")) & (m > 0), F.split(text, "\n", -1)).when(m < 2, F.array(text)).when(total <= 0, F.concat(F.array(text), rest)).otherwise(pieces)

    total = lambda x: F.aggregate(x["lengths"], F.lit(0).cast("long"), lambda a, b: a + b)
    sized = lambda x: F.struct(x["text"].alias("text"), x["lengths"].alias("lengths"), F.length(x["text"]).alias("n"), F.size(x["lengths"]).alias("m"), total(x).alias("total"))
    return _bound(_bound(F.struct(text.alias("text"), lengths.alias("lengths")), sized), dealt)

"""Licence scans by a positional rare-token index, with DataFrame functions only.

Templates are word sequences. The documents give every template word its
inverse document frequency, and each template is posted under the few rarest
words of its key phrase with their offsets. A file looks up its words in the
postings, a table of hash buckets laid out flat in constant arrays, so a lookup
costs the same however many templates there are; each hit proposes a template
at a start, the template's other words are intersected at their relative
positions (a match weighs its word's frequency), and the mandatory key phrase
must stand in its place. Rows stay whole: nothing is shuffled or joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: runs of letters a-z, digits and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: The words that must stand; all, if empty.
    key: str = ""
    base: bool = False


#: The phrases whose every place counts, with their labels.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
#: Usual notices and the phrases that they can't be without.
NOTICES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "copy modify and or distribute this software"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    Template("cc0-1.0", "released under cc0 1 0 universal", "cc0 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Documents, and documents with each word of the (small, fixed) vocabulary."""
    held = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    found = {r.w: r["count"] for r in rows}
    return found.pop("", 0), found


def templates_of(licences: DataFrame, label: str = "label", text: str = "text", key: str = "key", most: int = 16 << 20) -> tuple[Template, ...]:
    """Templates from a table of licence texts, split as documents are. The table goes to every worker: beyond `most` bytes this raises. Rows without words are left out."""
    size = licences.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the licences have {size} bytes; scan for parts of at most {most}")
    rows = licences.select(label, F.array_join(words_of(F.col(text)), " ").alias("t"), F.array_join(words_of(F.col(key)), " ").alias("k")).where("t <> ''").orderBy(label, "t", "k").collect()
    return tuple(Template(r[0], r.t, r.k) for r in rows)


def _numbers(values, kind: str = "int") -> Column:
    """A constant array, by one literal however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _strings(values) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = BASE + NOTICES, rare: int = 2, cover: float = 0.8, buckets: int = 1 << 14) -> DataFrame:
    """`docs` with `n_words` and `places`: an array of (label, base, start, length, cover) in the text's words; and `nearest`, the best cover of any proposal.

    A place of a notice has its key phrase and at least `cover` of its
    weighted words at their relative positions; every place of a base phrase
    has all its words. Null and empty texts have no words and no places; equal
    places of two notices of one label are both returned. All rows and columns
    of `docs` are kept; of clashing names, `n_words`, `places` and `nearest`
    are replaced. The work is linear in the words of a text and in its
    proposals. Raises if a key phrase isn't in its template.
    """
    split = [t.text.split() for t in templates]
    vocabulary = sorted({w for s in split for w in s})
    total, df = frequencies(docs, vocabulary, text)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 0.5)) + 1e-6 for w in vocabulary}
    posts, keys, weights = [], [], []
    for t, s in enumerate(split):
        key = (templates[t].key or templates[t].text).split()
        at = next((i for i in range(len(s)) if s[i : i + len(key)] == key), None)
        if at is None:
            raise ValueError(f"the key phrase of {templates[t].label} isn't in its text")
        # The rarest words of the key phrase: a place has all of these, so one posting finds it.
        order = sorted(range(at, at + len(key)), key=lambda i: (-idf[s[i]], i))
        posts += [(s[i], t, i) for i in order[: 1 if templates[t].base else rare]]
        keys += [int(at <= i < at + len(key)) for i in range(len(s))]
        whole = sum(idf[w] for w in s)
        weights += [idf[w] / whole for w in s]
    spark = docs.sparkSession
    hashed = spark.createDataFrame([(i, p[0]) for i, p in enumerate(posts)], "i int, w string").select("i", F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("b"))
    order = sorted((r.b, r.i) for r in hashed.collect())
    count = [0] * (buckets + 1)
    for b, _ in order:
        count[b + 1] += 1
    bucket_at = _numbers(accumulate(count))
    post_word, post = _strings(posts[i][0] for _, i in order), [posts[i] for _, i in order]
    post_template, post_offset = _numbers(p[1] for p in post), _numbers(p[2] for p in post)
    template_at = _numbers(accumulate([0, *map(len, split)]))
    own_word, own_key, own_weight = _strings(w for s in split for w in s), _numbers(keys), _numbers(weights, "double")
    labels, bases = _strings(t.label for t in templates), _numbers(int(t.base) for t in templates)

    words = F.col("_words")
    bucket = lambda i: F.pmod(F.xxhash64(F.get(words, i)), F.lit(buckets)).cast("int")
    hits = F.filter(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)), lambda i: F.get(bucket_at, bucket(i) + 1) > F.get(bucket_at, bucket(i)))
    # A proposal is one long, so that equal ones go by hash: the template, and the start, which may lie before the text.
    pack = lambda t, start: F.shiftleft(t.cast("long"), 32) + (start + (1 << 31)).cast("long")

    def proposals(i: Column) -> Column:
        inside = F.sequence(F.get(bucket_at, bucket(i)), F.get(bucket_at, bucket(i) + 1) - 1)
        own = F.filter(inside, lambda j: F.get(post_word, j) == F.get(words, i))
        return F.transform(own, lambda j: pack(F.get(post_template, j), i.cast("long") - F.get(post_offset, j)))

    def check(c: Column) -> Column:
        t, start = F.shiftright(c, 32).cast("int"), (c.bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int")
        begin, length = F.get(template_at, t), F.get(template_at, t + 1) - F.get(template_at, t)
        places = F.sequence(F.lit(0), length - 1)
        stands = lambda i: F.get(words, start + i).eqNullSafe(F.get(own_word, begin + i))
        covered = F.aggregate(places, F.lit(0.0), lambda a, i: a + F.when(stands(i), F.get(own_weight, begin + i)).otherwise(0.0))
        whole = F.forall(places, lambda i: (F.get(own_key, begin + i) == 0) | stands(i))
        return F.struct(F.get(labels, t).alias("label"), (F.get(bases, t) == 1).alias("base"), start.alias("start"), length.alias("length"), F.least(covered, F.lit(1.0)).alias("cover"), whole.alias("key"))

    kept = [c for c in docs.columns if c not in ("n_words", "places", "nearest")]
    # Names of our own are in one struct, so that none can clash.
    rows = docs.select(F.struct(*kept).alias("row"), words_of(F.col(text)).alias("_words"))
    rows = rows.withColumn("_found", F.array_distinct(F.flatten(F.transform(hits, proposals)))).select("row", F.size("_words").cast("long").alias("n_words"), F.coalesce(F.transform("_found", check), F.array().cast(_FOUND)).alias("_found"))
    good = F.filter("_found", lambda p: p.key & (p.cover >= F.when(p.base, F.lit(0.0)).otherwise(F.lit(cover))))
    places = F.transform(good, lambda p: p.dropFields("key"))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], "n_words", places.alias("places"), F.coalesce(F.array_max(F.transform("_found", lambda p: p.cover)), F.lit(0.0)).alias("nearest"))


_FOUND = "array<struct<label:string,base:boolean,start:int,length:int,cover:double,key:boolean>>"


def summary(scanned: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The digest of scan(): counts and places of base phrases, labels, and the score, the best cover met."""
    base = F.filter("places", lambda p: p.base)
    starts = F.transform(base, lambda p: p.start.cast("long"))
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda p: p.label))), ",")
    return scanned.select(
        ident, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.col("nearest").alias("score"),
    )

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.llm import bloom_lm, queries, scratch, suffixes

SF = "/root/testdata/sf0.01"


def brute_dedupe(rows, length=400):
    seen = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[hash(raw[i : i + length])] += 1
    out = []
    for (ident, _), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[hash(raw[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((ident, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), *brute_words(rows)[len(out)]))
    return out


@functools.cache
def _brute_words(rows, length=51):
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    covered = [len({k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}) for w in split]
    return [(n, n > 0) for n in covered]


def brute_words(rows):
    return _brute_words(tuple(rows))


def test_dedupe(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_dedupe([(r.doc_id, r.text) for r in docs.collect()])
    got = queries.op5_suffixes(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_removed > 0 for r in got) > 50


@pytest.mark.parametrize(("batches", "hot"), [(1, 16384), (4, 3)])
def test_dedupe_odd(spark, batches, hot):
    rnd = random.Random(1)
    text = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    passage, long = text(450), text(3000)
    rows = [(i, text(rnd.randint(0, 300)) + passage + text(300)) for i in range(25)]
    rows += [(100 + i, long[:k] + "X" + long[k:]) for i, k in enumerate((5, 900, 1500, 2999))]
    rows += [(200, None), (None, None), (201, ""), (202, "a" * 399), (203, "a" * 400), (204, "b" * 401), (205, "xyz" * 3000), (206, long[100:499]), (207, long[100:500]), (None, long), (208, text(5000)), (208, text(5000))]
    rows += [(300, passage + "!" + passage)] * 2
    # Runs of a short period, whole and cut, alone and shared, longer and shorter than one that finds itself.
    run = lambda word, n: (word * (n // len(word) + 2))[:n]
    rows += [(400 + i, text(rnd.randint(0, 90)) + run(rnd.choice(["the ", "of ", "ab", "é", "seven w"]), rnd.choice([300, 399, 400, 401, 405, 800, 1500])) + text(rnd.choice([0, 30, 600]))) for i in range(40)]
    rows += [(500 + i, text(100) + run("once upon a time ", n) + text(100)) for i, n in enumerate((402, 410, 430))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, row int").repartition(3)
    got = suffixes.dedupe(df, batches=batches, hot=hot).drop("kept").collect()
    assert Counter(map(tuple, got)) == Counter(brute_dedupe(rows))
    assert suffixes.dedupe(df.limit(0)).collect() == []


def test_levels_are_scanned_on_arrival(spark):
    """Every array meets the levels before it; levels merge like a binary counter."""
    with scratch.Space(spark) as space:
        family = suffixes.Family(space)
        for b in range(5):
            family.add(spark.createDataFrame([(k, 10 * b) for k in range(b, b + 3)] + [(100 + b, 1)] * (1 + (b == 2)), "key long, context long"))
        assert [rank for rank, _ in family.levels] == [2, 0]
        got = {(r.key, r.context): (r.copies, r.contexts) for r in family.repeats().collect()}
        # A family that never scans finds only what repeats inside a batch.
        assert {k for k, _ in got} == {1, 2, 3, 4, 5, 102} and got[3, 10] == (1, 3) and got[102, 1] == (2, 1)
    assert [suffixes.batches_for(n) for n in (0, 1 << 27, 1 << 29, 1 << 40)] == [1, 1, 2, 13]


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, ws in rows if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op10_scores(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, ws in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score <= 0
    # The pairs of the model help on texts it has not seen.
    out = [got[i] for i in held if held[i]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_odd(spark):
    rows = [(1, "A b\x0bc  a"), (2, None), (3, ""), (None, "lost"), (4, "long " * 50000), (4, "long " * 50000), (5, "\x00 é É")]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, rare string")
    for segment in (1 << 23, 1 << 10):
        got = bloom_lm.score(df, F.lit(True), segment=segment).collect()
        c = Counter(w for _, t in rows for w in words(t))
        n, v = sum(c.values()), len(c)
        want = defaultdict(list)
        for i, t in rows:
            want[i].append(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)))
        assert len(got) == len(rows) and all(r.base_score in [pytest.approx(x) for x in want[r.doc_id]] and r.n_known == r.n_tokens and r.rare == "x" for r in got)
    assert bloom_lm.score(df.limit(0), F.lit(True)).collect() == []
    none = bloom_lm.score(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0) for r in none)


def test_scores_all_pairs(spark):
    """Pairs of rare words count like any other, in one segment or many."""
    rnd = random.Random(3)
    chain = [f"w{i}" for i in range(6000)]
    rows = [(i, " ".join(chain[k : k + 200])) for i, k in enumerate(range(0, 6000, 100))] + [(1000 + i, " ".join(rnd.choices(chain, k=50))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    learn = F.col("doc_id") % 7 != 3
    got = bloom_lm.score(df, learn).where("doc_id < 1000 and doc_id % 7 <> 3").collect()
    # Each pair of the chain is certain: most of what a word costs by itself is gone.
    assert all(r.score > -1.2 * r.n_tokens > r.base_score for r in got)
    held = [words(t) for i, t in rows if i % 7 != 3]
    c, c2 = Counter(w for ws in held for w in ws), Counter(p for ws in held for p in zip(ws, ws[1:]))  # noqa: B905
    low = sum(c.values()) + 0.1 * (len(c) + 1)
    about = lambda n: n if n < 2 else 2 ** ((1 + math.floor(math.log2(n) * 2 + 1e-9) - 0.5) / 2)
    for segment in (1 << 24, 1 << 12):
        got = {r.doc_id: r.score for r in bloom_lm.score(df, learn, bits_a_gram=400, segment=segment).collect()}
        for i, t in rows:
            ws = words(t)
            p = [(about(c[w]) + 0.1) / low for w in ws]
            p[1:] = [0.4 * min(about(c2[a, b]) / max(about(c[a]), 1), 1) + 0.6 * q for a, b, q in zip(ws, ws[1:], p[1:])]  # noqa: B905
            assert got[i] == pytest.approx(sum(map(math.log10, p)), rel=1e-6)


def test_rows_follow_the_text(spark):
    """A chunk asks segments that its n-grams are in, so rows grow with the text and not with chunks times segments."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices("abcdefghij", k=30))) for i in range(20)]
    whole = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select(F.struct("doc_id").alias("row"), F.col("text").alias("_text"), F.lit(True).alias("_learn"))
    grams = len({w for _, t in rows for w in words(t)}) + len({p for _, t in rows for p in zip(words(t), words(t)[1:])})  # noqa: B905
    kind = "chunk long, part int, seq int, row struct<doc_id:bigint>, a binary, b binary, c binary, d binary"
    for segments in (1, 7, 1 << 12, 1 << 18):
        found = whole.mapInArrow(lambda it: bloom_lm._ask(it, segments, 0), kind).where("part >= 0").select("part").collect()  # noqa: B023
        parts = [r.part for r in found]
        assert parts == sorted(set(parts)) and len(parts) <= min(segments, grams) and max(parts) < segments
    assert len(parts) > 0.9 * grams
    import numpy as np

    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 500, np.uint64) * np.uint64(2))
    for segments in (1, 3, 64, 4096):
        part, begin, end = bloom_lm.ranges(h, bloom_lm.edges(segments))
        assert [(int(x) * segments) >> 64 for x in h] == np.repeat(part, end - begin).tolist() and begin.tolist() == [0, *end[:-1].tolist()] and end[-1] == 500


def test_filter_levels(spark):
    import numpy as np

    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    text = " ".join(rnd.choices(vocab, [1 / (i + 1) for i in range(300)], k=20000))
    model, counts = bloom_lm.train(spark.createDataFrame([(text,)], "text string"))
    exact = {r.h: r.c for r in counts.collect()}
    h = np.array(list(exact), np.int64).view(np.uint64)
    got, want = model.levels(h), bloom_lm.level(np.array(list(exact.values())))
    assert (got >= want).all() and (got == want).mean() > 0.9
    strange = np.random.default_rng(1).integers(0, 2**63, 5000, np.uint64)
    assert (model.levels(strange) > 0).mean() < 0.1

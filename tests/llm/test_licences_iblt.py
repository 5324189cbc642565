import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import iblt, licences

SF = "/root/testdata/sf0.01"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [p[0] for p in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[1] for p in places}))


def test_licences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: brute_base(r.text) for r in docs.collect()}
    rows = licences.summary(licences.scan(docs)).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == want
    labels = {r.doc_id: set(filter(None, r.labels.split(","))) for r in rows}
    assert all(set(filter(None, r.base_labels.split(","))) <= labels[r.doc_id] and 0 <= r.score <= 1 for r in rows)
    for r in docs.collect():
        assert ("mit" in labels[r.doc_id]) == ("Released under the MIT License" in r.text)
        assert ("apache-2.0" in labels[r.doc_id]) == ("Apache License, Version 2.0" in r.text)
        assert ("gpl-3.0" in labels[r.doc_id]) == ("GNU General Public License, version 3" in r.text)


def test_licences_odd(spark):
    texts = [None, "", "cc", "CC-BY cc by", "All rights\nreserved. all-rights-reserved", "by cc by", "generKal public license", "general public license " * 3000, "x" * 200000, "Licensed under CC BY-NC 4.0.", "éall rights reserved", "cc\x00by", "MIT license", "mit License released under the"]
    df = spark.createDataFrame([(i, t, "n", [1]) for i, t in enumerate(texts)] + [(None, None, None, None)] * 2, "doc_id long, text string, n_words string, places array<int>")
    got = licences.summary(licences.scan(df)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter([(i, *brute_base(t)) for i, t in enumerate(texts)] + [(None, 0, 0, None, None, "")] * 2)
    assert next(r for r in got if r.doc_id == 9).labels == "cc-by,cc-by-nc-4.0"
    assert licences.summary(licences.scan(df.limit(0))).collect() == []


def test_many_places_and_long_licences(spark):
    """Linear in the places of one text; licence texts of hundreds of words from a table."""
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(common) if rnd.random() < 0.8 else f"rare{k}x{rnd.randint(0, 400)}" for _ in range(600)) for k in range(80)]
    keys = [" ".join(t.split()[100:112]) for t in texts]
    table = spark.createDataFrame([(f"lic{k}", t.upper().replace(" ", ", "), key) for k, (t, key) in enumerate(zip(texts, keys, strict=True))] + [("none", None, None)], "label string, text string, key string")
    templates = licences.BASE + licences.templates_of(table)
    assert len(templates) == 83
    edited = texts[7].split()
    for i in range(200, 260):
        edited[i] = "changed"
    cut, broken = " ".join(texts[9].split()[90:]), texts[11].replace(keys[11], keys[11][:-3])
    docs = [(1, "intro " + texts[3] + " outro " + texts[4]), (2, " ".join(edited)), (3, cut), (4, broken), (5, "All rights reserved. " * 200_000), (6, "cc by")]
    began = time.monotonic()
    got = {r.doc_id: r for r in licences.summary(licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates=templates)).collect()}
    assert time.monotonic() - began < 60
    assert got[1].labels == "lic3,lic4" and got[2].labels == "lic7" and got[3].labels == "lic9" and got[4].labels == ""
    assert 0.8 < got[2].score < 1 and got[1].score == pytest.approx(1)
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (200_000, 0, 599_997)
    with pytest.raises(ValueError, match="key phrase"):
        licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates=(licences.Template("x", "a b c", "d"),))


def jaccard(a, b):
    x, y = Counter(iblt.paragraphs(a)), Counter(iblt.paragraphs(b))
    union = sum((x | y).values())
    return 1.0 if not union else sum((x & y).values()) / union


def brute_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), pytest.approx(jaccard(t, e)), pytest.approx(jaccard(t, u))))
    return out


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    for rows in (50, 4096):
        iblt_rows, iblt.neighbours.__defaults__ = iblt.neighbours.__defaults__, ("text", "doc_id", rows, 4096)
        got = {r.doc_id: r for r in iblt.fingerprint_pairs(docs).collect()}
        iblt.neighbours.__defaults__ = iblt_rows
        for i, n, sha, near, following in brute_pairs([(r.doc_id, r.text) for r in docs.collect()]):
            assert (got[i].n_chars, got[i].edited_sha256, got[i].near_edited, got[i].near_next) == (n, sha, near, following)
    by = {}
    for r in docs.collect():
        assert by.setdefault(r.text, got[r.doc_id].fingerprint) == got[r.doc_id].fingerprint
    assert len(set(by.values())) == len(by)


def test_fingerprints_odd(spark):
    rows = [(3, None), (2, ""), (1, "a. b. c. " * 20000), (7, "é\U0001f600x"), (9, "line\n" * 50), (None, "lost")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, block string, h string")
    got = {r.doc_id: tuple(r) for r in iblt.fingerprint_pairs(df).collect()}
    for i, n, sha, near, following in brute_pairs(rows):
        assert (got[i][1], got[i][2], got[i][5], got[i][6]) == (n, sha, near, following)
    assert iblt.fingerprint_pairs(df.limit(0)).collect() == []
    one = iblt.fingerprint_pairs(df.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a")], "doc_id long, text string")
    assert len(iblt.fingerprint_pairs(same).collect()) == 5


def test_differences_recovered():
    rnd = random.Random(5)
    a = [rnd.getrandbits(64) for _ in range(900)]
    for b in (a[400:] + [rnd.getrandbits(64) for _ in range(700)], a[:899], a[5:8], [], [rnd.getrandbits(64) for _ in range(5000)]):
        d, doc = np.array(a + b, np.uint64), np.repeat([0, 1], [len(a), len(b)])
        t = iblt.build(doc, d, 2)
        prints = [iblt.stored([x[[t.place[i]]] for x in t.found[int(t.third[i])]])[0] for i in (0, 1)]
        only_a, only_b, near = iblt.compare(*prints)
        assert set(only_a.tolist()) == set(a) - set(b) and set(only_b.tolist()) == set(b) - set(a)
        assert near == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b))) and iblt.likeness(t, np.array([0]), np.array([1]))[0] == near
    with pytest.raises(ValueError):
        iblt.compare(prints[0][:-56] + "A" * 56, prints[1])


def test_tables_fold():
    d = np.array([random.Random(i).getrandbits(64) for i in range(50)], np.uint64)
    zero = np.zeros(50, int)
    for third in (8, 16, 64):
        assert all((x == y).all() for x, y in zip(iblt.folded(iblt.tables(zero, d, 1, 128), third), iblt.tables(zero, d, 1, third), strict=True))


def test_every_table_is_peeled_alone():
    """Whatever its size, a text's digests come back from its table; few tables need more room than they start with."""
    rnd, grown = random.Random(8), 0
    sizes = [*range(120)] * 5 + [1000, 5000]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    d = np.array([rnd.getrandbits(64) for _ in range(len(doc))], np.uint64)
    t = iblt.build(doc, d, len(sizes))
    order = np.lexsort((d, doc))
    assert (t.doc == doc[order]).all() and (t.d == d[order]).all()
    grown = (t.third > iblt.third_for(np.array(sizes))).sum()
    assert grown < 0.05 * len(sizes)


def test_likeness_follows_from_the_fingerprints(spark):
    """The returned strings alone give the likeness, in every row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = iblt.fingerprint_pairs(docs).collect()
    by = {r.doc_id: r for r in got}
    order = sorted(by, reverse=True)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        assert iblt.compare(by[i].fingerprint, by[i].edited_fingerprint)[2] == pytest.approx(by[i].near_edited)
        assert iblt.compare(by[i].fingerprint, by[j].fingerprint)[2] == pytest.approx(by[i].near_next)


def test_long_sentences_are_cut():
    rnd = random.Random(9)
    t = " ".join(rnd.choice(["alpha", "beta", "gamma!", "delta", "eps", "zeta7", "theta", "iota"]) + str(rnd.randint(0, 99)) for _ in range(3000))
    for text in (t, "WORD!! " * 3000, "x" * 50_000, " " * 5000 + "y", "é " * 900, "\ud800 " * 400):
        p = iblt.paragraphs(text)
        assert "".join(p) == text and len(p) > 3
    half = t[: len(t) // 2] + "something else " * 700
    assert 0.2 < jaccard(t, half) < 0.6
    with pytest.raises(TypeError):
        iblt.neighbours(type("D", (), {"schema": {"doc_id": type("F", (), {"dataType": type("T", (), {"typeName": lambda self: "string"})()})}})())

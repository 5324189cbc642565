import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from foliospark.llm import queries, ranking

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Every item's k best, by scoring all documents."""
    held = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        q = Counter(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in q if df[t]}
        rows = []
        for i, c, size in held:
            m = 75 + (25 * size * n) // total
            score = sum(q[t] * w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in w if c[t])
            if score > 0:
                rows.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted([(r[0], r[1], r[2], r[3]) for r in df.collect()], key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    names = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    return [" ".join(rng.choice(names) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("shard", [4 << 10, 32 << 20])
def test_against_all_scores(spark, shard):
    """Many blocks, ties, equal texts, over small and large shards."""
    docs = list(enumerate(texts(1, 1500))) + [(5000 + i, t) for i, t in enumerate(texts(1, 300))]
    docs += [(9000, None), (9001, ""), (9002, " .,- "), (None, "w1 w2 Ünï W3"), (9003, "w1 " * 3000), (7, "w1 w2"), (7, "w1 w2")]
    items = list(enumerate(texts(2, 25))) + [(100, "w1 w1 W1 w2"), (101, None), (102, ""), (103, "neverseen"), (104, "ünï ÜNÏ"), (0, "w3 w4"), (100, "w1 w1 W1 w2")]
    random.Random(3).shuffle(docs)
    index = ranking.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes=shard)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = found(ranking.search(index, asked, 20))
    want = [x for x in brute(docs, items, 20)]
    assert Counter(got) == Counter(want)
    assert Counter(found(ranking.search(index, asked, 20, most=3000))) == Counter(want)  # items in batches
    assert Counter(found(ranking.search(index, asked, 3))) == Counter(brute(docs, items, 3))


def test_blocks_are_skipped():
    """Blocks whose window can't pass the threshold stay compressed, and the best are those of all scores."""
    rng = np.random.default_rng(4)
    n, k = 60_000, 20
    m = ranking.norm(rng.integers(20, 200, n), n, 110 * n)
    lists, score = [], np.zeros(n, np.int64)
    for share, w in ((0.5, 700), (0.02, 4000), (0.001, 7000)):
        doc = np.flatnonzero(rng.random(n) < share)
        count = rng.integers(1, 4, len(doc)) * np.where(rng.random(len(doc)) < 0.002, 300, 1)
        got = ranking.impact(count, m[doc])
        score[doc] += w * got
        cuts = range(0, len(doc), ranking.BLOCK)
        parts, firsts, lasts, tops, widths = [], [], [], [], []
        for a in cuts:
            d, c = doc[a : a + ranking.BLOCK], count[a : a + ranking.BLOCK]
            delta = np.diff(d, prepend=d[0])
            wide, high = int(ranking._width(delta.max())), int(ranking._width(c.max()))
            parts += [delta.astype(f"<u{wide}").tobytes(), c.astype(f"<u{high}").tobytes()]
            firsts.append(d[0])
            lasts.append(d[-1])
            tops.append(got[a : a + ranking.BLOCK].max())
            widths.append(wide * 8 + high)
        lists.append((w, ranking._List(*(np.array(x, np.int32) for x in (firsts, lasts, tops, widths)), b"".join(parts), len(doc))))
    docs, scores = ranking.best(lists, m, k, np.zeros(n, np.int64))
    order = np.lexsort((np.arange(n), -score))[:k]
    assert docs.tolist() == order.tolist() and scores.tolist() == score[order].tolist()
    opened, there = sum(len(x.held) for _, x in lists), sum(len(x.tops) for _, x in lists)
    assert opened < 0.5 * there


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id int, text string")
    assert found(ranking.search(ranking.build(none), items)) == []
    docs = spark.createDataFrame([("a", "w1", 3, "x"), ("b", "w1 w2", 4, "y")], "id string, body string, rank int, score string")
    index = ranking.build(docs, "body", "id")
    assert [r.id for r in ranking.search(index, items, ident="id").orderBy("rank").collect()] == ["a", "b"]
    assert found(ranking.search(index, items.where("false"))) == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.op11_ranking(spark, sf), queries.SQL["op11_ranking"], sf)
    assert queries.op11_ranking(spark, sf).select(F.max("rank")).first()[0] == 20

import random
import re
from collections import Counter

from foliospark.llm import decontaminate

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_counts(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, items, least=0.8):
    items = [(i, words(t)) for i, t in items if words(t)]
    of = [(i, len(w), shingle_counts(w)) for i, w in items]
    df = Counter(s for _, _, c in of for s in c)
    weigh = lambda c: {s: n / df.get(s, 1) for s, n in c.items()}
    of = [(i, n, weigh(c)) for i, n, c in of]
    out = {}
    for d, t in docs:
        w = words(t)
        mine = shingle_counts(w) | Counter(s for k in range(1, 5) for s in [tuple(w[i : i + k]) for i in range(len(w))])
        for i, n, c in of:
            if min(n, 5) > len(w) or not any(s in mine for s in c):
                continue
            for a in range(max(1, len(w) - n + 1)):
                x = weigh(shingle_counts(w[a : a + n]))
                shared = sum(min(v, c.get(s, 0)) for s, v in x.items())
                if shared / (sum(x.values()) + sum(c.values()) - shared) >= least - 1e-12:
                    out.setdefault(d, set()).add(i)
                    break
    return out


def test_find(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {r.doc_id: {x.item for x in r.leaks} for r in decontaminate.find(docs, items).collect() if r.leaks}
    assert got == want and len(want) > 5
    assert decontaminate.find(docs, items).columns == [*docs.columns, "leaks"]


def test_edited_windows(spark):
    """Passages with a few words changed: whatever is similar enough is found within the radius."""
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(12, 70)))) for i in range(60)]
    docs = []
    for d in range(300):
        w = rnd.choice(items)[1].split()
        for _ in range(d % 4):
            w[rnd.randrange(len(w))] = "changed"
        if d % 5 == 0:
            del w[rnd.randrange(len(w))]
        docs.append((d, " ".join(rnd.choices(vocab, k=30) + w + rnd.choices(vocab, k=30))))
    want = brute(docs, items)
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: {x.item for x in r.leaks} for r in got.collect() if r.leaks}
    found = sum(len(got.get(d, set()) & i) for d, i in want.items())
    assert all(i <= want.get(d, set()) for d, i in got.items())
    assert found >= 0.99 * sum(map(len, want.values())) and found > 100


def test_items_cut_short(spark):
    """A document that is an item less its last words, all by itself."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12 + i))) for i in range(40)]
    docs = [(100 * i + c, " ".join(t.split()[: len(t.split()) - c])) for i, t in items for c in (1, 2, 3, 9)] + [(9999, "w1x0 w1x1")]
    want = brute(docs, items)
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: {x.item for x in r.leaks} for r in got if r.leaks} == want and len(want) > 90
    assert all(x.words == len(r.text.split()) for r in got for x in r.leaks)


def test_odd(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", None, 1), (None, "One two, THREE four five six", "x", 1), (3, "pad " * 50000 + "one two three four five six", "", 1), (3, "two words", "", 1), (4, "word", "", 1)], "doc_id long, text string, leaks string, row int")
    items = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "two words")], "item_id long, text string")
    got = decontaminate.find(docs, items).collect()
    assert Counter((r.doc_id, tuple(x.item for x in r.leaks)) for r in got) == Counter([(1, ()), (2, ()), (None, (1, 1)), (3, (1, 1)), (3, (None,)), (4, ())])
    assert all(not r.leaks for r in decontaminate.find(docs, items.limit(0)).collect())
    assert decontaminate.find(docs.limit(0), items).collect() == []

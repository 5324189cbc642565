import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from foliospark.llm import components, mixing, sharding, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size int, _key string, shard string"


def odd(spark):
    """Nulls, empties, one very long text, repeats, clashing column names."""
    rows = [(i, f"word{i % 7} some words here {i}", "ab"[i % 2], 1, "k", "s") for i in range(60)]
    rows += [(None, None, None, None, None, None), (None, "x y", None, 1, "", ""), (77, "", "a", 1, "", ""), (78, None, "b", 1, "", ""), (5, "word5 some words here 5", "b", 1, "k", "s")]
    rows += [(100 + i, "the same text again and again", "a", 1, "", "") for i in range(40)] + [(99, "long " * 30000, "a", 1, "", "")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_shard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs, 24, range_rows=20).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    assert all(r["size"] == len(want[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(want[r.doc_id].encode()) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    most = max(r["size"] for r in rows)
    mean = sum(r["size"] for r in rows) / 24
    assert all(abs(sum(r["size"] for r in by[s]) - mean) <= most for s in range(24))


def test_shard_odd(spark):
    rows, df = odd(spark)
    got = sharding.shard(df, 4, range_rows=10).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))
    assert sharding.shard(df.limit(0), 4).collect() == []


def test_range_of(spark):
    bounds = sorted(random.Random(1).sample(range(1000), 37))
    got = spark.range(1000).select("id", sharding.range_of(__import__("pyspark.sql.functions").sql.functions.col("id"), bounds).alias("r")).collect()
    assert all(r.r == sum(b <= r.id for b in bounds) for r in got)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    d = sorted(set(fps))
    for i, a in enumerate(d):
        for b in d[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, f in zip(ids, fps, strict=True):
        least[find(f)].append(i)
    return [min((x for x in least[find(f)] if x is not None), default=None) for f in fps]


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f, c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps), strict=True)}
    got = {r.doc_id: (r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_odd(spark):
    rows, df = odd(spark)
    fps = [brute_fingerprint(r[1]) for r in rows]
    got = simhash.near_duplicates(df).collect()
    want = Counter(zip([r[0] for r in rows], fps, brute_components([r[0] for r in rows], fps), strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("tile", [16, 4096])
def test_link_dense_group(spark, tile):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    points = {base}
    while len(points) < 300:
        x = rnd.choice(sorted(points))
        for _ in range(rnd.randint(1, 5)):
            x ^= 1 << rnd.randrange(64)
        points.add(x)
    points |= {rnd.getrandbits(64) for _ in range(300)}
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p, p, 0) for p in signed], "node long, fp long, other long")
    links = simhash.link(df, 4, tile=tile)
    assert links.count() < 15 * 300 * (20 if tile == 16 else 1)
    got = {r.node: r.component for r in components.components(links).collect()}
    want = dict(zip(signed, brute_components(signed, points), strict=True))
    assert {p: got.get(p, p) for p in signed} == want


def test_blocks_grow_with_the_table():
    assert simhash.blocks_for(10**6, 4, 6) == 6 and simhash.blocks_for(10**12, 4, 6) > 6
    assert simhash.blocks_for(10**6, 8, 10) == 10 and simhash.blocks_for(10**9, 8, 10) > 10


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (5, 5), (None, 3)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200} | {300 + i: 300 for i in range(51)}


def test_targets():
    got = mixing.targets({"a": 100, "b": 10, "c": 1000, None: 5})
    assert sum(got.values()) == pytest.approx(1115)
    assert got["b"] == 30 and got[None] == 15 and got["a"] == 300 and got["c"] == pytest.approx(770)


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    assert len(rows) == len(text)
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id][0])) and 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        by[text[r.doc_id][1]].append(r)
    want = mixing.targets({s: sum(r["size"] for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert v[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in v) - want[s]) <= max(25, 0.002 * want[s])
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_mix_bins(spark):
    """Small bins: only the bin at the cut is filled record by record."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs, bin_rows=8).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r[2] - r.target) <= 0.05 * r.target for r in got)


def test_mix_odd(spark):
    rows, df = odd(spark)
    got = mixing.mix(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert mixing.mix(df.limit(0)).collect() == []

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliospark.llm import decontaminate, mixing, simhash
from foliospark.llm.scratch import documents

SF = "/root/testdata/sf0.001"


def shingle_set(t, k=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_keep(rows, least=0.8):
    """The least ident of each component of texts whose shingle sets are similar enough."""
    sets = [(i, shingle_set(t)) for i, t in sorted(rows)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(k)
    links = 0
    for k, (_, s) in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < k} if s else {j for j in range(k) if not sets[j][1]}:
            if not s or len(s & sets[j][1]) >= least * len(s | sets[j][1]):
                links += 1
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    return {sets[find(k)][0] for k in range(len(sets))}, links


def test_keep_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows, got = docs.collect(), {r.doc_id: r.text for r in kept.collect()}
    want, links = brute_keep([(r.doc_id, r.text) for r in rows])
    assert links > 50 and want <= set(got)
    # Nothing else goes; of what should go, at least 99 in 100 does.
    assert len(set(got) - want) <= 0.01 * (len(rows) - len(want)) + 1


def test_keep_one_recall(spark):
    """Copies edited to similarities from 0.7 to 1: those of 0.8 and more go, the others stay."""
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(2000)]
    rows = []
    for k in range(400):
        w = rnd.choices(vocab, k=rnd.choice([60, 150, 400]))
        rows.append((2 * k, " ".join(w)))
        for _ in range(max(1, round(len(w) * rnd.random() * 0.035))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((2 * k + 1, " ".join(w)))
    want, links = brute_keep(rows)
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [k for k in range(400) if len(shingle_set(rows[2 * k][1]) & shingle_set(rows[2 * k + 1][1])) < 0.88 * len(shingle_set(rows[2 * k][1]) | shingle_set(rows[2 * k + 1][1])) and 2 * k + 1 not in want]
    assert links > 200 and len(near) > 60 and want <= got
    assert sum(2 * k + 1 not in got for k in near) >= 0.97 * len(near)


def test_keep_one_hot_group(spark):
    """Very many near copies of one text, in tiles: one stays."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base, f"x{i}", "end"])) for i in range(150)] + [(1000 + i, f"lone text number {i} of others {i}") for i in range(20)]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), tile=16).collect()}
    assert got == {0, *range(1000, 1020)}


def test_keep_one_odd(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "same text here", 1), (7, "same text here", 1), (5, "other words entirely different", 1), (5, "other words entirely different", 1), (None, "lonely words without id", 1), (9, "long " * 50000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("nth", F.lit(1)).withColumn("rid", F.lit(2))
    assert Counter(r.doc_id for r in simhash.keep_one(df).collect()) == Counter([1, 7, 5, None, 9])
    assert simhash.keep_one(df.limit(0)).collect() == []


def test_repeat(spark):
    docs = documents(spark, SF)
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = Counter(r.doc_id for r in mixing.repeat(docs).collect())
    assert got == Counter({i: n for i, n in want.items() if n})


def test_stages(spark):
    import corpus_pipeline

    docs = documents(spark, SF)
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema or out.columns == docs.columns
        texts = {r.doc_id: r.text for r in docs.collect()}
        kept = out.collect()
        assert all(texts[r.doc_id] == r.text for r in kept) and len({r.doc_id for r in kept}) == len(kept)
        sizes.append(len(kept))
        docs = spark.createDataFrame(kept, docs.schema)
    assert not [r for r in decontaminate.find(docs, documents(spark, SF, "benchmark")).collect() if r.leaks]
    rows = corpus_pipeline.run(spark, SF).collect()
    # The last stages change no decision of the first ones: each kept document as often as the mix takes it.
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in rows) == Counter(want)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))


def test_run_odd(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows; an empty table."""
    import corpus_pipeline

    base = documents(spark, SF)
    schema = base.schema
    odd = [(None, None, None, None, None)] * 2 + [(900001, "", "en", None, 0), (900002, None, None, "web", None), (900003, "word " * 200_000, "en", "web", 1_000_000), (None, "a text that has no id at all but some words", "en", "x", 43)]
    rows = [*map(tuple, base.limit(60).collect()), *odd, tuple(base.first())]
    assert base.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for name, data in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        for t in ("labels", "benchmark"):
            documents(spark, SF, t).write.parquet(str(folder / f"{t}.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(got) == bool(data)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())

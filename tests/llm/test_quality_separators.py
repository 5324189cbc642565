import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import quality, separators
from foliospark.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.01"


def path():
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)
    got = {r.doc_id: r for r in quality.classify(docs, train, F.col("source"), path(), keep=["doc_id"]).collect()}
    assert len(got) == docs.count()
    rows = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).collect()
    clean = [got[r.doc_id].accepted for r in rows if r.quality and not r.toxic]
    junk = [got[r.doc_id].accepted for r in rows if not r.quality]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.1 * len(junk)
    seen = [got[r.doc_id].accepted for r in labels.collect() if r.quality and r.toxic]
    assert sum(seen) <= 0.4 * len(seen)


def test_marks_that_vary_by_ending(spark):
    """Held-out toxic texts of every language are seen, though their words recur seldom."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.fit(docs, labels.where(~held))
    rows = docs.join(labels.where(held & (F.col("quality") == 1)), "doc_id")
    seen = quality._evidence(rows, model, "text", ["lang", "toxic", "text"]).select("row.kept.lang", "row.kept.toxic", (F.col("marked") >= 0.5).alias("m")).collect()
    for lang in ("en", "de", "es", "fr"):
        toxic = [r.m for r in seen if r.lang == lang and r.toxic]
        assert len(toxic) >= 4 and sum(toxic) >= 0.8 * len(toxic), (lang, sum(toxic), len(toxic))
    clean = [r.m for r in seen if not r.toxic]
    assert sum(clean) <= 0.02 * len(clean)
    print("marked:", {lang: (sum(r.m for r in seen if r.lang == lang and r.toxic), sum(r.toxic for r in seen if r.lang == lang)) for lang in ("en", "de", "es", "fr")}, "clean:", sum(clean), len(clean))


def test_sites_shrink(spark):
    rows = [("a", f"a/{i % 5}", float(i % 10 > 0)) for i in range(1000)] + [("b", "b/0", 0.0), ("c", "c/1", 1.0), (None, None, 1.0)] + [("d", "d/0", float(i % 10 > 7)) for i in range(1000)]
    got = {(r.host, r.path): r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert len(got) == 9
    rate = sum(r[2] for r in rows) / len(rows)
    assert got["a", "a/0"].global_rate == pytest.approx(rate)
    assert rate < got["a", "a/1"].path_rate <= 1 and abs(got["a", "a/1"].host_rate - 0.9) < 0.02
    assert 0 < got["b", "b/0"].host_rate < rate < got["c", "c/1"].host_rate < 1


def test_posterior(spark):
    """Rates and posteriors from the evidence of each document, step by step."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels, F.col("source"), path(), keep=["doc_id", "source", "lang"]).collect()
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in rows:
        p = r.form * (1 - r.marked)
        hosts[r.source].append(p)
        paths[r.source, f"{r.source}/{r.lang}"].append(p)
    rate = sum(map(sum, hosts.values())) / len(rows)

    def strength(groups):
        groups = [g for g in groups if len(g) > 1]
        n = sum(map(len, groups))
        between = sum(len(g) * (sum(g) / len(g) - rate) ** 2 for g in groups)
        chance = rate * (1 - rate)
        spread = max(0.0, (between - (len(groups) - 1) * chance) / max(1e-9, n - sum(len(g) ** 2 for g in groups) / n))
        return min(1e6, max(1.0, chance / max(spread, 1e-9) - 1))

    th, tp = strength(hosts.values()), strength(paths.values())
    logit = lambda x: math.log(max(x, 1e-9) / max(1 - x, 1e-9))
    for r in rows:
        h, g = hosts[r.source], paths[r.source, f"{r.source}/{r.lang}"]
        host_rate = (sum(h) + th * rate) / (len(h) + th)
        path_rate = (sum(g) + tp * host_rate) / (len(g) + tp)
        odds = logit(r.form * (1 - r.marked)) + logit(path_rate) - logit(rate)
        assert (r.host_rate, r.path_rate, r.posterior) == pytest.approx((host_rate, path_rate, 1 / (1 + math.exp(-odds))), rel=1e-6)
        assert r.accepted == (r.posterior >= 0.5)


def test_classifier_odd(spark):
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(n)) + "."
    rows = [(i, text(20) if i % 3 else "!!! $$$ " * 30, "x", "h", "p") for i in range(90)]
    rows += [(None, None, None, None, None), (900, "", None, "h", None), (901, "word " * 100000, "x", "h", "p"), (5, rows[5][1], "x", "h", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string, posterior string").withColumns({"_h": F.lit(1), "row": F.lit(2), "kept": F.lit(3)})
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (61, None, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels, F.col("source"), F.col("source")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and got[0].text is not None
    assert all(r.accepted == bool(r.doc_id % 3) for r in got if r.doc_id is not None and r.doc_id < 90)
    assert all(r.accepted for r in quality.classify(df, labels.limit(0), F.col("source"), F.col("source")).collect())
    assert quality.classify(df.limit(0), labels, F.col("source"), F.col("source")).collect() == []
    assert quality.classify(df, labels.where("quality = 1"), F.col("source"), F.col("source")).count() == len(rows)


def test_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    tokenizer = separators.encoder(separators.ranks(VOCABULARY))
    want = {r.doc_id: len(tokenizer.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in separators.count_documents(docs, VOCABULARY).collect()} == want


def test_counts_odd(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "<|endoftext|>"), (3, "<|endoftext|>"), (4, "x y " * 40000)]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, file string, nth int")
    tokenizer = separators.encoder(separators.ranks(VOCABULARY))
    got = separators.count_documents(df.select("doc_id", "text", "file", "nth"), VOCABULARY).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(tokenizer.encode_ordinary(t or ""))) for i, t in rows)
    assert separators.count_documents(df.limit(0), VOCABULARY).collect() == []


def test_encode_in_pieces(monkeypatch):
    """Cut at long white space, a text has the same ids."""
    tokenizer, rnd = separators.encoder(separators.ranks(VOCABULARY)), random.Random(6)
    texts = ["".join(rnd.choice(["a", "B1", " ", "\n", "\t", "\r", ".", "\u3000", "\x1c", "é", "'s"]) * rnd.choice([1, 1, 2, 9]) for _ in range(60)) for _ in range(300)]
    want = [tokenizer.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(separators, "_BLANKS", re.compile(separators._BLANKS.pattern.replace("4096", "3")))
    assert [separators.encode(tokenizer, t) for t in texts] == want


def test_counts_of_long_blanks(spark):
    rows = [(1, " " * 10_000_000), (2, "a" + "\n" * 1_000_000 + "b"), (3, " \t" * 600_000 + "x"), (4, "x" * 1_000_000)]
    got = {r.doc_id: r.n_tokens for r in separators.count_documents(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()}
    assert len(got) == 4 and all(0 < n <= len(dict(rows)[i]) for i, n in got.items())


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rnd = random.Random(block)
    want = set()
    for f in range(4):
        lengths = [rnd.choice([0, 0, 1, 2, 3, 40, 200]) for _ in range(30)]
        ids = [x for n in lengths for x in [*rnd.choices(range(1000), k=n), separators.END]]
        if f == 1:
            ids += [7] * 50
            lengths.append(50)
        if f == 2:
            ids, lengths = [5] * 90, [90]
        if f == 3:
            ids, lengths = [], []
        (tmp_path / f"f{f}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        want |= {(f"f{f}.bin", i, n) for i, n in enumerate(lengths)}
    got = separators.token_counts(spark, f"file://{tmp_path}", block=block).collect()
    assert Counter(map(tuple, got)) == Counter(want)

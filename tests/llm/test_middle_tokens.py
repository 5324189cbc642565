import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import middle, queries, token_tables
from foliospark.llm.queries import TOKENIZER

ODD = ["", None, " ", "  a  ", "<P>", "a<M>b", "x" * 9000, "é" * 5000 + " 🦆" * 3, "ä ̈b", "tab\tline\r\nnul\x00end", " 　\x85\x1c\xa0", "İSTANBUL ΣΑΣ ﬁ ½", "<|endoftext|> a<|startoftext|>b", "don't we'll I'm 'sabc", "12345 1a2b", "각 가 한국어", "🏴‍☠️👩‍👩‍👧", "a" * 300 + "\n" + "ab " * 4000]


def mixed(seed, n):
    rng = random.Random(seed)
    letters = "abcXYZ '-.0123\n\t\ré̈ 　中\U0001f986<>PSM|"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def expected(key, text):
    t = text or ""
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(t)
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_rearranged_as_by_hand(spark):
    rows = list(enumerate(ODD + mixed(1, 400))) + [(None, "a null ident"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(t, k, "x") for k, t in rows], "text string, doc_id long, form string")
    out = middle.rearrange(docs).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    got = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()], key=repr)
    want = sorted([(k, *expected(k, t), t or "") for k, t in rows], key=repr)
    assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert middle.rearrange(docs.where("false")).count() == 0


def test_other_marks_and_names(spark):
    docs = spark.range(300).selectExpr("cast(id as string) n", "concat('body ', id, ' end') output")
    marks = ("<fim_prefix>", "<fim_suffix>", "<fim_middle>")
    out = middle.rearrange(docs.withColumnRenamed("n", "name"), "output", "name", seed="7", plain=0, spm=50, marks=marks)
    rows = out.withColumn("back", middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == f"body {r.name} end" and r.form != "plain" for r in rows)
    assert 100 < sum(r.form == "spm" for r in rows) < 200
    for bad in (("<P>", "<P>", "<M>"), ("P", "S", "M"), ("<a<b>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            middle.rearrange(docs, marks=bad)


def test_offsets_of_units():
    units = middle.Units()
    for t in filter(None, ODD + mixed(2, 100)):
        parts, before = units.pieces(t)
        assert "".join(parts) == t and before[-1] == len(t)
        assert all(units.offset(parts, before, r) == r for r in {0, len(t) // 3, len(t) // 2, len(t)})
    assert all(len(p) <= 9 for p in units.held)


def test_middle_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.op12_middle(spark, sf), queries.SQL["op12_middle"], sf)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_give_the_ids_of_whole_texts():
    with open(TOKENIZER, encoding="utf-8") as f:
        settings = f.read()
    coder, whole = token_tables.Encoder(settings), Tokenizer.from_file(TOKENIZER)
    ids = lambda c, t: np.frombuffer(c.encode([t])[0], "<i4").tolist()
    assert coder.words
    rng = random.Random(5)
    ascii_ = ["".join(map(chr, rng.choices(range(0, 128), k=rng.randint(0, 60)))) for _ in range(3000)] + ["".join(rng.choices("abAB09'.,-<|>_ ", k=rng.randint(0, 40))) for _ in range(3000)]
    latin = ["".join(map(chr, rng.choices([32, 39, 60, *range(0x21, 0x250)], k=rng.randint(0, 40)))) for _ in range(3000)] + [chr(c) + d for c in range(0x21, 0x250) for d in ("", "A", "1", ".", "\u0301")]
    for t in [*filter(None, ODD), *mixed(3, 3000), *ascii_, *latin]:
        assert ids(coder, t) == whole.encode(t, add_special_tokens=False).ids
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist() if r["text"]]
    for t in texts[:400]:
        assert ids(coder, t) == whole.encode(t, add_special_tokens=False).ids
    with open("/opt/tokenizers/byte_bpe_50k.json", encoding="utf-8") as f:
        other = token_tables.Encoder(f.read())  # there spaces are parts of tokens, and whole texts are encoded
    assert not other.words
    assert ids(other, "a  b c") == Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json").encode("a  b c", add_special_tokens=False).ids


def test_words_met_again_make_no_python_objects():
    with open(TOKENIZER, encoding="utf-8") as f:
        coder = token_tables.Encoder(f.read())
    words = [f"{a}ing{b}," for a in "abcdefghij" for b in "klmnopqrst"]
    text = " ".join(words * 4000)
    tracemalloc.start()
    try:
        (got,) = coder.encode([text])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == coder.encode([" ".join(words)])[0] * 4000
    assert most < len(got) + 8 * len(text)  # a string and a place in a list for each word need over 60 bytes


def test_pieces_are_merged_again_only_when_they_were_not_met_lately(monkeypatch):
    monkeypatch.setattr(token_tables, "HELD", 50)
    with open(TOKENIZER, encoding="utf-8") as f:
        coder = token_tables.Encoder(f.read())
    asked, merged, whole = [], coder._merged, coder._whole
    coder._merged = lambda p: asked.append(p) or merged(p)
    coder._whole = lambda w: asked.append(w) or whole(w)
    often, rare = [f"often{c}" for c in "abcdefghij"] + ["\u043c\u0438\u0440", "x" * 65], [f"rare{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    texts = [" ".join(often + rare), " ".join(often).upper(), " ".join(often), " ".join(often + rare)]
    first = Tokenizer.from_file(TOKENIZER)
    for t in texts:
        assert np.frombuffer(coder.encode([t])[0], "<i4").tolist() == first.encode(t, add_special_tokens=False).ids
    count = {w: asked.count(w) for w in often + rare}
    assert all(count[w] == 1 for w in often[:11]) and count["x" * 65] == 4 and all(count[w] == 2 for w in rare)
    assert "x" * 65 not in coder.pieces


def test_texts_of_a_batch_have_the_ids_of_each():
    with open(TOKENIZER, encoding="utf-8") as f:
        coder = token_tables.Encoder(f.read())
    texts, whole = [t or "" for t in ODD + mixed(6, 500)], Tokenizer.from_file(TOKENIZER)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert coder.lists(pa.array(texts, kind)).to_pylist() == want
        assert coder.lists(pa.array(texts, kind).slice(7, 20)).to_pylist() == want[7:27]
        assert coder.lists(pa.array([], kind)).to_pylist() == []


def test_portions_hold_so_many_bytes():
    texts = pa.array(["a" * 10, None, "", "b" * 95, "c" * 5, "\u00e9" * 200, "", "d"])
    assert [len(x) for x in token_tables.portions(texts, 100)] == [3, 2, 3]
    assert pa.concat_arrays(token_tables.portions(texts, 100)).equals(texts)
    assert [len(x) for x in token_tables.portions(texts.slice(3), 1 << 20)] == [5]
    assert list(token_tables.portions(texts.slice(8), 100)) == []


def test_many_portions_of_one_part(spark, tmp_path):
    texts = ["caf\u00e9 Don't 12,5 \n" * 700, "\u041f\u0440\u0438\u0432\u0435\u0442 a\u0308b  c\td " * 500, "", "z" * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    docs = spark.range(3000).withColumn("k", (F.col("id") % 4).cast("int")).join(F.broadcast(rows), "k").selectExpr("id doc_id", "text")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_tables.write(docs, f"file://{tmp_path}/t", TOKENIZER)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    whole = Tokenizer.from_file(TOKENIZER)
    each = [ids_of(whole, t) for t in texts]
    sums = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in each]
    n = [len(each[k % 4]) for k in range(3000)]
    want = [(k, a, n[k], sums[k % 4]) for k, a in zip(range(3000), np.cumsum([0, *n]).tolist())]
    got = token_tables.summary(spark, f"file://{tmp_path}/t").orderBy("doc_id").collect()
    assert 3000 * sum(len((t or "").encode()) for t in texts) / 4 > 2 * token_tables.BATCH
    assert list(map(tuple, got)) == want


def test_tables_hold_all_documents(spark, tmp_path):
    rows = [(k * 7 % 1009, t) for k, t in enumerate(ODD + mixed(4, 500))] + [(None, "null ident"), (5, "twice"), (5, "twice")] + [(8, f"one of many {i % 3}") for i in range(300)]
    docs = spark.createDataFrame([(t, k, 1) for k, t in rows], "text string, doc_id long, part int").repartition(4)
    path = f"file://{tmp_path}/t"
    token_tables.write(docs, path, TOKENIZER, layout={"parquet.page.row.count.limit": 50})
    whole = Tokenizer.from_file(TOKENIZER)
    got = token_tables.summary(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = sorted([(k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, t in rows for x in [ids_of(whole, t)]], key=repr)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=repr) == want
    one = token_tables.tokens(spark, path, F.col("doc_id") == 5).collect()
    assert sorted(r.ids for r in one) == sorted(ids_of(whole, t) for k, t in rows if k == 5)
    plan = spark.read.parquet(path).select("part", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<part:int,n_tokens:int>" in plan


def test_encodings_row_groups_and_indexes(spark, tmp_path):
    docs = spark.range(20_000, numPartitions=2).selectExpr("id doc_id", "concat('alpha beta ', id, repeat(' gamma', cast(id % 50 as int))) text").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_tables.write(docs, f"file://{tmp_path}/t", TOKENIZER, layout={"parquet.block.row.count.limit": 6000})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    (file,) = tmp_path.glob("t/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [6000, 6000, 6000, 2000]
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    (ids,) = (c for name, c in columns.items() if name.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    for name in ("doc_id", "offset", "n_tokens"):
        assert columns[name].encodings == ("DELTA_BINARY_PACKED",)


def test_empty_table_and_refusals(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_tables.write(none, f"file://{tmp_path}/t", TOKENIZER)
    assert token_tables.summary(spark, f"file://{tmp_path}/t").count() == 0


def test_query_of_token_tables(spark):
    sf = "/root/testdata/sf0.001"
    whole = Tokenizer.from_file(TOKENIZER)
    at, want = 0, []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = ids_of(whole, r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op13_token_tables(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want

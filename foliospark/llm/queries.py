"""One query an operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, decontaminate, licences, middle, quality, ranking, scratch, separators, token_tables
from .iblt import fingerprint_pairs
from .mixing import mix
from .scratch import documents
from .sharding import shard
from .simhash import near_duplicates
from .suffixes import dedupe

#: A rank file of a public tokenizer; the pattern that belongs to it lies beside it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A file of a public tokenizer.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 24).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return separators.count_documents(documents(spark, sf_dir), vocabulary)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x.item)))
    return found.select("doc_id", (F.size("leaks") > 0).alias("leaked"), items.alias("item_ids"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x.similarity)), F.lit(0.0)).alias("similarity"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(documents(spark, sf_dir)).drop("kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("row_hash")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), F.col("source"), path, keep=["doc_id"])


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scan(documents(spark, sf_dir)))


def op10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)))
    return bloom_lm.score(docs, ~F.col("held_out") & F.col("doc_id").isNotNull())


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(ranking.build(documents(spark, sf_dir)), documents(spark, sf_dir, "benchmark"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle.rearrange(documents(spark, sf_dir))
    text = middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_token_tables(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    path = scratch.place(spark, "token-table")
    token_tables.write(documents(spark, sf_dir), path, tokenizer)
    return token_tables.summary(spark, path)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: The terms of a text in DuckDB.
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = {
    "op11_ranking": f"""
with d as (select doc_id, {_TERMS} ts from documents), ok as (select doc_id, ts, len(ts)::bigint n from d where len(ts) > 0),
c as (select count(*)::bigint nn, sum(n)::bigint ll from ok), p as (select doc_id, n, unnest(ts) t from ok), tf as (select doc_id, n, t, count(*)::bigint tf from p group by all),
w as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint w from tf, c group by t, nn),
q as (select item_id, t, count(*)::bigint k from (select item_id, unnest({_TERMS}) t from (select distinct item_id, text from benchmark)) group by all),
s as (select item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::bigint score from q join w using (t) join tf using (t), c group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) rank, doc_id, score from s where score > 0)
select item_id, rank::int rank, doc_id, score from r where rank <= 20""",
    "op12_middle": """
with a as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || doc_id) h from documents),
b as (select *, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from a),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) x, greatest(h1 % (n + 1), h2 % (n + 1)) y, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from b),
e as (select *, substring(t, 1, x) p, substring(t, x + 1, y - x) m, substring(t, y + 1, n - y) s from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then x end prefix_chars, case when form <> 'plain' then y - x end middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from e""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid.llm import bpe, chat, licenses, mixing, near_dedup, packing, quality, spelling, suffix_dedup, token_shards, topk, toxicity, vector_codes
from slidegrid.llm.shared import fresh_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "token-shards")
    manifest = token_shards.write_token_shards(table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_shards.read_token_shards(out, manifest)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_records(chat.conversation_records(rows.unionByName(extra))))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048, table_bytes=token_shards.TABLE_BYTES)
    return packed.selectExpr("doc_id", "piece", "start", "cast(length as long) as length", "ids_crc32", "sequence_id", "offset")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(quality.ledger(table(spark, sf_dir, "documents")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs, length=400))
    digests = ["doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")]
    return removed.select(*digests, F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return both.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), *digests)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), least_length=7, least_count=2, drop_every=31)
    return spelling.spelling_variants(words, ratio=10)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_shards, op2_chat_formatting, op3_source_mixing, op4_best_fit_packing, op5_exact_top_k, op6_license_scan,
        op7_toxicity, op8_near_dedup, op9_quality_rules, op10_suffix_array_dedup, op11_bpe, op12_spelling_variants, op13_vector_codes,
    )
}

_TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op5_exact_top_k": _TOP_K_SQL, "op6_license_scan": licenses.SQL, "op9_quality_rules": quality.SQL, "op13_vector_codes": vector_codes.SQL}

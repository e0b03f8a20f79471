"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import chat, exact, ngramjoin, ordermin, pii, ppm, quality, rankbpe, rolling, sharding, tokencount, whitening
from gridlake.llm.common import documents
from gridlake.llm.packing import Bins, pack_documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) conv_id, CAST(t AS BIGINT) turn, r role, '{odd}' text FROM VALUES (0, 'user'), (1, 'assistant') AS x(t, r)")
    return chat.digests(chat.format_records(chat.records_from_rows(rows.unionByName(extra))))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), Bins(2048))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_documents(documents(spark, sf_dir), shingle=4, threshold=85)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprint_documents(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 40)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(documents(spark, sf_dir), audit=True).drop("failed_rule")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankbpe.digest_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = ppm.train(docs, ~F.col("held_out"))
    return ppm.predict(docs, model, keep=["doc_id", "held_out"])


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(documents(spark, sf_dir))


def op13_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_medians(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_formatting, op2_token_counts, op3_best_fit_packing, op4_ngram_jaccard, op5_order_minhash, op6_sharding, op7_pii, op8_quality_rules, op9_bpe_codec, op10_language_id, op11_embedding_whitening, op12_exact_dedup, op13_rolling_median)
}
SQL: dict[str, str] = {
    # DuckDB's lower() also lowers other letters, so A-Z is translated
    "op12_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op13_rolling_median": """
        WITH c AS (
            SELECT DISTINCT click_id, ts, kind, CASE WHEN value IS NOT NULL THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents FROM clicks WHERE ts IS NOT NULL
        ), w AS (
            SELECT a.click_id, a.kind, a.cents, list_sort(coalesce(list(b.cents) FILTER (WHERE b.cents IS NOT NULL), [])) AS v
            FROM c a JOIN c b ON a.kind IS NOT DISTINCT FROM b.kind AND b.ts BETWEEN a.ts - INTERVAL 360 MINUTE AND a.ts GROUP BY a.click_id, a.kind, a.cents
        ), m AS (
            SELECT *, len(v) AS n, CASE WHEN len(v) >= 5 THEN v[(len(v) + 1) // 2] + v[len(v) // 2 + 1] END AS median2 FROM w
        ), r AS (
            SELECT *, CASE WHEN n >= 5 THEN list_sort([abs(2 * x - median2) for x in v]) END AS u FROM m
        ), f AS (SELECT *, u[(n + 1) // 2] + u[n // 2 + 1] AS mad4 FROM r)
        SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * cents - median2) > 5 * mad4 AS far FROM f""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""The registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, clustering, lines, packing, passages, resampling, shards, simhash, topk, toxicity, warc
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.filter("id % 50 = 0"), rows, k=5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), shards=16)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.removed(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.vectors(table(spark, sf_dir, "embeddings"))
    return ann.neighbours(rows, rows.filter("id % 20 = 0"), k=20)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(table(spark, sf_dir, "conversations"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(clustering.kept(table(spark, sf_dir, "embeddings"))).rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_topk": op2_exact_topk,
    "op3_line_dedup": op3_line_dedup,
    "op4_hash_tree_shards": op4_hash_tree_shards,
    "op5_simhash": op5_simhash,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_ann": op9_ann,
    "op10_chat": op10_chat,
    "op11_resampling": op11_resampling,
    "op12_warc": op12_warc,
    "op13_hamerly": op13_hamerly,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": lines.SQL,
    "op11_resampling": resampling.SQL,
    "op12_warc": warc.SQL,
    "op13_hamerly": clustering.SQL,
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
    """,
}

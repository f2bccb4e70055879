"""Registered queries of the corpus operators: thin digests of each operator's result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import centroids, chat_format, chunked_bpe, license_scan, line_dedup, packing, quality_mil, quality_rules, simhash_dedup, source_divergence, token_output, topk, toxicity
from daybook.llm.common import documents, fold, labels, scratch_path

TOXIC_AT, QUALITY_AT = 0.5, 0.7


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = token_output.write_token_shards(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_output.shard_digests(spark, folder, manifest)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra)))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train_model(docs, labels(spark, sf_dir), fold("doc_id", 5) != 0)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text")))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_mil.train_model(docs, labels(spark, sf_dir), fold("doc_id", 4) != 2)
    scored = quality_mil.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(quality_rules.judge_documents(documents(spark, sf_dir).select("doc_id", "text")))


def op8_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.digests(chunked_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op10_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op11_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digests(license_scan.scan_licenses(documents(spark, sf_dir).select("doc_id", "text")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.compare_sources(documents(spark, sf_dir), min_docs=3, top=200)


def op13_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(*centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3))


def queries() -> dict:
    own = (
        op1_token_shards, op2_chat_format, op3_simhash_dedup, op4_toxicity, op5_line_dedup, op6_quality_mil, op7_quality_rules, op8_chunked_bpe, op9_best_fit_packing,
        op10_ball_tree_topk, op11_license_index, op12_source_divergence, op13_heap_kmeans,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op10_ball_tree_topk": topk.ORACLE, "op12_source_divergence": source_divergence.ORACLE, "op13_heap_kmeans": centroids.ORACLE}

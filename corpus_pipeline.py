"""From raw documents to packed training sequences: five stages, each one operator.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns a DataFrame; all but the last return the columns of ``docs``. ``run`` writes each
stage as Parquet in the shared folder and rereads it, so a lost executor costs a stage's
tasks, never an earlier stage. No SQL is given: the first two stages are learned models
and the last is an optimisation, so tests hold the stages to brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import line_dedup, packing, quality_mil, simhash_dedup, toxicity
from daybook.llm.common import documents, fold, labels, materialise, unused
from daybook.llm.queries import QUALITY_AT, TOXIC_AT


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_mil.train_model(docs, labels(spark, sf_dir), fold("doc_id", 4) != 2)
    score = unused(docs, "_score")
    return quality_mil.score_documents(docs, model, score=score).where(F.col(score) >= QUALITY_AT).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.train_model(docs, labels(spark, sf_dir), fold("doc_id", 5) != 0)
    score = unused(docs, "_score")
    return toxicity.score_documents(docs, model, score=score).where(F.col(score) < TOXIC_AT).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document holds too; n_chars follows the text."""
    counts = unused(docs, "_n_lines"), unused(docs, "_n_dropped")
    kept = line_dedup.dedup_lines(docs, counts=counts)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

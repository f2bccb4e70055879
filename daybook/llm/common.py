"""Helpers shared by the corpus operators: shared scratch tables and text columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources.shared import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/daybook-{uuid.uuid4().hex[:12]}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    Parquet under ``spark.checkpoint.dir`` survives lost executors and is
    columnar and compressed, unlike the row blobs of ``checkpoint()``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one where the columns of ``docs`` have it, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(docs: DataFrame, *names: str) -> list[str]:
    """The columns of ``docs`` but those that ``names`` would replace, in any case."""
    taken = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in taken]


def sliced(body: bytes, table: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, some ``size`` bytes at a time: ``table`` makes blanks of what is no part of a word."""
    at = 0
    while at < len(body):
        end = at + size
        part = body[at:end].translate(table)
        # a word that runs over the end goes on to its own end
        while end < len(body) and part[-1:] != b" ":
            more = body[end : end + 65536].translate(table)
            stop = more.find(b" ") + 1 or len(more)
            part, end = part + more[:stop], end + stop
        yield part.split()
        at = end


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)

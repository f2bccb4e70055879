"""Exports in text formats: written to the shared folder and read back, malformed records apart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources.shared import cut, shared_dir

_BAD = "_malformed"


def export_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/daybook-{uuid.uuid4().hex[:12]}/{name}"


def write_lines(lines: DataFrame, name: str, *by: str) -> str:
    """Write a frame whose column ``value`` is a line of text; folders by ``by``."""
    path = export_path(lines.sparkSession, name)
    writer = lines.write.partitionBy(*by) if by else lines.write
    writer.text(path)
    return path


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of an NDJSON scan, and the lines that are none (column ``line``)."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    kept = [c for c in lines.columns if c != "value"]
    return parsed.where(f"_r.{_BAD} IS NULL").select(*kept, "_r.*").drop(_BAD), parsed.where(f"_r.{_BAD} IS NOT NULL").select(*kept, F.col("value").alias("line"))


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    return spark.read.options(**options).schema(f"{schema}, {_BAD} string").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a CSV scan with a header, quoted fields over several lines included; those that don't fit are left out."""
    return _csv(spark, path, schema).where(f"{_BAD} IS NULL").drop(_BAD)


def malformed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records that ``read_csv`` leaves out (column ``line``), written to the shared folder once."""
    return cut(_csv(spark, path, schema).where(f"{_BAD} IS NOT NULL")).select(F.col(_BAD).alias("line"))

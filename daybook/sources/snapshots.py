"""Snapshot tables by refresh_id: idempotent replace, tail replacement, pruning, guards, NDJSON scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_slice(df: DataFrame, path: str, refresh_id: str) -> None:
    """Write one refresh's rows; what the table holds of that refresh goes, other slices stay."""
    rows = df.withColumn("refresh_id", F.lit(refresh_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("refresh_id").parquet(path)


def replace_tail(previous: DataFrame, fresh: DataFrame, day: str, tail_start) -> DataFrame:
    """The predecessor before ``tail_start`` and the recomputed rows from it on."""
    return previous.where(F.col(day) < F.lit(tail_start)).unionByName(fresh.where(F.col(day) >= F.lit(tail_start)))


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def keep_latest(df: DataFrame, n: int, refresh: str = "refresh_id") -> DataFrame:
    """Rows of the ``n`` greatest refreshes; the list of refreshes is small."""
    kept = df.select(refresh).distinct().orderBy(F.col(refresh).desc()).limit(n)
    return df.join(F.broadcast(kept), refresh, "left_semi")


def guard_shrinkage(new_rows: int, old_rows: int, floor: float = 0.5) -> None:
    if old_rows and new_rows < floor * old_rows:
        raise ValueError(f"refused: {new_rows} rows would replace {old_rows}")


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows of NDJSON files, and the malformed lines by file."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    lines = spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("r"), F.col("_metadata.file_path").alias("_file"))
    rows = lines.select("r.*", "_file")
    return rows.where("_corrupt IS NULL").drop("_corrupt", "_file"), rows.where("_corrupt IS NOT NULL").select("_file", "_corrupt")

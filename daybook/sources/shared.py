"""The folder that driver and executors share, cutting a lineage by a checkpoint in it, and tasks of a bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task where they are dealt out by key.
TASK_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local master, whose executors are the driver, may leave it unset (tests, a
    laptop): a folder is then made and set. On a cluster it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="daybook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/daybook-{uuid.uuid4().hex[:12]}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet, in columns: for what is large and read often."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in tasks of some TASK_ROWS of its ``rows`` rows.

    What is grouped or joined on these keys next needs no further shuffle, and its memory follows the size of a task, not of the input.
    """
    return df.repartition(rows // TASK_ROWS + 1, *keys)


def heavy(df: DataFrame, rows: int, *columns: str) -> DataFrame | None:
    """``_hot``: values that as many of ``df``'s ``rows`` rows as a task holds share in one of ``columns``; None where one task holds all rows.

    They are guessed from some 200 rows a task, by hash, so a few may be missed or too many; what follows from that is the way that a row
    goes, never a result.
    """
    if rows <= TASK_ROWS:
        return None
    one_in = max(1, TASK_ROWS // 200)
    seen = df.select(*columns).where(F.pmod(F.xxhash64(*columns), F.lit(one_in)) == 0)
    seen = seen.select(F.explode(F.array(*columns)).alias("_hot")).groupBy("_hot").count()
    return cut(seen.where(F.col("count") * one_in * 2 >= TASK_ROWS).select("_hot"))

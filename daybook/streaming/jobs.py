"""The incremental jobs as Structured Streaming: each takes a streaming frame of events.

Event time is ``ts``; rows later than the watermark are dropped, where the batch forms
would sort them in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Gap sessions a user."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def daily(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding aggregates."""
    w = F.window("ts", width, slide or width)
    return events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("event_type", F.col("w.start").alias("start"), "n", "mean")


def with_context(events: DataFrame, contexts: DataFrame) -> DataFrame:
    """Stream rows joined to a static table of intervals (user_id, valid_from, valid_to, context)."""
    on = (events["user_id"] == contexts["user_id"]) & (events["ts"] >= contexts["valid_from"]) & (events["ts"] < contexts["valid_to"])
    return events.join(contexts, on, "left").select(events["event_id"], events["user_id"], events["ts"], contexts["context"])


def near_pairs(a: DataFrame, b: DataFrame, late: str = "1 day", band: str = "90 minutes") -> DataFrame:
    """Pairs of two streams of one user at most ``band`` apart."""
    x = a.withWatermark("ts", late).select(F.col("user_id"), F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    y = b.withWatermark("ts", late).select(F.col("user_id").alias("b_user"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    return x.join(y, F.expr(f"user_id = b_user AND b_ts >= a_ts - INTERVAL {band} AND b_ts <= a_ts + INTERVAL {band}")).select("user_id", "a_id", "b_id")


def append_by_day(stream: DataFrame, path: str, checkpoint: str):
    """Append new rows, partitioned by logical day; a replayed batch overwrites its own folder.

    Within a day each micro-batch writes under its number, so a batch that is run again after a
    failure replaces what it wrote before, and a day's rows lie together; ``compact_day`` puts them into one folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        day = F.to_date(F.col("ts") - F.expr("INTERVAL 6 HOURS"))
        rows = batch.withColumn("logical_day", day).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("logical_day", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_day(spark: SparkSession, path: str, day: str, upto: int) -> int:
    """Rewrite a day's batches up to number ``upto`` (none of which can run again) as batch -1; how many rows that has now.

    The new folder is written apart and put in place of the old ones, batch -1 among them.
    """
    folder = f"{path}/logical_day={day}"
    rows = spark.read.option("basePath", path).parquet(folder).where(F.col("batch") <= upto)
    whole = f"{path}/_compacted-{day}"  # a name that readers pass over
    rows.drop("logical_day", "batch").coalesce(1).write.mode("overwrite").parquet(whole)
    n = spark.read.schema(EVENTS).parquet(whole).count()
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(top):
        number = status.getPath().getName().partition("batch=")[2]
        if number.lstrip("-").isdigit() and int(number) <= upto:
            store.delete(status.getPath(), True)
    store.rename(jvm.org.apache.hadoop.fs.Path(whole), jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=-1"))
    return n

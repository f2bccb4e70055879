"""Bounded readers: stored tables read by window, host, project and snapshot, with the filters that reach the scan.

A window is the middle half of the days that the table holds; it, and a limit, are what these operators are for.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators.dedup import latest_rows
from daybook.plans.registry import registry
from daybook.sources.exports import export_path, read_json, write_lines
from daybook.sources.snapshots import replace_slice
from daybook.sources.tables import commits, events, sql

REGISTRY, query = registry()
#: The first day of the window and the first day after it, by quarters of the whole range.
BOUNDS = """b AS (SELECT min(day) + CAST((max(day) - min(day)) // 4 AS INTEGER) AS lo, max(day) - CAST((max(day) - min(day)) // 4 AS INTEGER) AS hi FROM {0})"""
IN_WINDOW = "day >= (SELECT lo FROM b) AND day < (SELECT hi FROM b)"


def window_of(df: DataFrame, column: str = "day"):
    """The two days of BOUNDS, or two nulls for an empty table: one aggregate row."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return None, None
    quarter = timedelta(days=(hi - lo).days // 4)
    return lo + quarter, hi - quarter


def between(df: DataFrame, bounds, column: str = "day") -> DataFrame:
    lo, hi = bounds
    return df.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))


def ready(spark, df: DataFrame, name: str, *by: str):
    """Write and read back as Parquet, in folders by ``by``, so that their filters skip whole folders."""
    path = export_path(spark, name)
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(path)  # a folder's rows come from one task
    return spark.read.parquet(path)


@query(sql("WITH " + BOUNDS.format("ev") + f""" SELECT event_type AS kind, 's' || (user_id % 3) AS signal, day, count(*) AS n FROM ev WHERE {IN_WINDOW} AND event_id % 7 <> 3 GROUP BY ALL""", "ev"))
def temporal_signals(spark, sf_dir):
    """Derived signals from an NDJSON store inside a window; lines that are no records (every seventh is torn here) are passed over."""
    e = events(spark, sf_dir)
    line = F.to_json(F.struct(F.col("event_type").alias("kind"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("signal"), F.col("day").alias("event_date")))
    path = write_lines(e.select(F.when(F.col("event_id") % 7 == 3, F.substring(line, 1, 20)).otherwise(line).alias("value")), "signals")
    rows, _ = read_json(spark, path, "kind string, signal string, event_date date")
    return between(rows.withColumnRenamed("event_date", "day"), window_of(e)).groupBy("kind", "signal", "day").agg(F.count("*").alias("n"))


@query(sql("WITH " + BOUNDS.format("ev") + f""" SELECT CAST(user_id % 4 AS INTEGER) AS host, day, count(*) AS n, min("at") AS first_at, max("at") AS last_at FROM ev WHERE {IN_WINDOW} AND user_id % 4 = 1 GROUP BY ALL""", "ev"))
def metric_samples(spark, sf_dir):
    """Samples of a host in a window from a store in folders by host and day: both filters choose folders."""
    e = events(spark, sf_dir)
    s = ready(spark, e.select((F.col("user_id") % 4).cast("int").alias("host"), "day", "at", "value"), "samples", "host", "day")
    return between(s.where("host = 1"), window_of(e)).groupBy("host", "day").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


SAMPLED = """r AS (SELECT event_id, user_id, CAST(user_id % 4 AS INTEGER) AS host, "at", day, CAST(floor(value * 100) AS BIGINT) AS read_bytes, CAST(floor(value * 7) AS BIGINT) AS calls FROM ev)"""


def refreshed(spark, sf_dir) -> DataFrame:
    """Samples stored under two refreshes: the first holds all of them with half the bytes, the second those of even ids as they are."""
    e = events(spark, sf_dir).select("event_id", "user_id", (F.col("user_id") % 4).cast("int").alias("host"), "at", "day", F.floor(F.col("value") * 100).alias("read_bytes"), F.floor(F.col("value") * 7).alias("calls"))
    path = export_path(spark, "refreshed")
    replace_slice(e.withColumn("read_bytes", F.floor(F.col("read_bytes") / 2)), path, "r1")
    replace_slice(e.where("event_id % 2 = 0"), path, "r2")
    return spark.read.parquet(path)


@query(sql("WITH " + SAMPLED + ", " + BOUNDS.format("ev") + f""" SELECT event_id, host, "at", CASE WHEN event_id % 2 = 0 THEN read_bytes ELSE read_bytes // 2 END AS read_bytes, calls FROM r WHERE {IN_WINDOW} AND host IN (0, 2) ORDER BY "at", read_bytes DESC, calls DESC, event_id LIMIT 500""", "ev"))
def io_delta_samples(spark, sf_dir):
    """The latest row of each sample over all refreshes, of two hosts in a window, in time order, heaviest first, 500 at most (the limit is the feature)."""
    s = refreshed(spark, sf_dir).where("host IN (0, 2)")
    kept = latest_rows(between(s, window_of(events(spark, sf_dir))), ["event_id"], [F.desc("refresh_id")])
    return kept.orderBy("at", F.desc("read_bytes"), F.desc("calls"), "event_id").limit(500).select("event_id", "host", "at", "read_bytes", "calls")


@query(sql("WITH " + SAMPLED + ", " + BOUNDS.format("ev") + f""" SELECT event_id, "at", host, read_bytes, read_bytes - read_bytes // 3 AS cache, read_bytes // 3 AS anonymous FROM r WHERE {IN_WINDOW} AND event_id % 2 = 0 AND host = 3 ORDER BY "at" DESC, event_id DESC LIMIT 200""", "ev"))
def memory_breakdown(spark, sf_dir):
    """The 200 newest samples of one refresh and host, split into parts (the limit is the feature)."""
    s = refreshed(spark, sf_dir).where("refresh_id = 'r2' AND host = 3")
    part = F.floor(F.col("read_bytes") / 3)
    rows = between(s, window_of(events(spark, sf_dir))).orderBy(F.desc("at"), F.desc("event_id")).limit(200)
    return rows.select("event_id", "at", "host", "read_bytes", (F.col("read_bytes") - part).alias("cache"), part.alias("anonymous"))


@query(sql("WITH " + BOUNDS.format("commits") + f""" SELECT sha, day, kind, status FROM commits WHERE {IN_WINDOW} AND project = 'BUILDING' ORDER BY day DESC, sha DESC LIMIT 1000""", "commits"))
def work_observations(spark, sf_dir):
    """Runs of one project in a window, newest first, 1,000 at most (the limit is the feature)."""
    c = commits(spark, sf_dir)
    return between(c.where("project = 'BUILDING'"), window_of(c)).orderBy(F.desc("day"), F.desc("sha")).limit(1000).select("sha", "day", "kind", "status")


@query(sql("""SELECT project, kind, count(*) AS files, CAST(sum(CAST(floor(lines) AS BIGINT)) AS BIGINT) AS size FROM commits WHERE project IN ('BUILDING', 'MACHINERY') GROUP BY ALL""", "commits"))
def snapshot_slices(spark, sf_dir):
    """Rows of the latest snapshot by project; older snapshots in the store take no part."""
    path = export_path(spark, "slices")
    s = commits(spark, sf_dir).groupBy("project", "kind").agg(F.count("*").alias("files"), F.sum(F.floor("lines")).alias("size"))
    replace_slice(s.withColumn("files", F.lit(0).cast("long")), path, "earlier")
    replace_slice(s, path, "latest")
    return spark.read.parquet(path).where("refresh_id = 'latest' AND project IN ('BUILDING', 'MACHINERY')").select("project", "kind", "files", "size")


@query(sql("WITH " + BOUNDS.format("ev") + f""", a AS (SELECT 'run:' || event_id AS id, 'run' AS store, day, value, TRUE AS timed FROM ev WHERE event_type = 'click' UNION ALL SELECT 'stage:' || event_id, 'stage', day, NULL, FALSE FROM ev WHERE event_type = 'view'
UNION ALL SELECT 'test:' || event_id, 'test', day, value, TRUE FROM ev WHERE event_type = 'error') SELECT store, day, count(*) AS n, count(value) AS n_timed FROM a WHERE {IN_WINDOW} GROUP BY ALL""", "ev"))
def invocations(spark, sf_dir):
    """Histories of three stores with columns of their own (one lacks the duration) as one, ids prefixed by store, inside a window."""
    e = events(spark, sf_dir)
    kinds = {"run": ("click", True), "stage": ("view", False), "test": ("error", True)}
    stores = [ready(spark, e.where(F.col("event_type") == k).select("event_id", "day", *(["value"] if timed else [])), name).withColumn("store", F.lit(name)) for name, (k, timed) in kinds.items()]
    every = stores[0].unionByName(stores[1], allowMissingColumns=True).unionByName(stores[2], allowMissingColumns=True)
    rows = between(every.withColumn("id", F.concat("store", F.lit(":"), F.col("event_id").cast("string"))), window_of(e))
    return rows.groupBy("store", "day").agg(F.count("id").alias("n"), F.count("value").alias("n_timed"))


@query(sql("WITH " + BOUNDS.format("ev") + f""" SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS conversations, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS minutes FROM ev WHERE {IN_WINDOW} AND event_id % 5 <> 0 GROUP BY 1""", "ev"))
def work_events(spark, sf_dir):
    """Work events of a window; those without a start (every fifth here) are in no window."""
    e = events(spark, sf_dir)
    s = ready(spark, e.select("event_id", "user_id", "event_type", "value", F.when(F.col("event_id") % 5 != 0, F.col("day")).alias("day")), "work")
    return between(s, window_of(e)).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("conversations"), F.sum(F.floor("value")).alias("minutes"))


@query(sql("WITH " + BOUNDS.format("ev") + f""" SELECT 'c' || user_id AS id, day, max(event_id) AS event_id, count(*) AS exports FROM ev WHERE event_type = 'signup' AND {IN_WINDOW} GROUP BY ALL""", "ev"))
def commitments(spark, sf_dir):
    """Dated NDJSON exports, the date in the folder's name; a window chooses folders, and a commitment exported again keeps its newest row."""
    e = events(spark, sf_dir)
    line = F.to_json(F.struct(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("id"), "event_id")).alias("value")
    path = write_lines(e.where("event_type = 'signup'").select("day", line), "commitments", "day")
    rows, _ = read_json(spark, path, "id string, event_id long")
    return between(rows, window_of(e)).groupBy("id", "day").agg(F.max("event_id").alias("event_id"), F.count("*").alias("exports"))


@query(sql("WITH " + BOUNDS.format("ev") + f""" SELECT "at", CAST(floor(value) AS BIGINT) AS text, CAST(min(event_id) AS BIGINT) AS event_id FROM ev WHERE {IN_WINDOW} GROUP BY ALL""", "ev"))
def clipboard_entries(spark, sf_dir):
    """Entries of several JSON files in a window; the same instant and text in two files is one entry."""
    e = events(spark, sf_dir)
    line = F.to_json(F.struct("at", F.floor("value").alias("text"), "event_id", "day")).alias("value")
    files = e.select(line, F.lit("a").alias("file")).unionByName(e.where("event_id % 3 = 0").select(line, F.lit("b").alias("file")))
    rows, _ = read_json(spark, write_lines(files, "clipboard", "file"), "at long, text long, event_id long, day date")
    return between(rows, window_of(e)).groupBy("at", "text").agg(F.min("event_id").alias("event_id"))

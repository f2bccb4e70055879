"""Typed frames over the supplied tables: the stand-ins for commits, events, spans, nodes.

Times are microseconds since the epoch where intervals are computed with, so that
joins and islands work on plain longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds of a zone-less timestamp (the session's zone is UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def commits(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """sha, project, day, kind, lines, thread: orders with their customer's segment; ``deal``: in tasks of TASK_ROWS orders."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("project"))
    if deal:
        rows = o.count()
        o, c = dealt(o, rows, "o_custkey"), dealt(c, rows, "o_custkey")
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("sha"), "project", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("kind"),
        F.col("o_totalprice").alias("lines"), F.col("o_custkey").alias("thread"), F.col("o_orderstatus").alias("status"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, path, day, change, lines: one row a file change."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("change"),
        F.col("l_quantity").alias("lines"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("owner"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, at (microseconds), day, value, props."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"), F.to_date("ts").alias("day"), "value", "props")


def whole_months(e: DataFrame) -> tuple[int, int]:
    """Microseconds of the start of the first and of the end of the last calendar month that hold events; (0, 0) without any."""
    start = F.date_trunc("month", F.timestamp_micros(F.min("at")))
    end = F.date_trunc("month", F.timestamp_micros(F.max("at"))) + F.expr("INTERVAL 1 MONTH")
    lo, hi = e.agg(F.unix_micros(start), F.unix_micros(end)).first()
    return (lo or 0), (hi or 0)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as half-open spans: start, end = start + whole minutes of the value."""
    e = events(spark, sf_dir)
    return e.select("event_id", "user_id", "event_type", F.col("at").alias("start"), (F.col("at") + F.floor(F.abs("value")).cast("long") * 60_000_000).alias("end"), "day")


#: The same frames as DuckDB common table expressions.
SQL = {
    "commits": """commits AS (SELECT o_orderkey AS sha, c_mktsegment AS project, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS kind,
  o_totalprice AS lines, o_custkey AS thread, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "changes": """changes AS (SELECT l_orderkey AS sha, l_partkey AS path, CAST(l_shipdate AS DATE) AS day, l_returnflag AS change,
  l_quantity AS lines, l_linenumber AS line, l_suppkey AS owner FROM lineitem)""",
    "ev": """ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS "at", CAST(ts AS DATE) AS day, value, props FROM events)""",
    "spans": """spans AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS start, epoch_us(ts) + CAST(floor(abs(value)) AS BIGINT) * 60000000 AS "end",
  CAST(ts AS DATE) AS day FROM events)""",
}


def sql(body: str, *frames: str) -> str:
    """``body`` (a SELECT, or more CTEs before one) over the named frames."""
    body = body.strip()
    return "WITH " + ",\n".join(SQL[f] for f in frames) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)

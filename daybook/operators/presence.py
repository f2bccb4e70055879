"""Silence and presence: long gaps of streams, what else was alive in them, and presence records set right by other signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.joins import asof_join, interval_join

#: Sources of a forced absence, the strongest first.
SOURCES = ["sleep-overlap", "empty-app", "stuck-window", "keylog-silent"]


def long_gaps(df: DataFrame, bounds: DataFrame, key: str, start: str, end: str, least: int) -> DataFrame:
    """key, gap_start, gap_end: stretches of ``least`` or more that no interval covers, within the key's ``lo`` to ``hi`` of ``bounds``.

    Intervals lie inside their bounds. Two that start less than ``least`` apart leave no such gap between them, so a key keeps a row for
    each stretch of ``least`` before anything is sorted: the window grows with time, not with rows. A key of ``bounds``
    without intervals is one gap.
    """
    kept = df.groupBy(key, F.floor(F.col(start) / least).alias("_bin")).agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    edges = bounds.select(key, F.explode(F.array(*[F.struct(F.col(at).alias("_s"), F.col(at).alias("_e"), F.lit(o).alias("_o")) for at, o in (("lo", 0), ("hi", 2))])).alias("_p"))
    points = kept.select(key, "_s", "_e", F.lit(1).alias("_o")).unionByName(edges.select(key, "_p.*"))
    reach = F.max("_e").over(Window.partitionBy(key).orderBy("_s", "_o").rowsBetween(Window.unboundedPreceding, -1))
    gaps = points.select(key, reach.alias("gap_start"), F.col("_s").alias("gap_end"))
    return gaps.where(F.col("gap_end") - F.col("gap_start") >= least)


def silent_windows(spans: DataFrame, points: DataFrame, key: str, span: str, at: str, least: int, width: int) -> DataFrame:
    """key, ``span``, start, end: stretches of ``least`` or more without a point within each span (key, ``span``, start, end).

    The long gaps of a key are few; they, not its points, meet the spans.
    """
    bounds = spans.groupBy(key).agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    inside = points.join(bounds, key).where((F.col(at) >= F.col("lo")) & (F.col(at) <= F.col("hi")))
    gaps = long_gaps(inside, bounds, key, at, at, least)
    both = interval_join(spans.select(key, span, F.col("start").alias("_a"), F.col("end").alias("_b")), gaps, key, width, ("_a", "_b"), ("gap_start", "gap_end"))
    cut = both.select(key, span, F.greatest("_a", "gap_start").alias("start"), F.least("_b", "gap_end").alias("end"))
    return cut.where(F.col("end") - F.col("start") >= least)


def outages(presence: DataFrame, windows: DataFrame, web: DataFrame, bounds: DataFrame, key: str, least: int, width: int) -> DataFrame:
    """key, gap_start, gap_end, windows, web, pattern: long gaps of presence by what started meanwhile.

    Pattern A: neither of the others; B: web alone; C: windows. A gap that reaches the end of the bounds ends there.
    """
    gaps = long_gaps(presence, bounds, key, "start", "end", least)
    started = lambda df, kind: df.select(key, F.col("start").alias("_t"), (F.col("start") + 1).alias("_u"), F.lit(kind).alias("_kind"))
    met = interval_join(gaps, started(windows, "windows").unionByName(started(web, "web")), key, width, ("gap_start", "gap_end"), ("_t", "_u"))
    counts = met.groupBy(key, "gap_start", "gap_end").agg(*[F.count_if(F.col("_kind") == k).alias(k) for k in ("windows", "web")])
    found = gaps.join(counts, [key, "gap_start", "gap_end"], "left").na.fill(0, ["windows", "web"])
    return found.withColumn("pattern", F.when(F.col("windows") > 0, "C").when(F.col("web") > 0, "B").otherwise("A"))


def without(stretches: DataFrame, points: DataFrame, key: str, at: str) -> DataFrame:
    """The stretches (key, start, end, more) within which no point lies, the end left out: the last point before the end tells."""
    last = points.select(key, F.col(at).alias("_seen"))
    seen = asof_join(stretches.withColumn("_last", F.col("end") - 1), last, key, "_last", "_seen", "_seen")
    return seen.where(F.col("_seen").isNull() | (F.col("_seen") < F.col("start"))).drop("_last", "_seen", "_seen_at")


def repair(events: DataFrame, sleep: DataFrame, windows: DataFrame, presses: DataFrame, commands: DataFrame, key: str, active: str, silent: int, stuck: int, long: int, width: int) -> DataFrame:
    """key, event_id, start, end, status, original_status, source: ``events`` (key, event_id, start, end, status), active ones split where other signals show absence.

    Absent: sleep (key, start, end); within events of ``long`` or more, windows (key, start, end, app) without an app, and windows of
    ``stuck`` or more with no command in them; and, in events that meet the days of the key's presses, ``silent`` or more without a press,
    unless one sleep holds all of it or a command falls in it. Stretches that touch become one, of the strongest source.
    """
    own = events.where((F.col("status") == active) & (F.col("end") > F.col("start"))).select(key, "event_id", F.col("start").alias("_a"), F.col("end").alias("_b"))

    def shared(other: DataFrame, held: DataFrame = own) -> DataFrame:
        """What an event and an interval of the other share."""
        both = interval_join(held, other.withColumnRenamed("start", "_s").withColumnRenamed("end", "_e"), key, width, ("_a", "_b"), ("_s", "_e"))
        return both.withColumn("start", F.greatest("_a", "_s")).withColumn("end", F.least("_b", "_e"))

    asleep = shared(sleep.select(key, "start", "end")).select(key, "event_id", "start", "end")
    focus = shared(windows.where("end > start").select(key, "start", "end", "app"), own.where(F.col("_b") - F.col("_a") >= long))
    empty = focus.where(F.coalesce(F.trim("app"), F.lit("")) == "").select(key, "event_id", "start", "end")
    still = without(focus.where(F.col("_e") - F.col("_s") >= stuck).select(key, "event_id", "start", "end"), commands, key, "at")

    day = 86_400_000_000
    covered = presses.groupBy(key).agg(F.min(F.floor(F.col("at") / day)).alias("_first"), F.max(F.floor(F.col("at") / day)).alias("_last"))
    logged = own.join(covered, key).where((F.floor(F.col("_b") / day) >= F.col("_first")) & (F.floor(F.col("_a") / day) <= F.col("_last")))
    quiet = silent_windows(logged.select(key, "event_id", F.col("_a").alias("start"), F.col("_b").alias("end")), presses.select(key, "at"), key, "event_id", "at", silent, width)
    held = asleep.groupBy("event_id", F.col("start").alias("_s")).agg(F.max("end").alias("_e"))
    inside = quiet.join(held, "event_id").where((F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end"))).select("event_id", "start", "end").distinct()
    quiet = without(quiet.join(inside, ["event_id", "start", "end"], "left_anti").select(key, "event_id", "start", "end"), commands, key, "at")

    parts = [df.select("event_id", "start", "end", F.lit(rank).alias("_rank")) for rank, df in enumerate((asleep, empty, still, quiet))]
    forced = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("event_id").orderBy("start", "end", "_rank")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = forced.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("event_id", "_run").agg(F.min("start").alias("_s"), F.max("end").alias("_e"), F.min("_rank").alias("_rank")).select("event_id", "_s", "_e", "_rank")
    # each event's end closes what is left of it
    marks = merged.unionByName(own.select("event_id", F.col("_b").alias("_s"), F.col("_b").alias("_e"), F.lit(None).cast("int").alias("_rank")))
    laid = marks.join(own, "event_id").withColumn("_from", F.coalesce(F.lag("_e").over(Window.partitionBy("event_id").orderBy("_s", F.col("_rank").isNull())), F.col("_a")))
    name = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("_rank") + 1)
    two = F.array(
        F.struct(F.col("_from").alias("start"), F.col("_s").alias("end"), F.lit(active).alias("status"), F.lit("").alias("source")),
        F.struct(F.col("_s").alias("start"), F.col("_e").alias("end"), F.lit("afk").alias("status"), F.when(F.col("_rank").isNotNull(), name).otherwise("").alias("source")),
    )
    split = laid.select(key, "event_id", F.explode(two).alias("_p")).select(key, "event_id", "_p.*").where("end > start")
    status = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").otherwise(F.lower(F.trim(c)))
    other = events.where(~F.col("status").eqNullSafe(active) | (F.col("end") <= F.col("start"))).select(key, "event_id", "start", "end", status("status").alias("status"), F.lit("").alias("source"), status("status").alias("original_status"))
    return split.withColumn("original_status", F.lit(active)).unionByName(other).select(key, "event_id", "start", "end", "status", "original_status", "source")

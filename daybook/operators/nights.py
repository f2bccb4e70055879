"""Nights inferred from four layers of evidence: a wearable's sleep records, absences between active spans, key presses, media playing.

Layers are joined by time, never a subject at a time: overlaps by bins, counts by
band. Only the choice of the absence that belongs to a record depends on what earlier
records chose; records and absences that touch form stretches of some hours, and each
stretch is settled by itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.dedup import merge_islands
from daybook.operators.joins import interval_join
from daybook.sources.shared import cut

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
#: What makes an absence a record's, what rules one out, and what each finding takes from the confidence.
LEAST_GAP, MOST_GAP, NEAR, SHARED, KEYS = 3 * HOUR, 16 * HOUR, 90 * MINUTE, 30 * MINUTE, 20


def absences(active: DataFrame, key: str) -> DataFrame:
    """key, g_start, g_end, g: the time from a span's end to the start of the next one, where it is long enough; numbered."""
    w = Window.partitionBy(key).orderBy("start", "end")
    g = active.select(key, F.col("end").alias("g_start"), F.lead("start").over(w).alias("g_end")).where(F.col("g_end") - F.col("g_start") >= LEAST_GAP)
    return g.withColumn("g", F.row_number().over(Window.partitionBy(key).orderBy("g_start")))


def records(watch: DataFrame, key: str) -> DataFrame:
    """key, w_start, w_end, score, minutes, n: of records that touch, the longest (then a scored one, then the first), and how many there were."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = watch.where("end > start").withColumn("_opens", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    own = own.withColumn("_island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min(F.struct((F.col("start") - F.col("end")).alias("a"), F.col("score").isNull().alias("b"), F.col("start").alias("w_start"), F.col("end").alias("w_end"), "score", "minutes"))
    own = own.groupBy(key, "_island").agg(best.alias("_b"), F.count("*").alias("n"))
    return own.select(key, "_b.w_start", "_b.w_end", "_b.score", "_b.minutes", "n")


def _matched(watch: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """key, w_start, g: the absence that a record took, if any: the one it shares most time with of those left by earlier records."""
    kind = dict(watch.dtypes)[key]
    pairs = interval_join(watch.select(key, "w_start", "w_end"), gaps.where(F.col("g_end") - F.col("g_start") <= MOST_GAP), key, 6 * HOUR, ("w_start", "w_end"), ("g_start", "g_end"))
    shared = F.least("w_end", "g_end") - F.greatest("w_start", "g_start")
    near = (F.abs(F.col("w_start") - F.col("g_start")) <= NEAR) | (F.abs(F.col("w_end") - F.col("g_end")) <= NEAR)
    pairs = pairs.withColumn("shared", shared).where((F.col("shared") >= F.least(F.lit(HOUR), (F.col("w_end") - F.col("w_start")) * 0.2)) | near)
    # what doesn't touch can't compete: stretches of records and absences that hang together
    ends = pairs.select(key, "w_start", "g", F.least("w_start", "g_start").alias("start"), F.greatest("w_end", "g_end").alias("end"))
    islands = merge_islands(ends.select(key, "start", "end"), [key], 0)
    own = interval_join(pairs.withColumnRenamed("shared", "_s"), islands.select(key, "start", "end", "island"), key, DAY, ("w_start", "w_end"), ("start", "end"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for start, mine in rows.groupby("w_start", sort=True):
            best, most = None, 0
            for g, s in sorted(zip(mine["g"], mine["_s"])):
                if g not in taken and s > most:
                    best, most = g, s
            if best is not None:
                taken.add(best)
                out.append((rows[key].iloc[0], start, best))
        return pd.DataFrame(out, columns=[key, "w_start", "g"])

    return own.groupBy(key, "island").applyInPandas(settle, f"{key} {kind}, w_start long, g int")


def _shared_time(spans: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``spans`` (key, start, end, id) with the time that each shares with the spans of ``other``."""
    o = other.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = interval_join(spans.select(key, "id", "start", "end"), o, key, 6 * HOUR, ("start", "end"), ("_s", "_e"))
    time = met.groupBy("id").agg(F.sum(F.least("end", "_e") - F.greatest("start", "_s")).alias(name))
    return spans.join(time, "id", "left").na.fill(0, [name])


def _pressed(spans: DataFrame, keys: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """``spans`` with ``keys`` pressed within, and whether key presses were recorded then (``covered``: key, start, end)."""
    at = keys.select(key, F.col("at").alias("_s"), (F.col("at") + 1).alias("_e"))
    met = interval_join(spans.select(key, "id", "start", "end"), at, key, 6 * HOUR, ("start", "end"), ("_s", "_e")).groupBy("id").agg(F.count("*").alias("keys"))
    c = interval_join(spans.select(key, "id", "start", "end"), covered.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")), key, DAY, ("start", "end"), ("_s", "_e")).select("id").distinct()
    out = spans.join(met, "id", "left").join(c.withColumn("covered", F.lit(True)), "id", "left").na.fill({"keys": 0, "covered": False})
    return out.withColumn("keys", F.when(F.col("covered"), F.col("keys")).otherwise(F.lit(0)))


def _evidence(watched: Column) -> Column:
    minutes = (F.col("end") - F.col("start")) / MINUTE
    active = F.col("active") / (F.col("end") - F.col("start")) * 100
    media = F.col("media") / (F.col("end") - F.col("start")) * 100
    of_record = F.array(
        F.lit("watch_sleep"), F.when(F.col("n") > 1, F.format_string("collapsed_%d_overlapping_watch_records", F.col("n"))), F.when(minutes >= 14 * 60, "implausibly_long_watch_sleep"),
        F.when(active >= 50, "aw_not_afk_during_watch_sleep"),
        F.when(~F.col("covered"), "keylog_unavailable").when((F.col("keys") == 0) & (active >= 50), "aw_active_probably_stale").when(F.col("keys") >= KEYS, "keypresses_during_watch_sleep"),
        F.when((media >= 30) & (F.col("keys") <= 5), "ambient_media_during_sleep"),
    )
    of_gap = F.array(F.lit("no_watch_sleep"), F.lit("aw_inactivity_gap"), F.when(~F.col("covered"), "keylog_unavailable").otherwise("no_keypresses_during_gap"))
    return F.array_compact(F.when(watched, of_record).otherwise(of_gap))


def _confidence(base: Column, slept: Column) -> Column:
    has = lambda name: F.array_contains("evidence", name)
    dense = F.col("keys") / F.greatest(slept, F.lit(1.0))
    less = (
        F.when(F.col("n") > 1, 0.05).otherwise(0.0) + F.when(has("implausibly_long_watch_sleep"), 0.25).otherwise(0.0)
        + F.when(has("keypresses_during_watch_sleep"), F.when(dense < 0.2, 0.25).otherwise(0.45)).otherwise(0.0) + F.when(has("keylog_unavailable"), 0.05).otherwise(0.0)
        + F.when(has("aw_not_afk_during_watch_sleep") & ~has("aw_active_probably_stale"), 0.1).otherwise(0.0)
    )
    return F.round(F.least(F.greatest(base - less, F.lit(0.05)), F.lit(0.99)), 2)


def infer_nights(watch: DataFrame, active: DataFrame, keys: DataFrame, covered: DataFrame, media: DataFrame, key: str = "user_id") -> DataFrame:
    """A row a night found: by a record, with the absence about it where there is one, or by an absence that no other layer speaks against.

    ``watch``: key, start, end, score, minutes; ``active``, ``covered`` (when key presses were recorded) and ``media``: key, start, end;
    ``keys``: key, at; times in microseconds. ``winner``: the most confident of a subject's day (from 06:00), then the longest, then
    the first.
    """
    gaps, w = cut(absences(active, key)), cut(records(watch, key))
    took = cut(_matched(w, gaps, key))
    r = w.join(took, [key, "w_start"], "left").join(gaps, [key, "g"], "left").select(key, F.col("w_start").alias("start"), F.col("w_end").alias("end"), "score", "minutes", "n", "g_start", "g_end")
    r = r.withColumn("bed_start", F.coalesce(F.least("g_start", "start"), F.col("start"))).withColumn("bed_end", F.coalesce(F.greatest("g_end", "end"), F.col("end")))
    r = r.withColumn("source", F.when(F.col("g_start").isNull(), "watch_only").otherwise("watch+aw")).drop("g_start", "g_end")
    # an absence alone: taken by no record, not too long, next to no time shared with any
    g = gaps.where(F.col("g_end") - F.col("g_start") <= MOST_GAP).join(took.select(key, "g"), [key, "g"], "left_anti")
    met = interval_join(g, w.select(key, "w_start", "w_end"), key, 6 * HOUR, ("g_start", "g_end"), ("w_start", "w_end")).where(F.least("g_end", "w_end") - F.greatest("g_start", "w_start") >= SHARED)
    g = g.join(met.select(key, "g").distinct(), [key, "g"], "left_anti").select(
        key, F.col("g_start").alias("start"), F.col("g_end").alias("end"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("minutes"), F.lit(0).cast("long").alias("n"),
        F.col("g_start").alias("bed_start"), F.col("g_end").alias("bed_end"), F.lit("aw_only").alias("source"),
    )
    spans = cut(r.unionByName(g).withColumn("id", F.concat_ws(":", F.col(key).cast("string"), "start", "source")))
    spans = _pressed(_shared_time(_shared_time(spans, active, key, "active"), media, key, "media"), keys, covered, key)
    watched = F.col("source") != "aw_only"
    spans = spans.where(watched | (F.col("keys") < KEYS)).withColumn("evidence", _evidence(watched))
    minutes = (F.col("end") - F.col("start")) / MINUTE
    slept = F.when(watched, F.coalesce("minutes", minutes)).otherwise(F.greatest(minutes - 40, minutes * 0.85))
    base = F.when(~watched, 0.55).when(F.col("score").isNotNull(), 0.9).otherwise(0.75)
    spans = spans.withColumn("confidence", _confidence(base, F.when(watched, minutes).otherwise(slept)))
    spans = spans.withColumn("day", F.to_date(F.timestamp_micros(F.col("start") - 6 * HOUR)))
    one = lambda c: F.round(c, 1)
    out = spans.select(
        key, "day", "source", "bed_start", "bed_end", F.when(watched, F.col("start")).alias("sleep_start"), F.when(watched, F.col("end")).alias("sleep_end"),
        one((F.col("bed_end") - F.col("bed_start")) / MINUTE).alias("bed_min"), one(slept).alias("sleep_min"),
        F.when(watched, one((F.col("start") - F.col("bed_start")) / MINUTE)).otherwise(F.lit(20.0)).alias("pre_min"), F.when(watched, one((F.col("bed_end") - F.col("end")) / MINUTE)).otherwise(F.lit(20.0)).alias("post_min"),
        "score", "confidence", F.array_join("evidence", ",").alias("evidence"), one(F.when(watched, F.col("active") / MINUTE).otherwise(0.0)).alias("active_min"),
        F.when(watched, one(F.col("media") / MINUTE)).alias("media_min"), "keys",
    )
    order = Window.partitionBy(key, "day").orderBy(F.col("confidence").desc(), F.col("sleep_min").desc(), "bed_start", "source")
    return out.withColumn("winner", F.row_number().over(order) == 1)

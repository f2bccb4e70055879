"""Trailing personal baselines: a day against the median and spread of the calendar days before it.

A day's values become a histogram over the key's own quantiles, with the ends of what
each bin holds. Histograms of a window add up, so a window is some ``bins`` rows however
many values its days have. They bound where the wanted ranks lie; only the values of the
bins that reach into those bounds are looked at, to rank them exactly. The spread is taken the
same way in a second pass, over distances from the median just found: the bins' ends bound
those as well.

Scale: values are shuffled once (equal values of a day are one row); windows cost bins x days
x history; the values met again are those of a few bins. No window's values lie in one buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.sources.shared import cut

#: What makes a median absolute deviation comparable to a standard deviation.
MAD_TO_SD = 1.4826


def _mean(v: Column, k: Column) -> Column:
    """The mean of values ``v`` that each count ``k`` times, whatever their order: whole steps of 2 ** -20 add up exactly, only what is less is added as doubles."""
    step = float(1 << 20)
    steps = F.floor(v * step)
    return (F.sum(steps.cast("decimal(19,0)") * k.cast("decimal(18,0)")).cast("double") / step + F.sum((v - steps / step) * k)) / F.sum(k)


def _ends(wanted: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The least and the largest distance from ``wanted`` within [low, high]."""
    least = F.when(wanted < low, low - wanted).when(wanted > high, wanted - high).otherwise(F.lit(0.0))
    return least, F.greatest(F.abs(low - wanted), F.abs(high - wanted))


def _middle(window: DataFrame, values: DataFrame, key: str, history: int, of: Column | None) -> DataFrame:
    """key, target, middle: the median of what ``of`` makes of each window's values (of the values themselves: None).

    ``window`` has key, target, bin, n, lo, hi and, for ``of``, the column that it refers to; ``values`` has key, day, bin, v, k.
    """
    keys = [key, "target"]
    low, high = (F.col("lo"), F.col("hi")) if of is None else _ends(of, F.col("lo"), F.col("hi"))
    w = window.withColumn("_low", low).withColumn("_high", high)
    whole, by = Window.partitionBy(*keys), lambda c: Window.partitionBy(*keys).orderBy(c).rangeBetween(Window.unboundedPreceding, 0)  # a row a bin
    w = w.withColumn("_n", F.sum("n").over(whole)).withColumn("_to_high", F.sum("n").over(by("_high"))).withColumn("_to_low", F.sum("n").over(by("_low")))
    w = w.withColumn("_r1", F.floor((F.col("_n") - 1) / 2)).withColumn("_r2", F.floor(F.col("_n") / 2))
    # the wanted ranks lie in [_from, _upto]
    w = w.withColumn("_upto", F.min(F.when(F.col("_to_high") > F.col("_r2"), F.col("_high"))).over(whole))
    w = w.withColumn("_from", F.min(F.when(F.col("_to_low") > F.col("_r1"), F.col("_low"))).over(whole))
    w = w.withColumn("_under", F.sum(F.when(F.col("_high") < F.col("_from"), F.col("n")).otherwise(0)).over(whole))
    near = w.where((F.col("_low") <= F.col("_upto")) & (F.col("_high") >= F.col("_from")))
    carried = [c for c in near.columns if c not in (key, "bin", "n", "lo", "hi", "_low", "_high", "_to_high", "_to_low", "_n")]
    near = near.select(key, "bin", *carried, F.explode(F.sequence(F.lit(1), F.lit(history))).alias("_back")).withColumn("day", F.date_sub("target", F.col("_back")))
    met = near.join(values, [key, "bin", "day"]).withColumn("_v", F.col("v") if of is None else F.abs(F.col("v") - of))
    below = met.groupBy(*keys).agg(F.sum(F.when(F.col("_v") < F.col("_from"), F.col("k")).otherwise(0)).alias("_below"))
    held = met.where(F.col("_v").between(F.col("_from"), F.col("_upto"))).groupBy(*keys, "_v").agg(F.sum("k").alias("k"), *[F.first(c).alias(c) for c in ("_r1", "_r2", "_under")])
    held = held.join(below, keys).withColumn("_to", F.sum("k").over(by("_v")) + F.col("_under") + F.col("_below"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) < F.col("_to")) & (F.col(rank) >= F.col("_to") - F.col("k")), F.col("_v")))

    return held.groupBy(*keys).agg(((at("_r1") + at("_r2")) / 2).alias("middle"))


def trailing_baselines(df: DataFrame, key: str, day: str, value: str, history: int = 28, least: int = 7, flag_at: float = 2.0, bins: int = 64) -> DataFrame:
    """key, day, mean, most, n, baseline, deviation, flagged: a row for each day that has values.

    The baseline is the median of the ``history`` calendar days before (the day itself left out), where those hold ``least`` values or
    more; the deviation is the day's mean less that, in robust standard deviations about it, where those aren't zero.
    """
    own, key = key, "_key"
    v = df.select(F.col(own).alias(key), F.col(day).alias("day"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    v = cut(v.groupBy(key, "day", "v").agg(F.count("*").alias("k")))
    marks = [i / bins for i in range(1, bins)]
    edges = v.groupBy(key).agg(F.percentile_approx("v", marks, 10_000).alias("_edges"))
    v = cut(v.join(edges, key).select(key, "day", "v", "k", F.size(F.filter("_edges", lambda e: e <= F.col("v"))).alias("bin")))
    days = v.groupBy(key, "day").agg(_mean(F.col("v"), F.col("k")).alias("mean"), F.max("v").alias("most"), F.sum("k").alias("n"))
    hist = v.groupBy(key, "day", "bin").agg(F.sum("k").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ahead = hist.select(key, "bin", "n", "lo", "hi", "day", F.explode(F.sequence(F.lit(1), F.lit(history))).alias("_on")).withColumn("target", F.date_add("day", F.col("_on")))
    ahead = ahead.join(days.select(key, F.col("day").alias("target")), [key, "target"], "left_semi")
    window = ahead.groupBy(key, "target", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    enough = Window.partitionBy(key, "target")
    window = cut(window.withColumn("_all", F.sum("n").over(enough)).where(F.col("_all") >= least).drop("_all"))
    middle = cut(_middle(window, v, key, history, None).withColumnRenamed("middle", "baseline"))
    spread = _middle(window.join(middle, [key, "target"]), v, key, history, F.col("baseline")).withColumnRenamed("middle", "mad")
    found = middle.join(spread, [key, "target"]).select(key, F.col("target").alias("day"), "baseline", (F.col("mad") * MAD_TO_SD).alias("_sd"))
    out = days.join(found, [key, "day"], "left").withColumn("deviation", F.when(F.col("_sd") > 0, (F.col("mean") - F.col("baseline")) / F.col("_sd")))
    return out.withColumn("flagged", F.coalesce(F.abs("deviation") >= flag_at, F.lit(False))).drop("_sd").withColumnRenamed(key, own)

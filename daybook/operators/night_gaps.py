"""What happened in the gaps between the segments of a night, by the sensors' readings in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.dedup import merge_islands
from daybook.operators.joins import interval_join
from daybook.sources.shared import cut

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
# What counts as evidence.
STAGE_SHARE, WAKE_RATIO, WAKE_MOVEMENT, BASE_SHARE = 0.5, 1.15, 2.0, 0.2
#: Verdicts that are a change between sleep and wake.
CHANGES = ["confirmed_wake_pc", "genuine_wake", "undetermined"]


def night_gaps(segments: DataFrame, key: str, apart: int) -> tuple[DataFrame, DataFrame]:
    """Gaps (key, night, gap_start, gap_end, intra) and nights (key, night, lo, hi of the main episode).

    Segments (key, start, end) no further than ``apart`` make an episode, which belongs to the night (a day's number) that it starts in; a night's
    longest one (of equal ones the first) is its main. Gaps inside the main are ``intra``; the others lie between a night's episodes.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = segments.where("end > start").select(key, "start", "end").withColumn("reach", F.max("end").over(before))
    s = s.withColumn("_new", F.coalesce((F.col("start") - F.col("reach") > apart).cast("int"), F.lit(1)))
    s = s.withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    episodes = s.groupBy(key, "episode").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).withColumn("night", F.expr(f"lo div {DAY}"))
    nights = episodes.groupBy(key, "night").agg(F.max(F.struct((F.col("hi") - F.col("lo")).alias("long"), (-F.col("lo")).alias("first"), "episode", "lo", "hi")).alias("m"))
    main = nights.select(key, "night", F.col("m.episode").alias("episode"), F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"))
    inner = s.where((F.col("_new") == 0) & (F.col("start") > F.col("reach"))).join(main.select(key, "night", "episode"), [key, "episode"])
    inner = inner.select(key, "night", F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"), F.lit(True).alias("intra"))
    last = F.lag("hi").over(Window.partitionBy(key, "night").orderBy("lo"))
    outer = episodes.withColumn("gap_start", last).where("gap_start IS NOT NULL").select(key, "night", "gap_start", F.col("lo").alias("gap_end"), F.lit(False).alias("intra"))
    return inner.unionByName(outer), main.select(key, "night", "lo", "hi")


def gap_evidence(segments: DataFrame, heart: DataFrame, movement: DataFrame, presses: DataFrame, stages: DataFrame, key: str, apart: int, least: int = 5) -> DataFrame:
    """key, night, gap_start, gap_end, intra, hr_minutes, hr_mean, hr_ratio, movement_mean, press_minutes, stage_minutes, verdict.

    ``heart``, ``movement`` (key, at, value) and ``presses`` (key, at) become a row a key and minute before they meet a gap; ``stages``
    (key, start, end) become disjoint stretches of whole minutes, of which only the overlap is counted. The night's own heart rate is the value a fifth up
    the sorted minutes from two hours before its main episode to two after. The first that fits: presses: confirmed_wake_pc; fewer than ``least`` heart
    minutes: sensor_absent; half or more in stages: stage_continuous; movement of 2 or a heart rate of 1.15 times the night's: genuine_wake;
    a lower heart rate: missed_sleep; no night's rate: undetermined.
    """
    gaps, nights = map(cut, night_gaps(segments, key, apart))  # each is read several times below
    minute = F.floor(F.col("at") / MINUTE).alias("m")
    each = lambda df, name, value: df.select(key, minute, F.lit(name).alias("_k"), value.alias("_v"))
    read = each(heart, "h", F.col("value").cast("double")).unionByName(each(movement, "v", F.col("value").cast("double"))).unionByName(each(presses, "p", F.lit(1.0)))
    pick = lambda k: F.avg(F.when(F.col("_k") == k, F.col("_v")))
    minutes = read.groupBy(key, "m").agg(pick("h").alias("h"), pick("v").alias("v"), pick("p").alias("p"))
    minutes = cut(minutes.select(key, (F.col("m") * MINUTE).alias("_s"), (F.col("m") * MINUTE + 1).alias("_t"), "h", "v", "p"))

    whole = lambda c: F.floor(F.col(c) / MINUTE) * MINUTE
    asked = gaps.select(key, "night", "gap_start", "gap_end", whole("gap_start").alias("_a"), F.col("gap_end").alias("_b"))
    own = [key, "night", "gap_start", "gap_end"]
    seen = interval_join(asked, minutes, key, HOUR, ("_a", "_b"), ("_s", "_t")).groupBy(*own).agg(F.count("h").alias("hr_minutes"), F.avg("h").alias("hr_mean"), F.avg("v").alias("movement_mean"), F.count("p").alias("press_minutes"))
    up = lambda c: F.ceil(F.col(c) / MINUTE) * MINUTE
    stretches = merge_islands(stages.where("end > start").select(key, whole("start").alias("start"), up("end").alias("end")), [key], 0).select(key, F.col("start").alias("_s"), F.col("end").alias("_t"))
    full = asked.withColumn("_b", up("gap_end"))
    covered = interval_join(full, stretches, key, HOUR, ("_a", "_b"), ("_s", "_t")).groupBy(*own).agg(F.sum((F.least("_b", "_t") - F.greatest("_a", "_s")) / MINUTE).cast("long").alias("stage_minutes"))

    around = nights.select(key, "night", (whole("lo") - 2 * HOUR).alias("_a"), (F.col("hi") + 2 * HOUR).alias("_b"))
    rates = interval_join(around, minutes.where("h IS NOT NULL"), key, HOUR, ("_a", "_b"), ("_s", "_t")).groupBy(key, "night").agg(F.sort_array(F.collect_list("h")).alias("_h")).where(F.size("_h") >= least)
    place = F.greatest(F.floor(F.size("_h") * BASE_SHARE), F.lit(1)).cast("int")
    base = rates.select(key, "night", F.nullif(F.element_at("_h", place), F.lit(0.0)).alias("_base"))

    g = gaps.join(seen, own, "left").join(covered, own, "left").join(base, [key, "night"], "left").na.fill(0, ["hr_minutes", "press_minutes", "stage_minutes"])
    g = g.withColumn("hr_ratio", F.col("hr_mean") / F.col("_base"))
    long = (F.col("gap_end") - F.col("gap_start")) / MINUTE
    verdict = (
        F.when(F.col("press_minutes") > 0, "confirmed_wake_pc")
        .when(F.col("hr_minutes") < least, "sensor_absent")
        .when(F.col("stage_minutes") / long >= STAGE_SHARE, "stage_continuous")
        .when(F.col("movement_mean") >= WAKE_MOVEMENT, "genuine_wake")
        .when(F.col("hr_ratio") >= WAKE_RATIO, "genuine_wake")
        .when(F.col("hr_ratio") < WAKE_RATIO, "missed_sleep")
        .otherwise("undetermined")
    )
    return g.select(*own, "intra", "hr_minutes", "hr_mean", "hr_ratio", "movement_mean", "press_minutes", "stage_minutes", verdict.alias("verdict"))


def validated_nights(segments: DataFrame, evidence: DataFrame, key: str, apart: int) -> DataFrame:
    """key, start, end: segments with every gap inside a main episode filled that is no change between sleep and wake."""
    fill = evidence.where(F.col("intra") & ~F.col("verdict").isin(*CHANGES)).select(key, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    return merge_islands(segments.where("end > start").select(key, "start", "end").unionByName(fill), [key], 0).select(key, "start", "end")

"""Bootstraps and randomisation tests of paired, stratified and plain designs, for any number of units.

Draws are counter-based: a hash of seed, replicate, stratum and place, so a draw depends on
nothing that was drawn before it, nor on partitions, and SQL can repeat it. Exact p-values
come from the distribution of sums, built up unit by unit with equal sums merged (as many
states as there are different sums, not as there are assignments); where there would be more
than ``states`` of them, or a key has more than ``units`` units, the p is by Monte Carlo over
all units, summed in the tasks that hold them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators import series
from daybook.sources.shared import cut


def draw(n: Column, *place: Column | int) -> Column:
    """A whole number from 0 to n - 1 for each seed, replicate, place and so on."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in place])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % n


def draw_sql(n: str, *place: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(place)})), 1, 15) AS BIGINT) % {n})"


def tails(confidence: float, iterations: int) -> tuple[int, int]:
    """Which of the sorted replicates end the interval."""
    alpha = min(max(1 - confidence, 0.0), 1.0)
    low, high = int(alpha / 2 * iterations), int((1 - alpha / 2) * iterations) - 1
    return min(iterations - 1, max(0, low)), min(iterations - 1, max(0, high))


def _interval(means: DataFrame, key: str, confidence: float, iterations: int) -> DataFrame:
    low, high = tails(confidence, iterations)
    held = means.groupBy(key).agg(F.sort_array(F.collect_list("_mean")).alias("_m"))  # one number a replicate
    return held.select(F.col(key).alias("_key"), F.get("_m", F.lit(low)).alias("low"), F.get("_m", F.lit(high)).alias("high"))


def _spots(df: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """``df`` with a place from 0 in each group, in the order of the units."""
    return df.withColumn("_spot", F.row_number().over(Window.partitionBy(*keys).orderBy(unit)) - 1)


#: Groups of up to so many values are looked up in an array by the tasks that draw from them; draws from larger ones are joined.
HELD = 1_000_000
#: Values of a group that one buffer gathers, and tasks that draw from one group at once.
BLOCK, TASKS = 50_000, 32


def _drawn_means(slots: DataFrame, x: DataFrame, on: list[str], own: list[str], place: list[Column], held: int = HELD) -> DataFrame:
    """on, own, _mean: for each slot (``on``, ``own``, _n) the mean of _n draws from the values (``on``, _spot, _v) of its group.

    A draw is by ``place`` and its number. Draws are made and looked up in one task and never shuffled; a group's values are sent to
    ``TASKS`` tasks, as an array of ``held`` values at most.
    """
    few, many = slots.where(F.col("_n") <= held), slots.where(F.col("_n") > held)
    sizes = x.groupBy(*on).agg(F.count("*").alias("_n"))
    places = F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("_place")
    spot = draw(F.col("_n"), *place, F.col("_place"))
    # an array in two steps, so that no buffer holds more than a block
    blocks = x.join(sizes.where(F.col("_n") <= held).select(*on), on, "left_semi").groupBy(*on, F.expr(f"_spot div {BLOCK}").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_spot", "_v"))).alias("_a"))
    arrays = blocks.select(*on, "_b", F.col("_a._v").alias("_a")).groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("_b", "_a"))).alias("_a")).select(*on, F.flatten(F.col("_a._a")).alias("_a"))
    arrays = arrays.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(TASKS - 1))))
    few = few.withColumn("_task", F.pmod(F.xxhash64(*on, *own), F.lit(TASKS)).cast("int"))
    # by number: the slots are few bytes but much work, and would else be put together into one task
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = few.repartition(parts, *on, "_task").join(arrays.repartition(parts, *on, "_task").hint("merge"), [*on, "_task"])
    looked = few.select(*on, *own, "_n", "_a", places).select(*on, *own, F.get("_a", spot.cast("int")).alias("_v")).groupBy(*on, *own).agg(F.avg("_v").alias("_mean"))
    if many.isEmpty():
        return looked
    drawn = many.repartition(*on, *own).select(*on, *own, "_n", places).withColumn("_spot", spot)
    return looked.unionByName(drawn.join(x.select(*on, "_spot", "_v"), [*on, "_spot"]).groupBy(*on, *own).agg(F.avg("_v").alias("_mean")))


def paired_bootstrap(df: DataFrame, key: str, unit: str, delta: str, iterations: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """key, pairs, delta, low, high: the mean of paired differences with its percentile interval.

    Each replicate draws as many pairs as the key has. Rows without a difference are no pairs.
    """
    x = cut(_spots(df.where(F.col(delta).isNotNull()).select(key, unit, F.col(delta).alias("_v")), [key], unit))
    n = cut(x.groupBy(key).agg(F.count("*").alias("_n"), F.avg("_v").alias("delta")))
    reps = n.select(key, "_n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_rep"))
    means = _drawn_means(reps, x, [key], ["_rep"], [F.lit(seed), F.col("_rep")])
    ends = _interval(means, key, confidence, iterations)
    return n.join(ends, F.col(key) == F.col("_key")).select(key, F.col("_n").alias("pairs"), "delta", "low", "high")


def complete_strata(df: DataFrame, key: str, stratum: str, arm: str, value: str) -> DataFrame:
    """key, stratum, n_t, n_c, mean_t, mean_c, weight (the smaller arm's size) of the strata that have both arms."""
    t = F.col(arm)
    s = df.where(F.col(value).isNotNull() & t.isNotNull()).groupBy(key, stratum).agg(F.count_if(t).alias("n_t"), F.count_if(~t).alias("n_c"), F.avg(F.when(t, F.col(value))).alias("mean_t"), F.avg(F.when(~t, F.col(value))).alias("mean_c"))
    return s.where("n_t > 0 AND n_c > 0").withColumn("weight", F.least("n_t", "n_c"))


def stratified_bootstrap(df: DataFrame, key: str, stratum: str, unit: str, arm: str, value: str, iterations: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """key, strata, delta, low, high: the weighted mean of the strata's differences (arm true minus false).

    Each replicate draws as many strata as there are complete ones, then each arm's units within every drawn stratum. A stratum
    weighs as much as its smaller arm; one without both arms takes no part.
    """
    s = cut(_spots(complete_strata(df, key, stratum, arm, value), [key], stratum).withColumnRenamed("_spot", "_s"))
    weighed = lambda x: F.sum(F.col("weight") * x) / F.sum("weight")
    n = cut(s.groupBy(key).agg(F.count("*").alias("strata"), weighed(F.col("mean_t") - F.col("mean_c")).alias("delta")))
    x = df.where(F.col(value).isNotNull() & F.col(arm).isNotNull()).select(key, stratum, unit, F.col(arm).alias("_arm"), F.col(value).alias("_v"))
    x = cut(_spots(x, [key, stratum, "_arm"], unit).join(s.select(key, stratum, "_s"), [key, stratum]).select(key, "_s", "_arm", "_spot", "_v"))
    slots = n.select(key, "strata", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_rep")).select("*", F.explode(F.sequence(F.lit(0), F.col("strata").cast("int") - 1)).alias("_slot"))
    slots = slots.withColumn("_s", draw(F.col("strata"), seed, F.col("_rep"), F.col("_slot"))).join(s.select(key, "_s", "n_t", "n_c", "weight"), [key, "_s"])
    arms = F.explode(F.array(F.struct(F.lit(True).alias("arm"), F.col("n_t").alias("n")), F.struct(F.lit(False).alias("arm"), F.col("n_c").alias("n"))))
    slots = slots.select(key, "_rep", "_slot", "_s", "weight", arms.alias("a")).select(key, "_rep", "_slot", "_s", "weight", F.col("a.arm").alias("_arm"), F.col("a.n").alias("_n"))
    place = [F.lit(seed), F.col("_rep"), F.col("_slot"), F.col("_arm").cast("int")]
    met = _drawn_means(slots, x, [key, "_s", "_arm"], ["_rep", "_slot", "weight"], place)
    met = met.groupBy(key, "_rep", "_slot", "weight").agg(F.max(F.when(F.col("_arm"), F.col("_mean"))).alias("t"), F.max(F.when(~F.col("_arm"), F.col("_mean"))).alias("c"))
    means = met.groupBy(key, "_rep").agg(weighed(F.col("t") - F.col("c")).alias("_mean"))
    ends = _interval(means, key, confidence, iterations)
    return n.join(ends, F.col(key) == F.col("_key")).select(key, "strata", "delta", "low", "high")


Sums = tuple[np.ndarray, np.ndarray]  # different sums, in order, with their probabilities or counts


def _merged(sums: np.ndarray, weights: np.ndarray) -> Sums:
    found, at = np.unique(sums, return_inverse=True)
    return found, np.bincount(at, weights, len(found))


def signed_sums(deltas: np.ndarray, states: int) -> Sums | None:
    """The distribution of the sum of ``deltas`` under fair signs; None where it has more than ``states`` values."""
    sums, weights = np.zeros(1, np.int64), np.ones(1)
    for d in np.abs(deltas).tolist():
        sums, weights = _merged(np.concatenate([sums + d, sums - d]), np.concatenate([weights, weights]) / 2)
        if len(sums) > states:
            return None
    return sums, weights


def chosen_sums(values: np.ndarray, take: int, states: int) -> Sums | None:
    """The distribution of the sum of ``take`` of ``values`` drawn without putting back."""
    by: list[Sums | None] = [(np.zeros(1, np.int64), np.ones(1))] + [None] * take
    for v in values.tolist():
        for k in range(take, 0, -1):  # sums of k values, the new one among them or not
            less, same = by[k - 1], by[k]
            if less is not None:
                more = (less[0] + v, less[1])
                by[k] = more if same is None else _merged(np.concatenate([same[0], more[0]]), np.concatenate([same[1], more[1]]))
        if sum(len(x[0]) for x in by if x is not None) > states:
            return None
    sums, counts = by[take]
    return sums, counts / counts.sum()


def strata_sums(strata: list[tuple[np.ndarray, np.ndarray]], states: int) -> tuple[Sums, int] | None:
    """For (values, arm) of each stratum: the distribution of the weighted mean difference under relabelling, and what was seen.

    Both are multiplied by what makes them whole numbers.
    """
    scale = math.lcm(*[int(arm.sum()) * int((~arm).sum()) for _, arm in strata])
    total, seen = (np.zeros(1, np.int64), np.ones(1)), 0
    for values, arm in strata:
        n_t, n_c = int(arm.sum()), int((~arm).sum())
        a, b = min(n_t, n_c) * scale // n_t, min(n_t, n_c) * scale // n_c
        if (a + b) * int(np.abs(values).sum()) * len(strata) >= 1 << 62:
            return None
        own = chosen_sums(values, n_t, states)
        if own is None or len(own[0]) * len(total[0]) > 64 * states:
            return None
        # a * treated - b * (all - treated)
        shifted = (a + b) * own[0] - b * int(values.sum())
        total = _merged((total[0][:, None] + shifted[None, :]).ravel(), (total[1][:, None] * own[1][None, :]).ravel())
        if len(total[0]) > states:
            return None
        seen += (a + b) * int(values[arm].sum()) - b * int(values.sum())
    return total, seen


def _beyond(sums: Sums, seen: int) -> float:
    return min(1.0, float(sums[1][np.abs(sums[0]) >= abs(seen)].sum()))


def _whole(column: str, step: float) -> Column:
    return F.round(F.col(column) / F.lit(step)).cast("long")


def sign_flip_p(df: DataFrame, key: str, unit: str, delta: str, step: float = 1.0, units: int = 2000, states: int = 1_000_000, iterations: int = 10_000, seed: int = 0) -> DataFrame:
    """key, pairs, p, method: two-sided p of a mean paired difference under sign flips, differences in whole steps of ``step``."""
    x = cut(df.where(F.col(delta).isNotNull()).select(key, unit, _whole(delta, step).alias("_d")))
    n = cut(x.groupBy(key).agg(F.count("*").alias("pairs"), F.sum("_d").alias("_seen")))
    kind = dict(df.dtypes)[key]

    def exact(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows["_d"].to_numpy(np.int64)
        sums = signed_sums(d, states) if int(np.abs(d).sum()) < 1 << 62 else None
        return pd.DataFrame({"_key": rows[key].iloc[:1], "p": [None if sums is None else _beyond(sums, int(d.sum()))]})

    held = x.join(n.where(F.col("pairs") <= units).select(key), key, "left_semi")
    known = cut(n.join(held.groupBy(key).applyInPandas(exact, f"_key {kind}, p double"), F.col(key) == F.col("_key"), "left").drop("_key"))
    done = known.where("p IS NOT NULL").select(key, "pairs", "p", F.lit("exact").alias("method"))
    open_ = known.where("p IS NULL").select(key, "_seen")
    if open_.isEmpty():
        return done

    def flip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame({key: list(held), "sums": [s.tolist() for s in held.values()]})

        for batch in batches:
            for k, u, d in zip(batch[key], batch["_u"], batch["_d"]):
                rng = np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(u.encode())]))
                signs = 2 * rng.integers(0, 2, iterations, np.int8).astype(np.int64) - 1
                held[k] = held.get(k, 0) + signs * int(d)
                if len(held) >= 256:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    drawn = x.join(open_.select(key), key, "left_semi").select(key, "_d", F.concat_ws("\x00", F.col(key).cast("string"), F.col(unit).cast("string")).alias("_u"))
    sums = drawn.mapInPandas(flip, f"{key} {kind}, sums array<long>").select(key, F.posexplode("sums").alias("_rep", "_s")).groupBy(key, "_rep").agg(F.sum("_s").alias("_s"))
    p = sums.join(open_, key).groupBy(key).agg(((F.count_if(F.abs("_s") >= F.abs("_seen")) + 1) / (iterations + 1)).alias("p"))
    return done.unionByName(p.join(n.select(key, "pairs"), key).select(key, "pairs", "p", F.lit("monte carlo").alias("method")))


def permutation_p(
    df: DataFrame, key: str, arm: str, value: str, stratum: str | None = None, step: float = 1.0, units: int = 500, states: int = 1_000_000, iterations: int = 10_000, seed: int = 0
) -> DataFrame:
    """key, units, p, method: two-sided p of the difference of arms under relabelling, within strata where ``stratum`` is given.

    Values are taken in whole steps of ``step``. The statistic is the mean of the strata's differences weighted by their smaller arms.
    """
    x = df.where(F.col(value).isNotNull() & F.col(arm).isNotNull())
    x = x.select(key, (F.col(stratum) if stratum else F.lit(0)).alias("_stratum"), F.col(arm).alias("_arm"), _whole(value, step).alias("_v"))
    s = complete_strata(x, key, "_stratum", "_arm", "_v")
    x = cut(x.join(s.select(key, "_stratum", "weight", (F.col("mean_t") - F.col("mean_c")).alias("_gap")), [key, "_stratum"]))
    n = cut(x.groupBy(key).agg(F.count("*").alias("units")))
    kind = dict(df.dtypes)[key]

    def exact(rows: pd.DataFrame) -> pd.DataFrame:
        strata = [(own["_v"].to_numpy(np.int64), own["_arm"].to_numpy(bool)) for _, own in rows.groupby("_stratum", sort=True)]
        found = strata_sums(strata, states)
        return pd.DataFrame({"_key": rows[key].iloc[:1], "p": [None if found is None else _beyond(*found)]})

    held = x.join(n.where(F.col("units") <= units).select(key), key, "left_semi")
    known = cut(n.join(held.groupBy(key).applyInPandas(exact, f"_key {kind}, p double"), F.col(key) == F.col("_key"), "left").drop("_key"))
    done = known.where("p IS NOT NULL").select(key, "units", "p", F.lit("exact").alias("method"))
    open_ = known.where("p IS NULL").select(key, "units")
    if open_.isEmpty():
        return done
    # one relabelling a cell (key and stratum), in blocks of values, then the strata's mean
    cells = x.join(open_, key, "left_semi").withColumn("_cell", F.to_json(F.struct(key, "_stratum")))
    of = cells.groupBy("_cell").agg(F.first(key).alias(key), F.first("weight").alias("weight"), F.first("_gap").alias("_gap"))
    drawn = series.relabelled(cells, "_cell", "_arm", "_v", iterations, seed).join(of, "_cell")
    gaps = drawn.groupBy(key, "replicate").agg(F.sum(F.col("weight") * F.col("delta")).alias("_drawn"), F.sum(F.col("weight") * F.col("_gap")).alias("_seen"))
    near = 1e-9 * F.greatest(F.lit(1.0), F.abs("_seen"))  # sums in another order differ in the last digits
    p = gaps.groupBy(key).agg(((F.count_if(F.abs("_drawn") >= F.abs("_seen") - near) + 1) / (iterations + 1)).alias("p"))
    return done.unionByName(p.join(open_, key).select(key, "units", "p", F.lit("monte carlo").alias("method")))

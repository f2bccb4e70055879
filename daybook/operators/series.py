"""Statistics of many series at once: one group a series.

The closed forms are joins and window frames; change points and spectra walk a series in order and
run as grouped-map functions over numpy, one series a call; resampling runs over blocks of values.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changepoints(df: DataFrame, key: str, order: str, value: str, least: int = 5, most: int = 5) -> DataFrame:
    """Binary segmentation on squared error with a BIC penalty; means are of the whole prefix and suffix."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x = rows[value].to_numpy(float)
        s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])

        def cost(a, b):
            return s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)

        spread = x.var(ddof=1) if len(x) > 1 else 1.0
        penalty, segments, cuts = math.log(max(len(x), 2)) * spread if spread > 0 else 1.0, [(0, len(x))], []
        while segments and len(cuts) < most:
            best = None
            for a, b in segments:
                for m in range(a + least, b - least + 1):
                    gain = cost(a, b) - cost(a, m) - cost(m, b)
                    if best is None or gain > best[0]:
                        best = (gain, a, m, b)
            if best is None or best[0] <= penalty:
                break
            cuts.append(best[2])
            segments = [s for s in segments if s != (best[1], best[3])] + [(best[1], best[2]), (best[2], best[3])]
        return pd.DataFrame([(rows[key].iloc[0], m, x[:m].mean(), x[m:].mean()) for m in sorted(cuts)], columns=[key, "at", "before", "after"])

    kind = dict(df.dtypes)[key]
    return df.select(key, order, value).where(F.col(value).isNotNull()).groupBy(key).applyInPandas(split, f"{key} {kind}, at long, before double, after double")


def periods(df: DataFrame, key: str, order: str, value: str, top: int = 5) -> DataFrame:
    """Strong periods by discrete Fourier power: at least twice the median and a tenth of the top."""

    def spectrum(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[value].to_numpy(float)
        n, out = len(x), []
        if n >= 8:
            power = np.abs(np.fft.rfft(x - x.mean())) ** 2 / n
            ks = [k for k in range(1, n // 2) if 2 <= n / k <= n / 2]
            if ks and power[ks].max() > 1e-12:
                floor = max(2 * np.median(power[ks]), 0.1 * power[ks].max())
                strong = sorted((k for k in ks if power[k] >= floor), key=lambda k: -power[k])[:top]
                out = [(rows[key].iloc[0], n / k, power[k]) for k in strong]
        return pd.DataFrame(out, columns=[key, "period", "power"])

    kind = dict(df.dtypes)[key]
    return df.select(key, order, value).where(F.col(value).isNotNull()).groupBy(key).applyInPandas(spectrum, f"{key} {kind}, period double, power double")


def lagged_correlation(a: DataFrame, b: DataFrame, day: str, x: str, y: str, most: int) -> DataFrame:
    """Pearson correlation of x on a day with y ``lag`` days later, lag from -most to most."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    left = a.select(F.col(day).alias("_d"), F.col(x).alias("_x")).withColumn("lag", lags).withColumn("_d", F.date_add("_d", F.col("lag")))
    right = b.select(F.col(day).alias("_d"), F.col(y).alias("_y"))
    return left.join(right, "_d").groupBy("lag").agg(F.corr("_x", "_y").alias("r"), F.count("*").alias("n"))


def anomalies(df: DataFrame, key: str, order: str, value: str, history: int = 28, least: int = 5, fence: float = 1.5) -> DataFrame:
    """IQR fence over the ``history`` rows before each row; too little history is no anomaly."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-history, -1)
    frame = df.withColumn("_past", F.sort_array(F.collect_list(value).over(w))).withColumn("n_past", F.size("_past"))

    def quantile(p: float):
        at = (F.col("n_past") - 1) * F.lit(p)
        low = F.get("_past", F.floor(at).cast("int"))
        high = F.get("_past", F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    enough = F.col("n_past") >= least
    q1, q3 = quantile(0.25), quantile(0.75)
    out = F.when(enough, (F.col(value) < q1 - fence * (q3 - q1)) | (F.col(value) > q3 + fence * (q3 - q1))).otherwise(F.lit(False))
    return frame.withColumn("anomaly", out).drop("_past")


def value_blocks(df: DataFrame, key: str, arm: str, value: str, least: int) -> DataFrame:
    """key, block, value, t, c: rows of each arm (True and False) with a value, dealt by hash into blocks of about ``least`` values.

    Keys without rows in both arms are left out. Equal values are one row, so a common value fills no block.
    """
    cells = df.where(F.col(arm).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(key, F.col(value).cast("double").alias("value")).agg(F.count_if(F.col(arm)).alias("t"), F.count_if(~F.col(arm)).alias("c"))
    sizes = cells.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / least).alias("_blocks"), F.sum("t").alias("_t"), F.sum("c").alias("_c")).where("_t > 0 AND _c > 0")
    block = F.pmod(F.xxhash64("value"), F.col("_blocks"))
    return cells.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).select(key, block.alias("block"), "value", "t", "c")


def _rng(seed: int, *parts) -> np.random.Generator:
    """A generator of its own for each key and block, whichever task it runs in."""
    return np.random.default_rng([seed, zlib.crc32(repr(parts).encode())])


def _replicates(cells: DataFrame, key: str, iterations: int, allocate, draw) -> DataFrame:
    """key, replicate, n_t, s_t, n_c, s_c: for each replicate the rows drawn for each arm and their sums.

    ``allocate`` deals a replicate's draws among the blocks of a key, from their totals alone; ``draw`` makes those of one block.
    """
    kind = dict(cells.dtypes)[key]
    totals = cells.groupBy(key, "block").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        take_t, take_c = allocate(_rng(0, rows[key].iloc[0]), rows["t"].to_numpy(), rows["c"].to_numpy())
        return pd.DataFrame({key: rows[key], "block": rows["block"], "take_t": list(take_t.T), "take_c": list(take_c.T)})

    def block(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        rows, name, at = rows.sort_values("value"), plan[key].iloc[0], int(plan["block"].iloc[0])
        take_t, take_c = (np.asarray(plan[x].iloc[0], np.int64) for x in ("take_t", "take_c"))
        s_t, s_c = draw(_rng(1, name, at), rows["value"].to_numpy(float), rows["t"].to_numpy(), rows["c"].to_numpy(), take_t, take_c)
        return pd.DataFrame({key: [name] * iterations, "replicate": np.arange(iterations), "n_t": take_t, "s_t": s_t, "n_c": take_c, "s_c": s_c})

    plan = totals.groupBy(key).applyInPandas(deal, f"{key} {kind}, block long, take_t array<long>, take_c array<long>")
    drawn = cells.groupBy(key, "block").cogroup(plan.groupBy(key, "block")).applyInPandas(block, f"{key} {kind}, replicate long, n_t long, s_t double, n_c long, s_c double")
    return drawn.groupBy(key, "replicate").agg(*[F.sum(x).alias(x) for x in ("n_t", "s_t", "n_c", "s_c")])


def _delta():
    return F.col("s_t") / F.col("n_t") - F.col("s_c") / F.col("n_c")


def bootstrap_delta(df: DataFrame, key: str, arm: str, value: str, iterations: int = 500, seed: int = 7, confidence: float = 0.95, block_values: int = 5000) -> DataFrame:
    """Mean difference of the two arms (True minus False) with a seeded percentile interval.

    Each replicate draws as many rows an arm as there are: multinomial counts a block first, then a value within it.
    """

    def allocate(rng, t, c):
        rng = _rng(seed, int(rng.integers(1 << 62)))
        return rng.multinomial(t.sum(), t / t.sum(), iterations), rng.multinomial(c.sum(), c / c.sum(), iterations)

    def draw(rng, x, t, c, take_t, take_c):
        rng = _rng(seed, int(rng.integers(1 << 62)))
        sums = lambda n, take: rng.multinomial(take, n / n.sum()) @ x if n.sum() else np.zeros(iterations)
        return sums(t, take_t), sums(c, take_c)

    cells = value_blocks(df, key, arm, value, block_values)
    means = _replicates(cells, key, iterations, allocate, draw)
    tail = (1 - confidence) / 2
    q = means.groupBy(F.col(key).alias("_key")).agg(F.percentile(_delta(), F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    return _seen(cells, key).join(q, F.col(key).eqNullSafe(F.col("_key"))).select(key, "delta", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def _seen(cells: DataFrame, key: str) -> DataFrame:
    mean = lambda n: F.sum(F.col("value") * F.col(n)) / F.sum(n)
    return cells.groupBy(key).agg((mean("t") - mean("c")).alias("delta"))


def relabelled(df: DataFrame, key: str, arm: str, value: str, iterations: int = 1000, seed: int = 7, block_values: int = 5000) -> DataFrame:
    """key, replicate, delta: the difference of means in each seeded relabelling of a key's rows.

    A relabelling keeps the size of both arms: hypergeometric counts a block first, then a value within it. A key with
    1e9 rows or more is refused by numpy, not cut.
    """
    cells = value_blocks(df, key, arm, value, block_values)
    return _relabelled(cells, key, iterations, seed).select(key, "replicate", _delta().alias("delta"))


def _relabelled(cells: DataFrame, key: str, iterations: int, seed: int) -> DataFrame:
    def chosen(rng, colours, n):
        return rng.multivariate_hypergeometric(colours, n, method="marginals")

    def allocate(rng, t, c):
        rng = _rng(seed, int(rng.integers(1 << 62)))
        take = np.array([chosen(rng, t + c, t.sum()) for _ in range(iterations)])
        return take, (t + c) - take

    def draw(rng, x, t, c, take_t, take_c):
        rng = _rng(seed, int(rng.integers(1 << 62)))
        s_t = np.array([chosen(rng, t + c, n) @ x for n in take_t])
        return s_t, (t + c) @ x - s_t

    return _replicates(cells, key, iterations, allocate, draw)


def permutation_p(df: DataFrame, key: str, arm: str, value: str, iterations: int = 1000, seed: int = 7, block_values: int = 5000) -> DataFrame:
    """Share of seeded relabellings with a mean difference at least as large (see ``relabelled``)."""
    cells = value_blocks(df, key, arm, value, block_values)
    means = _relabelled(cells, key, iterations, seed).join(_seen(cells, key).withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")))
    hit = F.abs(_delta()) >= F.abs("delta") - 1e-9 * F.greatest(F.lit(1.0), F.abs("delta"))  # sums in another order differ in the last digits
    return means.groupBy(key).agg(((F.count_if(hit) + 1) / (iterations + 1)).alias("p"))

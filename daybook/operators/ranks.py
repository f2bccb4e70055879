"""Ranks and medians of cohorts over their values themselves, at any number of values.

Distinct values are dealt by range, so that a partition holds a stretch of them; sums of the
stretches before it (a row a partition) make ranks within it ranks among all. No window runs over
all values, and cohorts meet values only where they have some.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.sources.shared import cut


def in_stretches(df: DataFrame, cohort: str, value: str, stretches: int | None = None) -> DataFrame:
    """cohort, v, k, stretch: how often a cohort has a value, stretches numbered in the order of the values. Null and NaN values are none."""
    n = stretches or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = df.select(F.col(cohort).alias("cohort"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    v = v.groupBy("cohort", "v").agg(F.count("*").alias("k"))
    return cut(v.repartitionByRange(n, "v").withColumn("stretch", F.spark_partition_id()))


def rank_sums(held: DataFrame) -> DataFrame:
    """cohort, n1, n2, u, sd: of each cohort against the rest, by the ranks of its values among all, ties sharing theirs."""
    every = held.groupBy("stretch", "v").agg(F.sum("k").alias("every"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = every.groupBy("stretch").agg(F.sum("every").alias("_n")).select("stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))  # a row a stretch
    inner = Window.partitionBy("stretch").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = every.join(F.broadcast(ahead), "stretch").withColumn("below", F.col("_ahead") + F.coalesce(F.sum("every").over(inner), F.lit(0)))
    own = held.join(ranked.select("stretch", "v", "below", "every"), ["stretch", "v"])
    sums = own.groupBy("cohort").agg(F.sum("k").alias("n1"), F.sum(F.expr("k * (below + (every + 1) / 2.0D)")).alias("ranks"))
    whole = every.agg(F.sum("every").alias("n"), F.sum(F.expr("CAST(every AS DOUBLE) * every * every - every")).alias("ties")).first()
    n, ties = F.lit(whole["n"] or 0).cast("long"), F.lit(whole["ties"] or 0.0)
    s = sums.withColumn("n2", n - F.col("n1")).where("n1 > 0 AND n2 > 0").withColumn("u", F.expr("ranks - n1 * (n1 + 1) / 2.0D"))
    return s.withColumn("sd", F.sqrt(F.col("n1") / 12 * F.col("n2") * ((n + 1) - ties / (n * (n - F.lit(1.0)))))).select("cohort", "n1", "n2", "u", "sd")


def resampled_middles(n: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """For each of ``draws`` resamples of ``n`` rows: the places (from 0, in order of value) of the two rows about its median.

    Places drawn uniformly have order statistics of a known law, so a resample's middle is drawn without the resample.
    """
    k = (n + 1) // 2
    first = rng.beta(k, n - k + 1, draws)
    second = first if n % 2 else first + (1 - first) * rng.beta(1, n - k, draws)
    return np.minimum(np.stack([first, second], 1) * n, n - 1).astype(np.int64)


def median_contrasts(held: DataFrame, draws: int = 500, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """cohort, median_delta, median_ratio, low, high: each cohort's median against the rest's, with a bootstrap interval of the difference."""
    last = held.agg(F.max("stretch")).first()[0]
    if last is None:
        return held.sparkSession.createDataFrame([], "cohort string, median_delta double, median_ratio double, low double, high double")
    own = held.groupBy("cohort", "stretch").agg(F.sum("k").alias("own"))
    every = held.groupBy("stretch").agg(F.sum("k").alias("every"))
    # a row a cohort and stretch: what each side has in it and before it
    grid = held.select("cohort").distinct().select("cohort", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("stretch"))
    grid = grid.join(own, ["cohort", "stretch"], "left").join(every, "stretch", "left").na.fill(0)
    sides = F.explode(F.array(F.struct(F.lit("own").alias("side"), F.col("own").alias("n")), F.struct(F.lit("rest").alias("side"), (F.col("every") - F.col("own")).alias("n"))))
    before = Window.partitionBy("cohort", "side").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    grid = cut(grid.select("cohort", "stretch", sides.alias("s")).select("cohort", "stretch", "s.side", "s.n").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    sizes = grid.groupBy("cohort").pivot("side", ["own", "rest"]).agg(F.sum("n")).where("own > 0 AND rest > 0")
    kind = dict(held.dtypes)["cohort"]

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        name, sides, found = rows["cohort"].iloc[0], [], []
        for side in ("own", "rest"):
            n = int(rows[side].iloc[0])
            rng = np.random.default_rng([seed, zlib.crc32(f"{name}:{side}".encode())])
            places = np.concatenate([[[(n - 1) // 2, n // 2]], resampled_middles(n, draws, rng)])
            sides += [side] * places.size
            found.append(places.ravel())
        return pd.DataFrame({"cohort": pd.Series([name] * len(sides), dtype=object), "side": pd.Series(sides, dtype=object), "rep": np.tile(np.repeat(np.arange(-1, draws), 2), 2), "place": np.concatenate(found)})

    asked = sizes.groupBy("cohort").applyInPandas(ask, f"cohort {kind}, side string, rep long, place long")
    asked = asked.join(grid, ["cohort", "side"]).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    asked = asked.select("stretch", "cohort", "side", "rep", (F.col("place") - F.col("before")).alias("place"))

    def look(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """Values at places of a stretch, by running counts of each side."""
        values, at = np.unique(rows["v"].to_numpy(float), return_inverse=True)
        counts = np.bincount(at, rows["k"], len(values))
        mine = rows["cohort"].to_numpy()
        out: dict[str, list] = {"cohort": [], "side": [], "rep": [], "v": []}
        for (cohort, side), ask in wanted.groupby(["cohort", "side"]):
            sel = mine == cohort
            k = np.bincount(at[sel], rows["k"][sel], len(values))
            ends = np.cumsum(k if side == "own" else counts - k)
            out["cohort"] += [cohort] * len(ask)
            out["side"] += [side] * len(ask)
            out["rep"] += ask["rep"].tolist()
            out["v"] += values[np.searchsorted(ends, ask["place"].to_numpy(), "right")].tolist()
        # plain objects: strings of another kind come in pieces, which Spark doesn't take
        return pd.DataFrame({k: pd.Series(v, dtype={"rep": "int64", "v": "float64"}.get(k, object)) for k, v in out.items()})

    found = held.groupBy("stretch").cogroup(asked.groupBy("stretch")).applyInPandas(look, f"cohort {kind}, side string, rep long, v double")
    middle = found.groupBy("cohort", "rep").agg(F.avg(F.when(F.col("side") == "own", F.col("v"))).alias("own"), F.avg(F.when(F.col("side") == "rest", F.col("v"))).alias("rest"))
    seen = middle.where("rep = -1").select("cohort", (F.col("own") - F.col("rest")).alias("median_delta"), (F.col("own") / F.when(F.col("rest") != 0, F.col("rest"))).alias("median_ratio"))
    tail = (1 - confidence) / 2
    q = middle.where("rep >= 0").groupBy("cohort").agg(F.percentile(F.col("own") - F.col("rest"), F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))  # a number a draw
    return seen.join(q, "cohort").select("cohort", "median_delta", "median_ratio", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))

"""Exact percentiles of groups of any size: no group's values lie in one buffer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.sources.shared import cut


#: Groups whose bounds are broadcast; more of them are joined by a shuffle.
FEW = 10_000
#: A large group's distinct values are cut into so many bins.
BINS = 64


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], accuracy: int = 10_000, small: int = 100_000, weight: str | None = None) -> DataFrame:
    """keys, n (values that are not null) and a column a name of ``wanted``: the interpolated percentile, null for a group of nulls.

    ``df`` is read once: equal values of a group become one row with their number (the sum of ``weight``, a whole number that says how
    often a row counts, where given). Where no group has more than ``small`` distinct values, each is sorted in one buffer. Else a mergeable
    sketch cuts each group's distinct values into ``BINS`` bins, whose counts say in which bins a percentile lies; only these are ranked.
    """
    names, ps = list(wanted), list(wanted.values())
    v = cut(df.groupBy(*keys, F.col(value).alias("_v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_k")))
    sizes = v.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_k"))), F.lit(0)).alias("n"), F.count("_v").alias("_distinct"))
    most, groups = sizes.agg(F.max("_distinct"), F.count("*")).first()
    if (most or 0) <= small:
        q = v.where("_v IS NULL OR _k > 0").groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(p) for p in ps]), F.col("_k")).alias("_q"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_k")).otherwise(0)).alias("n"))
        return q.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)])
    sent = F.broadcast if groups <= FEW else lambda x: x
    v = v.where("_v IS NOT NULL")
    edges = cut(v.groupBy(*keys).agg(F.percentile_approx("_v", [i / BINS for i in range(1, BINS)], accuracy).alias("_edges")))
    above = [(F.get("_edges", F.lit(i)) <= F.col("_v")).cast("int") for i in range(BINS - 1)]
    v = v.join(sent(edges), keys).select(*keys, "_v", "_k", sum(above[1:], above[0]).alias("_bin"))
    counts = v.groupBy(*keys, "_bin").agg(F.sum("_k").alias("_in"))
    by = Window.partitionBy(*keys)  # a row a bin
    counts = counts.withColumn("n", F.sum("_in").over(by)).withColumn("_before", F.sum("_in").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in"))
    ranks = [(F.floor(p * (F.col("n") - 1)), F.ceil(p * (F.col("n") - 1))) for p in map(F.lit, ps)]
    holds = [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")) for pair in ranks for r in pair]
    held = counts.where(reduce(Column.__or__, holds)).select(*keys, "_bin", "_before", "n")
    near = v.join(sent(cut(held)), [*keys, "_bin"])
    near = near.withColumn("_to", F.col("_before") + F.sum("_k").over(Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_k")), F.col("_v")))

    columns = [(at(low) + (at(high) - at(low)) * F.max(p * (F.col("n") - 1) - low)).alias(name) for name, p, (low, high) in zip(names, map(F.lit, ps), ranks)]
    return sizes.select(*keys, "n").join(near.groupBy(*keys).agg(*columns), keys, "left")

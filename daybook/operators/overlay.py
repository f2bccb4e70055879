"""One timeline out of overlapping layers: at every instant the layer of the highest rank wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def priority_overlay(df: DataFrame, keys: list[str], layer: str, ranked: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Disjoint segments with the winning layer, equal neighbours merged, gaps left out.

    Each interval gives two boundary points. Running sums of what opened and closed tell
    which layers are active after each point, so no segment is joined to its intervals; points
    combine before the sort. ``ranked`` lists the layers, first wins; others don't take part.
    """
    known = df.where(F.col(layer).isin(ranked) & (F.col(end) > F.col(start)))
    ends = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("p")
    sums = [F.sum(F.when(F.col(layer) == name, F.col("p.d")).otherwise(0)).alias(f"_{i}") for i, name in enumerate(ranked)]
    points = known.select(*keys, layer, ends).groupBy(*keys, F.col("p.t").alias("t")).agg(*sums)
    w = Window.partitionBy(*keys).orderBy("t")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    active = F.coalesce(*[F.when(F.sum(f"_{i}").over(running) > 0, F.lit(name)) for i, name in enumerate(ranked)])
    lines = points.select(*keys, "t", active.alias(layer), F.lead("t").over(w).alias("until"))
    turns = lines.withColumn("_turn", (~F.col(layer).eqNullSafe(F.lag(layer).over(w))).cast("int")).withColumn("_run", F.sum("_turn").over(running))
    runs = turns.where(F.col(layer).isNotNull()).groupBy(*keys, "_run", layer).agg(F.min("t").alias(start), F.max("until").alias(end))
    return runs.drop("_run")

"""Joins in time: as-of, interval overlap, band, nearest, top-n per centre.

An interval or band condition alone would compare all pairs of a key. Time is cut into
bins; each side is exploded into the bins that it touches, the join is on key and bin, and
a pair is kept only in the first bin that both touch, so nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, right_at: str) -> DataFrame:
    """Each left row with ``value`` of the last right row at or before it; null before the first.

    One sort of both sides together; ties on the right go to the greatest value.
    """
    a = left.select(F.struct("*").alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(None).cast("long").alias("_seen"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.col(right_at).alias("_seen"))
    w = Window.partitionBy("_k").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_value", F.last("_value", True).over(w)).withColumn("_seen", F.last("_seen", True).over(w))
    return both.where("_side = 1").select("_row.*", F.col("_value").alias(value), F.col("_seen").alias(f"{value}_at"))


def binned(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """A row for each bin that [start, end] touches."""
    first, last = F.floor(start / width), F.floor(end / width)
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(last, first))))


def interval_join(left: DataFrame, right: DataFrame, key: str, width: int, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of a key whose half-open intervals share positive time. Column names must differ but for the key."""
    x = binned(left, F.col(a[0]), F.col(a[1]), width).withColumnRenamed("_first", "_first_a")
    y = binned(right, F.col(b[0]), F.col(b[1]), width).withColumnRenamed("_first", "_first_b")
    pairs = x.join(y, [key, "_bin"]).where(F.col("_bin") == F.greatest("_first_a", "_first_b"))
    return pairs.where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))).drop("_bin", "_first_a", "_first_b")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other_at: str, band: int) -> DataFrame:
    """Pairs of equal keys with times at most ``band`` apart; each right row stands in three bins."""
    x = left.withColumn("_bin", F.floor(F.col(at) / band))
    y = right.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(other_at) / band) + d for d in (-1, 0, 1)])))
    return x.join(y, [*keys, "_bin"]).where(F.abs(F.col(at) - F.col(other_at)) <= band).drop("_bin")


def top_within(centres: DataFrame, rows: DataFrame, key: str, centre: str, at: str, half: int, order: list[Column], n: int) -> DataFrame:
    """For each centre the ``n`` best rows of its key within ``half`` of it."""
    near = band_join(centres, rows, [key], centre, at, half)
    w = Window.partitionBy(key, centre).orderBy(*order)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

"""Latest rows, merges of repeated events, tolerance dedup, graph normalisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_000


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under ``order`` (a total order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_revision(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row by ``order`` of each key, by a partial aggregate: no sort, no hot key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def merge_repeats(df: DataFrame, keys: list[str], gap: int, start: str = "start", end: str = "end") -> DataFrame:
    """Keep the latest end of equal starts, then join runs whose next start comes within ``gap``."""
    first = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    return merge_islands(first, keys, gap, start, end)


def merge_islands(df: DataFrame, keys: list[str], gap: int, start: str = "start", end: str = "end") -> DataFrame:
    """Islands of intervals: a new one begins where the start lies over ``gap`` past the running end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    numbered = df.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).withColumn("island", F.col("island").cast("long"))


def in_blocks(df: DataFrame, order: Window, opens: Column) -> DataFrame:
    """``_block``: stretches of the window's key, each begun by ``opens``, put together up to some BLOCK rows; none is divided."""
    marked = df.withColumn("_at", F.row_number().over(order)).withColumn("_opens", opens)
    first = F.max(F.when(F.col("_opens"), F.col("_at"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_block", F.floor(first / BLOCK)).drop("_at", "_opens")


def drop_within(df: DataFrame, key: str, at: str, tolerance: int) -> DataFrame:
    """Greedy: a row goes if a kept row of its key lies at most ``tolerance`` before it.

    Which rows stay depends on those kept before, so rows are walked in order; a gap over the
    tolerance forgets them, so a key is cut at such gaps, into blocks of some ``BLOCK`` rows.
    """
    w = Window.partitionBy(key).orderBy(at)
    opens = F.coalesce(F.col(at) - F.lag(at).over(w) > tolerance, F.lit(True))
    cut = in_blocks(df, w, opens)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at, kind="stable")
        keep, last = [], None
        for t in rows[at]:
            keep.append(last is None or t - last > tolerance)
            last = t if keep[-1] else last
        return rows[keep].drop(columns="_block")

    return cut.groupBy(key, "_block").applyInPandas(walk, df.schema)


def union_preferring(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first`` and what ``second`` has under other keys."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def normalise_edges(edges: DataFrame, nodes: DataFrame, a: str = "source", b: str = "target", node: str = "id") -> DataFrame:
    """Distinct edges between two different known nodes."""
    kept = edges.where(F.col(a) != F.col(b)).select(a, b).distinct()
    return kept.join(nodes.select(F.col(node).alias(a)), a, "left_semi").join(nodes.select(F.col(node).alias(b)), b, "left_semi")

"""Several stores of buckets and events read as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_store(stores: list[tuple[DataFrame, DataFrame]], prefixes: list[str], start: int | None = None, end: int | None = None, order: str | None = None, distinct: bool = True) -> DataFrame:
    """bucket, start, end, data of the events of all stores whose bucket's name begins with a prefix, those that reach into [start, end).

    A store is its buckets (id, name) and its events (bucket, start, end, data); ids mean something within their store only. The bounds
    are set on each store's events, so they reach its scan. Stores may overlap: with ``distinct`` an event that several hold
    comes once (hashes, no sort). ``order``: "start" or "bucket" sorts; only "start" can keep repeats, as a sort by bucket brings equal events
    together, of which one is kept. No prefix, no rows.
    """
    if order not in (None, "start", "bucket"):
        raise ValueError(f"order {order!r} is neither start nor bucket")
    named = reduce(lambda a, b: a | b, [F.col("name").startswith(p) for p in prefixes], F.lit(False))
    parts = []
    for buckets, events in stores:
        held = events if end is None else events.where(F.col("start") < end)
        held = held if start is None else held.where(F.col("end") > start)
        known = buckets.where(named).select(F.col("id").alias("bucket"), "name")
        parts.append(held.join(known, "bucket").select(F.col("name").alias("bucket"), "start", "end", "data"))
    found = reduce(DataFrame.unionByName, parts)
    if distinct or order == "bucket":
        found = found.distinct()
    sorts = {"start": ["start", "bucket", "end", "data"], "bucket": ["bucket", "start", "end", "data"]}
    return found.orderBy(*sorts[order]) if order else found

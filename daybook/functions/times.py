"""Times from other programs' shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 1601 epoch lies this many microseconds before 1970; larger counts than the bound are of that epoch.
SINCE_1601, BOUND = 11_644_473_600_000_000, 8_000_000_000_000_000


def parse_web_time(raw: Column) -> Column:
    """Microseconds since 1970 of a count since 1970, a count since 1601 or an ISO time; null where it is none."""
    count = raw.try_cast("long")
    iso = F.unix_micros(raw.try_cast("timestamp"))
    return F.when(count > BOUND, count - SINCE_1601).when(count.isNotNull(), count).otherwise(iso)

"""Sessions and timelines: gap sessions with absorption, intersections, downtime, alternation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.dedup import in_blocks
from daybook.operators.joins import interval_join
from daybook.sources.shared import cut


def number_sessions(df: DataFrame, keys: list[str], at: str, order: list[str], gap: int) -> DataFrame:
    """``session``: from 1 in each key; a new one begins after more than ``gap`` since the row before."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    opens = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def absorbing_sessions(df: DataFrame, key: str, kind: str, start: str, end: str, gap: int, absorb: int) -> DataFrame:
    """Runs of one kind; a short item of another kind is absorbed and counted as an interruption.

    What an item is compared with depends on what was absorbed before it, so items are walked
    in order. No run reaches past the greatest end before it, so a key is cut where an item
    starts over ``gap`` after that, into blocks of some thousands of items.
    """
    w = Window.partitionBy(key).orderBy(start, end, kind)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    items = in_blocks(df.select(key, kind, start, end), w, F.coalesce(F.col(start) - reach > gap, F.lit(True)))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, now = rows.sort_values([start, end, kind], kind="stable"), [], None
        for k, s, e in zip(rows[kind], rows[start], rows[end]):
            if now and s - now[2] <= gap and (k == now[0] or e - s <= absorb):
                now[3 if k == now[0] else 4] += 1
                now[2] = max(now[2], e)
                continue
            if now:
                out.append(now)
            now = [k, s, e, 1, 0]
        out += [now] if now else []
        done = pd.DataFrame(out, columns=[kind, start, end, "items", "interruptions"])
        done.insert(0, key, rows[key].iloc[0])
        return done

    types = dict(df.dtypes)
    return items.groupBy(key, "_block").applyInPandas(walk, f"{key} {types[key]}, {kind} {types[kind]}, {start} long, {end} long, items long, interruptions long")


def alternations(df: DataFrame, key: str, kind: str, at: str, order: str, least: int = 4) -> DataFrame:
    """A-B-A-B runs: islands where each item equals the one two before and not the one before."""
    w = Window.partitionBy(key).orderBy(at, order)
    flag = (F.lag(kind, 2).over(w) == F.col(kind)) & (F.lag(kind, 1).over(w) != F.col(kind))
    rows = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("_flag")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_flag").groupBy(key, "run").agg(F.min(at).alias("start"), (F.count("*") + 2).alias("items")).where(F.col("items") >= least)


def clip(left: DataFrame, right: DataFrame, key: str, width: int, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """The shared part of each overlapping pair as ``from_us`` and ``to_us``."""
    both = interval_join(left, right, key, width, a, b)
    return both.withColumn("from_us", F.greatest(a[0], b[0])).withColumn("to_us", F.least(a[1], b[1]))


def downtime(states: DataFrame, unit: str, at: str, bad: Column, until: int) -> DataFrame:
    """Intervals from the first bad sample to the next good one, or to ``until``."""
    w = Window.partitionBy(unit).orderBy(at)
    marked = states.withColumn("_bad", bad).withColumn("_turn", F.coalesce(F.lag("_bad").over(w) != F.col("_bad"), F.lit(True))).where("_turn")
    return marked.withColumn("end", F.coalesce(F.lead(at).over(w), F.lit(until))).where("_bad").select(unit, F.col(at).alias("start"), "end")


def absorbed_items(df: DataFrame, key: str, kind: str, start: str, end: str, gap: int, absorb: int) -> DataFrame:
    """``df`` with ``session`` (its start, a stretch of the key and a number in it) and ``own`` of each item: false for one taken in as an interruption.

    Items are put together as by ``absorbing_sessions``.
    """
    w = Window.partitionBy(key).orderBy(start, end, kind)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    items = in_blocks(df, w, F.coalesce(F.col(start) - reach > gap, F.lit(True)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Items of a partition in order, a stretch after the other, batch by batch."""
        at = now = None
        number = 0
        for rows in batches:
            sessions, own = [], []
            for q, b, k, s, e in zip(rows[key], rows["_block"], rows[kind], rows[start], rows[end]):
                if at != (q, b):
                    at, now, number = (q, b), None, -1
                if now and s - now[1] <= gap and (k == now[0] or e - s <= absorb):
                    now[1] = max(now[1], e)
                else:
                    number, now = number + 1, [k, e]
                sessions.append(number)
                own.append(k == now[0])
            yield rows.assign(_n=sessions, own=own)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    ordered = items.repartition(key, "_block").sortWithinPartitions(key, "_block", start, end, kind)
    walked = ordered.mapInPandas(walk, f"{fields}, _n long, own boolean")
    return walked.withColumn("session", F.concat_ws(":", F.col(key).cast("string"), "_block", "_n")).drop("_n", "_block")


def dominant(rows: DataFrame, key: str, name: str, weight: str, out: str) -> DataFrame:
    """key, ``out``: the name with the greatest summed weight of each key, the least name of those that tie; null names count for none."""
    by = rows.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.sum(weight).alias("_w"))
    return by.groupBy(key).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col(name).alias("name"))).alias("_d")).select(key, F.col("_d.name").alias(out))


def app_sessions(spans: DataFrame, key: str, gap: int = 120_000_000, absorb: int = 30_000_000, least: int = 60_000_000) -> DataFrame:
    """key, app, session, start, end, wall, mode, project, title, interruptions: runs of one app with what dominates their own spans.

    ``spans``: key, app, start, end, mode, project, title. ``key`` should hold the logical day, on which a run never goes on to the next.
    """
    items = cut(absorbed_items(spans, key, "app", "start", "end", gap, absorb).withColumn("_d", F.col("end") - F.col("start")))  # read by each sum below
    own = items.where("own")
    g = items.groupBy(key, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.when(F.col("own"), F.col("app"))).alias("app"), F.count_if(~F.col("own")).alias("interruptions"))
    g = g.withColumn("wall", F.col("end") - F.col("start")).where(F.col("wall") >= least)
    for name in ("mode", "project", "title"):
        g = g.join(dominant(own, "session", name, "_d", name), "session", "left")
    return g.select(key, "app", "session", "start", "end", "wall", "mode", "project", "title", "interruptions")


def deep_blocks(sessions: DataFrame, key: str, productive: list[str], gap: int = 600_000_000, absorb: int = 300_000_000, least: int = 1_800_000_000, ratio: float = 0.85) -> DataFrame:
    """key, start, end, mode, project, ratio, switches: long stretches of productive sessions of one project or mode.

    A session is productive with a project or a mode of ``productive``; of a stretch, its own sessions fill ``ratio`` or more.
    """
    s = sessions.where(F.col("project").isNotNull() | F.col("mode").isin(*productive)).drop("session")
    s = s.withColumn("_about", F.coalesce("project", "mode"))
    items = cut(absorbed_items(s, key, "_about", "start", "end", gap, absorb))
    own = items.where("own")
    before = F.lag("app").over(Window.partitionBy("session").orderBy("start", "end"))
    own = own.withColumn("_switch", F.coalesce((before != F.col("app")).cast("int"), F.lit(0)))
    g = items.groupBy(key, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.when(F.col("own"), F.col("wall"))).alias("_own"))
    g = g.join(own.groupBy("session").agg(F.sum("_switch").alias("switches")), "session").withColumn("ratio", F.col("_own") / (F.col("end") - F.col("start")))
    for name in ("mode", "project"):
        g = g.join(dominant(own, "session", name, "wall", name), "session", "left")
    return g.where((F.col("end") - F.col("start") >= least) & (F.col("ratio") >= ratio)).select(key, "start", "end", "mode", "project", "ratio", "switches")

"""Stateful streams replayed in several batches, rows out of order, against the batch forms; what is late, and what state is left."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybook.operators.dedup import merge_islands
from daybook.operators.sessions import absorbing_sessions
from daybook.streaming import stateful

MIN, HOUR = 60_000_000, 3_600_000_000
DAY = 24 * HOUR
FAR = 400 * DAY


@pytest.fixture()
def stores(spark):
    for k, v in stateful.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in stateful.STATE_STORE:
        spark.conf.unset(k)


def replay(spark, tmp_path, name, batches, schema, make):
    """Each batch a file, one file a micro-batch; the rows given out and the query."""
    folder = tmp_path / name
    folder.mkdir()
    columns = [c.split()[0] for c in schema.split(", ")]
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=columns).to_parquet(folder / f"{i:04d}.parquet")
        os.utime(folder / f"{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return [tuple(r) for r in spark.table(name).collect()], q


def test_absorbing_sessions_replayed(spark, tmp_path, stores):
    rng = np.random.default_rng(1)
    rows = []
    for user in range(4):
        at = 10 * DAY
        for _ in range(60):
            at += int(rng.choice([1, 5, 20, 90])) * MIN
            rows.append((user, at, str(rng.choice(["code", "mail", "chat"])), at, at + int(rng.integers(0, 30)) * MIN))
    rows = sorted(set(rows), key=lambda r: r[1])
    # out of order by up to some hours, within the watermark of a day
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + int(rng.integers(0, 6)) * HOUR)
    parts = np.array_split([*order], 5)
    schema = "user_id long, at long, kind string, start long, end long"
    late = [(0, 9 * DAY, "mail", 9 * DAY, 9 * DAY + MIN)]
    end = [[(9, FAR, "x", FAR, FAR)], [(9, FAR + DAY, "x", FAR + DAY, FAR + DAY), *late], [(9, FAR + 9 * DAY, "x", FAR + 9 * DAY, FAR + 9 * DAY)]]
    batches = [[rows[i] for i in p] for p in parts] + end
    make = lambda s: stateful.absorbing_sessions(s.withColumn("ts", F.timestamp_micros("start")), 30 * MIN, 10 * MIN)
    got, query = replay(spark, tmp_path, "absorbing", batches, schema, make)
    whole = absorbing_sessions(spark.createDataFrame(rows, schema), "user_id", "kind", "start", "end", 30 * MIN, 10 * MIN)
    want = sorted(tuple(r[c] for c in ("user_id", "kind", "start", "end", "items", "interruptions")) for r in whole.collect())
    assert sorted(r for r in got if r[0] != 9) == want and len(want) > 20 and any(r[5] for r in want)
    assert stateful.late_rows(query) == 1
    # nothing is held but what came last
    left = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert left <= 4, left


def test_threshold_episodes_replayed(spark, tmp_path, stores):
    rng = np.random.default_rng(2)
    rows, at = [], 10 * DAY
    for i in range(240):
        at += int(rng.choice([2, 30, 200])) * MIN
        rows.append((i, at, int(rng.integers(0, 2)), str(rng.choice(["a", "b"])), float(rng.integers(0, 100)), "{}"))
    schema = "event_id long, at long, user_id long, event_type string, value double, props string"
    end = [[(900 + j, FAR + j * 9 * DAY, 7, "a", 1e9, "{}")] for j in range(3)]
    batches = [rows[i::4] if i < 0 else rows[i * 60 : (i + 1) * 60] for i in range(4)] + end
    thresholds = spark.createDataFrame([("a", 40.0), ("b", 60.0)], "event_type string, threshold double")
    make = lambda s: stateful.threshold_episodes(s.withColumn("ts", F.timestamp_micros("at")), thresholds, 60 * MIN, 2)
    got, _ = replay(spark, tmp_path, "episodes", batches, schema, make)
    over = spark.createDataFrame(rows, schema).join(thresholds, "event_type").where("value > threshold").select("event_type", "user_id", F.col("at").alias("start"), F.col("at").alias("end"))
    want = sorted((r["event_type"], r["user_id"], r["start"], r["end"], r["n"]) for r in merge_islands(over, ["event_type", "user_id"], 60 * MIN).where("n >= 2").collect())
    assert sorted(r[:5] for r in got if r[1] != 7) == want and len(want) > 5
    most = {(r[0], r[1], r[2]): r[5] for r in got}
    for kind, user, start, stop, _ in want:
        assert most[kind, user, start] == max(v for _, t, u, k, v, _ in rows if (k, u) == (kind, user) and start <= t <= stop and v > (40 if k == "a" else 60))

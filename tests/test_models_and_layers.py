"""Layers, fitted models and time shapes on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from daybook.functions.times import parse_web_time
from daybook.operators.models import balanced_probability, cluster_rows, forest_forecast, smooth_states
from daybook.operators.overlay import priority_overlay


def brute_overlay(rows, ranked):
    """The same by walking every instant."""
    out = []
    for key in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == key]
        last = None
        for t in range(min(r[2] for r in own), max(r[3] for r in own) + 1):
            on = [name for name in ranked if any(r[1] == name and r[2] <= t < r[3] for r in own)]
            now = on[0] if on else None
            if now != last and now:
                out.append([key, now, t, t + 1])
            elif now:
                out[-1][3] = t + 1
            last = now
    return sorted(map(tuple, out))


def test_priority_overlay(spark):
    rows = [("u", "low", 0, 20), ("u", "high", 5, 8), ("u", "high", 8, 10), ("u", "low", 20, 22), ("u", "mid", 9, 12), ("u", "mid", 9, 12), ("u", "high", 30, 30), ("v", "mid", 3, 4), ("v", "low", 6, 9), ("v", "other", 0, 50)]
    ranked = ["high", "mid", "low"]
    df = spark.createDataFrame(rows, "k string, layer string, start long, end long")
    got = sorted((r["k"], r["layer"], r["start"], r["end"]) for r in priority_overlay(df, ["k"], "layer", ranked).collect())
    assert got == brute_overlay([r for r in rows if r[1] != "other"], ranked)
    assert priority_overlay(df.limit(0), ["k"], "layer", ranked).count() == 0


def test_smooth_states(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([1, 1, 2, 1, 2, 2])], "k string, i int, s int")
    assert [r["s"] for r in smooth_states(df, ["k"], "i", "s").orderBy("i").collect()] == [1, 1, 1, 2, 2, 2]


def test_clusters(spark):
    rows = [(i, float(i % 3) + 10 * (i % 2), 1.0 * (i % 2)) for i in range(40)] + [(99, None, 1.0)]
    got = cluster_rows(spark.createDataFrame(rows, "i int, x double, y double"), ["x", "y"]).collect()
    assert len(got) == 40
    assert len({r["cluster"] for r in got if r["i"] % 2}.intersection(r["cluster"] for r in got if not r["i"] % 2)) == 0
    alike = spark.createDataFrame([(1, 2.0), (2, 2.0)], "i int, x double")
    assert {r["cluster"] for r in cluster_rows(alike, ["x"]).collect()} == {0}


def test_forest_and_classifier(spark):
    rows = [(i, float(i % 10), float(i % 7), 3.0 * (i % 10), int(i % 10 > 7)) for i in range(500) if i % 10 not in (6, 7)]
    df = spark.createDataFrame(rows, "i int, x double, noise double, y double, label int")
    train = F.col("i") < 300
    held = forest_forecast(df, ["x", "noise"], "y", train).select("i", "y", "forecast").collect()
    assert len(held) == 160 and sum(abs(r["y"] - r["forecast"]) for r in held) / 160 < 3
    scored = balanced_probability(df, ["x", "noise"], "label", train).where(~train).collect()
    assert sum((r["probability"] >= 0.5) == bool(r["label"]) for r in scored) == 160
    with pytest.raises(ValueError):
        balanced_probability(df.withColumn("label", F.lit(1)), ["x"], "label", train)


def test_time_shapes(spark):
    at = 1_704_067_200_000_001
    rows = [(str(at),), (str(at + 11_644_473_600_000_000),), ("2024-01-01T00:00:00.000001Z",), ("soon",), (None,)]
    got = spark.createDataFrame(rows, "raw string").select(parse_web_time(F.col("raw")).alias("at"))
    assert [r["at"] for r in got.collect()] == [at, at, at, None, None]

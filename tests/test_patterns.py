"""Sessions with what dominates them, deep blocks, compaction of a day, against plain versions."""

import datetime
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from daybook.operators import sessions
from daybook.streaming import jobs

SEC = 1_000_000


def plain_groups(items, kind, gap, absorb):
    """Runs of items (dicts) of one key in order: own items, interruptions, start, end."""
    out, now = [], None
    for x in sorted(items, key=lambda x: (x["start"], x["end"], x[kind])):
        if now and x["start"] - now["end"] <= gap and (x[kind] == now["kind"] or x["end"] - x["start"] <= absorb):
            (now["own"] if x[kind] == now["kind"] else now["other"]).append(x)
            now["end"] = max(now["end"], x["end"])
        else:
            now = {"kind": x[kind], "start": x["start"], "end": x["end"], "own": [x], "other": []}
            out.append(now)
    return out


def top(own, name, weight):
    by = Counter()
    for x in own:
        if x[name] is not None:
            by[x[name]] += weight(x)
    return min(by, key=lambda n: (-by[n], n)) if by else None


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for key in ("u1/1", "u1/2", "u2/1"):
        at = 0
        for _ in range(90):
            at += int(rng.choice([0, 5, 60, 130, 700])) * SEC
            d = int(rng.choice([5, 20, 31, 100, 900])) * SEC
            pick = lambda *x: x[int(rng.integers(len(x)))]
            out.append({"key": key, "app": pick("ed", "web", "ed", "term"), "start": at, "end": at + d, "mode": pick("coding", "reading", None), "project": pick("p", "q", None, None), "title": pick("a", "b", "c")})
            at += d
    return out


def test_app_sessions_and_deep_blocks(spark, rows):
    frame = spark.createDataFrame(rows, "key string, app string, start long, end long, mode string, project string, title string").repartition(5)
    got = sessions.app_sessions(frame, "key")
    found = sorted((r["key"], r["start"], r["end"], r["app"], r["wall"], r["mode"], r["project"], r["title"], r["interruptions"]) for r in got.collect())
    span, want, kept = (lambda x: x["end"] - x["start"]), [], {}
    for key in ("u1/1", "u1/2", "u2/1"):
        for g in plain_groups([r for r in rows if r["key"] == key], "app", 120 * SEC, 30 * SEC):
            wall = g["end"] - g["start"]
            if wall >= 60 * SEC:
                s = {"key": key, "app": g["kind"], "start": g["start"], "end": g["end"], "wall": wall, **{n: top(g["own"], n, span) for n in ("mode", "project", "title")}}
                want.append((key, g["start"], g["end"], g["kind"], wall, s["mode"], s["project"], s["title"], len(g["other"])))
                kept.setdefault(key, []).append(s)
    assert found == sorted(want) and len(want) > 20 and any(w[-1] for w in want)
    blocks = sessions.deep_blocks(got, "key", ["coding"], least=600 * SEC, ratio=0.6)
    found = sorted((r["key"], r["start"], r["end"], r["mode"], r["project"], round(r["ratio"], 9), r["switches"]) for r in blocks.collect())
    want = []
    for key, own in kept.items():
        own = [s | {"about": s["project"] or s["mode"]} for s in own if s["project"] or s["mode"] == "coding"]
        for g in plain_groups(own, "about", 600 * SEC, 300 * SEC):
            wall, filled = g["end"] - g["start"], sum(s["wall"] for s in g["own"])
            if wall >= 600 * SEC and filled / wall >= 0.6:
                switches = sum(a["app"] != b["app"] for a, b in zip(g["own"], g["own"][1:]))
                want.append((key, g["start"], g["end"], *(top(g["own"], n, lambda s: s["wall"]) for n in ("mode", "project")), round(filled / wall, 9), switches))
    assert found == sorted(want) and want


def test_absorbed_items_agree_with_sessions(spark, rows):
    frame = spark.createDataFrame([(r["key"], r["app"], r["start"], r["end"]) for r in rows], "key string, app string, start long, end long")
    items = sessions.absorbed_items(frame, "key", "app", "start", "end", 120 * SEC, 30 * SEC).toPandas()
    assert len(items) == len(rows)
    got = sorted((g["key"].iloc[0], g.loc[g["own"], "app"].iloc[0], int(g["start"].min()), int(g["end"].max()), int(g["own"].sum()), int((~g["own"]).sum())) for _, g in items.groupby("session"))
    want = sessions.absorbing_sessions(frame, "key", "app", "start", "end", 120 * SEC, 30 * SEC).collect()
    assert got == sorted((r["key"], r["app"], r["start"], r["end"], r["items"], r["interruptions"]) for r in want)


def test_a_day_is_compacted(spark, tmp_path):
    at = pd.to_datetime(["2024-01-01 08:00", "2024-01-01 09:00", "2024-01-02 09:00", "2024-01-01 10:00"])
    folder, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    for i in range(2):
        pdf = pd.DataFrame({"event_id": [2 * i, 2 * i + 1], "ts": at[2 * i : 2 * i + 2], "user_id": [1, 2], "event_type": ["a", "b"], "value": [1.0, 2.0], "props": ["{}"] * 2})
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(folder)
        jobs.append_by_day(jobs.event_stream(spark, folder), out, cp).awaitTermination(120)
    before = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert before == [0, 1, 2, 3]
    assert jobs.compact_day(spark, out, "2024-01-01", 1) == 3
    after = spark.read.parquet(out)
    assert sorted(r["event_id"] for r in after.collect()) == before
    assert {(r["logical_day"], r["batch"]) for r in after.select("logical_day", "batch").distinct().collect()} == {(datetime.date(2024, 1, 1), -1), (datetime.date(2024, 1, 2), 1)}
    assert jobs.compact_day(spark, out, "2024-01-01", 1) == 3 and spark.read.parquet(out).count() == 4

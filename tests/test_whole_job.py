"""Queries and operators over the whole of their input: nothing left out by a constant, a round limit or a single task."""

import numpy as np
import pandas as pd
import pytest

from daybook.operators import graph, series
from daybook.plans import catalog, coverage, graphs, intervals, stats


def chain(spark, ids):
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "source long, target long")
    return edges, spark.createDataFrame([(i,) for i in ids], "id long")


def test_components_of_a_long_chain(spark):
    edges, nodes = chain(spark, [0, *range(1001, 1050), *range(50, 0, -1)])
    assert {r["component"] for r in graph.connected(edges, nodes).collect()} == {0}


def test_components_that_do_not_settle_raise(spark):
    with pytest.raises(RuntimeError):
        graph.connected(*chain(spark, [0, *range(1001, 1050), *range(50, 0, -1)]), limit=2)


def whole_links(sf):
    """Suppliers that follow each other in an order, of all lines, by hand."""
    lines = pd.read_parquet(f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_suppkey"]).sort_values(["l_orderkey", "l_linenumber", "l_suppkey"])
    nxt = lines.groupby("l_orderkey")["l_suppkey"].shift(-1)
    return sorted({(int(a), int(b)) for a, b in zip(lines["l_suppkey"], nxt) if b == b and a != b}), sorted(map(int, pd.read_parquet(f"{sf}/supplier.parquet")["s_suppkey"]))


def test_graph_queries_take_all_lines(spark, sf):
    links, ids = whole_links(sf)
    assert {(r["source"], r["target"]) for r in graphs.edges(spark, sf).collect()} == set(links)
    root = {i: i for i in ids}
    for a, b in links * len(ids):
        root[a] = root[b] = min(root[a], root[b])
    assert {(r["id"], r["component"]) for r in graphs.whole_weak_components(spark, sf).collect()} == set(root.items())
    at, n = {i: k for k, i in enumerate(ids)}, len(ids)
    step = np.zeros((n, n))
    for a, b in links:
        step[at[b], at[a]] = 1
    out = step.sum(axis=0)
    step = np.where(out > 0, step / np.maximum(out, 1), 1 / n)
    rank = np.full(n, 1 / n)
    for _ in range(40):
        rank = 0.15 / n + 0.85 * step @ rank
    got = {r["id"]: r["rank"] for r in graphs.page_rank(spark, sf).collect()}
    assert np.allclose([got[i] for i in ids], rank, atol=2e-8)


def test_file_overlap_keeps_every_path(spark, tmp_path):
    row = {"l_linenumber": 1, "l_suppkey": 1, "l_quantity": 1.0, "l_returnflag": "A", "l_shipdate": pd.Timestamp("1998-01-05")}
    pd.DataFrame([row | {"l_orderkey": sha, "l_partkey": path} for sha, path in ((1, 7), (2, 7), (3, 8), (4, 8))]).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    assert {(r["sha"], r["others"], r["paths"]) for r in intervals.whole_file_overlap(spark, str(tmp_path)).collect()} == {(1, 1, 1), (3, 1, 1)}


def test_windows_follow_the_events(spark, tmp_path):
    at = pd.to_datetime(["2025-03-03 05:00", "2025-04-10 06:00", "2025-04-30 12:00"])
    pd.DataFrame({"event_id": [1, 2, 3], "ts": at, "user_id": [7, 7, 7], "event_type": ["view", "purchase", "error"], "value": [1.0, 2.0, 3.0], "props": ["{}"] * 3}).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    d = str(tmp_path)
    hours = intervals.hourly_presence(spark, d).collect()
    assert len(hours) == 61 * 24 and sum(r["n"] for r in hours) == 3
    assert [(r["end"] - r["start"]) // 3_600_000_000 for r in intervals.downtime_intervals(spark, d).collect()] == [12]
    assert [r["uptime"] for r in intervals.uptime_summary(spark, d).collect()] == [round(1 - 12 / (61 * 24), 6)]
    assert {str(r["day"]) for r in stats.active_levels(spark, d).collect()} == {"2025-04-10", "2025-04-11", "2025-04-12", "2025-04-13"}
    days = coverage.covered_days(spark, d).collect()
    assert len(days) == 7 + 61 + 5 and sum(r["n"] or 0 for r in days) == 3


def test_resampling_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, 900)
    rows = [("a", bool(i % 3 == 0), float(v + (i % 3 == 0))) for i, v in enumerate(x)] + [("b", bool(i % 2), float(i % 4 // 2)) for i in range(400)] + [("one", True, 1.0)]
    df = spark.createDataFrame(rows, "k string, arm boolean, v double")
    sizes = series.value_blocks(df, "k", "arm", "v", 50).groupBy("k", "block").count().collect()
    assert max(r["count"] for r in sizes) < 100 and {r["k"] for r in sizes} == {"a", "b"}
    t, c = (np.array([v for k, arm, v in rows if k == "a" and arm == which]) for which in (True, False))
    error = 1.96 * np.sqrt(t.var() / len(t) + c.var() / len(c))
    for size in (50, 5000):
        got = {r["k"]: r for r in series.bootstrap_delta(df, "k", "arm", "v", block_values=size).collect()}
        assert set(got) == {"a", "b"} and abs(got["a"]["delta"] - (t.mean() - c.mean())) < 1e-9
        assert abs(got["a"]["delta"] - got["a"]["low"] - error) < 0.15 * error and abs(got["a"]["high"] - got["a"]["delta"] - error) < 0.15 * error
        p = {r["k"]: r["p"] for r in series.permutation_p(df, "k", "arm", "v", iterations=300, block_values=size).collect()}
        assert p["a"] == 1 / 301 and p["b"] == 1.0
    four = spark.createDataFrame([(1, i < 3, float(i)) for i in range(6)], "k long, arm boolean, v double")
    assert abs(series.permutation_p(four, "k", "arm", "v", iterations=2000, block_values=2).first()["p"] - 0.1) < 0.03


def test_queries_claim_only_what_they_do():
    """Ids that a query shares a computation with, but doesn't compute."""
    said = {name: f.__doc__ or "" for name, f in catalog.queries().items()}
    for name, ids in {"supported_claims": ("A60",), "whole_weak_components": ("F18", "G10"), "month_quarter_keys": ("P08", "F10"), "whole_file_overlap": ("J04", "J26")}.items():
        assert not [i for i in ids if i in said[name]], name
    assert said["supported_claims"].startswith("Part of A05")

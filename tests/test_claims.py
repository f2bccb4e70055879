"""Medians of histograms, bootstrap intervals, exact percentiles and walks cut into stretches, against plain versions."""

import numpy as np
import pytest

from daybook.operators import dedup, quantiles, ranks, sessions



@pytest.mark.parametrize("stretches", [1, 5, 40])
def test_contrasts_of_values_themselves(spark, stretches):
    """Ranks, medians and their interval against plain versions, whatever the stretches; ties, even and odd sizes, a cohort that is alone in nothing."""
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(3, 2, 401), "b": np.round(rng.normal(1, 2, 700), 1), "c": np.round(rng.normal(1, 9, 50), 0), "one": np.array([2.5])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan"))]
    held = ranks.in_stretches(spark.createDataFrame(rows, "g string, x double"), "g", "x", stretches)
    got = {r["cohort"]: r for r in ranks.median_contrasts(held, 800).collect()}
    sums = {r["cohort"]: r for r in ranks.rank_sums(held).collect()}
    assert got.keys() == sums.keys() == groups.keys()
    for k, own in groups.items():
        rest = np.concatenate([v for q, v in groups.items() if q != k])
        r, s = got[k], sums[k]
        assert r["median_delta"] == pytest.approx(np.median(own) - np.median(rest)) and r["median_ratio"] == pytest.approx(np.median(own) / np.median(rest))
        drawn = [np.median(rng.choice(own, len(own))) - np.median(rng.choice(rest, len(rest))) for _ in range(1500)]
        low, high = np.percentile(drawn, [2.5, 97.5])
        room = 0.15 * (high - low) + 0.06
        assert abs(r["low"] - low) < room and abs(r["high"] - high) < room, k
        u = sum((own[:, None] > rest[None, :]).sum(1) + 0.5 * (own[:, None] == rest[None, :]).sum(1))
        assert (s["n1"], s["n2"]) == (len(own), len(rest)) and s["u"] == pytest.approx(u)
        whole = np.concatenate([own, rest])
        _, ties = np.unique(whole, return_counts=True)
        n = len(whole)
        assert s["sd"] == pytest.approx(np.sqrt(len(own) * len(rest) / 12 * ((n + 1) - (ties.astype(float) ** 3 - ties).sum() / (n * (n - 1)))))


def test_middles_of_resamples():
    """The drawn middle has the law of a resample's: compared by its quantiles, for odd and even sizes."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 30):
        fast = ranks.resampled_middles(n, 20_000, rng).mean(1)
        plain = np.array([np.median(rng.integers(0, n, n)) for _ in range(20_000)])
        assert abs(fast.mean() - plain.mean()) < 0.05 * max(1, plain.std()) and abs(fast.std() - plain.std()) < 0.05 * max(1, plain.std())


def test_no_rows_no_contrasts(spark):
    held = ranks.in_stretches(spark.createDataFrame([], "g string, x double"), "g", "x")
    assert ranks.median_contrasts(held).count() == 0 and ranks.rank_sums(held).count() == 0


def test_percentiles_of_small_and_large_groups(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(0, 9, 4000), "b": rng.integers(0, 7, 3000).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("none", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"p0": 0.0, "p10": 0.1, "mid": 0.5, "p95": 0.95, "p100": 1.0}
    for accuracy, small in ((10_000, 100_000), (300, 1000)):
        got = {r["k"]: r for r in quantiles.percentiles(df, ["k"], "v", wanted, accuracy, small).collect()}
        assert set(got) == {*values, "none"} and got["none"]["mid"] is None and got["none"]["n"] == 0
        for k, vs in values.items():
            assert got[k]["n"] == len(vs)
            assert [got[k][c] for c in wanted] == pytest.approx(list(np.quantile(vs, list(wanted.values()))), abs=1e-9)


def test_walks_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 30)  # several blocks
    rng = np.random.default_rng(8)
    at = sorted(int(x) for x in rng.integers(0, 3000, 150))
    kept, last = [], None
    for t in at:
        if last is None or t - last > 20:
            kept.append(t)
            last = t
    got = dedup.drop_within(spark.createDataFrame([("u", t) for t in at], "k string, at long"), "k", "at", 20)
    assert got.columns == ["k", "at"] and sorted(r["at"] for r in got.collect()) == kept
    items = sorted((int(s), int(s + n), "ab"[int(k)]) for s, n, k in zip(rng.integers(0, 4000, 120), rng.integers(1, 60, 120), rng.integers(0, 2, 120)))
    want, now = [], None
    for s, e, k in items:
        if now and s - now[2] <= 25 and (k == now[0] or e - s <= 10):
            now[3 if k == now[0] else 4] += 1
            now[2] = max(now[2], e)
        else:
            want += [tuple(now)] if now else []
            now = [k, s, e, 1, 0]
    want.append(tuple(now))
    found = sessions.absorbing_sessions(spark.createDataFrame([("u", k, s, e) for s, e, k in items], "u string, kind string, s long, e long"), "u", "kind", "s", "e", 25, 10)
    assert sorted((r["kind"], r["s"], r["e"], r["items"], r["interruptions"]) for r in found.collect()) == sorted(want)

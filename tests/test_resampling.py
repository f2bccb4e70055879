"""Resampling of any number of units against enumeration and theory; slopes and baselines against plain versions."""

import datetime
import itertools
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import baselines, resampling, slopes


def pairs_frame(spark, groups):
    return spark.createDataFrame([(k, i, float(d)) for k, ds in groups.items() for i, d in enumerate(ds)], "k string, unit long, d double")


def flips(ds):
    seen = abs(sum(ds))
    return sum(abs(sum(s * d for s, d in zip(signs, ds))) >= seen for signs in itertools.product((1, -1), repeat=len(ds))) / 2 ** len(ds)


def relabellings(strata):
    """p of the weighted mean difference over all relabellings within strata, by whole numbers."""
    gaps, seen = [0.0], 0.0
    for values, arm in strata:
        n, n_t = len(values), sum(arm)
        w = min(n_t, n - n_t)
        gap = lambda own: w * (sum(values[i] for i in own) / n_t - sum(values[i] for i in range(n) if i not in own) / (n - n_t))
        own = [gap(set(c)) for c in itertools.combinations(range(n), n_t)]
        gaps = [a + b for a in gaps for b in own]
        seen += gap({i for i in range(n) if arm[i]})
    return sum(abs(g) >= abs(seen) - 1e-9 for g in gaps) / len(gaps)


@pytest.mark.parametrize("states", [1_000_000, 10])
def test_sign_flips_equal_enumeration(spark, states):
    """From one pair to twelve, ties and zeros among them; with few states allowed, Monte Carlo comes near."""
    rng = np.random.default_rng(1)
    groups = {f"n{n}": rng.integers(-9, 15, n).tolist() for n in range(1, 13)} | {"zero": [0, 0, 0], "same": [2] * 11}
    got = {r["k"]: r for r in resampling.sign_flip_p(pairs_frame(spark, groups), "k", "unit", "d", states=states, iterations=4000).collect()}
    assert got.keys() == groups.keys()
    for k, ds in groups.items():
        if got[k]["method"] == "exact":
            assert got[k]["p"] == pytest.approx(flips(ds), abs=1e-12)
        else:
            assert abs(got[k]["p"] - flips(ds)) < 0.04
    assert ({r["method"] for r in got.values()} == {"exact"}) == (states > 10)


def test_sign_flips_of_many_pairs(spark):
    """Hundreds of pairs of small whole differences are exact; so is a step."""
    ds = [1] * 260 + [-1] * 240
    p = resampling.sign_flip_p(pairs_frame(spark, {"a": ds, "b": [d / 4 for d in ds]}), "k", "unit", "d", step=0.25).collect()
    from math import comb

    want = sum(comb(500, j) for j in range(501) if abs(500 - 2 * j) >= 20) / 2**500
    assert {r["method"] for r in p} == {"exact"} and all(r["p"] == pytest.approx(want, rel=1e-9) for r in p)


@pytest.mark.parametrize("states", [1_000_000, 5])
def test_permutations_equal_enumeration(spark, states):
    rng = np.random.default_rng(2)
    designs = {}
    for n in range(2, 9):
        arm = [True] + [bool(x) for x in rng.integers(0, 2, n - 2)] + [False]
        designs[f"n{n}"] = [(rng.integers(0, 20, n).tolist(), arm)]
    designs["two"] = [([3, 9, 4, 1, 7], [True, False, False, True, False]), ([10, 2, 8], [True, False, True])]
    designs["three"] = [([1, 5], [True, False]), ([2, 2, 9, 4], [False, True, False, True]), ([6, 3, 3], [True, True, False])]
    rows = [(k, s, a, float(v)) for k, strata in designs.items() for s, (values, arm) in enumerate(strata) for v, a in zip(values, arm)]
    rows += [("one arm", 0, True, 1.0), ("two", 7, True, 50.0)]  # no both arms: no key, no stratum
    frame = spark.createDataFrame(rows, "k string, s int, arm boolean, v double")
    got = {r["k"]: r for r in resampling.permutation_p(frame, "k", "arm", "v", "s", states=states, iterations=2000).collect()}
    assert got.keys() == designs.keys()
    for k, strata in designs.items():
        assert got[k]["units"] == sum(len(v) for v, _ in strata)
        assert abs(got[k]["p"] - relabellings(strata)) < (1e-9 if got[k]["method"] == "exact" else 0.06), k
    assert any(r["method"] != "exact" for r in got.values()) == (states == 5)


def test_draws_hang_together_nowhere(spark):
    """Draws of neighbouring replicates and places: even, and not correlated."""
    d = spark.range(400).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("place"))
    rows = d.withColumn("x", resampling.draw(F.lit(10), 3, F.col("rep"), F.col("place"))).orderBy("rep", "place").collect()
    x = np.array([r["x"] for r in rows], float).reshape(400, 20)
    counts = np.bincount(x.astype(int).ravel(), minlength=10)
    assert counts.min() > 700 and counts.max() < 900
    places = np.corrcoef(x.T)
    assert abs(places[~np.eye(20, dtype=bool)]).max() < 0.2
    assert abs(np.corrcoef(x[:-1].ravel(), x[1:].ravel())[0, 1]) < 0.04 and len({tuple(r) for r in x}) == 400


def test_spread_of_the_paired_bootstrap(spark):
    """Over many data sets the width of the interval is that of theory."""
    rng = np.random.default_rng(3)
    groups = {f"g{i}": rng.normal(2, 3, 15).tolist() for i in range(40)}
    got = {r["k"]: r for r in resampling.paired_bootstrap(pairs_frame(spark, groups), "k", "unit", "d").collect()}
    ratio = []
    for k, ds in groups.items():
        assert got[k]["pairs"] == 15 and got[k]["delta"] == pytest.approx(np.mean(ds))
        ratio.append((got[k]["high"] - got[k]["low"]) / (2 * 1.96 * np.std(ds) / np.sqrt(15)))
    assert abs(np.mean(ratio) - 1) < 0.05 and 0.8 < min(ratio) and max(ratio) < 1.2


def test_spread_of_the_stratified_bootstrap(spark):
    """One stratum: the width of two resampled arms. Several: the same draws by plain loops over the same hash."""
    rng = np.random.default_rng(4)
    rows = [(f"g{i}", 0, u, u % 2 == 0, float(v)) for i in range(30) for u, v in enumerate(rng.normal(0, 2, 40))]
    frame = spark.createDataFrame(rows, "k string, s int, unit long, arm boolean, v double")
    ratio = []
    for r in resampling.stratified_bootstrap(frame, "k", "s", "unit", "arm", "v", iterations=500).collect():
        t, c = (np.array([v for k, _, _, a, v in rows if k == r["k"] and a == arm]) for arm in (True, False))
        ratio.append((r["high"] - r["low"]) / (2 * 1.96 * np.sqrt(t.var() / 20 + c.var() / 20)))
        assert r["delta"] == pytest.approx(t.mean() - c.mean())
    assert abs(np.mean(ratio) - 1) < 0.05
    mixed = [("a", s, u, u % 3 == 0, float(v)) for s in range(4) for u, v in enumerate(rng.normal(s, 1 + s, 6 + s))] + [("a", 9, 0, True, 99.0)]
    r = resampling.stratified_bootstrap(spark.createDataFrame(mixed, frame.schema), "k", "s", "unit", "arm", "v", iterations=300).first()
    assert r["strata"] == 4 and r["low"] < r["delta"] < r["high"]


def brute_slope(y):
    i, j = np.triu_indices(len(y), 1)
    return int(np.sign(y[j] - y[i]).sum()), float(np.median((y[j] - y[i]) / (j - i)))


def test_slopes_equal_all_pairs():
    rng = np.random.default_rng(5)
    for t in range(120):
        n = int(rng.integers(2, 70))
        y = rng.integers(0, 1 + t % 9, n).astype(float) if t % 2 else np.round(rng.normal(0, 1, n), t % 4)
        s, m = brute_slope(y)
        for listed in (None, 3, 25):
            assert slopes.mann_kendall(y) == s and slopes.sen_slope(y, listed) == pytest.approx(m, abs=1e-9)
    assert slopes.sen_slope(np.ones(1)) is None and slopes.mann_kendall(np.zeros(0)) == 0


def test_slope_of_a_long_series(spark):
    """200,000 points: twenty thousand million pairs, none of them made."""
    rng = np.random.default_rng(6)
    y = np.round(0.01 * np.arange(200_000) + rng.normal(0, 50, 200_000), 2)
    began = time.time()
    frame = spark.range(200_000).select(F.lit("a").alias("k"), "id").join(spark.createDataFrame(list(enumerate(y.tolist())), "id long, v double"), "id")
    r = slopes.trend(frame, "k", "id", "v").first()
    assert r["n"] == 200_000 and abs(r["slope"] - 0.01) < 1e-4 and r["s"] > 0 and time.time() - began < 90


@pytest.mark.parametrize("short", [0, 300])
def test_short_and_long_series_agree(spark, short):
    rng = np.random.default_rng(10)
    series = {k: rng.integers(0, 9, n).astype(float) for k, n in (("a", 2), ("b", 17), ("c", 60), ("one", 1))}
    rows = [(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)] + [("a", 99, None)]
    got = {r["k"]: (r["s"], r["slope"], r["n"]) for r in slopes.trend(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v", short).collect()}
    assert got.keys() == {"a", "b", "c"}
    for k, (s, slope, n) in got.items():
        assert (s, n) == (brute_slope(series[k])[0], len(series[k])) and slope == pytest.approx(brute_slope(series[k])[1])


def plain_baselines(rows, history=28, least=7):
    by = {}
    for k, day, v in rows:
        by.setdefault((k, day), []).append(v)
    out = {}
    for (k, day), own in by.items():
        past = [v for (q, d), vs in by.items() if q == k and 1 <= (day - d).days <= history for v in vs]
        base = dev = None
        if len(past) >= least:
            base = statistics.median(past)
            sd = statistics.median(abs(v - base) for v in past) * 1.4826
            dev = (statistics.mean(own) - base) / sd if sd > 0 else None
        out[k, day] = (statistics.mean(own), max(own), len(own), base, dev, dev is not None and abs(dev) >= 2)
    return out


@pytest.mark.parametrize("bins", [64, 4])
def test_baselines_by_hand(spark, bins):
    """Days missing, few values, equal values, one key flat: by calendar days, the day itself left out."""
    rng = np.random.default_rng(7)
    first = datetime.date(2024, 1, 1)
    rows = []
    for k in ("a", "b", "flat", "rare", "ties"):
        for d in range(90):
            if k == "rare" and d % 15 or k != "flat" and rng.random() < 0.3 or 40 < d < 72 and k == "b":
                continue
            for _ in range(int(rng.integers(1, 6))):
                v = 3.0 if k == "flat" else float(rng.integers(0, 4)) if k == "ties" else float(np.round(rng.normal(10, 4) + d / 10, 3))
                rows.append((k, first + datetime.timedelta(days=d), v))
    frame = spark.createDataFrame([*rows, ("a", first, None), ("a", first, float("nan"))], "k string, day date, v double")
    got = {(r["k"], r["day"]): r for r in baselines.trailing_baselines(frame, "k", "day", "v", bins=bins).collect()}
    want = plain_baselines(rows)
    assert got.keys() == want.keys()
    for key, (mean, most, n, base, dev, flag) in want.items():
        r = got[key]
        assert (r["n"], r["most"], r["flagged"]) == (n, most, flag) and r["mean"] == pytest.approx(mean), key
        assert (r["baseline"] is None) == (base is None) and (base is None or r["baseline"] == pytest.approx(base, abs=1e-9)), key
        assert (r["deviation"] is None) == (dev is None) and (dev is None or r["deviation"] == pytest.approx(dev, abs=1e-6)), key
    assert any(f for *_, f in want.values()) and any(base is None for _, _, _, base, _, _ in want.values())

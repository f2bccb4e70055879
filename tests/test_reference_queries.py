"""Every query against its SQL on the smallest tables, and helpers on hand-made frames."""

import math
import os
from datetime import date

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybook.functions.significance import normal_p, student_p, with_q
from daybook.operators import dedup, graph, joins, series, sessions, slopes
from daybook.plans import catalog, graphs
from daybook.plans.registry import registry
from daybook.plans.scalars import query_spec
from daybook.sources import snapshots
from daybook.sources.exports import export_path, malformed_csv, read_csv, read_json, write_lines
from daybook.sources.shared import shared_dir
from daybook.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_holds_what_it_must(spark, sf, name):
    """Rows there are (but for cuts and periods, which a series may lack), keys set, shares and intervals in their bounds."""
    got = catalog.queries()[name](spark, sf)
    rows = [r.asDict() for r in got.collect()]
    assert rows or name in ("changepoints_by_type", "periods_by_type")
    for r in rows:
        assert r[got.columns[0]] is not None
        assert all(0 <= r[c] <= 1 for c in ("p", "p_value", "rank") if r.get(c) is not None)
        assert all(r[a] <= r[b] for a, b in (("low", "high"), ("start", "end")) if a in r and b in r)


def test_names_are_registered_once():
    found, register = registry()
    register()(test_names_are_registered_once)
    with pytest.raises(ValueError):
        register()(test_names_are_registered_once)
    assert "month_quarter_keys" in catalog.queries() and "period_keys" in catalog.queries()


def test_student_and_normal_p(spark):
    """Against tables of the t and normal distributions."""
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.776, 4, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (2.763, 28, 0.01), (0.0, 7, 1.0), (3.0, 0, 1.0)]
    for r in spark.createDataFrame(known, "t double, df long, p double").withColumn("got", student_p(F.col("t"), F.col("df"))).collect():
        assert abs(r["got"] - r["p"]) < 2e-4
    known = [(1.95996, 0.05), (-2.57583, 0.01), (0.0, 1.0), (3.29053, 0.001), (9.0, 0.0)]
    for r in spark.createDataFrame(known, "z double, p double").withColumn("got", normal_p(F.col("z"))).collect():
        assert abs(r["got"] - r["p"]) < 1e-6
    frame = spark.createDataFrame([(1, 1, 0.01), (1, 2, 0.04), (1, 3, 0.03), (1, 4, 0.5)], "f int, k int, p double")
    assert [round(r["q"], 6) for r in with_q(frame, ["f"], ["k"]).orderBy("k").collect()] == [0.04, 0.053333, 0.053333, 0.5]


def test_malformed_records_come_apart(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("  ",), ('{"a": ',), ('{"a": 2, "b": "x"}',)], "value string")
    rows, bad = read_json(spark, write_lines(lines, "lines"), "a long, b string")
    assert {r["a"]: r["b"] for r in rows.collect()} == {1: None, 2: "x"}
    assert [r["line"] for r in bad.collect()] == ['{"a": ']
    path = export_path(spark, "csv")
    spark.createDataFrame([("1", 'say "hi",\nthere'), ("no", "x")], "id string, said string").write.options(header=True, quote='"', escape='"').csv(path)
    rows, bad = (f(spark, path, "id long, said string") for f in (read_csv, malformed_csv))
    assert [(r["id"], r["said"]) for r in rows.collect()] == [(1, 'say "hi",\nthere')] and bad.count() == 1


def test_shared_dir_must_be_set_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_merge_and_tolerance(spark):
    rows = [("a", 0, 10), ("a", 0, 15), ("a", 15, 20), ("a", 51, 52), ("b", 5, 5)]
    got = dedup.merge_repeats(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], 30)
    assert sorted((r["k"], r["start"], r["end"]) for r in got.collect()) == [("a", 0, 20), ("a", 51, 52), ("b", 5, 5)]
    v = spark.createDataFrame([("u", t) for t in (0, 5, 10, 11, 22)], "k string, at long")
    assert sorted(r["at"] for r in dedup.drop_within(v, "k", "at", 10).collect()) == [0, 11, 22]


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([(1, "h", 5), (2, "h", 10), (3, "h", 11), (4, "x", 1)], "id long, k string, at long")
    right = spark.createDataFrame([("h", 10, 1.0), ("h", 20, 2.0)], "k string, since long, v double")
    got = {r["id"]: r["v"] for r in joins.asof_join(left, right, "k", "at", "v", "since").collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: None}
    rng = np.random.default_rng(0)
    a = [(int(i), 0, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(0, 90, 60)))]
    b = [(int(i), 0, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(0, 90, 60)))]
    got = joins.interval_join(spark.createDataFrame(a, "i long, k long, s long, e long"), spark.createDataFrame(b, "j long, k long, t long, f long"), "k", 37, ("s", "e"), ("t", "f"))
    want = sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_absorption(spark):
    rows = [("u", "code", 0, 100), ("u", "mail", 110, 120), ("u", "code", 130, 200), ("u", "mail", 210, 400)]
    got = sessions.absorbing_sessions(spark.createDataFrame(rows, "u string, kind string, s long, e long"), "u", "kind", "s", "e", 120, 30)
    assert sorted((r["kind"], r["s"], r["e"], r["items"], r["interruptions"]) for r in got.collect()) == [("code", 0, 200, 2, 1), ("mail", 210, 400, 1, 0)]


def test_series(spark):
    x = [(1, i, 0.0 if i < 10 else 5.0) for i in range(20)] + [(2, i, 1.0) for i in range(20)] + [(3, i, math.sin(2 * math.pi * i / 7)) for i in range(70)]
    frame = spark.createDataFrame(x, "k long, i long, v double")
    cuts = series.changepoints(frame.where("k < 3"), "k", "i", "v").collect()
    assert [(r["k"], r["at"], r["before"], r["after"]) for r in cuts] == [(1, 10, 0.0, 5.0)]
    found = series.periods(frame.where("k > 1"), "k", "i", "v").collect()
    assert [(r["k"], round(r["period"], 3)) for r in found] == [(3, 7.0)]
    t = {r["k"]: (r["s"], r["slope"]) for r in slopes.trend(spark.createDataFrame([(1, i, 2.0 * i) for i in range(10)], "k long, i long, v double"), "k", "i", "v").collect()}
    assert t == {1: (45, 2.0)}


def test_graph_helpers(spark, sf):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "source long, target long")
    n = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert {(r["id"], r["component"]) for r in graph.connected(e, n).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    assert {(r["node"], r["depth"]) for r in graph.walk(e, n.where("id = 1"), 5).collect()} == {(1, 0), (2, 1), (3, 2)}
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(e, n, iterations=12).collect()}
    m = np.full(6, 1 / 6)
    for _ in range(12):
        into = np.zeros(6)
        for a, b in ((1, 2), (2, 3), (3, 1), (4, 5)):
            into[b - 1] += m[a - 1]
        m = 0.15 / 6 + 0.85 * (into + (1 - into.sum()) / 6)
    assert np.allclose([ranks[i] for i in range(1, 7)], m)


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for refresh, rows in (("r1", [(1,), (2,)]), ("r2", [(3,)]), ("r1", [(9,)])):
        snapshots.replace_slice(spark.createDataFrame(rows, "x long"), path, refresh)
    assert sorted((r["refresh_id"], r["x"]) for r in spark.read.parquet(path).collect()) == [("r1", 9), ("r2", 3)]
    with pytest.raises(ValueError):
        snapshots.guard_shrinkage(4, 10)
    (tmp_path / "a.json").write_text('{"x": 1}\nnot json\n{"x": 2}\n')
    good, bad = snapshots.read_ndjson(spark, f"{tmp_path}/a.json", spark.createDataFrame([(1,)], "x long").schema)
    assert good.count() == 2 and bad.count() == 1


def test_query_spec_rejects_unknown(spark, sf):
    with pytest.raises(ValueError):
        query_spec(spark.range(3), {"select": ["nothing"]})


def run(frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_streams(spark, tmp_path):
    at = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-01 09:00", "2024-01-09 00:00"])
    pdf = pd.DataFrame({"event_id": [1, 2, 3, 4], "ts": at, "user_id": [7, 7, 7, 8], "event_type": ["a", "b", "a", "a"], "value": [1.0, 2.0, 3.0, 4.0], "props": ["{}"] * 4})
    folder = f"{tmp_path}/in"
    spark.createDataFrame(pdf).coalesce(1).write.parquet(folder)
    stream = lambda: jobs.event_stream(spark, folder)
    assert sorted((r["user_id"], r["n"]) for r in run(jobs.sessions(stream()), "s1").collect()) == [(7, 1), (7, 2)]
    assert run(jobs.distinct_within(stream(), ["user_id"]), "s2").count() == 2
    assert sorted((r["event_type"], r["n"]) for r in run(jobs.daily(stream()), "s3").collect()) == [("a", 2), ("b", 1)]
    pairs = jobs.near_pairs(stream().where("event_type = 'a'"), stream().where("event_type = 'b'"))
    assert [(r["a_id"], r["b_id"]) for r in run(pairs, "s4").collect()] == [(1, 2)]
    jobs.append_by_day(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 4 and date(2023, 12, 31) in {r[0] for r in out.select("logical_day").distinct().collect()}
    ctx = spark.createDataFrame([(7, at[0].to_pydatetime(), at[2].to_pydatetime(), "c")], "user_id long, valid_from timestamp, valid_to timestamp, context string")
    assert sorted((r["event_id"], r["context"]) for r in run(jobs.with_context(stream(), ctx), "s5").collect()) == [(1, "c"), (2, "c"), (3, None), (4, None)]


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert graphs.REGISTRY and os.path.exists("/root/testdata")

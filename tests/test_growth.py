"""What a query moves grows with its input, not with the pairs or draws that it stands for."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import baselines, blocks, graph, mentions, names, regimes, resampling
from daybook.operators.quantiles import percentiles
from daybook.plans import catalog, evidence_graph
from daybook.sources import shared
from tests.test_reference_queries import plain


def moved(spark, run):
    """Rows of ``run()`` and the most records that one stage shuffled for them."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    before = max((s.stageId() for s in stages()), default=-1)
    rows = run()
    return rows, max((s.shuffleWriteRecords() for s in stages() if s.stageId() > before), default=0)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """400 work events and the lines of 400 orders that share a file, a module and an hour: 160,000 pairs."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    kind = F.element_at(F.array(F.lit("click"), F.lit("purchase")), (F.col("id") % 2 + 1).cast("int"))
    e = spark.range(400).select((F.col("id") * 50).alias("event_id"), (F.col("id") % 3 * 20).alias("user_id"), kind.alias("event_type"), F.expr("timestamp_seconds(1704069000 + id)").cast("timestamp_ntz").alias("ts"), (F.col("id") % 9).cast("double").alias("value"), F.lit("{}").alias("props"))
    e = e.unionByName(e.where("event_id < 500").withColumn("event_id", F.col("event_id") + 50_000).withColumn("value", F.lit(-400.0)))
    l = spark.range(800).select(F.expr("id div 2 * 720 + 1").alias("l_orderkey"), (F.col("id") % 4 * 10).alias("l_partkey"), (F.col("id") % 5 * 50).alias("l_suppkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"))
    o = spark.range(400).select(F.expr("id * 720 + 1").alias("o_orderkey"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"))
    for name, df in (("events", e), ("lineitem", l), ("orders", o)):
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def against_sql(name, rows, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert want and sorted(tuple(plain(r[c]) for c in names) for r in rows) == want


@pytest.mark.parametrize("name", ["symbol_overlap", "commit_lags", "assist_density", "attribution_backfill"])
def test_pairs_are_not_shuffled(spark, crowded, name):
    rows, most = moved(spark, lambda: catalog.queries()[name](spark, crowded).collect())
    against_sql(name, rows, crowded, ["events", "lineitem", "orders"])
    assert most < 10_000


def test_episode_without_length(spark, tmp_path):
    """episode_contributors: an episode that lasts no time shares none with what overlies it, of none in all."""
    at = "timestamp_seconds(1704069000 + id * 60)"
    e = spark.range(4).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.expr("IF(id = 0, 'view', 'error')").alias("event_type"), F.expr(at).cast("timestamp_ntz").alias("ts"), F.expr("CASE id WHEN 0 THEN 50.0D WHEN 1 THEN 0.5D ELSE 3.0D END").alias("value"), F.lit("{}").alias("props"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = catalog.queries()["episode_contributors"](spark, str(tmp_path)).collect()
    against_sql("episode_contributors", rows, tmp_path, ["events"])
    assert [r["episode"] for r in rows if r["share"] != r["share"]] == [1]


def test_percentiles_read_their_input_once(spark):
    """Equal values are counted before anything moves, weights stand for rows, and large groups are ranked as small ones."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") > 9, F.col("id") % 50 * F.col("id") % 41).alias("v"))
    wanted = {"a": 0.0, "b": 0.31, "c": 0.95, "d": 1.0}
    weights = df.groupBy("k", "v").agg(F.count("*").alias("w"))
    want = sorted(tuple(round(float(x), 6) for x in r) for r in df.groupBy("k").agg(F.count("v"), *[F.percentile("v", p) for p in wanted.values()]).collect())
    for frame, weight in ((df, None), (weights, "w")):
        for small in (10, 100):
            rows, most = moved(spark, lambda: percentiles(frame, ["k"], "v", wanted, 300, small, **({"weight": weight} if weight else {})).collect())
            assert sorted(tuple(round(float(x), 6) for x in r) for r in rows) == want
            assert most < 10_000


def test_draws_are_not_shuffled(spark):
    """Bootstraps over tables too large to broadcast: 120,000 draws stay in the tasks that make them, and those joined from larger groups give the same means."""
    df = spark.range(600).select((F.col("id") % 2).alias("k"), F.col("id").alias("unit"), (F.col("id") * 7 % 101).cast("double").alias("d"), (F.col("id") % 6).alias("s"), (F.col("id") % 5 < 2).alias("arm"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows, most = moved(spark, lambda: resampling.paired_bootstrap(df, "k", "unit", "d", 200).collect())
        assert len(rows) == 2 and all(r["low"] < r["delta"] < r["high"] for r in rows) and most < 10_000
        rows, most = moved(spark, lambda: resampling.stratified_bootstrap(df, "k", "s", "unit", "arm", "d", 200).collect())
        assert len(rows) == 2 and all(r["low"] < r["delta"] < r["high"] for r in rows) and most < 10_000
        x = resampling._spots(df.select("k", "unit", F.col("d").alias("_v")), ["k"], "unit")
        slots = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("_rep"), F.lit(300).cast("long").alias("_n"))
        means = [sorted((r["k"], r["_rep"], round(r["_mean"], 9)) for r in resampling._drawn_means(slots, x, ["k"], ["_rep"], [F.lit(0), F.col("_rep")], held).collect()) for held in (1000, 10)]
        assert len(means[0]) == 40 and means[0] == means[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_daily_mean_is_exact(spark):
    """stress_baselines: a mean of hundredths that lies half way between two ten-thousandths is rounded up, as SQL does, not down by the error of a sum."""
    for n in range(8):
        hundredths = [(i * 7919 + n * 104_729) % 9_973 for i in range(63)]
        hundredths.append((-sum(hundredths) + 4 + 64 * 9_973 * n) % 64 + 64 * n)
        exact = sum(hundredths) / 64 / 100
        rows = spark.createDataFrame([(h / 100.0,) for h in hundredths], "v double").repartition(3).groupBy("v").agg(F.count("*").alias("k"))
        assert sum(hundredths) % 64 == 4 and rows.agg(baselines._mean(F.col("v"), F.col("k"))).first()[0] == exact


def test_betweenness_moves_blocks(spark):
    """700 nodes and some 7,000 links over several blocks: half a million pairs of nodes are never rows; scores as by one search a source."""
    rng = np.random.default_rng(5)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 700, (7000, 2)) if a != b}
    after = {v: [b for a, b in links if a == v] for v in range(700)}
    want = dict.fromkeys(range(700), 0.0)
    for s in range(700):
        paths, depth, order = {s: 1.0}, {s: 0}, [s]
        for v in order:
            for w in after[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        through = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            through[v] = sum(paths[v] / paths[w] * (1 + through[w]) for w in after[v] if depth[w] == depth[v] + 1)
            want[v] += through[v] if v != s else 0.0
    edges = spark.createDataFrame([(a * 10, b * 10) for a, b in sorted(links)], "source long, target long")
    nodes = spark.range(700).select((F.col("id") * 10).alias("id"))
    rows, most = moved(spark, lambda: graph.betweenness(edges, nodes).collect())
    assert {r["id"]: r["score"] for r in rows} == {v * 10: pytest.approx(x / (699 * 698), abs=1.1e-6) for v, x in want.items()}
    assert most < 10_000


def test_series_are_walked_side_by_side():
    """hidden_regimes: sums and paths of many series at once equal those of each alone, whatever their lengths."""
    rng = np.random.default_rng(3)
    lengths = np.array([1, 7, 0, 31, 2, 31, 12])
    flat, k = rng.normal(size=(lengths.sum(), 3)), 4
    moves = rng.random((k, k)) + 0.1
    model = np.full(k, 1 / k), moves / moves.sum(1, keepdims=True), rng.normal(size=(k, 3)), rng.random((k, 3)) + 0.5
    parts = np.split(flat, np.cumsum(lengths)[:-1])
    want, total, seen = 0, 0, {}
    for x in parts:
        if len(x):
            like, share, moved = regimes.forward_backward(x, *model)
            want = want + np.concatenate([[like], share[0], moved.ravel(), share.sum(0), (share.T @ x).ravel(), (share.T @ (x * x)).ravel()])
    for part, own, x in regimes.laid_out(flat, lengths, 40):
        total = total + regimes.expected_counts(x, own, *model)
        seen |= {int(i): path[:n].tolist() for i, n, path in zip(part, own, regimes.best_paths(x, own, *model))}
    assert np.allclose(total, want)
    assert seen == {i: regimes.best_path(x, *model).tolist() for i, x in enumerate(parts) if len(x)}


BOUNDED = ["history_claims", "file_change_periods", "symbol_change_periods", "throughput_table"]


@pytest.mark.parametrize("name", BOUNDED)
def test_tasks_stay_small(spark, monkeypatch, name):
    """Memory of a task follows the size that tasks are dealt in: none reads the whole of a table, and rows are those of the SQL."""
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(shared, "TASK_ROWS", 300)
    context = spark.sparkContext
    store, none, most = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0), context._gateway.new_array(context._jvm.double, 1)
    most[0] = 1.0

    def stages():
        found = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    before = max((s.stageId() for s in stages()), default=-1)
    rows = catalog.queries()[name](spark, folder).collect()
    after = [s for s in stages() if s.stageId() > before and s.shuffleReadRecords() > 5000]
    read = [store.taskSummary(s.stageId(), s.attemptId(), most).get().shuffleReadMetrics().readRecords().apply(0) for s in after]
    assert read and max(read) < 1500
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(map(plain, r)) for r in found.fetchall())


def test_renames_are_paired_in_their_project(spark, monkeypatch):
    """rename_candidates: 300 projects of 40 similar names: names are paired where a project has both, the same rows if their pairs are too many to hold."""
    name = F.concat(F.lit("some_long_common_name_"), (F.col("id") % 40 + 10).cast("string"))
    gone = spark.range(12_000).select((F.col("id") % 300).alias("project"), F.concat(F.lit("some_long_common_name_"), (F.floor(F.col("id") / 300) + 10).cast("string")).alias("name"), F.lit("2024-01-02").cast("date").alias("day"), F.lit("DELETED").alias("change"))
    come = spark.range(300).select(F.col("id").alias("project"), name.alias("name"), F.lit("2024-01-03").cast("date").alias("day"), F.lit("ADDED").alias("change"))
    frame = gone.unionByName(come)
    rows, most = moved(spark, lambda: names.rename_candidates(frame, 0.9).collect())
    assert len(rows) == 300 * 39 and most < 30_000
    monkeypatch.setattr(names, "BROADCAST_PAIRS", 0)
    assert sorted(map(tuple, names.rename_candidates(frame, 0.9).collect())) == sorted(map(tuple, rows))


def most_read(spark, run):
    """Rows of ``run()`` and the most records that one task read from a shuffle for them."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)
    stages = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    before = max((stages.apply(i).stageId() for i in range(stages.size())), default=-1)
    rows, most = run(), 0
    stages = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    for stage in (stages.apply(i) for i in range(stages.size())):
        if stage.stageId() > before and stage.shuffleReadRecords():
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 1000)
            most = max([most, *(t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in (tasks.apply(i) for i in range(tasks.size())) if t.taskMetrics().isDefined())])
    return rows, most


@pytest.mark.parametrize("least", [True, False])
def test_components_do_not_meet_in_the_task_of_a_hub(spark, monkeypatch, least):
    """A hub of 8,000 neighbours (as the least of them, and as the greatest), 2,000 small chains and a node alone."""
    monkeypatch.setattr(shared, "TASK_ROWS", 2000)
    hub = 0 if least else 900_000
    links = spark.range(8000).select(F.lit(hub).cast("long").alias("source"), (F.col("id") + 1).alias("target"))
    chains = spark.range(2000).selectExpr("explode(array(struct(10000 + id * 3 AS source, 10001 + id * 3 AS target), struct(10002 + id * 3 AS source, 10001 + id * 3 AS target))) AS x").select("x.*")
    edges = links.unionByName(chains)
    nodes = spark.range(1, 8001).unionByName(spark.range(10_000, 16_000)).unionByName(spark.createDataFrame([(hub,), (99_999,)], "id long"))
    rows, most = most_read(spark, lambda: graph.connected(edges, nodes).collect())
    got = {r["id"]: r["component"] for r in rows}
    want = {v: min(hub, 1) for v in [hub, *range(1, 8001)]} | {v: 10_000 + (v - 10_000) // 3 * 3 for v in range(10_000, 16_000)} | {99_999: 99_999}
    assert got == want and len(rows) == len(want)
    assert most < 6000  # 16,001 before


def test_clusters_are_summed_in_small_tasks(spark, monkeypatch):
    """A cluster of 6,000 nodes and 6,000 of one node each."""
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    nodes = spark.range(12_000).selectExpr("id", "IF(id % 2 = 0, 'commit', 'raw_log') AS kind", "IF(id % 3 = 0, 'a', 'b') AS source", "IF(id % 5 = 0, NULL, concat('p', id % 5)) AS project", "IF(id = 7, date'2024-01-02', date'2024-02-01') AS day")
    members = spark.range(12_000).selectExpr("id", "IF(id < 6000, 0, id) AS component")
    labels = spark.range(6001).selectExpr("id", "IF(id % 2 = 0, 'decision_signal', 'risk_signal') AS label")
    rows, most = most_read(spark, lambda: mentions.score_clusters(nodes, labels, members).collect())
    by = {r["cluster"]: r.asDict() for r in rows}
    assert len(by) == len(rows) == 6001 and sum(r["n"] for r in rows) == 12_000
    assert {k: str(v) if k == "day" else v for k, v in by[0].items()} == {"cluster": 0, "day": "2024-01-02", "project": "p1", "n": 6000, "sources": "a,b", "labels": "decision_signal,risk_signal", "score": 0.8 * 2 + 1.44 + 0.9 + 0.35, "moment": True}
    assert by[6000]["labels"] == "decision_signal" and by[6000]["project"] is None and by[6001]["labels"] == "" and by[6001]["score"] == 0.92
    assert most < 3000  # 6,002 before


def test_links_of_strong_components_are_not_shuffled(spark):
    """300 nodes, each linked to each (89,700 links), and one that only the last of them leads to."""
    edges = spark.range(300).selectExpr("id AS source", "explode(sequence(0L, 299L)) AS target").where("source <> target").unionByName(spark.createDataFrame([(299, 300)], "source long, target long"))
    rows, most = moved(spark, lambda: graph.strong_components(edges, spark.range(301)).collect())
    assert {r["id"]: r["component"] for r in rows} == dict.fromkeys(range(300), 0) | {300: 300}
    assert most < 10_000  # 89,701 before


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_strong_components_joined_or_sent(spark, monkeypatch, most):
    """Two rings of three that lead one to the other, a link twice, a link to itself and an end that is no node."""
    monkeypatch.setattr(graph, "SENT_NODES", most)
    links = [(3, 4), (4, 5), (5, 3), (5, 0), (0, 1), (1, 2), (2, 0), (2, 0), (2, 2), (2, 6), (7, 9)]
    edges, nodes = spark.createDataFrame(links, "source long, target long"), spark.range(8)
    got = graph.strong_components(edges, nodes)
    assert {r["id"]: r["component"] for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    assert graph.longest_chain(edges, got) == 3


def through_by_search(n, links):
    """What passes each node: one search a source, and back."""
    after = {v: sorted(b for a, b in links if a == v) for v in range(n)}
    want = np.zeros((n, n))
    for s in range(n):
        paths, depth, order = {s: 1.0}, {s: 0}, [s]
        for v in order:
            for w in after[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        for v in reversed(order):
            want[s, v] = sum(paths[v] / paths[w] * (1 + want[s, w]) for w in after[v] if depth[w] == depth[v] + 1)
        want[s, s] = 0
    return want


def test_state_of_walks_does_not_move(spark):
    """Betweenness of 700 nodes and some 7,000 links: what is shuffled in all is links and sums, no number for each pair of nodes."""
    rng = np.random.default_rng(5)
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, 700, (7000, 2)) if a != b})
    edges, nodes = spark.createDataFrame(links, "source long, target long"), spark.range(700)
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    before = max((s.stageId() for s in stages()), default=-1)
    got = {r["id"]: r["score"] for r in graph.betweenness(edges, nodes).collect()}
    want = through_by_search(700, links).sum(0) / (699 * 698)
    assert got == {v: pytest.approx(x, abs=1.1e-6) for v, x in enumerate(want)}
    assert sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > before) < 1_000_000  # 35,216,401 before


@pytest.mark.parametrize("held, per_block", [(1, 40), (1 << 20, 300), (1 << 20, 100_000)])
def test_walks_over_stored_blocks(spark, monkeypatch, held, per_block):
    """Whatever the size of a block and of what a task keeps: two parts of which one leads to the other, nodes that only lead in, and some alone."""
    monkeypatch.setattr(blocks, "LINKS", per_block)
    monkeypatch.setattr(blocks, "HELD", held)
    rng = np.random.default_rng(11)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 120, (1300, 2))} | {(int(a), int(b)) for a, b in rng.integers(150, 200, (200, 2))}
    links |= {(int(a), int(b)) for a, b in zip(rng.integers(125, 145, 150), rng.integers(150, 200, 150))} | {(3, 170)}
    links = sorted((a, b) for a, b in links if a != b)
    edges = spark.createDataFrame(links, "source long, target long")
    places = spark.range(210).select("id", F.col("id").alias("at"))
    folders, width = blocks.store_links(edges, places, 210)
    ways, turn = set(), blocks._turn
    monkeypatch.setattr(blocks, "_turn", lambda links, low, size, jobs: ways.update(j[:2] for j in jobs) or turn(links, low, size, jobs))
    known, want = blocks.Links(folders, width, 210), through_by_search(210, links)
    for i in range(0, 210, 7):
        low, total = blocks.passed(known, np.arange(i, min(i + 7, 210)))
        got = np.zeros(210)
        got[low : low + len(total)] = total
        assert np.allclose(got, want[i : i + 7].sum(0))
    assert ways == {(blocks.OUT, False), (blocks.IN, True), (blocks.OUT, True), (blocks.IN, False)}
    assert held > 1 or len(known.held) == 1


@pytest.mark.parametrize("rows_of_a_task, side_by_side", [(200_000, 100_000), (100, 50)])
def test_overlaps_of_a_commit_lie_together(spark, crowded, monkeypatch, rows_of_a_task, side_by_side):
    """symbol_overlap: 164,000 pairs come commit after commit, also where an hour's lines are cut into shares and its events into several rows."""
    monkeypatch.setattr(shared, "TASK_ROWS", rows_of_a_task)
    monkeypatch.setattr(evidence_graph, "SIDE_BY_SIDE", side_by_side, raising=False)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = catalog.queries()["symbol_overlap"](spark, crowded).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    against_sql("symbol_overlap", rows, crowded, ["events", "lineitem"])
    runs = 1 + sum(a["sha"] != b["sha"] for a, b in zip(rows, rows[1:]))
    assert runs < 20_000


def test_overlaps_of_odd_rows(spark, tmp_path):
    """symbol_overlap: events without a user or a time, events given twice and in two modules, lines without a part, number, supplier or order."""
    e = [(i * 50 + i % 2, [3, 23, 4, None, -7][i % 5], ["click", "purchase", "view"][i % 3], None if i % 11 == 10 else 1704070000 + i % 4 * 1800) for i in range(60)]
    e += e[:20] + [(a, 4, "click", at) for a, _, _, at in e[20:40]] + [(None, 3, "click", 1704070000)]
    e = spark.createDataFrame(e, "event_id long, user_id long, event_type string, at long").selectExpr("event_id", "user_id", "event_type", "CAST(timestamp_seconds(at) AS timestamp_ntz) AS ts", "1.0D AS value", "'{}' AS props")
    l = [(720 * (i % 13) + i % 3, [3, 4, 23, -7, None][i % 5], [0, 50, 1, 100, 51, None, -50][i % 7], [1, 2, 4, None][i % 4]) for i in range(300)] + [(None, 3, 0, 1)]
    l = spark.createDataFrame(l, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    for name, df in (("events", e), ("lineitem", l)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    against_sql("symbol_overlap", catalog.queries()["symbol_overlap"](spark, str(tmp_path)).collect(), tmp_path, ["events", "lineitem"])

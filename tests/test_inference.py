"""Mentions, clusters, renames, nights, capped walks and forecasts by time against plain versions on hand-made frames."""

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import folds, graph, mentions, names, nights
from daybook.plans import inference

MIN, HOUR = 60_000_000, 3_600_000_000


def plain_mentions(texts, registry):
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    word = lambda c: c.isalnum() or c in "_-"
    out = set()
    for k, text in texts:
        text = fold(text)
        for name, canonical in registry:
            name = fold(name)
            at = text.find(name) if name not in ("", " ") else -1
            while at >= 0:
                before, after = text[at - 1 : at] if at else "", text[at + len(name) : at + len(name) + 1]
                if not (before and word(before) or after and word(after)):
                    out.add((k, canonical))
                    break
                at = text.find(name, at + 1)
    return out


REGISTRY = [("Raw Log", "kb"), ("raw-log", "kb"), ("target vision", "tv"), ("target", "t"), ("é", "e"), ("log", "log"), ("", "none"), (None, "none"), ("x" * 50, "long"), ("C++", "cpp"), ("中文", "zh")]
TEXTS = ["the raw\n\t log of it", "a raw-log", "raw-logs", "Target  Vision!", "target visionary", "my-target", "target_", "É é", "éa", "log", "catalog", "log.log", "", None, "x" * 51, "x" * 50, "uses C++, not C+++", "说中文", "说 中文 吧", "raw log raw log"]


@pytest.mark.parametrize("portion", [20_000, 1, 3])
def test_mentions_by_hand(spark, portion):
    rows = list(enumerate(TEXTS))
    got = mentions.mentions(spark.createDataFrame(rows, "id long, text string"), "id", "text", spark.createDataFrame(REGISTRY, "name string, canonical string"), portion=portion)
    assert got.count() == len({tuple(r) for r in got.collect()})
    assert {tuple(r) for r in got.collect()} == plain_mentions(rows, REGISTRY)
    assert {(0, "kb"), (1, "kb"), (3, "tv"), (3, "t")} <= {tuple(r) for r in got.collect()}


def test_no_names_no_mentions(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    assert mentions.mentions(texts, "id", "text", spark.createDataFrame([("", "x")], "name string, canonical string")).count() == 0


def test_many_names(spark):
    names_ = [(f"name {i} of many", f"c{i % 50}") for i in range(300)]
    texts = [(i, f"here is name {i * 7 % 300} of many, and Name {i} of  many") for i in range(40)]
    got = mentions.mentions(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(names_, "name string, canonical string"), portion=128)
    assert {tuple(r) for r in got.collect()} == plain_mentions(texts, names_)


def test_text_tags_by_hand(spark):
    texts = [(1, "We DECIDED; is it broken?"), (2, "nothing"), (3, None), (4, "I am not sure whether to sleep"), (5, "priority: critical  path")]
    got = {(r["id"], r["label"]) for r in mentions.text_tags(spark.createDataFrame(texts, "id long, text string"), "id", "text").collect()}
    assert got == {(1, "decision_signal"), (1, "blocker_signal"), (1, "open_question"), (4, "open_question"), (4, "energy_context"), (5, "intent_signal")}


def test_clusters_against_union_find(spark):
    rng = np.random.default_rng(1)
    kinds = ["commit", "ai_session", "machine_pressure_incident", "raw_log", "visit"]
    nodes = [(f"n{i}", kinds[int(rng.integers(5))], f"s{rng.integers(3)}", [None, "p", "q"][int(rng.integers(3))], None if rng.random() < 0.2 else f"2024-01-{rng.integers(1, 28):02d}") for i in range(150)]
    relations = [*mentions.CLUSTER_RELATIONS, "spoken_by"]
    edges = [(f"n{a}", f"n{b}", relations[int(rng.integers(5))]) for a, b in rng.integers(0, 150, (110, 2))] + [("n1", "stranger", "references")]
    labels = [(f"n{rng.integers(150)}", str(rng.choice(["decision_signal", "blocker_signal", "code_change", "risk_signal"]))) for _ in range(120)]
    root = {n[0]: n[0] for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, r in edges:
        if r in mentions.CLUSTER_RELATIONS and b in root:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want, held = {}, defaultdict(list)
    for n in nodes:
        held[find(n[0])].append(n)
    for own in held.values():
        ids = {n[0] for n in own}
        said = sorted({label for i, label in labels if i in ids})
        sources = sorted({n[2] for n in own})
        score = 0.8 * len(sources) + 0.12 * min(len(own), 12) + 0.9 * len({"decision_signal", "blocker_signal"} & set(said)) + 0.35 * len(set(kinds[:3]) & {n[1] for n in own})
        by = Counter(n[3] for n in own if n[3])
        project = min(by, key=lambda p: (-by[p], p)) if by else None
        want[min(ids)] = (min((n[4] for n in own if n[4]), default=None), project, len(own), ",".join(sources), ",".join(said), round(score, 3), round(score, 3) >= 1.5 or len(sources) >= 2)
    frame = spark.createDataFrame(nodes, "id string, kind string, source string, project string, day string").withColumn("day", F.to_date("day"))
    got = mentions.weak_clusters(frame, spark.createDataFrame(edges, "source string, target string, relation string"), spark.createDataFrame(labels, "id string, label string"))
    got = {r["cluster"]: (str(r["day"]) if r["day"] else None, r["project"], r["n"], r["sources"], r["labels"], r["score"], r["moment"]) for r in got.collect()}
    assert got == want and any(m[-1] for m in want.values()) and not all(m[-1] for m in want.values())


def test_group_edges_join_groups(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "g string, n long")
    assert sorted(tuple(r) for r in mentions.group_edges(rows, ["g"], "n", "same").collect()) == [(1, 2, "same"), (1, 3, "same")]


@pytest.mark.parametrize("ratio", [0.6, 0.8, 0.95])
def test_similar_names_equal_all_pairs(spark, ratio):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcde_é1"), int(rng.integers(1, 14))))
    old = [word() for _ in range(90)] + ["read_config", "parse", "aaaa", "", None, "same", "getValue"]
    new = [word() for _ in range(90)] + ["read_configs", "parser", "aaab", "aaaa", "", None, "same", "get_value"]
    got = names.similar_names(spark.createDataFrame([(x,) for x in old], "old_name string"), spark.createDataFrame([(x,) for x in new], "new_name string"), ratio)
    rows = [tuple(r) for r in got.collect()]
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in {x for x in old if x} for b in {x for x in new if x} if a != b}
    assert len(rows) == len({r[:2] for r in rows})
    assert {(a, b): s for a, b, s in rows} == {k: s for k, s in want.items() if s >= ratio}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rename_candidates_by_hand(spark):
    rows = [
        ("p", "load_rows", "2024-01-02", "DELETED"), ("p", "load_row", "2024-01-01", "ADDED"), ("p", "load_rowz", "2024-01-02", "ADDED"), ("p", "load_rowz", "2024-02-02", "ADDED"),
        ("q", "load_rows", "2024-03-01", "DELETED"), ("q", "load_row", "2024-04-01", "ADDED"), ("q", "load_rows", "2024-05-01", "ADDED"), ("p", "moved", "2024-06-01", "RENAMED"), ("p", "moved", "2024-05-01", "RENAMED"),
        ("r", "load_row", "2024-04-01", "ADDED"), ("p", "zzz", "2024-04-01", "ADDED"), ("p", "x", "2024-04-01", "MODIFIED"),
    ]
    frame = spark.createDataFrame(rows, "project string, name string, day string, change string").withColumn("day", F.to_date("day"))
    got = {(r["project"], r["old_name"], r["new_name"], str(r["day"]), r["source"], round(r["similarity"], 3)) for r in names.rename_candidates(frame).collect()}
    assert got == {("p", "moved", "moved", "2024-05-01", "explicit_rename", 1.0), ("p", "load_rows", "load_rowz", "2024-01-02", "similar_name", 0.889), ("q", "load_rows", "load_row", "2024-04-01", "similar_name", 0.941)}


def frames(spark, watch=(), active=(), keys=(), covered=(), media=()):
    u = lambda rows: [("u", *r) for r in rows]
    return (
        spark.createDataFrame(u(watch), "user_id string, start long, end long, score double, minutes double"), spark.createDataFrame(u(active), "user_id string, start long, end long"),
        spark.createDataFrame(u([(k,) for k in keys]), "user_id string, at long"), spark.createDataFrame(u(covered), "user_id string, start long, end long"), spark.createDataFrame(u(media), "user_id string, start long, end long"),
    )


def h(x):
    return int(x * HOUR)


def test_nights_layer_by_layer(spark):
    """One night, with each layer present or away in turn."""
    watch, active = [(h(23), h(31), 80.0, None)], [(h(20), h(22.5)), (h(31.5), h(33))]
    night = lambda **k: [r.asDict() for r in nights.infer_nights(*frames(spark, **k)).orderBy("bed_start").collect()]
    (r,) = night(watch=watch, active=active, covered=[(h(0), h(48))])
    assert (r["source"], r["bed_start"], r["bed_end"], r["pre_min"], r["post_min"], r["sleep_min"], r["confidence"], r["evidence"]) == ("watch+aw", h(22.5), h(31.5), 30.0, 30.0, 480.0, 0.9, "watch_sleep")
    (r,) = night(watch=watch, covered=[(h(0), h(48))])
    assert (r["source"], r["bed_start"], r["confidence"], r["winner"]) == ("watch_only", h(23), 0.9, True)
    (r,) = night(active=active, covered=[(h(0), h(48))])
    assert (r["source"], r["sleep_start"], r["sleep_min"], r["confidence"], r["evidence"]) == ("aw_only", None, 500.0, 0.55, "no_watch_sleep,aw_inactivity_gap,no_keypresses_during_gap")
    (r,) = night(watch=watch, active=active)
    assert r["evidence"] == "watch_sleep,keylog_unavailable" and r["confidence"] == 0.85
    (r,) = night(watch=watch, active=active, covered=[(h(0), h(48))], keys=[h(24) + i for i in range(30)])
    assert r["keys"] == 30 and r["confidence"] == 0.65 and "keypresses" in r["evidence"]
    (r,) = night(watch=watch, active=[(h(20), h(30)), (h(40), h(41))], covered=[(h(0), h(48))], media=[(h(23), h(28))])
    assert r["evidence"] == "watch_sleep,aw_not_afk_during_watch_sleep,aw_active_probably_stale,ambient_media_during_sleep" and (r["active_min"], r["media_min"]) == (420.0, 300.0)
    assert night(active=active, covered=[(h(0), h(48))], keys=[h(24) + i for i in range(20)]) == []
    assert night() == [] and night(active=[(0, h(1)), (h(30), h(31))]) == []
    (r,) = night(watch=[(h(23), h(29), None, None), (h(24), h(31), 70.0, 300.0), (h(24.5), h(25), 1.0, None)], covered=[(h(0), h(48))])
    assert (r["sleep_start"], r["score"], r["sleep_min"], r["confidence"]) == (h(24), 70.0, 300.0, 0.85) and "collapsed_3" in r["evidence"]


def plain_nights(watch, active, keys, covered, media):
    """Record by record in order; source, bed, keys, confidence of each night."""
    active = sorted(active)
    gaps = [(a[1], b[0]) for a, b in zip(active, active[1:]) if b[0] - a[1] >= 3 * HOUR]
    groups, spans = [], []
    for w in sorted(watch, key=lambda w: w[:2]):
        if w[1] <= w[0]:
            continue
        if groups and w[0] <= max(x[1] for x in groups[-1]):
            groups[-1].append(w)
        else:
            groups.append([w])
    for own in groups:
        spans.append((*max(own, key=lambda w: (w[1] - w[0], w[2] is not None))[:3], len(own)))
    over = lambda a, b, c, d: max(0, min(b, d) - max(a, c))
    known = lambda a, b: any(over(a, b, c, d) for c, d in covered)
    pressed = lambda a, b: sum(a <= k < b for k in keys) if known(a, b) else 0
    used, out = set(), []
    for a, b, score, n in spans:
        best, most = None, 0
        for i, (c, d) in enumerate(gaps):
            s = over(a, b, c, d)
            if i not in used and d - c <= 16 * HOUR and s > most and (s >= min(HOUR, 0.2 * (b - a)) or abs(a - c) <= 90 * MIN or abs(b - d) <= 90 * MIN):
                best, most = i, s
        used |= {best} - {None}
        bed = (min(a, gaps[best][0]), max(b, gaps[best][1])) if best is not None else (a, b)
        k, act = pressed(a, b), sum(over(a, b, c, d) for c, d in active)
        conf = 0.9 if score is not None else 0.75
        conf -= 0.05 * (n > 1) + 0.25 * (b - a >= 14 * HOUR) + 0.05 * (not known(a, b))
        if known(a, b) and not (k == 0 and act * 2 >= b - a) and k >= 20:
            conf -= 0.25 if k / ((b - a) / MIN) < 0.2 else 0.45
        conf -= 0.1 * (act * 2 >= b - a and not (known(a, b) and k == 0))
        out.append(("watch+aw" if best is not None else "watch_only", *bed, k, round(min(max(conf, 0.05), 0.99), 2)))
    for i, (c, d) in enumerate(gaps):
        if i in used or d - c > 16 * HOUR or any(over(c, d, a, b) >= 30 * MIN for a, b, *_ in spans) or pressed(c, d) >= 20:
            continue
        out.append(("aw_only", c, d, pressed(c, d), round(0.55 - 0.05 * (not known(c, d)), 2)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_nights_against_a_plain_walk(spark, seed):
    rng = np.random.default_rng(seed)
    at = lambda n, top=400: sorted(int(x) for x in rng.integers(0, top * 60, n) * MIN)
    layers = {
        "watch": [(s, s + int(rng.integers(-5, 900)) * MIN, [None, 60.0][int(rng.integers(2))], None) for s in at(22)],
        "active": [(s, s + int(rng.integers(1, 200)) * MIN) for s in at(45)],
        "keys": [k for s in at(12) for k in range(s, s + int(rng.integers(1, 40)) * MIN, MIN)],
        "covered": [(s, s + 20 * HOUR) for s in at(9)],
        "media": [(s, s + 2 * HOUR) for s in at(8)],
    }
    got = nights.infer_nights(*frames(spark, **layers)).collect()
    want = plain_nights(**layers)
    assert sorted((r["source"], r["bed_start"], r["bed_end"], r["keys"], r["confidence"]) for r in got) == want and len({w[0] for w in want}) == 3
    days = [r["day"] for r in got]
    assert sum(r["winner"] for r in got) == len(set(days))


def walked(spark, edges, ids, starts, **options):
    e = spark.createDataFrame(edges, "source_id string, target_id string, relation string")
    n = spark.createDataFrame([(i, i[0]) for i in ids], "id string, kind string")
    steps, summary = graph.walk_evidence(e, n, spark.createDataFrame([(s,) for s in starts], "id string"), **options)
    return {(r["start"], r["node"]): (r["depth"], r["parent"], r["relation"], r["direction"]) for r in steps.collect()}, {r["start"]: (r["visited"], r["truncated"], r["reason"]) for r in summary.collect()}


def test_walks_by_hand(spark):
    """Two hops, an orphan, a cycle, directions, relations, a predicate on the output only, unknown starts and nodes."""
    edges = [("i1", "p1", "references"), ("p1", "c1", "references"), ("c1", "i1", "references"), ("c1", "x", "references"), ("q1", "p1", "mentions")]
    ids = ["i1", "p1", "c1", "q1", "lone"]
    steps, summary = walked(spark, edges, ids, ["i1", "lone", "nobody"], max_depth=5)
    assert steps == {("i1", "i1"): (0, None, None, None), ("i1", "p1"): (1, "i1", "references", "out"), ("i1", "c1"): (2, "p1", "references", "out"), ("lone", "lone"): (0, None, None, None)}
    assert summary == {"i1": (3, False, None), "lone": (1, False, None), "nobody": (0, False, "start is not in the graph")}
    steps, summary = walked(spark, edges, ids, ["i1"], max_depth=1)
    assert set(steps) == {("i1", "i1"), ("i1", "p1")} and summary["i1"] == (2, True, "max_depth cap (1) reached")
    steps, _ = walked(spark, edges, ids, ["p1"], direction="in", max_depth=9)
    assert {k[1]: v[0] for k, v in steps.items()} == {"p1": 0, "i1": 1, "q1": 1, "c1": 2}
    steps, _ = walked(spark, edges, ids, ["p1"], direction="both", max_depth=1)
    assert {k[1]: v[3] for k, v in steps.items()} == {"p1": None, "i1": "in", "q1": "in", "c1": "out"}
    steps, _ = walked(spark, edges, ids, ["p1"], direction="both", relations=["mentions"])
    assert {k[1] for k in steps} == {"p1", "q1"}
    assert {k[1] for k in walked(spark, edges, ids, ["p1"], relations=[])[0]} == {"p1"}
    steps, _ = walked(spark, edges, ids, ["i1"], keep=F.col("kind") == "c")
    assert set(steps) == {("i1", "c1")}
    with pytest.raises(ValueError):
        walked(spark, edges, ids, ["i1"], direction="up")


def test_walks_are_capped(spark):
    """A hub of 1,500 and one of 30: the least ids of a level are kept, and what is kept is gone on from."""
    edges = [("hub", f"n{i:04d}", "r") for i in range(1500)] + [("n0003", "deep", "r"), ("n1400", "far", "r"), ("small", "n0001", "r")]
    ids = ["hub", "deep", "far", "small", *[f"n{i:04d}" for i in range(1500)]]
    steps, summary = walked(spark, edges, ids, ["hub", "small"], max_nodes=5000)
    assert summary["hub"] == (1000, True, "max_nodes cap (1000) reached") and summary["small"][0] == 2
    assert {k[1] for k in steps if k[0] == "hub"} == {"hub", *[f"n{i:04d}" for i in range(999)]}
    steps, summary = walked(spark, edges, ids, ["hub", "small"], max_nodes=4)
    assert {k[1] for k in steps if k[0] == "hub"} == {"hub", "n0000", "n0001", "n0002"} and summary["hub"][1] and not summary["small"][1]


def test_folds_never_see_their_future(spark):
    rng = np.random.default_rng(8)
    rows = [("p", f"2024-{m:02d}-{d:02d}", float(rng.normal()), float(m * 10 + d)) for m in range(1, 6) for d in range(1, 29)]
    frame = spark.createDataFrame(rows, "k string, day string, x double, target double").withColumn("day", F.to_date("day"))
    split = folds.time_folds(frame, "day", 4)
    edges = {r["fold"]: (r["a"], r["b"]) for r in split.groupBy("fold").agg(F.min("day").alias("a"), F.max("day").alias("b")).collect()}
    assert sorted(edges) == [0, 1, 2, 3, 4] and all(edges[f][1] < edges[f + 1][0] for f in range(4))
    scores = {(r["fold"], r["model"]): r for r in folds.fold_scores(split, ["x"]).collect()}
    assert {k[0] for k in scores} == {2, 3, 4} or {k[0] for k in scores} == {1, 2, 3, 4}
    for (fold, model), r in scores.items():
        assert r["n_train"] == split.where(F.col("fold") < fold).count() and r["n_test"] == split.where(F.col("fold") == fold).count()
        assert r["r2_test"] < 0 and r["mae_test"] > 0  # the target only grows: nothing of the past reaches it
    # the future changes nothing of a fold's fit
    other = split.withColumn("target", F.when(F.col("fold") > 2, F.lit(1e6)).otherwise(F.col("target")))
    again = {(r["fold"], r["model"]): r for r in folds.fold_scores(other, ["x"]).collect()}
    assert again[2, "linear"] == scores[2, "linear"] and again[2, "forest"] == scores[2, "forest"]
    r = {(r["fold"], r["feature"]): r for r in folds.past_correlations(split, ["x"], [1, 4]).collect()}
    pdf = split.toPandas()
    for f in (1, 4):
        own = pdf[pdf["fold"] < f]
        assert r[f, "x"]["n"] == len(own) and r[f, "x"]["r"] == pytest.approx(own["x"].corr(own["target"]))
    linear = {r["fold"]: r for r in folds.fold_scores(split, ["x"]).where("model = 'linear'").collect()}
    own, ahead = pdf[pdf["fold"] < 3], pdf[pdf["fold"] == 3]
    slope, base = np.polyfit(own["x"], own["target"], 1)
    assert linear[3]["mae_test"] == pytest.approx((ahead["target"] - slope * ahead["x"] - base).abs().mean(), rel=1e-6)
    assert linear[3]["r2_train"] == pytest.approx(own["x"].corr(own["target"]) ** 2, rel=1e-6)
    assert folds.fold_scores(split.where("fold < 1"), ["x"]).count() == 0


def test_lagged_features_need_the_day_before(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("a", "2024-01-04", 3), ("b", "2024-01-03", 9)]
    frame = spark.createDataFrame(rows, "k string, day string, n int").withColumn("day", F.to_date("day"))
    got = folds.lagged_features(frame, ["k"], "day", ["n"], "n").collect()
    assert [(r["k"], str(r["day"]), r["target"], r["n_before"]) for r in got] == [("a", "2024-01-02", 2, 1)]


def test_queries_without_sql_agree_with_plain_versions(spark, sf):
    """rename_candidates against all pairs of names; weak_tag_clusters counts every node once."""
    rows = [r.asDict() for r in inference.rename_candidates(spark, sf).collect()]
    s = inference.symbols(spark, sf).toPandas()
    gone = s[s["change"] == "DELETED"].groupby(["project", "name"])["day"].min().to_dict()
    come = s[s["change"] == "ADDED"].groupby(["project", "name"])["day"].apply(sorted).to_dict()
    project = sorted({p for p, _ in gone})[0]
    want = set()
    for (p, old), first in gone.items():
        for (q, new), days in come.items():
            if p == q == project and old != new and days[-1] >= first and SequenceMatcher(None, old, new).quick_ratio() >= 0.9 and SequenceMatcher(None, old, new).ratio() >= 0.9:
                want.add((old, new, next(d for d in days if d >= first)))
    assert {(r["old_name"], r["new_name"], r["day"]) for r in rows if r["source"] == "similar_name" and r["project"] == project} == want and want
    nodes, _, _ = inference.tagged_graph(spark, sf)
    clusters = inference.weak_tag_clusters(spark, sf)
    assert clusters.agg(F.sum("n")).first()[0] == nodes.count()

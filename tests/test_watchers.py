"""Gaps, outages, repaired presence and stores against plain walks; titles by hand; hidden states against all paths and planted ones."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import night_gaps, presence, regimes, titles
from daybook.plans import watchers
from daybook.sources.stores import one_store

DAY = 86_400_000_000


def walk_gaps(intervals, lo, hi, least):
    out, reach = [], lo
    for s, e in sorted(intervals):
        if s - reach >= least:
            out.append((reach, s))
        reach = max(reach, e)
    return out + ([(reach, hi)] if hi - reach >= least else [])


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_long_gaps_and_outages_equal_a_walk(spark):
    rng = random.Random(5)
    held = {k: [(s, s + rng.choice([0, 3, 40])) for s in (rng.randrange(0, 900) for _ in range(rng.choice([0, 1, 9, 30])))] for k in range(12)}
    other = [(k, t, rng.choice(["windows", "web"])) for k in range(12) for t in (rng.randrange(0, 950) for _ in range(6))]
    df = frame(spark, [(k, s, e) for k, v in held.items() for s, e in v], "k long, start long, end long")
    bounds = frame(spark, [(k, 0, 1000) for k in held], "k long, lo long, hi long")
    got = presence.long_gaps(df, bounds, "k", "start", "end", 37).collect()
    want = {k: walk_gaps(v, 0, 1000, 37) for k, v in held.items()}
    assert sorted((r["k"], r["gap_start"], r["gap_end"]) for r in got) == sorted((k, *g) for k, v in want.items() for g in v)
    kinds = {w: frame(spark, [(k, t) for k, t, kind in other if kind == w], "k long, start long") for w in ("windows", "web")}
    found = presence.outages(df, kinds["windows"], kinds["web"], bounds, "k", 37, 100).collect()
    assert len(found) == len(got) and {r["pattern"] for r in found} == {"A", "B", "C"}
    for r in found:
        n = [sum(1 for k, t, kind in other if k == r["k"] and kind == w and r["gap_start"] <= t < r["gap_end"]) for w in ("windows", "web")]
        assert [r["windows"], r["web"]] == n and r["pattern"] == ("C" if n[0] else "B" if n[1] else "A")


def test_gaps_sort_a_row_for_each_stretch(spark):
    """Ten thousand points of one key within ten stretches leave ten rows and two edges to sort."""
    df = spark.range(10_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("at"))
    plan = presence.long_gaps(df, frame(spark, [(1, 0, 12_000)], "k long, lo long, hi long"), "k", "at", "at", 1000)
    assert [tuple(r) for r in plan.collect()] == [(1, 9_999, 12_000)]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("Window") < text.index("HashAggregate")  # a plan reads from the top: counted first, sorted after


def plain_repair(e, sleep, windows, presses, commands, silent, stuck, long):
    """One event by hand: (start, end, status, source)."""
    s, t = e
    forced = [(max(a, s), min(b, t), 0) for a, b in sleep if a < t and s < b]
    held = list(forced)
    if t - s >= long:
        for a, b, app in windows:
            if a < t and s < b and b > a:
                c = (max(a, s), min(b, t))
                if not (app or "").strip():
                    forced.append((*c, 1))
                if b - a >= stuck and not any(c[0] <= x < c[1] for x in commands):
                    forced.append((*c, 2))
    if presses and t // DAY >= min(presses) // DAY and s // DAY <= max(presses) // DAY:
        marks = [s, *sorted(x for x in presses if s <= x <= t), t]
        for a, b in zip(marks, marks[1:]):
            if b - a >= silent and not any(x <= a and y >= b for x, y, _ in held) and not any(a <= x < b for x in commands):
                forced.append((a, b, 3))
    merged = []
    for a, b, r in sorted(forced):
        if merged and a <= merged[-1][1]:
            merged[-1] = [merged[-1][0], max(merged[-1][1], b), min(merged[-1][2], r)]
        else:
            merged.append([a, b, r])
    out, at = [], s
    for a, b, r in merged:
        out += [(at, a, "not-afk", "")] * (a > at) + [(a, b, "afk", presence.SOURCES[r])]
        at = b
    return out + [(at, t, "not-afk", "")] * (at < t)


def test_repair_equals_a_walk(spark):
    rng = random.Random(9)
    unit = 3_600_000_000
    some = lambda n, most: [(a, a + rng.randrange(1, most) * unit // 4) for a in (rng.randrange(0, 200) * unit // 4 for _ in range(n))]
    users = {k: (some(8, 40), some(4, 20), [(*w, rng.choice(["", "app", None])) for w in some(10, 30)], [a for a, _ in some(k * 3, 2)], [a for a, _ in some(5, 2)]) for k in range(8)}
    ids = itertools.count()
    events, want = [], []
    for k, (held, sleep, windows, presses, commands) in users.items():
        for e in held:
            i = next(ids)
            events.append((k, i, *e, "not-afk"))
            want += [(k, i, a, b, st, "not-afk", src) for a, b, st, src in plain_repair(e, sleep, windows, presses, commands, unit // 2, 2 * unit, unit)]
    events += [(0, 900, 5, 9, " AFK "), (0, 901, 5, 9, None), (0, 902, 5, 5, "not-afk")]
    want += [(0, 900, 5, 9, "afk", "afk", ""), (0, 901, 5, 9, "unknown", "unknown", ""), (0, 902, 5, 5, "not-afk", "not-afk", "")]
    parts = [frame(spark, [(k, *r) for k, u in users.items() for r in u[i]], s) for i, s in ((1, "k long, start long, end long"), (2, "k long, start long, end long, app string"))]
    points = [frame(spark, [(k, a) for k, u in users.items() for a in u[i]], "k long, at long") for i in (3, 4)]
    got = presence.repair(frame(spark, events, "k long, event_id long, start long, end long, status string"), *parts, *points, "k", "not-afk", unit // 2, 2 * unit, unit, DAY)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    assert {r[6] for r in rows} == {"", *presence.SOURCES}


def test_repair_of_nothing(spark):
    empty = frame(spark, [], "k long, start long, end long, app string")
    points = frame(spark, [], "k long, at long")
    e = frame(spark, [(1, 1, 0, 9 * DAY, "not-afk")], "k long, event_id long, start long, end long, status string")
    got = presence.repair(e, empty.drop("app"), empty, points, points, "k", "not-afk", 1, 1, 1, DAY).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 9 * DAY, "not-afk", "not-afk", "")]
    assert presence.repair(e.where("k = 2"), empty.drop("app"), empty, points, points, "k", "not-afk", 1, 1, 1, DAY).count() == 0


def test_stores_as_one(spark):
    b1 = frame(spark, [(1, "watch-afk_h"), (2, "other")], "id long, name string")
    b2 = frame(spark, [(7, "watch-afk_h"), (1, "watch-win_h")], "id long, name string")
    schema = "bucket long, start long, end long, data string"
    e1 = frame(spark, [(1, 0, 5, "a"), (1, 5, 9, "b"), (2, 5, 9, "c"), (1, 20, 30, "d")], schema)
    e2 = frame(spark, [(7, 5, 9, "b"), (7, 5, 9, "B"), (1, 8, 12, None), (1, 8, 12, None)], schema)
    stores = [(b1, e1), (b2, e2)]
    read = lambda *a, **o: [tuple(r) for r in one_store(stores, *a, **o).collect()]
    assert read(["watch-"], 5, 20, order="start") == [("watch-afk_h", 5, 9, "B"), ("watch-afk_h", 5, 9, "b"), ("watch-win_h", 8, 12, None)]
    assert len(read(["watch-"], 5, 20, order="start", distinct=False)) == 5
    assert len(read(["watch-"], 5, 20, order="bucket", distinct=False)) == 3
    assert read(["watch-win"]) == [("watch-win_h", 8, 12, None)] and read([]) == []
    assert len(read(["watch-afk"])) == 4
    with pytest.raises(ValueError):
        one_store(stores, ["w"], order="end")


# app, title, kind, tool, project, domain, category, agent, active
SEEN = [
    ("kitty", "⠐ Ready (alpha)", "terminal", "claude-code", "alpha", None, None, True, True),
    ("kitty", "◇ Ready (Fork)", "terminal", "claude-code", None, None, None, True, True),
    ("kitty", "Claude Code", "terminal", "claude-code", None, None, None, True, False),
    ("kitty", "codex resume x", "terminal", "codex", None, None, None, True, False),
    ("kitty", "codex do", "terminal", "codex", None, None, None, True, True),
    ("foot", "nvim /projects/alpha-two/x", "terminal", "nvim", "alpha", None, None, False, False),
    ("foot", "cd /projects/new__", "terminal", None, "new", None, None, False, False),
    ("kitty", "me@host:/home", "terminal", None, None, None, None, False, False),
    ("kitty", "btop 1", "terminal", "btop", None, None, None, False, False),
    ("kitty", "just x", "terminal", "just", None, None, None, False, False),
    ("kitty", "a WeeChat b", "terminal", "weechat", None, None, None, False, False),
    ("google-chrome", "Hi - https://www.docs.rs/x", "browser", None, None, "docs.rs", "docs", False, False),
    ("zen", "Hi https://en.wikipedia.org", "browser", None, None, "en.wikipedia.org", "reading", False, False),
    ("firefox", "Pull requests · Beta · GitHub - https://github.com/a/b", "browser", None, "beta", "github.com", "code", False, False),
    ("firefox", "Chat - https://chatgpt.com/c", "browser", None, None, "chatgpt.com", "ai", True, False),
    ("firefox", "New tab", "browser", None, None, None, None, False, False),
    ("mpv", "film", "media_player", "mpv", None, None, None, False, False),
    ("org-discord", "x", "chat", "discord", None, None, None, False, False),
    ("antigravity", "Beta plan", "system", "antigravity", "beta", None, None, False, False),
    ("steam", "Beta plan", "system", "steam", None, None, None, False, False),
    ("code", "/projects/gamma; x", "editor", "code", "gamma", None, None, False, False),
    ("obsidian", "", "editor", None, None, None, None, False, False),
    ("code", None, "other", None, None, None, None, False, False),
    (None, None, "other", None, None, None, None, False, False),
    ("x", "y" * 100_000, "other", None, None, None, None, False, False),
]


def test_titles_by_hand(spark):
    df = frame(spark, [(i, *r[:2]) for i, r in enumerate(SEEN)], "i int, app string, title string")
    got = df.select("i", titles.title_features(F.col("app"), F.col("title"), ["alpha", "beta"]).alias("f")).select("i", "f.*").orderBy("i").collect()
    for row, want in zip(got, SEEN):
        assert tuple(row)[1:] == want[2:], want[:2]


# app, title, rule, subject, tool, confidence
RULED = [
    ("x", "<local-command-caveat> y", "sentinel", None, "claude-code", 0.7),
    ("x", " Codex ", "lifecycle", None, "codex", 0.7),
    ("Kitty", "Alpha", "project", "alpha", None, 0.7),
    ("kitty", "al", "project", "alpha", None, 0.7),
    ("kitty", "al-x", "project", "alpha", None, 0.7),
    ("kitty", "alpha-x-y", "project", "alpha", None, 0.7),
    ("foot", "see the inner thing", "project", "alpha", None, 0.7),
    ("foot", "phased-issue-closure", "slug", None, None, 0.6),
    ("foot", "Create schema inventory document", "sentence", None, "claude-code", 0.5),
    ("x", "Create schema inventory document", None, None, None, None),
    ("foot", "two-words", None, None, None, None),
    ("foot", "   ", None, None, None, None),
    ("foot", None, None, None, None, None),
    ("", "alpha", None, None, None, None),
]


def test_title_rules_by_hand(spark):
    df = frame(spark, [(i, *r[:2]) for i, r in enumerate(RULED)], "i int, app string, title string")
    rule = titles.title_rule(F.col("app"), F.col("title"), ["alpha"], {"al": "alpha"}, {}, {"inner thing": "alpha"})
    got = df.select("i", rule.alias("r")).select("i", "r.rule", "r.subject", "r.tool", "r.confidence").orderBy("i").collect()
    for row, want in zip(got, RULED):
        assert tuple(row)[1:] == want[2:], want[:2]


def test_title_rules_are_computed_once(spark, sf):
    """Once a line: not again by the filter and by each column; whitespace of all six kinds is stripped."""
    plan = watchers.title_rules(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(titles.CAVEAT) == 1
    got = frame(spark, [("\t\x0b \x0c\rCodex\n ",)], "t string").select(titles.title_rule(F.lit("kitty"), F.col("t"), [], {}, {}, {}).alias("r")).first()["r"]
    assert (got["rule"], got["tool"]) == ("lifecycle", "codex")


def test_likelihood_and_path_equal_all_paths():
    rng = np.random.default_rng(1)
    x, k = rng.normal(size=(5, 2)), 3
    start, moves = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
    means, spreads = rng.normal(size=(k, 2)), rng.uniform(0.5, 2, (k, 2))
    logs = regimes.log_densities(x, means, spreads)
    paths = list(itertools.product(range(k), repeat=5))
    each = np.array([np.log(start[p[0]]) + sum(np.log(moves[a, b]) for a, b in zip(p, p[1:])) + sum(logs[t, s] for t, s in enumerate(p)) for p in paths])
    like, share, moved = regimes.forward_backward(x, start, moves, means, spreads)
    chance = np.exp(each - each.max()) / np.exp(each - each.max()).sum()
    assert abs(like - np.log(np.exp(each - each.max()).sum()) - each.max()) < 1e-9
    for t in range(5):
        assert np.allclose(share[t], [sum(c for p, c in zip(paths, chance) if p[t] == s) for s in range(k)])
    want = np.array([[sum(c * sum(p[t] == a and p[t + 1] == b for t in range(4)) for p, c in zip(paths, chance)) for b in range(k)] for a in range(k)])
    assert np.allclose(moved, want)
    assert tuple(regimes.best_path(x, start, moves, means, spreads)) == paths[int(each.argmax())]


def test_planted_regimes_are_found(spark):
    rng = np.random.default_rng(0)
    rows, true = [], {}
    for k in range(6):
        state = k % 2
        for t in range(60):
            state = 1 - state if rng.random() < 0.1 else state
            true[k, t] = state
            rows.append((k, t, float(rng.normal(3 * state, 1)), float(rng.normal(-2 * state, 0.5))))
    df = frame(spark, rows + [(9, 0, None, 1.0)], "k long, t long, a double, b double")
    got, history = regimes.hidden_states(df, "k", "t", ["a", "b"], 2)
    found = {(r["k"], r["t"]): r["state"] for r in got.collect()}
    assert found.keys() == true.keys() and np.mean([found[i] == s for i, s in true.items()]) > 0.97
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    few, none = regimes.hidden_states(df.limit(3), "k", "t", ["a", "b"], 2)
    assert few.count() == 0 and few.columns == ["k", "t", "state"] and none == []
    same, _ = regimes.hidden_states(df.where("k = 1").withColumn("a", F.lit(1.0)).withColumn("b", F.lit(2.0)), "k", "t", ["a", "b"], 2)
    assert same.count() == 60


MINUTE = 60_000_000


def test_night_gaps_by_hand(spark):
    """One night of six segments and a nap; each gap meets one verdict."""
    at = lambda m: m * MINUTE
    segments = frame(spark, [(1, at(a), at(b)) for a, b in ((100, 160), (180, 240), (260, 300), (320, 380), (400, 440), (460, 500), (800, 830))], "k long, start long, end long")
    steady = [(1, at(m) + 7, 50.0) for m in range(100, 500) if not 160 <= m < 180]
    heart = frame(spark, [(k, t, 70.0 if at(320 - 20) <= t < at(320) else v) for k, t, v in steady], "k long, at long, value double")
    movement = frame(spark, [(1, at(385), 3.0), (1, at(392), 1.5)], "k long, at long, value double")
    presses = frame(spark, [(1, at(245) + 1), (1, at(245) + 2)], "k long, at long")
    stages = frame(spark, [(1, at(440), at(449)), (1, at(445), at(452)), (1, at(10), at(20))], "k long, start long, end long")
    got = night_gaps.gap_evidence(segments, heart, movement, presses, stages, "k", at(90)).orderBy("gap_start").collect()
    assert [(r["gap_start"] // MINUTE, r["gap_end"] // MINUTE, r["intra"], r["verdict"]) for r in got] == [
        (160, 180, True, "sensor_absent"), (240, 260, True, "confirmed_wake_pc"), (300, 320, True, "genuine_wake"), (380, 400, True, "genuine_wake"),
        (440, 460, True, "stage_continuous"), (500, 800, False, "sensor_absent"),
    ]
    assert got[1]["press_minutes"] == 1 and got[4]["stage_minutes"] == 12 and got[2]["hr_ratio"] == 1.4 and got[3]["movement_mean"] == 2.25
    none = frame(spark, [], "k long, at long, value double")
    calm = night_gaps.gap_evidence(segments, heart, none, none.drop("value"), stages.where("k = 2"), "k", at(90)).where("gap_start = 440 * 60000000L").first()
    assert calm["verdict"] == "missed_sleep" and calm["hr_ratio"] == 1.0
    empty = night_gaps.gap_evidence(segments, none, none, none.drop("value"), stages.where("k = 2"), "k", at(90)).collect()
    assert len(empty) == 6 and {r["verdict"] for r in empty} == {"sensor_absent"}
    nights = night_gaps.validated_nights(segments, night_gaps.gap_evidence(segments, heart, movement, presses, stages, "k", at(90)), "k", at(90))
    assert sorted((r["start"] // MINUTE, r["end"] // MINUTE) for r in nights.collect()) == [(100, 240), (260, 300), (320, 380), (400, 500), (800, 830)]
    assert night_gaps.gap_evidence(segments.where("k = 2"), heart, movement, presses, stages, "k", at(90)).count() == 0

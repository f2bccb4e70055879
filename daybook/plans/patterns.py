"""Patterns within sessions, chains of neighbouring work, what dominates sessions and windows, and effects of arms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.operators.joins import interval_join
from daybook.operators.series import bootstrap_delta
from daybook.operators.sessions import app_sessions, deep_blocks, number_sessions
from daybook.plans.registry import registry
from daybook.sources.tables import events, spans, sql

REGISTRY, query = registry()
MINUTE = 60_000_000
HOUR = 60 * MINUTE

#: Commands: events in order of time, in sessions a user; one of 40 or more failed.
COMMANDS = """c0 AS (SELECT user_id, event_id, event_type AS command, "at", value, value >= 40 AS failed, lag("at") OVER (PARTITION BY user_id ORDER BY "at", event_id) AS p FROM ev),
c1 AS (SELECT *, sum(CASE WHEN p IS NULL OR "at" - p > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "at", event_id) AS session FROM c0),
c2 AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, session ORDER BY "at", event_id) AS run FROM c1),
er AS (SELECT user_id, session, run, count(*) AS n, min("at") AS start, max("at") AS stop, arg_min(command, ("at", event_id)) AS command FROM c2 WHERE failed GROUP BY ALL HAVING count(*) >= 2),
loops AS (SELECT er.*, EXISTS (SELECT 1 FROM c1 x WHERE x.user_id = er.user_id AND x.session = er.session AND x."at" > er.stop AND NOT x.failed AND x.command = er.command) AS fixed FROM er),
spirals AS (SELECT user_id, session, command, count(*) AS n, min("at") AS start, max("at") AS stop FROM c1 WHERE failed GROUP BY ALL HAVING count(*) >= 3)"""


@query(sql("WITH " + COMMANDS + """ SELECT 'build_fix_loop' AS kind, user_id, start, command, n, (stop - start) // 1000000 AS seconds, CASE WHEN fixed THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM loops
UNION ALL SELECT 'retry_spiral', user_id, start, command, n, (stop - start) // 1000000, round(0.6 + least(0.2, (n - 3) * 0.05), 2)::DOUBLE FROM spirals
UNION ALL SELECT 'long_running', user_id, "at", command, 1, CAST(floor(value) AS BIGINT), 0.8::DOUBLE FROM c1 WHERE value > 60""", "ev"))
def terminal_patterns(spark, sf_dir):
    """Within sessions, runs of failures (fixed later or not), many failures of one command, long commands."""
    e = events(spark, sf_dir).withColumn("failed", F.col("value") >= 40).withColumnRenamed("event_type", "command")
    c = number_sessions(e, ["user_id"], "at", ["event_id"], 24 * HOUR)
    w = Window.partitionBy("user_id", "session").orderBy("at", "event_id")
    # when each command last went well in its session
    c = c.withColumn("run", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    well = c.where(~F.col("failed")).groupBy("user_id", "session", "command").agg(F.max("at").alias("well"))
    runs = c.where("failed").groupBy("user_id", "session", "run").agg(F.count("*").alias("n"), F.min("at").alias("start"), F.max("at").alias("stop"), F.min(F.struct("at", "event_id", "command")).alias("first")).where("n >= 2")
    loops = runs.withColumn("command", F.col("first.command")).join(well, ["user_id", "session", "command"], "left").withColumn("confidence", F.when(F.col("well") > F.col("stop"), 0.7).otherwise(0.5))
    spirals = c.where("failed").groupBy("user_id", "session", "command").agg(F.count("*").alias("n"), F.min("at").alias("start"), F.max("at").alias("stop")).where("n >= 3")
    spirals = spirals.withColumn("confidence", F.round(0.6 + F.least(F.lit(0.2), (F.col("n") - 3) * 0.05), 2))
    seconds = F.expr("(stop - start) div 1000000").alias("seconds")
    shaped = lambda df, kind: df.select(F.lit(kind).alias("kind"), "user_id", "start", "command", "n", seconds, "confidence")
    long = c.where("value > 60").select(F.lit("long_running").alias("kind"), "user_id", F.col("at").alias("start"), "command", F.lit(1).cast("long").alias("n"), F.floor("value").alias("seconds"), F.lit(0.8).alias("confidence"))
    return shaped(loops, "build_fix_loop").unionByName(shaped(spirals, "retry_spiral")).unionByName(long)


#: Templates over neighbours in the time of a project's day: kinds, most minutes between two, whether neighbours must share a file.
CHAINS = [
    ("assisted_change", ("click", "purchase"), 240, True),
    ("deep_delivery", ("view", "purchase"), 120, False),
    ("research_build_commit", ("view", "click", "purchase"), 480, False),
    ("error_burst", ("error", "error", "purchase"), 300, False),
    ("debug_fix", ("error", "click", "purchase"), 300, True),
]
_NEXT = ", ".join(f'lead({c}, {i}) OVER w AS {n}{i}' for i in (1, 2) for c, n in (("event_type", "k"), ('"at"', "a"), ("event_id", "id"), ("file", "f")))


def _chain_sql(name: str, kinds: tuple, most: int, shared: bool) -> str:
    n, us = len(kinds), most * MINUTE
    test = [f"event_type = '{kinds[0]}'", *[f"k{i} = '{k}'" for i, k in enumerate(kinds) if i], f'a1 - "at" <= {us}', *([f"a2 - a1 <= {us}"] if n == 3 else []), *(["file = f1"] if shared else []), *(["f1 = f2"] if shared and n == 3 else [])]
    gap = f'(a{n - 1} - "at") / {n - 1} / {MINUTE}.0'
    return f"SELECT '{name}' AS chain, project, day, event_id AS first_id, id{n - 1} AS last_id, round({gap}, 1) AS avg_gap, round(greatest(0.3, 0.85 - {gap} / {most} * 0.4), 2) AS confidence FROM t WHERE {' AND '.join(test)}"


@query(sql(f"WITH e AS (SELECT *, user_id % 10 AS project, 'f' || (event_id % 3) AS file FROM ev), t AS (SELECT *, {_NEXT} FROM e WINDOW w AS (PARTITION BY project, day ORDER BY \"at\", event_id)) " + " UNION ALL ".join(_chain_sql(*c) for c in CHAINS), "ev"))
def chain_windows(spark, sf_dir):
    """Templates of neighbouring work on one project's day, gaps bounded, neighbours that must share a file where the template asks it; confidence falls with the gaps."""
    w = Window.partitionBy("project", "day").orderBy("at", "event_id")
    t = events(spark, sf_dir).withColumn("project", F.col("user_id") % 10).withColumn("file", F.expr("'f' || (event_id % 3)"))
    for i in (1, 2):
        for c, n in (("event_type", "k"), ("at", "a"), ("event_id", "id"), ("file", "f")):
            t = t.withColumn(f"{n}{i}", F.lead(c, i).over(w))
    out = None
    for name, kinds, most, shared in CHAINS:
        n = len(kinds)
        test = (F.col("event_type") == kinds[0]) & (F.col("a1") - F.col("at") <= most * MINUTE)
        for i, k in enumerate(kinds[1:], 1):
            test &= F.col(f"k{i}") == k
        if n == 3:
            test &= F.col("a2") - F.col("a1") <= most * MINUTE
        if shared:
            test &= F.col("file") == F.col("f1")
            test &= (F.col("f1") == F.col("f2")) if n == 3 else F.lit(True)
        gap = (F.col(f"a{n - 1}") - F.col("at")) / (n - 1) / MINUTE
        found = t.where(test).select(F.lit(name).alias("chain"), "project", "day", F.col("event_id").alias("first_id"), F.col(f"id{n - 1}").alias("last_id"), F.round(gap, 1).alias("avg_gap"), F.round(F.greatest(F.lit(0.3), 0.85 - gap / most * 0.4), 2).alias("confidence"))
        out = found if out is None else out.unionByName(found)
    return out


@query(sql("""WITH w AS (SELECT event_id AS win, user_id, start, "end" FROM spans WHERE event_type = 'view' AND "end" > start), x AS (SELECT w.win, e.event_id AS episode, e.event_type AS kind, least(w."end", e."end") - greatest(w.start, e.start) AS shared FROM w JOIN spans e ON e.user_id = w.user_id AND e.event_type IN ('error', 'signup') AND e.start < w."end" AND w.start < e."end"),
g AS (SELECT win, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'signup') AS signups, arg_min(episode, (-shared, episode)) AS dominant, max(shared) AS shared FROM x GROUP BY 1)
SELECT w.win, CASE WHEN errors >= 1 THEN 'pressed' WHEN signups >= 1 THEN 'busy' ELSE 'calm' END || '/' || CASE WHEN w."end" - w.start >= 3600000000 THEN 'long' ELSE 'short' END AS state, dominant, round(coalesce(g.shared * 1.0 / (w."end" - w.start), 0), 6) AS covered, CASE WHEN dominant IS NULL THEN 0.5 WHEN g.shared * 2 >= w."end" - w.start THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM w LEFT JOIN g USING (win)""", "spans"))
def window_states(spark, sf_dir):
    """One state label a context window, the episode that dominates it, and how sure that makes it."""
    s = spans(spark, sf_dir)
    w = s.where("event_type = 'view' AND end > start").select(F.col("event_id").alias("win"), "user_id", "start", "end")
    e = s.where("event_type IN ('error', 'signup')").select("user_id", F.col("event_id").alias("episode"), F.col("event_type").alias("kind"), F.col("start").alias("s"), F.col("end").alias("t"))
    x = interval_join(w, e, "user_id", HOUR, ("start", "end"), ("s", "t")).withColumn("shared", F.least("end", "t") - F.greatest("start", "s"))
    g = x.groupBy("win").agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "signup").alias("signups"), F.min(F.struct((-F.col("shared")).alias("a"), "episode")).alias("top"))
    j = w.join(g, "win", "left").withColumn("long", F.col("end") - F.col("start")).withColumn("shared", -F.col("top.a"))
    first = F.when(F.col("errors") >= 1, "pressed").when(F.col("signups") >= 1, "busy").otherwise("calm")
    sure = F.when(F.col("top").isNull(), 0.5).when(F.col("shared") * 2 >= F.col("long"), 0.9).otherwise(0.7)
    return j.select("win", F.concat_ws("/", first, F.when(F.col("long") >= HOUR, "long").otherwise("short")).alias("state"), F.col("top.episode").alias("dominant"), F.round(F.coalesce(F.col("shared") / F.col("long"), F.lit(0.0)), 6).alias("covered"), sure.alias("confidence"))


def focus_spans(spark, sf_dir):
    """day_key, app, start, end, mode, project, title of the spans of events: apps are types, a mode and a project that some lack."""
    s = spans(spark, sf_dir).where("end > start")
    mode = F.element_at(F.array(F.lit("coding"), F.lit("reading"), F.lit("chat"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    project = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")))
    day = F.to_date(F.timestamp_micros(F.col("start") - 6 * HOUR))
    return s.select(F.concat_ws("/", F.col("user_id").cast("string"), day.cast("string")).alias("day_key"), F.col("event_type").alias("app"), "start", "end", mode.alias("mode"), project.alias("project"), F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string")).alias("title"))


@query()
def dominant_sessions(spark, sf_dir):
    """Sessions of one app on one logical day, short others absorbed, with the mode, project and title that dominate them; what absorbs what depends on order, so no SQL: held to a plain walk in the tests."""
    return app_sessions(focus_spans(spark, sf_dir), "day_key", 90 * MINUTE, 10 * MINUTE, MINUTE).drop("session")


@query()
def deep_work_blocks(spark, sf_dir):
    """Long stretches that productive sessions fill, with their dominant mode and project and the switches of app within; as dominant_sessions, no SQL."""
    s = app_sessions(focus_spans(spark, sf_dir), "day_key", 90 * MINUTE, 10 * MINUTE, MINUTE)
    b = deep_blocks(s, "day_key", ["coding", "research", "writing", "planning", "chat"], 120 * MINUTE, 60 * MINUTE, 30 * MINUTE, 0.5)
    return b.withColumn("ratio", F.round("ratio", 6))


@query()
def experiment_effects(spark, sf_dir):
    """Of each experiment (a type of event), the arms' sizes and means and the interval of their difference; random draws, no SQL."""
    e = events(spark, sf_dir).withColumn("arm", F.col("event_id") % 2 == 1)
    g = e.groupBy("event_type").agg(F.count_if("arm").alias("n_treated"), F.count_if(~F.col("arm")).alias("n_control"), F.avg(F.when(F.col("arm"), F.col("value"))).alias("mean_treated"), F.avg(F.when(~F.col("arm"), F.col("value"))).alias("mean_control"))
    return g.join(bootstrap_delta(e, "event_type", "arm", "value"), "event_type").withColumn("claim", F.when(F.col("low") * F.col("high") > 0, "effect").otherwise("none seen"))

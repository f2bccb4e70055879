"""Layered timelines, attribution by scope, conversations, signatures and daily evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.operators.joins import interval_join
from daybook.operators.overlay import priority_overlay
from daybook.operators.sessions import number_sessions
from daybook.plans.registry import registry
from daybook.plans.stats import DAILY, daily
from daybook.sources.tables import changes, commits, events, spans, sql, table

REGISTRY, query = registry()
HOUR, DAY = 3_600_000_000, 86_400_000_000
RANKED = ["error", "purchase", "signup", "view"]


@query(sql("""WITH p AS (SELECT user_id, event_type, start AS t, 1 AS d FROM spans WHERE "end" > start UNION ALL SELECT user_id, event_type, "end", -1 FROM spans WHERE "end" > start),
q AS (SELECT user_id, t, sum(CASE WHEN event_type = 'error' THEN d ELSE 0 END) AS a, sum(CASE WHEN event_type = 'purchase' THEN d ELSE 0 END) AS b, sum(CASE WHEN event_type = 'signup' THEN d ELSE 0 END) AS c, sum(CASE WHEN event_type = 'view' THEN d ELSE 0 END) AS e
FROM p WHERE event_type IN ('error', 'purchase', 'signup', 'view') GROUP BY ALL), r AS (SELECT user_id, t, lead(t) OVER w AS until, CASE WHEN sum(a) OVER w > 0 THEN 'error' WHEN sum(b) OVER w > 0 THEN 'purchase' WHEN sum(c) OVER w > 0 THEN 'signup' WHEN sum(e) OVER w > 0 THEN 'view' END AS kind
FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t)), s AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY user_id ORDER BY t) THEN 1 ELSE 0 END AS turn FROM r),
u AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY t) AS run FROM s) SELECT user_id, kind AS event_type, min(t) AS start, max(until) AS "end" FROM u WHERE kind IS NOT NULL GROUP BY user_id, run, kind""", "spans"))
def focus_overlay(spark, sf_dir):
    """Overlapping layers to one disjoint timeline, the highest rank wins."""
    s = spans(spark, sf_dir).select("user_id", "event_type", "start", "end")
    return priority_overlay(s, ["user_id"], "event_type", RANKED)


@query(sql("""WITH b AS (SELECT event_id, "at" FROM ev WHERE event_type = 'error'), s AS (SELECT event_id AS scope_id, user_id AS scope, start, "end" FROM spans WHERE event_type = 'purchase'),
p AS (SELECT b.event_id, count(DISTINCT scope) AS scopes, min(scope) AS scope FROM b JOIN s ON start <= "at" AND "at" < "end" GROUP BY b.event_id)
SELECT scope, count(*) AS builds FROM p WHERE scopes = 1 GROUP BY scope""", "ev", "spans"))
def scope_runs(spark, sf_dir):
    """A build belongs to a scope only where exactly one was active; least and greatest tell that without a set."""
    # builds and scopes of an hour meet by sixteenths of the builds, so that a busy hour is no single task
    b = events(spark, sf_dir).where("event_type = 'error'").select("event_id", "at", (F.col("at") + 1).alias("after"), F.pmod(F.xxhash64("event_id"), F.lit(16)).cast("int").alias("k"))
    s = spans(spark, sf_dir).where("event_type = 'purchase' AND end > start").select(F.col("user_id").alias("scope"), "start", "end", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    p = interval_join(b, s, "k", HOUR, ("at", "after"), ("start", "end")).groupBy("event_id").agg(F.min("scope").alias("scope"), F.max("scope").alias("most"))
    return p.where("scope = most").groupBy("scope").agg(F.count("*").alias("builds"))


@query(sql("""WITH w AS (SELECT event_id AS stall, user_id, "at" - 7200000000 AS lo, "at" + 7200000000 AS hi FROM ev WHERE event_type = 'error')
SELECT stall, count(*) AS n, arg_max(event_type, value * 1e6 + event_id / 1e6) AS culprit, round(max(value), 3) AS peak FROM w JOIN ev ON ev.user_id = w.user_id AND "at" >= lo AND "at" < hi WHERE event_type <> 'error' GROUP BY stall""", "ev"))
def stall_attribution(spark, sf_dir):
    """What peaked around each stall, within two hours on both sides."""
    e, pad = events(spark, sf_dir), 2 * HOUR
    w = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("stall"), (F.col("at") - pad).alias("lo"), (F.col("at") + pad).alias("hi"))
    o = e.where("event_type <> 'error'").select("user_id", "event_id", "event_type", "value", "at", (F.col("at") + 1).alias("after"))
    near = interval_join(w, o, "user_id", 4 * HOUR, ("lo", "hi"), ("at", "after"))
    return near.groupBy("stall").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("value", "event_id")).alias("culprit"), F.round(F.max("value"), 3).alias("peak"))


@query("""SELECT p_partkey, count(*) AS overlaps, CAST(sum(least(p_size, l_linenumber + CAST(l_quantity AS BIGINT)) - greatest(p_size % 5, l_linenumber)) AS BIGINT) AS shared FROM lineitem JOIN part ON l_partkey = p_partkey
AND l_linenumber < p_size AND p_size % 5 < l_linenumber + CAST(l_quantity AS BIGINT) AND p_size > p_size % 5 AND CAST(l_quantity AS BIGINT) > 0 GROUP BY p_partkey""")
def symbol_diffs(spark, sf_dir):
    """Changed line ranges that meet a symbol's range of the same path."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").cast("long").alias("a"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("b"))
    s = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("lo"), F.col("p_size").alias("hi")).where("hi > lo")
    both = c.where("b > a").join(s, "p_partkey").where("a < hi AND lo < b")
    return both.groupBy("p_partkey").agg(F.count("*").alias("overlaps"), F.sum(F.least("hi", "b") - F.greatest("lo", "a")).cast("long").alias("shared"))


@query(sql("""WITH k AS (SELECT event_type, day, user_id, "at", event_id, lag("at") OVER (PARTITION BY event_type, day ORDER BY "at", event_id) AS p FROM ev),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR "at" - p > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, day ORDER BY "at", event_id) AS session FROM k)
SELECT event_type, day, CAST(session AS BIGINT) AS session, min("at") AS start, max("at") AS "end", count(*) AS n, count(DISTINCT user_id) AS speakers FROM g GROUP BY event_type, day, session HAVING count(DISTINCT user_id) >= 2 AND count(*) >= 3""", "ev"))
def channel_conversations(spark, sf_dir):
    """Clusters in a channel with enough speakers and messages; a day cuts them, so a channel is many keys."""
    s = number_sessions(events(spark, sf_dir), ["event_type", "day"], "at", ["event_id"], HOUR // 2)
    c = s.groupBy("event_type", "day", F.col("session").cast("long").alias("session")).agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"), F.countDistinct("user_id").alias("speakers"))
    return c.where("speakers >= 2 AND n >= 3")


@query(sql("""WITH k AS (SELECT *, event_type <> 'error' AS human, max(CASE WHEN event_type <> 'error' THEN "at" END) OVER (PARTITION BY user_id ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ev),
g AS (SELECT *, sum(CASE WHEN human AND (p IS NULL OR "at" - p > 43200000000) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "at", event_id) AS session FROM k)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) FILTER (WHERE human) AS messages, count(*) FILTER (WHERE NOT human) AS meta FROM g WHERE session > 0 GROUP BY user_id, session HAVING count(*) FILTER (WHERE human) >= 2""", "ev"))
def chat_sessions(spark, sf_dir):
    """Sessions by idle time; meta rows stay in their session but don't reset the clock."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    human = F.col("event_type") != "error"
    last = F.max(F.when(human, F.col("at"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = events(spark, sf_dir).withColumn("opens", (human & (last.isNull() | (F.col("at") - last > 12 * HOUR))).cast("int"))
    g = e.withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("session > 0")
    return g.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count_if(human).alias("messages"), F.count_if(~human).alias("meta")).where("messages >= 2")


@query(sql("""WITH l AS (SELECT user_id, day, event_type, ("end" - start) / 6e7 AS mins, lag(event_type) OVER (PARTITION BY user_id, day ORDER BY start, event_id) AS p FROM spans),
g AS (SELECT user_id, day, event_type, sum(mins) AS minutes, count(*) FILTER (WHERE p <> event_type) AS transitions FROM l GROUP BY ALL)
SELECT user_id, day, event_type, minutes, transitions, round(minutes / nullif(sum(minutes) OVER (PARTITION BY user_id, day), 0), 4) AS share FROM g""", "spans"))
def stage_architecture(spark, sf_dir):
    """Minutes, share and transitions of each stage of a night."""
    w = Window.partitionBy("user_id", "day")
    l = spans(spark, sf_dir).withColumn("p", F.lag("event_type").over(w.orderBy("start", "event_id")))
    g = l.groupBy("user_id", "day", "event_type").agg(F.sum((F.col("end") - F.col("start")) / 6e7).alias("minutes"), F.count_if(F.col("p") != F.col("event_type")).alias("transitions"))
    return g.withColumn("share", F.round(F.col("minutes") / F.nullif(F.sum("minutes").over(w), F.lit(0.0)), 4))


@query(sql("""WITH d AS (SELECT project, day, count(*) AS n, sum(lines) AS total FROM commits GROUP BY ALL)
SELECT project, min(day) AS first_day, max(day) AS last_day, CAST(sum(n) AS BIGINT) AS commits, round(sum(total), 2) AS lines, strftime(arg_max(day, n * 100000 - date_diff('day', DATE '1970-01-01', day)), '%Y-%m-%d') AS peak_day FROM d GROUP BY project""", "commits"))
def velocity_narrative(spark, sf_dir):
    """Bounds, totals and the busiest day (the earliest of equals) of each project."""
    d = commits(spark, sf_dir).groupBy("project", "day").agg(F.count("*").alias("n"), F.sum("lines").alias("total"))
    peak = F.max_by("day", F.struct("n", -F.unix_date("day")))
    return d.groupBy("project").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("commits"), F.round(F.sum("total"), 2).alias("lines"), F.date_format(peak, "yyyy-MM-dd").alias("peak_day"))


@query(sql("""SELECT day, count(*) AS visits, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_share FROM ev GROUP BY day""", "ev"))
def terminal_days(spark, sf_dir):
    """Daily runs, users and error share."""
    failed = F.count_if(F.col("event_type") == "error")
    return events(spark, sf_dir).groupBy("day").agg(F.count("*").alias("visits"), F.countDistinct("user_id").alias("users"), failed.alias("failed"), F.round(failed / F.count("*"), 4).alias("error_share"))


@query(sql("""SELECT strftime(day, '%Y-%m') AS month, count(*) AS visits, count(DISTINCT thread) AS uniques FROM commits GROUP BY 1""", "commits"))
def months_summary(spark, sf_dir):
    """Monthly visits and distinct visitors."""
    return commits(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("visits"), F.countDistinct("thread").alias("uniques"))


@query("""WITH c AS (SELECT c_mktsegment AS project, count(*) AS members, round(sum(c_acctbal), 2) AS funds FROM customer GROUP BY 1), o AS (SELECT c_mktsegment AS project, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
l AS (SELECT c_mktsegment AS project, count(*) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT project, members, funds, coalesce(n, 0) AS commits, coalesce(returned, 0) AS returned FROM c LEFT JOIN o USING (project) LEFT JOIN l USING (project)""")
def project_health(spark, sf_dir):
    """Three aggregates of a project, each reduced before they meet."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("project")).agg(F.count("*").alias("members"), F.round(F.sum("c_acctbal"), 2).alias("funds"))
    k = commits(spark, sf_dir)
    o = k.groupBy("project").agg(F.count("*").alias("commits"))
    back = changes(spark, sf_dir).where("change = 'R'").groupBy("sha").agg(F.count("*").alias("m"))
    l = back.join(k.select("sha", "project"), "sha").groupBy("project").agg(F.sum("m").alias("returned"))
    return c.join(o, "project", "left").join(l, "project", "left").fillna(0, ["commits", "returned"])


@query("""WITH t AS (SELECT l_returnflag AS cohort, quantile_cont(l_quantity, 0.9) AS q, quantile_cont(l_discount, 0.9) AS d, quantile_cont(l_tax, 0.9) AS x FROM lineitem GROUP BY 1),
s AS (SELECT cohort, concat_ws('+', CASE WHEN l_quantity > q THEN 'quantity' END, CASE WHEN l_discount > d THEN 'discount' END, CASE WHEN l_tax > x THEN 'tax' END) AS signature FROM lineitem JOIN t ON cohort = l_returnflag)
SELECT cohort, signature, count(*) AS n FROM s WHERE signature <> '' GROUP BY ALL HAVING count(*) >= 5""")
def anomaly_clusters(spark, sf_dir):
    """Rows above their cohort's tail, grouped by which measures are elevated; measures have few values, so percentiles hold few."""
    l, parts = table(spark, sf_dir, "lineitem"), ("quantity", "discount", "tax")
    t = l.groupBy("l_returnflag").agg(*[F.percentile(f"l_{p}", F.lit(0.9)).alias(p) for p in parts])
    signature = F.concat_ws("+", *[F.when(F.col(f"l_{p}") > F.col(p), F.lit(p)) for p in parts]).alias("signature")
    return l.join(t, "l_returnflag").groupBy(F.col("l_returnflag").alias("cohort"), signature).agg(F.count("*").alias("n")).where("signature <> '' AND n >= 5")


@query("""SELECT p_brand, count(*) AS missing FROM part ANTI JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) ON l_partkey = p_partkey GROUP BY p_brand""")
def instrumentation_gaps(spark, sf_dir):
    """Candidates without any sample, by family."""
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(seen, "p_partkey", "left_anti").groupBy("p_brand").agg(F.count("*").alias("missing"))


@query("""SELECT p_brand, count(*) AS changes, count(*) FILTER (WHERE p_type LIKE '%STEEL%') AS guarded, count(*) FILTER (WHERE p_type LIKE '%STEEL%' AND l_returnflag = 'R') AS loosened FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def guardrail_movement(spark, sf_dir):
    """Changes of guarded paths in each project; changes are counted by path before they meet the paths."""
    c = changes(spark, sf_dir).groupBy(F.col("path").alias("p_partkey")).agg(F.count("*").alias("n"), F.count_if(F.col("change") == "R").alias("back"))
    steel = F.col("p_type").contains("STEEL")
    g = c.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey").groupBy("p_brand")
    return g.agg(F.sum("n").alias("changes"), F.sum(F.when(steel, F.col("n")).otherwise(0)).alias("guarded"), F.sum(F.when(steel, F.col("back")).otherwise(0)).alias("loosened"))


@query(sql("""SELECT a.event_id AS parent, count(*) AS forks, count(*) FILTER (WHERE b.event_type = a.event_type) AS same_kind FROM ev a JOIN ev b ON b.event_id // 3 = a.event_id AND b.event_id <> a.event_id GROUP BY a.event_id""", "ev"))
def fork_chains(spark, sf_dir):
    """Children of each parent by kind."""
    e = events(spark, sf_dir).select("event_id", "event_type")
    kids = e.select(F.expr("event_id div 3").alias("parent"), F.col("event_id").alias("child"), F.col("event_type").alias("kind")).where("parent <> child")
    return e.withColumnRenamed("event_id", "parent").join(kids, "parent").groupBy("parent").agg(F.count("*").alias("forks"), F.count_if(F.col("kind") == F.col("event_type")).alias("same_kind"))


@query(sql("""SELECT sha, line, path, lines FROM changes WHERE day >= DATE '1995-01-01' AND day < DATE '1995-07-01' AND change IN ('A', 'R')""", "changes"))
def selected_changes(spark, sf_dir):
    """Rows by day and kind; both filters reach the scan."""
    return changes(spark, sf_dir).where("day >= DATE'1995-01-01' AND day < DATE'1995-07-01' AND change IN ('A', 'R')").select("sha", "line", "path", "lines")


@query(sql(DAILY + """, z AS (SELECT day, n, (v - avg(v) OVER (PARTITION BY event_type)) / nullif(stddev_pop(v) OVER (PARTITION BY event_type), 0) AS z FROM d)
SELECT day, count(z) AS signals, round(sum(z * n) / sum(n), 4) AS composite FROM z WHERE z IS NOT NULL GROUP BY day HAVING count(z) >= 3""", "ev"))
def composite_signal(spark, sf_dir):
    """Weighted mean of a day's normalised signals, refused below three."""
    w = Window.partitionBy("event_type")
    z = daily(spark, sf_dir).withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.nullif(F.stddev_pop("v").over(w), F.lit(0.0))).where("z IS NOT NULL")
    return z.groupBy("day").agg(F.count("z").alias("signals"), F.round(F.sum(F.col("z") * F.col("n")) / F.sum("n"), 4).alias("composite")).where("signals >= 3")


@query(sql("""SELECT event_id, user_id, event_type, "at" FROM ev ORDER BY "at", event_id LIMIT 100""", "ev"))
def evidence_timeline(spark, sf_dir):
    """The first hundred rows in time, by a top-n and not a full sort."""
    return events(spark, sf_dir).orderBy("at", "event_id").limit(100).select("event_id", "user_id", "event_type", "at")

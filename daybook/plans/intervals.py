"""Joins in time, sessions and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.operators.dedup import drop_within, merge_islands
from daybook.operators.joins import asof_join, band_join, interval_join, top_within
from daybook.operators.sessions import absorbing_sessions, alternations, clip, downtime, number_sessions
from daybook.plans.registry import registry
from daybook.sources.tables import changes, commits, events, spans, sql, table, whole_months

REGISTRY, query = registry()
MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def of_type(e: DataFrame, kind: str, **names: str) -> DataFrame:
    return e.where(F.col("event_type") == kind).select("user_id", *[F.col(a).alias(b) for b, a in names.items()])


@query(sql("""SELECT a.event_id, b.value AS value, b."at" AS value_at FROM ev a ASOF LEFT JOIN
(SELECT user_id, "at", max(value) AS value FROM ev WHERE event_type = 'signup' GROUP BY ALL) b ON a.user_id = b.user_id AND a."at" >= b."at" WHERE a.event_type <> 'signup'""", "ev"))
def metric_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of left join of samples with the last activation of their host."""
    e = events(spark, sf_dir)
    right = of_type(e, "signup", since="at", value="value")
    return asof_join(e.where("event_type <> 'signup'").select("event_id", "user_id", "at"), right, "user_id", "at", "value", "since").select("event_id", "value", "value_at")


@query(sql("""WITH s AS (SELECT event_id, user_id, "at" FROM ev WHERE event_type = 'purchase'), b AS (SELECT s.*, max(e."at") AS before_at FROM s LEFT JOIN ev e ON e.user_id = s.user_id AND e.event_type = 'view' AND e."at" <= s."at" GROUP BY ALL)
SELECT event_id, ("at" - before_at) // 1000000 AS age_s, before_at IS NULL OR "at" - before_at > 86400000000 AS stale FROM b""", "ev"))
def machine_context(spark, sf_dir):
    """The nearest sample before an instant, kept with a caveat when stale."""
    e = events(spark, sf_dir)
    asked, seen = e.where("event_type = 'purchase'").select("event_id", "user_id", "at"), of_type(e, "view", since="at", v="event_id")
    found = asof_join(asked, seen, "user_id", "at", "v", "since")
    age = F.col("at") - F.col("v_at")
    return found.select("event_id", F.floor(age / 1_000_000).alias("age_s"), (F.col("v_at").isNull() | (age > DAY)).alias("stale"))


@query(sql("""SELECT a.event_id AS purchase_id, min(abs(a."at" - b."at")) // 1000000 AS gap_s FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.event_type = 'click' AND abs(a."at" - b."at") <= 86400000000
WHERE a.event_type = 'purchase' GROUP BY 1""", "ev"))
def nearest_signal(spark, sf_dir):
    """Nearest row of another stream within a day, either side."""
    e = events(spark, sf_dir)
    near = band_join(of_type(e, "purchase", purchase_id="event_id", at="at"), of_type(e, "click", other_at="at"), ["user_id"], "at", "other_at", DAY)
    return near.groupBy("purchase_id").agg(F.floor(F.min(F.abs(F.col("at") - F.col("other_at"))) / 1_000_000).alias("gap_s"))


def path_overlap(c: DataFrame) -> DataFrame:
    c = c.withColumn("d", F.unix_date("day"))
    a, b = c.select("sha", "path", "d"), c.select(F.col("sha").alias("other"), "path", F.col("d").alias("e"))
    near = band_join(a, b, ["path"], "d", "e", 3).where("sha < other")
    return near.groupBy("sha").agg(F.countDistinct("other").alias("others"), F.countDistinct("path").alias("paths"))


@query(sql("""SELECT c.sha AS sha, count(DISTINCT h.sha) AS others, count(DISTINCT h.path) AS paths FROM changes c JOIN changes h ON c.path = h.path AND c.sha < h.sha AND abs(c.day - h.day) <= 3 GROUP BY c.sha""", "changes"))
def whole_file_overlap(spark, sf_dir):
    """Pairs that share a path within a band of days, over all paths.

    The join is on path and time bin, not on the project, so a project's size doesn't square.
    """
    return path_overlap(changes(spark, sf_dir))


@query(sql("""SELECT c.project, count(*) AS n, min(h.day - c.day) AS least, round(median(h.day - c.day), 2) AS middle, round(avg(h.day - c.day), 4) AS mean, max(h.day - c.day) AS most
FROM commits c JOIN changes h ON c.sha = h.sha AND h.day - c.day BETWEEN 0 AND 60 GROUP BY c.project""", "commits", "changes"))
def lag_stats(spark, sf_dir):
    """Distribution of the lag from one stream to the other within a window."""
    j = commits(spark, sf_dir).select("sha", "project", F.col("day").alias("opened")).join(changes(spark, sf_dir).select("sha", "day"), "sha")
    j = j.withColumn("lag", F.datediff("day", "opened").cast("long")).where("lag BETWEEN 0 AND 60")
    return j.groupBy("project").agg(F.count("*").alias("n"), F.min("lag").alias("least"), F.round(F.percentile("lag", F.lit(0.5)), 2).alias("middle"), F.round(F.avg("lag"), 4).alias("mean"), F.max("lag").alias("most"))


@query(sql("""WITH c AS (SELECT event_id AS centre_id, user_id, "at" AS centre FROM ev WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 40)
SELECT centre_id, event_id, rank FROM (SELECT c.centre_id, e.event_id, CAST(row_number() OVER (PARTITION BY c.user_id, c.centre ORDER BY e.value DESC, e.event_id, c.centre_id) AS INTEGER) AS rank FROM c JOIN ev e
ON c.user_id = e.user_id AND e.event_type <> 'error' AND abs(c.centre - e."at") <= 43200000000) WHERE rank <= 3""", "ev"))
def pressure_explainer(spark, sf_dir):
    """The worst samples, each with the top rows about it."""
    e = events(spark, sf_dir)
    worst = e.where("event_type = 'error'").orderBy(F.desc("value"), "event_id").limit(40).select(F.col("event_id").alias("centre_id"), "user_id", F.col("at").alias("centre"))
    rows = e.where("event_type <> 'error'").select("event_id", "user_id", "at", "value")
    return top_within(worst, rows, "user_id", "centre", "at", 12 * HOUR, [F.desc("value"), F.col("event_id"), F.col("centre_id")], 3).select("centre_id", "event_id", "rank")


@query(sql("""WITH a AS (SELECT day, count(*) AS commits_n FROM commits GROUP BY day), b AS (SELECT day, count(*) AS changes_n FROM changes GROUP BY day)
SELECT coalesce(a.day, b.day) AS day, coalesce(commits_n, 0) AS commits_n, coalesce(changes_n, 0) AS changes_n FROM a FULL JOIN b ON a.day = b.day""", "commits", "changes"))
def symbol_velocity(spark, sf_dir):
    """Full outer join of two daily counts, zero-filled."""
    a, b = (f(spark, sf_dir).groupBy("day").agg(F.count("*").alias(n)) for f, n in ((commits, "commits_n"), (changes, "changes_n")))
    return a.join(b, "day", "full_outer").na.fill(0, ["commits_n", "changes_n"])


@query(sql("""WITH s AS (SELECT DISTINCT user_id, day, event_type FROM ev) SELECT a.event_type AS source_a, b.event_type AS source_b, count(*) AS n FROM s a JOIN s b
ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 3""", "ev"))
def source_co_occurrence(spark, sf_dir):
    """Pairs of sources on one subject and day."""
    s = events(spark, sf_dir).select("user_id", "day", "event_type").distinct()
    a, b = s.withColumnRenamed("event_type", "source_a"), s.withColumnRenamed("event_type", "source_b")
    return a.join(b, ["user_id", "day"]).where("source_a < source_b").groupBy("source_a", "source_b").agg(F.count("*").alias("n")).where("n >= 3")


@query(sql("""SELECT d.path AS path, d.day AS removed, a.day AS added FROM (SELECT DISTINCT path, day FROM changes WHERE change = 'R') d JOIN (SELECT DISTINCT path, day FROM changes WHERE change = 'A') a
ON a.path = d.path AND a.day >= d.day ORDER BY path, removed, added LIMIT 500""", "changes"))
def added_after_deleted(spark, sf_dir):
    """Additions on or after a removal of the same path."""
    c = changes(spark, sf_dir)
    d = c.where("change = 'R'").select("path", F.col("day").alias("removed")).distinct()
    a = c.where("change = 'A'").select("path", F.col("day").alias("added")).distinct()
    return d.join(a, "path").where("added >= removed").orderBy("path", "removed", "added").limit(500)


@query(sql("""WITH n AS (SELECT user_id, day, 'buy' AS kind FROM ev WHERE event_type = 'purchase' UNION ALL SELECT user_id, day, 'see' FROM ev WHERE event_type = 'view'
UNION ALL SELECT user_id, day, 'err' FROM ev e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.day = e.day))
SELECT user_id, day, count(*) FILTER (WHERE kind = 'buy') AS buys, count(*) FILTER (WHERE kind = 'see') AS sees, count(*) FILTER (WHERE kind = 'err') AS errors, count(DISTINCT kind) AS kinds FROM n GROUP BY ALL""", "ev"))
def project_day_correlation(spark, sf_dir):
    """Three node sets, one by an anti join, counted by kind."""
    e = events(spark, sf_dir).select("user_id", "day", "event_type")
    buy = e.where("event_type = 'purchase'")
    err = e.where("event_type = 'error'").join(buy.select("user_id", "day"), ["user_id", "day"], "left_anti").withColumn("kind", F.lit("err"))
    n = buy.withColumn("kind", F.lit("buy")).unionByName(e.where("event_type = 'view'").withColumn("kind", F.lit("see"))).unionByName(err.select("user_id", "day", "event_type", "kind"))
    count = lambda k: F.count_if(F.col("kind") == k)
    return n.groupBy("user_id", "day").agg(count("buy").alias("buys"), count("see").alias("sees"), count("err").alias("errors"), F.countDistinct("kind").alias("kinds"))


@query(sql("""SELECT a.event_id AS a_id, b.event_id AS b_id, (least(a."end", b."end") - greatest(a.start, b.start)) // 1000000 AS overlap_s FROM spans a JOIN spans b
ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.start < b."end" AND b.start < a."end" """, "spans"))
def timeline_overlaps(spark, sf_dir):
    """Overlapping spans of two streams with shared seconds."""
    s = spans(spark, sf_dir)
    a, b = of_type(s, "click", a_id="event_id", a_from="start", a_to="end"), of_type(s, "view", b_id="event_id", b_from="start", b_to="end")
    both = clip(a, b, "user_id", 5 * MINUTE, ("a_from", "a_to"), ("b_from", "b_to"))
    return both.select("a_id", "b_id", F.floor((F.col("to_us") - F.col("from_us")) / 1_000_000).alias("overlap_s"))


@query(sql("""SELECT a.event_id AS a_id, b.event_id AS b_id, CASE WHEN abs(a."at" - b."at") <= 1800000000 THEN 0.82e0 WHEN abs(a."at" - b."at") <= 3600000000 THEN 0.7e0 ELSE 0.58e0 END AS weight
FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type AND abs(a."at" - b."at") <= 5400000000""", "ev"))
def proximity_edges(spark, sf_dir):
    """Pairs of different sources within 90 minutes of one day, weighted by the gap."""
    e = events(spark, sf_dir)
    a = e.select("user_id", "day", F.col("event_id").alias("a_id"), F.col("event_type").alias("a_type"), "at")
    b = e.select("user_id", "day", F.col("event_id").alias("b_id"), F.col("event_type").alias("b_type"), F.col("at").alias("b_at"))
    near = band_join(a, b, ["user_id", "day"], "at", "b_at", 90 * MINUTE).where("a_type < b_type")
    gap = F.abs(F.col("at") - F.col("b_at"))
    return near.select("a_id", "b_id", F.when(gap <= 30 * MINUTE, 0.82).when(gap <= HOUR, 0.7).otherwise(0.58).alias("weight"))


@query(sql("""WITH w AS (SELECT event_id, user_id, start, "end" FROM spans WHERE event_type = 'view'), s AS (SELECT event_id, user_id, start - 600000000 AS lo, "end" + 600000000 AS hi, start, "end" FROM spans WHERE event_type = 'click'),
p AS (SELECT w.event_id AS span_id, s.event_id AS session_id, greatest(least(w."end", s."end") - greatest(w.start, s.start), 100000) AS o, s.start, greatest(w."end" - w.start, 1) AS len FROM w JOIN s ON w.user_id = s.user_id AND w.start < s.hi AND s.lo < w."end")
SELECT span_id, session_id, round(least(o * 1.0 / len, 1.0), 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY o DESC, start, session_id) AS k FROM p) WHERE k = 1""", "spans"))
def attribute_spans(spark, sf_dir):
    """The session with the longest overlap, ten minutes of slack, ties to the earlier."""
    s = spans(spark, sf_dir)
    w = of_type(s, "view", span_id="event_id", a_from="start", a_to="end")
    c = of_type(s, "click", session_id="event_id", start="start", end="end").withColumn("lo", F.col("start") - 10 * MINUTE).withColumn("hi", F.col("end") + 10 * MINUTE)
    p = interval_join(w, c, "user_id", 20 * MINUTE, ("a_from", "a_to"), ("lo", "hi"))
    shared = F.greatest(F.least("a_to", "end") - F.greatest("a_from", "start"), F.lit(100_000))
    p = p.withColumn("o", shared).withColumn("conf", F.least(shared / F.greatest(F.col("a_to") - F.col("a_from"), F.lit(1)), F.lit(1.0)))
    best = p.groupBy("span_id").agg(F.min(F.struct((-F.col("o")).alias("o"), "start", "session_id", "conf")).alias("b"))
    return best.select("span_id", "b.session_id", F.round("b.conf", 4).alias("confidence"))


@query(sql("""WITH n AS (SELECT user_id, day, sum(value) AS v FROM ev GROUP BY ALL) SELECT a.user_id, a.day, round(a.v, 4) AS before, round(b.v, 4) AS after FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND b.day = a.day + 1""", "ev"))
def night_to_day(spark, sf_dir):
    """A day joined to the next."""
    n = events(spark, sf_dir).groupBy("user_id", "day").agg(F.sum("value").alias("v"))
    nxt = n.select("user_id", F.date_sub("day", 1).alias("day"), F.round("v", 4).alias("after"))
    return n.select("user_id", "day", F.round("v", 4).alias("before")).join(nxt, ["user_id", "day"], "left")


@query(sql("""WITH a AS (SELECT user_id, count(*) AS n FROM ev WHERE day < DATE '2024-01-15' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM ev WHERE day >= DATE '2024-01-15' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.user_id = b.user_id ORDER BY abs(delta) DESC, 1 LIMIT 50""", "ev"))
def snapshot_diff(spark, sf_dir):
    """Two snapshots compared, largest changes first."""
    e = events(spark, sf_dir)
    early = F.col("day") < "2024-01-15"
    a, b = (e.where(t).groupBy("user_id").agg(F.count("*").alias(n)) for t, n in ((early, "n_a"), (~early, "n_b")))
    return a.join(b, "user_id", "full_outer").na.fill(0, ["n_a", "n_b"]).withColumn("delta", F.col("n_b") - F.col("n_a")).orderBy(F.desc(F.abs("delta")), "user_id").limit(50)


@query(sql("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'delivered' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'open' ELSE 'none' END AS state FROM customer""", "commits"))
def frontier_reconciliation(spark, sf_dir):
    """Intents by semi and anti joins into delivered, open and none."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    g = o.groupBy("c_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("done"))
    return c.join(g, "c_custkey", "left").select("c_custkey", F.when(F.col("done"), "delivered").when(F.col("done").isNotNull(), "open").otherwise("none").alias("state"))


@query(sql("""SELECT event_id FROM spans a WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND a.start < b."end" + 3600000000 AND b.start - 3600000000 < a."end")""", "spans"))
def uncaptured_episodes(spark, sf_dir):
    """Episodes that no capture window touches."""
    s = spans(spark, sf_dir)
    a = of_type(s, "error", event_id="event_id", a_from="start", a_to="end")
    b = s.where("event_type = 'view'").select("user_id", (F.col("start") - HOUR).alias("lo"), (F.col("end") + HOUR).alias("hi"))
    seen = interval_join(a, b, "user_id", 2 * HOUR, ("a_from", "a_to"), ("lo", "hi")).select("event_id").distinct()
    return a.join(seen, "event_id", "left_anti").select("event_id")


@query(sql("""WITH g AS (SELECT *, sum(CASE WHEN p IS NULL OR "at" - p > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "at", event_id) AS session FROM (SELECT *, lag("at") OVER (PARTITION BY user_id ORDER BY "at", event_id) AS p FROM ev))
SELECT user_id, CAST(session AS BIGINT) AS session, min("at") AS first_at, max("at") AS last_at, count(*) AS n FROM g GROUP BY ALL""", "ev"))
def gap_sessions(spark, sf_dir):
    """Sessions separated by over two hours."""
    e = number_sessions(events(spark, sf_dir), ["user_id"], "at", ["event_id"], 2 * HOUR)
    return e.groupBy("user_id", "session").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))


@query(sql("""WITH g AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end") AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY ALL""", "spans"))
def merged_intervals(spark, sf_dir):
    """Union of overlapping and touching spans."""
    return merge_islands(spans(spark, sf_dir).select("user_id", "start", "end"), ["user_id"], 0)


@query()
def app_sessions(spark, sf_dir):
    """S01 with absorption, S07, S08: short other items don't end a session. Depends on what was absorbed: no SQL."""
    return absorbing_sessions(spans(spark, sf_dir), "user_id", "event_type", "start", "end", 6 * HOUR, 30_000_000)


@query(sql("""WITH f AS (SELECT *, coalesce(lag(event_type, 2) OVER w = event_type AND lag(event_type) OVER w <> event_type, false) AS flag FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY "at", event_id)),
g AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY "at", event_id) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, min("at") AS start, count(*) + 2 AS items FROM g WHERE flag GROUP BY user_id, run HAVING count(*) + 2 >= 4""", "ev"))
def loops(spark, sf_dir):
    """Alternation runs of two kinds."""
    return alternations(events(spark, sf_dir), "user_id", "event_type", "at", "event_id")


@query(sql("""WITH s AS (SELECT user_id, day, "at", event_id, event_type, lag(event_type) OVER (PARTITION BY user_id, day ORDER BY "at", event_id) AS p FROM ev)
SELECT user_id, day, count(*) FILTER (WHERE p <> event_type) AS switches, count(*) AS n FROM s GROUP BY ALL""", "ev"))
def fragmentation(spark, sf_dir):
    """Switches of context a day."""
    w = Window.partitionBy("user_id", "day").orderBy("at", "event_id")
    s = events(spark, sf_dir).withColumn("p", F.lag("event_type").over(w))
    return s.groupBy("user_id", "day").agg(F.count_if(F.col("p") != F.col("event_type")).alias("switches"), F.count("*").alias("n"))


@query(sql("""WITH g AS (SELECT event_type, user_id, "end" AS gap_start, lead(start) OVER (PARTITION BY event_type, user_id ORDER BY start, event_id) AS gap_end FROM spans),
o AS (SELECT * FROM g WHERE gap_end - gap_start >= 432000000000)
SELECT o.event_type, o.user_id, gap_start, gap_end, count(DISTINCT e.event_type) AS others_alive FROM o LEFT JOIN spans e ON e.user_id = o.user_id AND e.event_type <> o.event_type AND e.start >= gap_start AND e.start < gap_end GROUP BY ALL""", "spans"))
def data_outages(spark, sf_dir):
    """Long gaps of one stream, by how many others were alive."""
    s = spans(spark, sf_dir)
    g = s.select("event_type", "user_id", F.col("end").alias("gap_start"), F.lead("start").over(Window.partitionBy("event_type", "user_id").orderBy("start", "event_id")).alias("gap_end"))
    o = g.where(F.col("gap_end") - F.col("gap_start") >= 120 * HOUR)
    e = s.select("user_id", F.col("event_type").alias("other"), F.col("start").alias("a"), (F.col("start") + 1).alias("b"))
    near = interval_join(o, e, "user_id", DAY, ("gap_start", "gap_end"), ("a", "b")).where("other <> event_type")
    alive = near.groupBy("event_type", "user_id", "gap_start", "gap_end").agg(F.countDistinct("other").alias("others_alive"))
    return o.join(alive, ["event_type", "user_id", "gap_start", "gap_end"], "left").na.fill(0, ["others_alive"])


@query(sql("""WITH s AS (SELECT user_id, "at", bool_or(event_type = 'error') AS bad FROM ev GROUP BY ALL), t AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY "at") <> bad, true) AS turn FROM s),
u AS (SELECT user_id, "at" AS start, coalesce(lead("at") OVER (PARTITION BY user_id ORDER BY "at"), 1706745600000000) AS "end", bad FROM t WHERE turn) SELECT user_id, start, "end" FROM u WHERE bad""", "ev"))
def downtime_intervals(spark, sf_dir):
    """From the first bad sample to the next good one or the end of the last month with events."""
    e = events(spark, sf_dir)
    s = e.groupBy("user_id", "at").agg(F.bool_or(F.col("event_type") == "error").alias("bad"))
    return downtime(s, "user_id", "at", F.col("bad"), whole_months(e)[1])


@query(sql("""WITH s AS (SELECT user_id, "at", bool_or(event_type = 'error') AS bad FROM ev GROUP BY ALL), t AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY "at") <> bad, true) AS turn FROM s),
u AS (SELECT user_id, "at" AS start, coalesce(lead("at") OVER (PARTITION BY user_id ORDER BY "at"), 1706745600000000) AS "end", bad FROM t WHERE turn)
SELECT user_id, round(1 - sum("end" - start) / 2678400000000.0, 6) AS uptime FROM u WHERE bad GROUP BY user_id""", "ev"))
def uptime_summary(spark, sf_dir):
    """Share of the whole months with events that was not down."""
    lo, hi = whole_months(events(spark, sf_dir))
    d = downtime_intervals(spark, sf_dir)
    return d.groupBy("user_id").agg(F.round(1 - F.sum(F.col("end") - F.col("start")) / float(hi - lo), 6).alias("uptime"))


@query(sql("""WITH b AS (SELECT user_id, "at" // 21600000000 AS bucket, count(DISTINCT event_type) AS kinds FROM ev GROUP BY ALL HAVING count(DISTINCT event_type) >= 2),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR bucket - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY bucket) AS island FROM (SELECT *, lag(bucket) OVER (PARTITION BY user_id ORDER BY bucket) AS p FROM b))
SELECT user_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket, CAST(max(kinds) AS BIGINT) AS kinds FROM g GROUP BY user_id, island""", "ev"))
def co_presence(spark, sf_dir):
    """Buckets with several kinds, merged over at most one missing bucket."""
    b = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("at") / (6 * HOUR)).alias("bucket")).agg(F.countDistinct("event_type").alias("kinds")).where("kinds >= 2")
    g = number_sessions(b, ["user_id"], "bucket", [], 2)
    return g.groupBy("user_id", "session").agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.max("kinds").alias("kinds")).drop("session")


@query(sql("""WITH h AS (SELECT unnest(range(1704067200000000, 1706745600000000, 3600000000)) AS hour), c AS (SELECT "at" // 3600000000 * 3600000000 AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY 1)
SELECT h.hour, coalesce(n, 0) AS n, coalesce(users, 0) AS users FROM h LEFT JOIN c USING (hour)""", "ev"))
def hourly_presence(spark, sf_dir):
    """A dense hour spine over the whole months with events, and what each hour holds."""
    e = events(spark, sf_dir)
    spine = spark.range(*whole_months(e), HOUR).withColumnRenamed("id", "hour")
    c = e.groupBy((F.floor(F.col("at") / HOUR) * HOUR).alias("hour")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return spine.join(c, "hour", "left").na.fill(0, ["n", "users"])


@query(sql("""WITH g AS (SELECT user_id, ("at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at", event_id)) / 1e6 AS gap FROM ev)
SELECT user_id, count(*) AS n, round(quantile_cont(gap, 0.1), 3) AS p10, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.9), 3) AS p90 FROM g WHERE gap <= 86400 GROUP BY user_id HAVING count(*) >= 10""", "ev"))
def interval_dynamics(spark, sf_dir):
    """S34, the deciles of S35: time between events inside bursts."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    g = events(spark, sf_dir).withColumn("gap", (F.col("at") - F.lag("at").over(w)) / 1e6).where("gap <= 86400")
    q = F.percentile("gap", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = g.groupBy("user_id").agg(F.count("*").alias("n"), q.alias("q")).where("n >= 10")
    return g.select("user_id", "n", *[F.round(F.col("q")[i], 3).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query()
def tolerance_dedup(spark, sf_dir):
    """Greedy by what was kept before: no SQL, tested on hand-made rows."""
    return drop_within(events(spark, sf_dir).select("user_id", "at", "event_id"), "user_id", "at", 6 * HOUR)

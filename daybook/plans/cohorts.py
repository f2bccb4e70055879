"""Episodes over robust thresholds, cohorts, matched differences and frontiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.operators.dedup import merge_islands
from daybook.operators.quantiles import percentiles
from daybook.operators.sessions import number_sessions
from daybook.plans.registry import registry
from daybook.sources.shared import cut
from daybook.sources.tables import changes, commits, events, sql, table

REGISTRY, query = registry()
HOUR = 3_600_000_000


@query(sql("""WITH m AS (SELECT event_type, median(value) AS med FROM ev GROUP BY 1), t AS (SELECT ev.event_type, max(med) + 1.5 * 1.4826 * median(abs(value - med)) AS threshold FROM ev JOIN m USING (event_type) GROUP BY 1),
x AS (SELECT ev.event_type, user_id, "at", value FROM ev JOIN t USING (event_type) WHERE value > threshold), g AS (SELECT *, sum(CASE WHEN p IS NULL OR "at" - p > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY "at") AS island
FROM (SELECT *, lag("at") OVER (PARTITION BY event_type, user_id ORDER BY "at") AS p FROM x))
SELECT event_type, user_id, min("at") AS start, max("at") AS "end", count(*) AS n FROM g GROUP BY event_type, user_id, island HAVING count(*) >= 2""", "ev"))
def machine_episodes(spark, sf_dir):
    """Exceedances of median + k * MAD, merged by gap, with a least count."""
    e = events(spark, sf_dir)
    med = cut(percentiles(e, ["event_type"], "value", {"med": 0.5}).select("event_type", "med"))  # a row a series kind
    off = e.join(med, "event_type").select("event_type", F.abs(F.col("value") - F.col("med")).alias("off"))
    dev = cut(percentiles(off, ["event_type"], "off", {"mad": 0.5}).join(med, "event_type").select("event_type", F.expr("med + 1.5D * 1.4826D * mad AS threshold")))
    x = e.join(dev, "event_type").where("value > threshold").select("event_type", "user_id", F.col("at").alias("start"), F.col("at").alias("end"))
    return merge_islands(x, ["event_type", "user_id"], 48 * HOUR).where("n >= 2").select("event_type", "user_id", "start", "end", "n")


@query(sql("""SELECT event_type, hour(to_timestamp("at" / 1e6) AT TIME ZONE 'UTC') AS hour, round(median(value), 4) AS med, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3, count(*) AS n FROM ev GROUP BY ALL""", "ev"))
def observational_baselines(spark, sf_dir):
    """Hourly bands of each source."""
    e = events(spark, sf_dir).withColumn("hour", F.hour(F.timestamp_micros("at")).cast("long"))
    q = percentiles(e, ["event_type", "hour"], "value", {"med": 0.5, "q1": 0.25, "q3": 0.75})
    return q.select("event_type", "hour", *[F.round(n, 4).alias(n) for n in ("med", "q1", "q3")], "n")


@query(sql("""SELECT project, kind, count(*) AS n, count(*) FILTER (WHERE status = 'P') AS censored, round(median(lines), 4) AS med, round(quantile_cont(lines, 0.95), 4) AS p95 FROM commits GROUP BY ALL HAVING count(*) >= 5""", "commits"))
def cohort_mining(spark, sf_dir):
    """Cohorts by two dimensions with censoring."""
    c = commits(spark, sf_dir)
    g = c.groupBy("project", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "P").alias("censored")).where("n >= 5")
    q = percentiles(c, ["project", "kind"], "lines", {"med": 0.5, "p95": 0.95}).drop("n")
    return g.join(q, ["project", "kind"]).select("project", "kind", "n", "censored", F.round("med", 4).alias("med"), F.round("p95", 4).alias("p95"))


@query(sql("""WITH f AS (SELECT event_type, value, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS exposed FROM ev)
SELECT event_type, coalesce(exposed, 0) AS exposed, count(*) AS n, round(median(value), 4) AS med FROM f WHERE event_type <> 'error' GROUP BY ALL""", "ev"))
def lagged_exposures(spark, sf_dir):
    """Outcome with and without an exposure in the day before."""
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-24 * HOUR, -1)
    f = events(spark, sf_dir).withColumn("exposed", F.coalesce(F.max((F.col("event_type") == "error").cast("int")).over(w), F.lit(0)))
    f = cut(f.where("event_type <> 'error'").select("event_type", "exposed", "value"))  # read by each step of the ranks
    return percentiles(f, ["event_type", "exposed"], "value", {"med": 0.5}).select("event_type", "exposed", "n", F.round("med", 4).alias("med"))


@query(sql("""WITH r AS (SELECT event_type, user_id % 2 = 0 AS arm, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk FROM ev)
SELECT event_type, count(*) FILTER (WHERE arm) AS n1, count(*) FILTER (WHERE NOT arm) AS n2, round(sum(rk) FILTER (WHERE arm) - count(*) FILTER (WHERE arm) * (count(*) FILTER (WHERE arm) + 1) / 2.0, 2) AS u,
round(2 * (sum(rk) FILTER (WHERE arm) - count(*) FILTER (WHERE arm) * (count(*) FILTER (WHERE arm) + 1) / 2.0) / (count(*) FILTER (WHERE arm) * count(*) FILTER (WHERE NOT arm)) - 1, 5) AS delta FROM r GROUP BY event_type""", "ev"))
def cohort_comparisons(spark, sf_dir):
    """Mann-Whitney U by mean ranks, and Cliff's delta.

    Ranks come from counts of distinct values, so that ties and repeated values combine before the sort.
    """
    e = events(spark, sf_dir).withColumn("arm", F.col("user_id") % 2 == 0)
    v = e.groupBy("event_type", "value").agg(F.count("*").alias("m"), F.count_if("arm").alias("m1"))
    w = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("rk", F.coalesce(F.sum("m").over(w), F.lit(0)) + (F.col("m") + 1) / 2)
    g = v.groupBy("event_type").agg(F.sum("m1").alias("n1"), (F.sum("m") - F.sum("m1")).alias("n2"), F.sum(F.col("rk") * F.col("m1")).alias("s"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    return g.select("event_type", "n1", "n2", F.round(u, 2).alias("u"), F.round(2 * u / (F.col("n1") * F.col("n2")) - 1, 5).alias("delta"))


@query(sql("""WITH m AS (SELECT quantile_cont(epoch_us(CAST(day AS TIMESTAMP)), 0.7) AS cut FROM commits) SELECT project, epoch_us(CAST(day AS TIMESTAMP)) > cut AS validation, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM commits, m GROUP BY ALL""", "commits"))
def validation_design(spark, sf_dir):
    """Time-ordered discovery and validation rows, split at a fraction of all."""
    c = commits(spark, sf_dir)
    days = c.groupBy("day").agg(F.count("*").alias("n"))  # the quantile of days needs their counts only
    cut = days.agg(F.percentile(F.unix_date("day"), F.lit(0.7), F.col("n")).alias("cut"))
    return c.join(F.broadcast(cut)).groupBy("project", (F.unix_date("day") > F.col("cut")).alias("validation")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(sql("""WITH s AS (SELECT event_type, user_id % 2 = 0 AS treated, day >= DATE '2024-01-16' AS after, median(value) AS m, count(*) AS n FROM ev GROUP BY ALL)
SELECT event_type, round(max(m) FILTER (WHERE treated AND after) - max(m) FILTER (WHERE treated AND NOT after) - (max(m) FILTER (WHERE NOT treated AND after) - max(m) FILTER (WHERE NOT treated AND NOT after)), 4) AS did, CAST(min(n) AS BIGINT) AS least_side FROM s GROUP BY event_type""", "ev"))
def matched_designs(spark, sf_dir):
    """Difference in differences of medians about a boundary, against a control."""
    treated, after = (F.col("user_id") % 2 == 0).alias("treated"), (F.col("day") >= "2024-01-16").alias("after")
    s = percentiles(events(spark, sf_dir).select("event_type", treated, after, "value"), ["event_type", "treated", "after"], "value", {"m": 0.5})
    side = lambda t, a: F.max(F.when((F.col("treated") == t) & (F.col("after") == a), F.col("m")))
    did = side(True, True) - side(True, False) - (side(False, True) - side(False, False))
    return s.groupBy("event_type").agg(F.round(did, 4).alias("did"), F.min("n").alias("least_side"))


@query("""WITH p AS (SELECT p_partkey, p_size AS a, p_retailprice AS b FROM part) SELECT p_partkey, a, b FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))""")
def pareto_frontier(spark, sf_dir):
    """Rows that no other dominates in two scores, by running maxima over the small score instead of a pair join."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    best = p.groupBy("a").agg(F.max("b").alias("top"))  # a row a distinct size
    above = best.select(F.col("a").alias("a2"), F.col("top").alias("top2"))
    beaten = best.join(above, F.col("a2") > F.col("a"), "left").groupBy("a", "top").agg(F.max("top2").alias("higher"))
    kept = beaten.where("higher IS NULL OR top > higher").select("a", F.col("top").alias("b"))
    return p.join(F.broadcast(kept), ["a", "b"]).select("p_partkey", "a", "b")


@query("""SELECT event_type, k, n, round(n * 1.0 / sum(n) OVER (PARTITION BY event_type), 4) AS share FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS k, count(*) AS n FROM events GROUP BY ALL)""")
def gap_summary(spark, sf_dir):
    """Share of each code inside its table, codes read from JSON."""
    g = table(spark, sf_dir, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 5).alias("k")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 4))


@query(sql("""SELECT day, event_type, round(quantile_cont(k, 0.5), 3) AS p50, round(quantile_cont(k, 0.95), 3) AS p95, max(k) AS most FROM (SELECT day, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM ev) GROUP BY ALL""", "ev"))
def bufferbloat_daily(spark, sf_dir):
    """Daily quantiles of a number inside JSON."""
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    g = e.groupBy("day", "event_type").agg(F.percentile("k", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), F.max("k").alias("most"))
    return g.select("day", "event_type", F.round(F.col("q")[0], 3).alias("p50"), F.round(F.col("q")[1], 3).alias("p95"), "most")


@query(sql("""WITH g AS (SELECT *, sum(CASE WHEN p IS NULL OR "at" - p > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY "at", event_id) AS chain FROM (SELECT *, lag("at") OVER (PARTITION BY user_id, event_type ORDER BY "at", event_id) AS p FROM ev)),
c AS (SELECT user_id, event_type, chain, count(*) AS n, count(*) FILTER (WHERE value > 50) AS failed FROM g GROUP BY ALL HAVING count(*) >= 2)
SELECT event_type, count(*) AS chains, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(failed) AS BIGINT) AS failed, round(median(n), 2) AS med FROM c GROUP BY event_type""", "ev"))
def workflow_mechanics(spark, sf_dir):
    """Retry chains of one command within a gap."""
    e = number_sessions(events(spark, sf_dir), ["user_id", "event_type"], "at", ["event_id"], 12 * HOUR)
    c = e.groupBy("user_id", "event_type", "session").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("failed")).where("n >= 2")
    return c.groupBy("event_type").agg(F.count("*").alias("chains"), F.sum("n").alias("attempts"), F.sum("failed").alias("failed"), F.round(F.percentile("n", F.lit(0.5)), 2).alias("med"))


@query(sql("""SELECT round(var_pop(m), 4) AS between_var, round(avg(v), 4) AS within_var, count(*) AS groups FROM (SELECT owner, avg(lines) AS m, var_samp(lines) AS v FROM changes GROUP BY owner HAVING count(*) > 1)""", "changes"))
def measurement_system(spark, sf_dir):
    """The means' and the mean variance of owners; measurement_checks has the components of M47."""
    g = changes(spark, sf_dir).groupBy("owner").agg(F.avg("lines").alias("m"), F.var_samp("lines").alias("v"), F.count("*").alias("n")).where("n > 1")
    return g.agg(F.round(F.var_pop("m"), 4).alias("between_var"), F.round(F.avg("v"), 4).alias("within_var"), F.count("*").alias("groups"))


@query(sql("""WITH d AS (SELECT user_id, day, sum(value) AS v FROM ev GROUP BY ALL) SELECT day, count(*) AS users, round(avg(v), 6) AS mean FROM d WHERE v < 60 GROUP BY day""", "ev"))
def idle_baseline(spark, sf_dir):
    """Quiet subject-days and their mean."""
    d = events(spark, sf_dir).groupBy("user_id", "day").agg(F.sum("value").alias("v")).where("v < 60")
    return d.groupBy("day").agg(F.count("*").alias("users"), F.round(F.avg("v"), 6).alias("mean"))


@query(sql("""SELECT user_id, max("at") - min("at") AS span_us, count(*) AS n FROM ev WHERE user_id NOT IN (0, 1, 2) GROUP BY user_id HAVING max("at") - min("at") >= 2160000000000""", "ev"))
def long_lived(spark, sf_dir):
    """Subjects whose samples span a long time, but for an exclusion list."""
    g = events(spark, sf_dir).where(~F.col("user_id").isin(0, 1, 2)).groupBy("user_id").agg((F.max("at") - F.min("at")).alias("span_us"), F.count("*").alias("n"))
    return g.where(F.col("span_us") >= 600 * HOUR)

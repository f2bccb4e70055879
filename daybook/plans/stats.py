"""Trends, change points, correlations, anomalies and decays over many series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.operators.series import anomalies, bootstrap_delta, changepoints, lagged_correlation, periods, permutation_p
from daybook.operators.slopes import trend
from daybook.plans.registry import registry
from daybook.sources.tables import changes, events, sql, table, whole_months

REGISTRY, query = registry()
DAILY = """WITH d AS (SELECT event_type, day, round(avg(value), 4) AS v, count(*) AS n FROM ev GROUP BY ALL) """


def daily(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", "day").agg(F.round(F.avg("value"), 4).alias("v"), F.count("*").alias("n"))


@query(sql(DAILY + """, p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, v FROM d)
SELECT a.event_type, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s, round(quantile_cont((b.v - a.v) / (b.i - a.i), 0.5), 5) AS slope, max(b.i) AS n FROM p a JOIN p b ON a.event_type = b.event_type AND a.i < b.i GROUP BY a.event_type""", "ev"))
def trend_by_type(spark, sf_dir):
    """S and slope of T01, of daily means; trend_tests has the p and the verdict."""
    return trend(daily(spark, sf_dir), "event_type", "day", "v").withColumn("slope", F.round("slope", 5))


@query()
def changepoints_by_type(spark, sf_dir):
    """Binary segmentation: iterative, no SQL; tested on made series."""
    return changepoints(daily(spark, sf_dir), "event_type", "day", "v")


@query()
def periods_by_type(spark, sf_dir):
    """Discrete Fourier periods; no SQL."""
    return periods(daily(spark, sf_dir), "event_type", "day", "v")


@query(sql(DAILY + """, a AS (SELECT day, v AS x FROM d WHERE event_type = 'click'), b AS (SELECT day, v AS y FROM d WHERE event_type = 'view'), l AS (SELECT unnest(range(-7, 8)) AS lag)
SELECT CAST(lag AS INTEGER) AS lag, round(corr(x, y), 5) AS r, count(*) AS n FROM a, l JOIN b ON b.day = a.day + CAST(l.lag AS INTEGER) GROUP BY lag""", "ev"))
def cross_correlation(spark, sf_dir):
    """T13, J13, the correlations of T04 without p and q: click and view at each lag."""
    d = daily(spark, sf_dir)
    a, b = d.where("event_type = 'click'"), d.where("event_type = 'view'")
    return lagged_correlation(a.select("day", F.col("v").alias("x")), b.select("day", F.col("v").alias("y")), "day", "x", "y", 7).withColumn("r", F.round("r", 5))


@query(sql(DAILY + """, l AS (SELECT event_type, v, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS p FROM d) SELECT event_type, round(corr(v, p), 5) AS r1, count(p) AS n FROM l GROUP BY event_type HAVING count(p) >= 10""", "ev"))
def lag1_autocorrelation(spark, sf_dir):
    """A series with itself a step later."""
    l = daily(spark, sf_dir).withColumn("p", F.lag("v").over(Window.partitionBy("event_type").orderBy("day")))
    return l.groupBy("event_type").agg(F.round(F.corr("v", "p"), 5).alias("r1"), F.count("p").alias("n")).where("n >= 10")


@query(sql(DAILY + """, h AS (SELECT event_type, day, v, list(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS past FROM d),
q AS (SELECT *, len(past) AS k, list_aggregate(past, 'quantile_cont', 0.25) AS q1, list_aggregate(past, 'quantile_cont', 0.75) AS q3 FROM h)
SELECT event_type, day, CAST(coalesce(k, 0) AS INTEGER) AS n_past, coalesce(k >= 5 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)), false) AS anomaly FROM q""", "ev"))
def daily_anomalies(spark, sf_dir):
    """Fence over the 28 rows before."""
    return anomalies(daily(spark, sf_dir), "event_type", "day", "v").select("event_type", "day", "n_past", "anomaly")


@query(sql(DAILY + """SELECT a.event_type AS a_type, b.event_type AS b_type, round(corr(a.v, b.v), 3) AS r, count(*) AS n FROM d a JOIN d b ON a.day = b.day AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 10""", "ev"))
def correlation_matrix(spark, sf_dir):
    """Every pair of series over common days."""
    d = daily(spark, sf_dir)
    a, b = d.select("day", F.col("event_type").alias("a_type"), F.col("v").alias("x")), d.select("day", F.col("event_type").alias("b_type"), F.col("v").alias("y"))
    return a.join(b, "day").where("a_type < b_type").groupBy("a_type", "b_type").agg(F.round(F.corr("x", "y"), 3).alias("r"), F.count("*").alias("n")).where("n >= 10")


@query(sql(DAILY + """, z AS (SELECT *, (n - avg(n) OVER (PARTITION BY event_type)) / nullif(stddev_pop(n) OVER (PARTITION BY event_type), 0) AS z FROM d)
SELECT event_type, day, round(z, 4) AS z, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS kind FROM z WHERE abs(z) >= 1.5""", "ev"))
def source_anomalies(spark, sf_dir):
    """Population z-scores over days."""
    w = Window.partitionBy("event_type")
    z = (F.col("n") - F.avg("n").over(w)) / F.nullif(F.stddev_pop("n").over(w), F.lit(0.0))
    return daily(spark, sf_dir).withColumn("z", z).where("abs(z) >= 1.5").select("event_type", "day", F.round("z", 4).alias("z"), F.when(F.col("z") > 0, "spike").otherwise("drop").alias("kind"))


@query(sql("""WITH g AS (SELECT CAST(day AS DATE) AS day, unnest(range(4)) * 6 AS hour FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS day)),
s AS (SELECT g.day, g.hour, u.user_id, sum(e.value * exp(-ln(2) * ((epoch_us(g.day + to_hours(CAST(hour AS INTEGER))) - e."at") / 3.6e9) / 12.0)) AS level FROM g, (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase' AND user_id < 20) u
JOIN ev e ON e.user_id = u.user_id AND e.event_type = 'purchase' AND e."at" <= epoch_us(g.day + to_hours(CAST(hour AS INTEGER))) AND e."at" > epoch_us(g.day + to_hours(CAST(hour AS INTEGER))) - 259200000000 GROUP BY ALL)
SELECT user_id, day, round(max(level), 3) AS peak, round(avg(level), 3) AS mean FROM s GROUP BY user_id, day""".replace(" AND user_id < 20", ""), "ev"))
def active_levels(spark, sf_dir):
    """Exponential decays summed on a grid; each dose only reaches the grid points of its three days."""
    step, reach = 6 * 3_600_000_000, 259_200_000_000
    e = events(spark, sf_dir)
    lo, hi = whole_months(e)
    e = e.where("event_type = 'purchase'").select("user_id", "at", "value")
    first = F.ceil(F.col("at") / step)
    last = F.ceil((F.col("at") + reach) / step) - 1
    g = e.withColumn("lo", F.greatest(first, F.lit(lo // step))).withColumn("hi", F.least(last, F.lit(hi // step - 1))).where("hi >= lo").withColumn("slot", F.explode(F.sequence("lo", "hi")))
    decay = F.exp(-F.log(F.lit(2.0)) * ((F.col("slot") * step - F.col("at")) / 3.6e9) / 12.0)
    s = g.groupBy("user_id", "slot").agg(F.sum(F.col("value") * decay).alias("level"))
    return s.groupBy("user_id", F.to_date(F.timestamp_micros(F.col("slot") * step)).alias("day")).agg(F.round(F.max("level"), 3).alias("peak"), F.round(F.avg("level"), 3).alias("mean"))


@query(sql("""SELECT path % 50 AS module, count(*) AS n, round(regr_slope(lines, date_diff('day', DATE '1992-01-01', day)), 6) AS slope FROM changes GROUP BY 1""", "changes"))
def growth_slopes(spark, sf_dir):
    """Least-squares slope of each series."""
    c = changes(spark, sf_dir).withColumn("d", F.datediff("day", F.lit("1992-01-01").cast("date")))
    return c.groupBy((F.col("path") % 50).alias("module")).agg(F.count("*").alias("n"), F.round(F.regr_slope("lines", "d"), 6).alias("slope"))


@query()
def bootstrap_deltas(spark, sf_dir):
    """Seeded bootstrap interval of a mean difference; random draws, no SQL."""
    e = events(spark, sf_dir).withColumn("arm", F.col("user_id") % 2 == 0)
    return bootstrap_delta(e, "event_type", "arm", "value")


@query()
def permutation_tests(spark, sf_dir):
    """The Monte Carlo form of M21: seeded permutation p-values; random draws, no SQL."""
    e = events(spark, sf_dir).withColumn("arm", F.col("user_id") % 2 == 0)
    return permutation_p(e, "event_type", "arm", "value")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * p[2])) /
sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x))) AS c FROM embeddings, q)
SELECT vec_id, round(c, 5) AS cosine FROM s ORDER BY c DESC, vec_id LIMIT 10""")
def semantic_search(spark, sf_dir):
    """Cosine top-k for one query vector."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id = 0 AND embedding IS NOT NULL").select("embedding").first()
    if asked is None:
        return spark.createDataFrame([], "vec_id long, cosine double")
    q = F.lit([float(x) for x in asked[0]])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e = F.col("embedding")
    return v.select("vec_id", (dot(e, q) / F.sqrt(dot(e, e) * dot(q, q))).alias("c")).orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", F.round("c", 5).alias("cosine"))

"""Tests of significance over many series and cohorts, each with its p and, in families, its q."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.functions.significance import correlation_p, correlation_p_sql, effective_n, normal_p, normal_p_sql, with_q, with_q_sql
from daybook.operators import ranks, resampling, slopes
from daybook.plans.registry import registry
from daybook.sources.tables import events, sql

REGISTRY, query = registry()
SERIES = """WITH d AS (SELECT event_type, day, count(*) AS v FROM ev GROUP BY ALL)"""
#: Every pair of types, at every lag up to a week: x a day's count of one, y the other's ``lag`` days later.
LAGGED = SERIES + """, l AS (SELECT unnest(range(-7, 8)) AS lag), r AS (SELECT a.event_type AS leader, b.event_type AS follower, CAST(lag AS INTEGER) AS lag, corr(a.v, b.v) AS r, count(*) AS n
FROM d a, l JOIN d b ON b.event_type <> a.event_type AND b.day = a.day + CAST(l.lag AS INTEGER) GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT *, """ + correlation_p_sql("r", "(n - 2)") + """ AS p FROM r WHERE r IS NOT NULL AND isfinite(r)), tested AS (""" + with_q_sql("t", "leader, follower", "lag") + ")"


def counts(spark, sf_dir):
    """A row a type and day that has events: as many rows as days, whatever the number of events."""
    return events(spark, sf_dir).groupBy("event_type", "day").agg(F.count("*").alias("v"))


def lagged(spark, sf_dir, max_lag: int = 7):
    d = counts(spark, sf_dir)
    a = d.select(F.col("event_type").alias("leader"), F.col("v").alias("x"), "day")
    a = a.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("day", F.date_add("day", F.col("lag")))
    b = d.select(F.col("event_type").alias("follower"), F.col("v").alias("y"), "day")
    r = a.join(b, "day").where("leader <> follower").groupBy("leader", "follower", "lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    r = r.where("n >= 5 AND r IS NOT NULL AND NOT isnan(r)").withColumn("p", correlation_p(F.col("r"), F.col("n") - 2))
    return with_q(r, ["leader", "follower"], ["lag"])


@query(sql(SERIES + """, p AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d),
s AS (SELECT a.event_type, sum(sign(b.v - a.v)) AS s, quantile_cont((b.v - a.v) / (b.i - a.i), 0.5) AS slope FROM p a JOIN p b ON a.event_type = b.event_type AND a.i < b.i GROUP BY 1),
n AS (SELECT event_type, count(*) AS n FROM p GROUP BY 1), ties AS (SELECT event_type, sum(t * (t - 1) * (2 * t + 5)) AS tied FROM (SELECT event_type, v, count(*) AS t FROM p GROUP BY ALL) GROUP BY 1),
z AS (SELECT event_type, n, CAST(s AS BIGINT) AS s, slope, (n * (n - 1) * (2 * n + 5) - tied) / 18.0 AS var_s FROM s JOIN n USING (event_type) JOIN ties USING (event_type) WHERE n >= 10),
p2 AS (SELECT *, CASE WHEN var_s = 0 OR s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(var_s) END AS z FROM z), q AS (SELECT *, """ + normal_p_sql("z") + """ AS p FROM p2)
SELECT event_type, n, s, round(slope, 5) AS slope, round(p, 5) AS p, CASE WHEN p >= 0.05 THEN 'stable' WHEN s > 0 THEN 'rising' ELSE 'falling' END AS direction FROM q""", "ev"))
def trend_tests(spark, sf_dir):
    """Mann-Kendall S with tied variance, its normal p, Sen's slope and the verdict, of daily counts."""
    d = counts(spark, sf_dir)
    s = slopes.trend(d, "event_type", "day", "v").drop("n")
    t = d.groupBy("event_type", "v").agg(F.count("*").alias("t")).groupBy("event_type").agg(F.sum("t").alias("n"), F.sum(F.expr("t * (t - 1) * (2 * t + 5)")).alias("tied"))
    z = s.join(t, "event_type").where("n >= 10").withColumn("var_s", F.expr("(n * (n - 1) * (2 * n + 5) - tied) / 18.0D"))
    z = z.withColumn("z", F.when((F.col("var_s") == 0) | (F.col("s") == 0), F.lit(0.0)).otherwise((F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt("var_s"))).withColumn("p", normal_p(F.col("z")))
    verdict = F.when(F.col("p") >= 0.05, "stable").when(F.col("s") > 0, "rising").otherwise("falling")
    return z.select("event_type", "n", "s", F.round("slope", 5).alias("slope"), F.round("p", 5).alias("p"), verdict.alias("direction"))


@query(sql(LAGGED + """ SELECT leader, follower, lag, round(r, 4) AS r, round(p, 4) AS p, round(q, 4) AS q, q < 0.05 AS significant, n FROM tested""", "ev"))
def cross_correlation_tests(spark, sf_dir):
    """Pearson r at each lag with its t-test p, q over the family of lags, and the verdict."""
    return lagged(spark, sf_dir).select("leader", "follower", "lag", *[F.round(c, 4).alias(c) for c in ("r", "p", "q")], (F.col("q") < 0.05).alias("significant"), "n")


@query(sql(LAGGED + """ SELECT leader, follower, lag, round(r, 4) AS r, round(p, 4) AS p, round(q, 4) AS q, CAST(row_number() OVER (PARTITION BY leader, follower ORDER BY p, lag) AS INTEGER) AS place FROM tested WHERE lag > 0 AND q < 0.05""", "ev"))
def leading_signals(spark, sf_dir):
    """Lags by which one series leads another that survive the false discovery rate, by p; a correlation, not a cause."""
    place = F.row_number().over(Window.partitionBy("leader", "follower").orderBy("p", "lag"))
    kept = lagged(spark, sf_dir).where("lag > 0 AND q < 0.05")
    return kept.select("leader", "follower", "lag", *[F.round(c, 4).alias(c) for c in ("r", "p", "q")], place.alias("place"))


EFFECTIVE = SERIES + """, a AS (SELECT x.event_type AS a_type, y.event_type AS b_type, x.day, x.v AS x, y.v AS y FROM d x JOIN d y ON x.day = y.day AND x.event_type < y.event_type),
g AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM a WINDOW w AS (PARTITION BY a_type, b_type ORDER BY day)),
c AS (SELECT a_type, b_type, count(*) AS n, corr(x, y) AS r, corr(x, px) AS r1x, corr(y, py) AS r1y FROM g GROUP BY ALL HAVING count(*) >= 10),
e AS (SELECT *, CASE WHEN r1x * r1y > 0 THEN greatest(5, least(n * (1 - r1x * r1y) / (1 + r1x * r1y), n)) ELSE n END AS n_eff FROM c)"""


def paired(spark, sf_dir):
    """Correlation and lag-one autocorrelations of every pair of types over their common days."""
    d = counts(spark, sf_dir)
    a, b = d.select("day", F.col("event_type").alias("a_type"), F.col("v").alias("x")), d.select("day", F.col("event_type").alias("b_type"), F.col("v").alias("y"))
    w = Window.partitionBy("a_type", "b_type").orderBy("day")
    g = a.join(b, "day").where("a_type < b_type").withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    c = g.groupBy("a_type", "b_type").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.corr("x", "px").alias("r1x"), F.corr("y", "py").alias("r1y")).where("n >= 10")
    return c.withColumn("n_eff", effective_n(F.col("n"), F.col("r1x"), F.col("r1y")))


@query(sql(EFFECTIVE + """ SELECT a_type, b_type, n, round(r1x, 4) AS r1x, round(r1y, 4) AS r1y, round(n_eff, 3) AS n_eff FROM e""", "ev"))
def effective_sizes(spark, sf_dir):
    """Effective sample size of each pair of series from their lag-one autocorrelations."""
    return paired(spark, sf_dir).select("a_type", "b_type", "n", F.round("r1x", 4).alias("r1x"), F.round("r1y", 4).alias("r1y"), F.round("n_eff", 3).alias("n_eff"))


@query(sql(EFFECTIVE + """, f AS (SELECT *, greatest(CAST(round(n_eff, 6) AS BIGINT) - 2, 1) AS df FROM e) SELECT a_type, b_type, n, round(r, 4) AS r, round(""" + correlation_p_sql("r", "(n - 2)") + """, 4) AS p_naive, round(""" + correlation_p_sql("r", "df") + """, 4) AS p FROM f""", "ev"))
def corrected_correlations(spark, sf_dir):
    """Pearson r with its plain p and the p at the effective sample size."""
    c = paired(spark, sf_dir).withColumn("df", F.greatest(F.round(F.round("n_eff", 6)).cast("long") - 2, F.lit(1)))
    c = c.select("a_type", "b_type", "n", "r", correlation_p(F.col("r"), F.col("n") - 2).alias("p_naive"), correlation_p(F.col("r"), F.col("df")).alias("p"))
    return c.select("a_type", "b_type", "n", *[F.round(x, 4).alias(x) for x in ("r", "p_naive", "p")])


#: Values with their counts: ranks are taken over distinct values, never over all rows of a cohort.
VALUES = """WITH v AS (SELECT event_type, value AS v, count(*) AS k FROM ev WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT DISTINCT event_type AS cohort FROM v),
g AS (SELECT cohort, v, sum(k) FILTER (WHERE event_type = cohort) AS own, sum(k) AS every FROM t, v GROUP BY ALL),
c AS (SELECT cohort, v, coalesce(own, 0) AS own, every, sum(every) OVER (PARTITION BY cohort ORDER BY v) - every AS below FROM g),
m AS (SELECT cohort, sum(own) AS n1, sum(every) - sum(own) AS n2, sum(own * (below + (every + 1) / 2.0)) AS ranks, sum(every * every * every - every) AS ties FROM c GROUP BY 1),
z AS (SELECT cohort, n1, n2, ranks - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 / 12.0 * n2 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd FROM m WHERE n1 > 0 AND n2 > 0),
s AS (SELECT *, (u - n1 * n2 / 2.0) / nullif(sd, 0) AS z FROM z), w AS (SELECT *, 1 AS family, """ + normal_p_sql("z") + """ AS p FROM s WHERE z IS NOT NULL)"""


def rank_tests(held):
    """cohort, n1, n2, u, z, p, q of each cohort against the rest, from values in stretches."""
    z = ranks.rank_sums(held).withColumn("z", F.expr("(u - n1 * n2 / 2.0D) / nullif(sd, 0D)")).where("z IS NOT NULL")
    return with_q(z.withColumn("family", F.lit(1)).withColumn("p", normal_p(F.col("z"))), ["family"], ["cohort"])


@query(sql(VALUES + ", tested AS (" + with_q_sql("w", "family", "cohort") + """) SELECT cohort, CAST(n1 AS BIGINT) AS n, CAST(n2 AS BIGINT) AS n_rest, round(u, 1) AS u, round(2 * u / n1 / n2 - 1, 4) AS cliffs_delta, round(p, 4) AS p, round(q, 4) AS q FROM tested""", "ev"))
def cohort_rank_tests(spark, sf_dir):
    """The rank test of M12: each cohort against the rest by Mann-Whitney with ties, Cliff's delta and q; ranks over the values themselves."""
    t = rank_tests(ranks.in_stretches(events(spark, sf_dir), "event_type", "value"))
    return t.select("cohort", F.col("n1").alias("n"), F.col("n2").alias("n_rest"), F.round("u", 1).alias("u"), F.round(F.expr("2 * u / n1 / n2 - 1"), 4).alias("cliffs_delta"), F.round("p", 4).alias("p"), F.round("q", 4).alias("q"))


#: Units are twelve groups of users: thousandths summed, so that every sum below is a whole number; a type's difference is its later half of the month less its earlier one.
UNITS = """WITH u AS (SELECT event_type, CAST(user_id % 12 AS INTEGER) AS unit, sum(CAST(floor(value * 1000) AS BIGINT)) FILTER (WHERE day_of < 15) AS before, sum(CAST(floor(value * 1000) AS BIGINT)) FILTER (WHERE day_of >= 15) AS after
FROM (SELECT *, day(day) - 1 AS day_of FROM ev) GROUP BY ALL), x AS (SELECT event_type, unit, CAST(coalesce(after, 0) - coalesce(before, 0) AS BIGINT) AS delta, CAST(coalesce(after, 0) + coalesce(before, 0) AS BIGINT) AS total FROM u)"""
#: The same with every user as a unit.
USERS = UNITS.replace("CAST(user_id % 12 AS INTEGER)", "user_id")


def units(spark, sf_dir, unit=None):
    e = events(spark, sf_dir).withColumn("w", F.floor(F.col("value") * 1000).cast("long")).withColumn("late", F.dayofmonth("day") > 15)
    unit = (F.col("user_id") % 12).cast("int") if unit is None else F.col(unit)
    return e.groupBy("event_type", unit.alias("unit")).agg(F.sum(F.when(F.col("late"), F.col("w")).otherwise(-F.col("w"))).alias("delta"), F.sum("w").alias("total"))


@query(sql(UNITS + """, m AS (SELECT unnest(range(0, 4096)) AS mask), s AS (SELECT event_type, mask, abs(sum(CASE WHEN (mask >> unit) & 1 = 1 THEN -delta ELSE delta END)) AS total, abs(sum(delta)) AS seen, count(*) AS n FROM x, m GROUP BY ALL)
SELECT event_type, max(n) AS pairs, round(count(*) FILTER (WHERE total >= seen) / 4096.0, 6) AS p, 'exact' AS method FROM s GROUP BY event_type""", "ev"))
def sign_flip_tests(spark, sf_dir):
    """Exact sign-flip p of paired differences, for any number of pairs; its SQL counts all flips of twelve."""
    t = resampling.sign_flip_p(units(spark, sf_dir), "event_type", "unit", "delta")
    return t.select("event_type", "pairs", F.round("p", 6).alias("p"), "method")


@query(sql(UNITS + """, m AS (SELECT unnest(range(0, 4096)) AS mask), s AS (SELECT event_type, mask, abs(sum(CASE WHEN (mask >> unit) & 1 = 1 THEN total ELSE -total END)) AS t, abs(sum(CASE WHEN unit < 6 THEN total ELSE -total END)) AS seen, count(*) AS n FROM x, m WHERE bit_count(mask) = 6 GROUP BY ALL)
SELECT event_type, max(n) AS units, round(count(*) FILTER (WHERE t >= seen) * 1.0 / count(*), 6) AS p, 'exact' AS method FROM s GROUP BY event_type""", "ev"))
def exact_permutation_tests(spark, sf_dir):
    """The exact form of M21, for any number of units; its SQL counts all ways to choose six of twelve as the treated ones."""
    t = resampling.permutation_p(units(spark, sf_dir).withColumn("treated", F.col("unit") < 6), "event_type", "treated", "total")
    return t.select("event_type", "units", F.round("p", 6).alias("p"), "method")


@query(sql(UNITS + """, m AS (SELECT unnest(range(0, 4096)) AS mask), k AS (SELECT mask FROM m WHERE bit_count(mask & 1365) = 2 AND bit_count(mask & 2730) = 2),
s AS (SELECT event_type, mask, abs(sum(CASE WHEN (mask >> unit) & 1 = 1 THEN 2 * total ELSE -total END)) AS t, abs(sum(CASE WHEN unit < 4 THEN 2 * total ELSE -total END)) AS seen, count(*) AS n FROM x, k GROUP BY ALL)
SELECT event_type, max(n) AS units, round(count(*) FILTER (WHERE t >= seen) * 1.0 / count(*), 6) AS p, 'exact' AS method FROM s GROUP BY event_type""", "ev"))
def stratified_permutation_tests(spark, sf_dir):
    """Exact permutation within strata of any sizes; its SQL counts all ways to treat two of six units in each of two strata."""
    x = units(spark, sf_dir).withColumn("stratum", F.col("unit") % 2).withColumn("treated", F.col("unit") < 4)
    t = resampling.permutation_p(x, "event_type", "treated", "total", "stratum")
    return t.select("event_type", "units", F.round("p", 6).alias("p"), "method")


LOW, HIGH = (1 + i for i in resampling.tails(0.95, 1000))


@query(sql(USERS + """, y AS (SELECT event_type, delta, row_number() OVER (PARTITION BY event_type ORDER BY unit) - 1 AS spot, count(*) OVER (PARTITION BY event_type) AS n FROM x),
d AS (SELECT event_type, rep, """ + resampling.draw_sql("n", "'0'", "rep", "place") + """ AS spot FROM (SELECT event_type, rep, n, unnest(range(0, n)) AS place FROM (SELECT DISTINCT event_type, n FROM y), (SELECT unnest(range(0, 1000)) AS rep))),
b AS (SELECT event_type, rep, avg(delta) AS mean FROM d JOIN y USING (event_type, spot) GROUP BY ALL), o AS (SELECT event_type, count(*) AS pairs, avg(delta) AS delta FROM y GROUP BY 1)
SELECT event_type, max(pairs) AS pairs, round(max(o.delta), 2) AS delta, round(list_sort(list(b.mean))[""" + f"{LOW}], 2) AS low, round(list_sort(list(b.mean))[{HIGH}" + """], 2) AS high FROM b JOIN o USING (event_type) GROUP BY event_type""", "ev"))
def paired_bootstraps(spark, sf_dir):
    """Seeded bootstrap of the mean paired difference of all users: 1,000 draws of as many pairs as there are, 95 per cent interval."""
    b = resampling.paired_bootstrap(units(spark, sf_dir, "user_id"), "event_type", "unit", "delta")
    return b.select("event_type", "pairs", *[F.round(c, 2).alias(c) for c in ("delta", "low", "high")])


@query(sql(USERS + """, y AS (SELECT event_type, unit % 5 AS stratum, unit, unit % 3 = 0 AS arm, total FROM x), s0 AS (SELECT event_type, stratum, count(*) FILTER (WHERE arm) AS n_t, count(*) FILTER (WHERE NOT arm) AS n_c, avg(total) FILTER (WHERE arm) - avg(total) FILTER (WHERE NOT arm) AS gap FROM y GROUP BY ALL),
s AS (SELECT *, least(n_t, n_c) AS weight, row_number() OVER (PARTITION BY event_type ORDER BY stratum) - 1 AS s, count(*) OVER (PARTITION BY event_type) AS strata FROM s0 WHERE n_t > 0 AND n_c > 0),
z AS (SELECT event_type, s, arm, total, row_number() OVER (PARTITION BY event_type, s, arm ORDER BY unit) - 1 AS spot FROM y JOIN s USING (event_type, stratum)),
q AS (SELECT event_type, rep, slot, """ + resampling.draw_sql("strata", "'0'", "rep", "slot") + """ AS s FROM (SELECT event_type, strata, rep, unnest(range(0, strata)) AS slot FROM (SELECT DISTINCT event_type, strata FROM s), (SELECT unnest(range(0, 1000)) AS rep))),
a AS (SELECT q.*, weight, arm, CASE WHEN arm THEN n_t ELSE n_c END AS n FROM q JOIN s USING (event_type, s), (SELECT unnest([true, false]) AS arm)),
d AS (SELECT event_type, rep, slot, s, weight, arm, """ + resampling.draw_sql("n", "'0'", "rep", "slot", "CAST(arm AS INTEGER)", "place") + """ AS spot FROM (SELECT *, unnest(range(0, n)) AS place FROM a)),
m AS (SELECT event_type, rep, slot, weight, avg(total) FILTER (WHERE arm) - avg(total) FILTER (WHERE NOT arm) AS gap FROM d JOIN z USING (event_type, s, arm, spot) GROUP BY ALL),
b AS (SELECT event_type, rep, sum(weight * gap) / sum(weight) AS mean FROM m GROUP BY ALL), o AS (SELECT event_type, count(*) AS strata, sum(weight * gap) / sum(weight) AS delta FROM s GROUP BY 1)
SELECT event_type, max(strata) AS strata, round(max(o.delta), 2) AS delta, round(list_sort(list(b.mean))[""" + f"{LOW}], 2) AS low, round(list_sort(list(b.mean))[{HIGH}" + """], 2) AS high FROM b JOIN o USING (event_type) GROUP BY event_type""", "ev"))
def stratified_bootstraps(spark, sf_dir):
    """Seeded blocked bootstrap: 1,000 draws of strata, and of each arm's units within, weighted by the smaller arm; 95 per cent interval."""
    x = units(spark, sf_dir, "user_id").withColumn("stratum", F.col("unit") % 5).withColumn("treated", F.col("unit") % 3 == 0)
    b = resampling.stratified_bootstrap(x, "event_type", "stratum", "unit", "treated", "total")
    return b.select("event_type", "strata", *[F.round(c, 2).alias(c) for c in ("delta", "low", "high")])


#: A day's outcome: purchases; what may move it: a genre's minutes, a weighted mean of a feature.
OUTCOME = "o AS (SELECT day, count(*) FILTER (WHERE event_type = 'purchase') AS y FROM ev GROUP BY 1)"


def outcome(spark, sf_dir):
    return events(spark, sf_dir).groupBy("day").agg(F.count_if(F.col("event_type") == "purchase").alias("y"))


@query(sql("WITH " + OUTCOME + """, g AS (SELECT day, 'g' || user_id % 3 AS genre, CAST(sum(floor(value)) AS BIGINT) AS x FROM ev WHERE event_type = 'view' GROUP BY ALL), r AS (SELECT genre, count(*) AS n, corr(x, y) AS r FROM g JOIN o USING (day) GROUP BY 1 HAVING count(*) >= 5),
t AS (SELECT *, 1 AS family, """ + correlation_p_sql("r", "(n - 2)") + " AS p FROM r), tested AS (" + with_q_sql("t", "family", "genre") + ") SELECT genre, n, round(r, 4) AS r, round(p, 4) AS p, round(q, 4) AS q FROM tested", "ev"))
def genre_outcomes(spark, sf_dir):
    """Each genre's daily minutes against the day's outcome, with p and q over genres."""
    g = events(spark, sf_dir).where("event_type = 'view'").groupBy("day", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("genre")).agg(F.sum(F.floor("value")).alias("x"))
    r = g.join(outcome(spark, sf_dir), "day").groupBy("genre").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).where("n >= 5")
    t = with_q(r.withColumn("family", F.lit(1)).withColumn("p", correlation_p(F.col("r"), F.col("n") - 2)), ["family"], ["genre"])
    return t.select("genre", "n", *[F.round(c, 4).alias(c) for c in ("r", "p", "q")])


@query(sql("WITH " + OUTCOME + """, f AS (SELECT day, sum(value * (user_id % 7)) / sum(value) AS x FROM ev WHERE event_type = 'view' AND value > 0 GROUP BY 1), c AS (SELECT day, x, y, lag(x) OVER (ORDER BY day) AS px, lag(y) OVER (ORDER BY day) AS py FROM f JOIN o USING (day)),
r AS (SELECT count(*) AS n, corr(x, y) AS r, corr(x, px) AS r1x, corr(y, py) AS r1y FROM c), e AS (SELECT *, CASE WHEN r1x * r1y > 0 THEN greatest(5, least(n * (1 - r1x * r1y) / (1 + r1x * r1y), n)) ELSE n END AS n_eff FROM r), d AS (SELECT *, greatest(CAST(round(n_eff, 6) AS BIGINT) - 2, 1) AS df FROM e)
SELECT n, round(r, 4) AS r, round(n_eff, 3) AS n_eff, round(""" + correlation_p_sql("r", "df") + ", 4) AS p FROM d", "ev"))
def feature_outcomes(spark, sf_dir):
    """A day's weighted feature mean against its outcome, p at the effective sample size."""
    v = events(spark, sf_dir).where("event_type = 'view' AND value > 0").groupBy("day").agg((F.sum(F.col("value") * (F.col("user_id") % 7)) / F.sum("value")).alias("x"))
    w = Window.orderBy("day")  # a row a day
    c = v.join(outcome(spark, sf_dir), "day").withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    r = c.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.corr("x", "px").alias("r1x"), F.corr("y", "py").alias("r1y")).withColumn("n_eff", effective_n(F.col("n"), F.col("r1x"), F.col("r1y")))
    r = r.withColumn("p", correlation_p(F.col("r"), F.greatest(F.round(F.round("n_eff", 6)).cast("long") - 2, F.lit(1))))
    return r.select("n", F.round("r", 4).alias("r"), F.round("n_eff", 3).alias("n_eff"), F.round("p", 4).alias("p"))

"""Fits, forecasts, calibration, rhythms and coverage over days; shapes of keys and times."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.functions.times import parse_web_time
from daybook.operators.dedup import merge_islands
from daybook.operators.models import balanced_probability, cluster_rows, forest_forecast, smooth_states
from daybook.operators.quantiles import percentiles
from daybook.plans.registry import registry
from daybook.plans.stats import DAILY, daily
from daybook.sources.shared import cut, shared_dir
from daybook.sources.tables import commits, events, spans, sql, table

REGISTRY, query = registry()
HOUR, DAY, START = 3_600_000_000, 86_400_000_000, 1_704_067_200_000_000
HELD = DAILY + """, x AS (SELECT event_type, n, v, date_diff('day', DATE '2024-01-01', day) AS z FROM d),
c AS (SELECT event_type, count(*) AS k, corr(n, v) AS rxy, corr(n, z) AS rxz, corr(v, z) AS ryz FROM x GROUP BY event_type HAVING count(*) >= 10) """


def moments(spark, sf_dir):
    """Correlations of daily mean, count and time of each kind: all that the closed forms need."""
    x = daily(spark, sf_dir).withColumn("z", F.datediff("day", F.lit("2024-01-01").cast("date")))
    return x.groupBy("event_type").agg(F.count("*").alias("k"), F.corr("n", "v").alias("rxy"), F.corr("n", "z").alias("rxz"), F.corr("v", "z").alias("ryz")).where("k >= 10")


@query(sql(HELD + """SELECT event_type, round((rxy - rxz * ryz) / sqrt((1 - rxz * rxz) * (1 - ryz * ryz)), 4) AS partial_r, k FROM c""", "ev"))
def partial_correlation(spark, sf_dir):
    """Correlation of what a line over time leaves of two series."""
    r = (F.col("rxy") - F.col("rxz") * F.col("ryz")) / F.sqrt((1 - F.col("rxz") ** 2) * (1 - F.col("ryz") ** 2))
    return moments(spark, sf_dir).select("event_type", F.round(r, 4).alias("partial_r"), "k")


@query(sql(HELD + """, s AS (SELECT event_type, 'n' AS features, 1 AS p, rxy * rxy AS r2, k FROM c UNION ALL SELECT event_type, 'day', 1, ryz * ryz, k FROM c
UNION ALL SELECT event_type, 'n+day', 2, (rxy * rxy + ryz * ryz - 2 * rxy * ryz * rxz) / (1 - rxz * rxz), k FROM c), a AS (SELECT event_type, features, 1 - (1 - r2) * (k - 1) / (k - p - 1) AS adj FROM s)
SELECT event_type, features, round(adj, 4) AS adj_r2, row_number() OVER (PARTITION BY event_type ORDER BY adj DESC, features) AS place FROM a""", "ev"))
def feature_subsets(spark, sf_dir):
    """Feature subsets ranked by adjusted R squared, from pairwise correlations alone."""
    a, b, c = F.col("rxy"), F.col("ryz"), F.col("rxz")
    fits = [("n", 1, a * a), ("day", 1, b * b), ("n+day", 2, (a * a + b * b - 2 * a * b * c) / (1 - c * c))]
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("features"), F.lit(p).alias("p"), r2.alias("r2")) for f, p, r2 in fits])).alias("f")
    s = moments(spark, sf_dir).select("event_type", "k", rows).select("event_type", "f.features", (1 - (1 - F.col("f.r2")) * (F.col("k") - 1) / (F.col("k") - F.col("f.p") - 1)).alias("adj"))
    w = Window.partitionBy("event_type").orderBy(F.desc("adj"), "features")
    return s.select("event_type", "features", F.round("adj", 4).alias("adj_r2"), F.row_number().over(w).cast("long").alias("place"))


@query(sql(DAILY + """, l AS (SELECT event_type, v AS x, lead(v) OVER w AS y, percent_rank() OVER w AS place FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
f AS (SELECT event_type, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM l WHERE y IS NOT NULL AND place < 0.8 GROUP BY event_type)
SELECT event_type, count(*) AS n_test, round(max(slope), 4) AS slope, round(avg(abs(y - base - slope * x)), 4) AS mae FROM l JOIN f USING (event_type) WHERE y IS NOT NULL AND place >= 0.8 GROUP BY event_type""", "ev"))
def next_day_forecast(spark, sf_dir):
    """The next day from this one, fitted on the first four fifths, judged on the rest."""
    w = Window.partitionBy("event_type").orderBy("day")
    l = daily(spark, sf_dir).select("event_type", F.col("v").alias("x"), F.lead("v").over(w).alias("y"), F.percent_rank().over(w).alias("place")).where("y IS NOT NULL")
    early = F.col("place") < 0.8
    both = lambda c: F.when(early, F.col(c))
    f = l.groupBy("event_type").agg(F.regr_slope(both("y"), both("x")).alias("slope"), F.regr_intercept(both("y"), both("x")).alias("base"))
    miss = F.abs(F.col("y") - F.col("base") - F.col("slope") * F.col("x"))
    return l.where(~early).join(f, "event_type").groupBy("event_type").agg(F.count("*").alias("n_test"), F.round(F.max("slope"), 4).alias("slope"), F.round(F.avg(miss), 4).alias("mae"))


@query(sql("""WITH x AS (SELECT *, ("at" - 1704067200000000) / 3.6e9 AS x FROM ev), f AS (SELECT event_type, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM x GROUP BY event_type),
r AS (SELECT event_type, user_id, "at", value - a - b * x AS e FROM x JOIN f USING (event_type)), s AS (SELECT event_type, stddev_pop(e) AS sd FROM r GROUP BY event_type),
k AS (SELECT event_type, user_id, "at", lag("at") OVER (PARTITION BY event_type, user_id ORDER BY "at") AS p FROM r JOIN s USING (event_type) WHERE abs(e) > 1.2 * sd),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR "at" - p > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY "at") AS island FROM k)
SELECT event_type, user_id, min("at") AS start, max("at") AS "end", count(*) AS n FROM g GROUP BY event_type, user_id, island HAVING count(*) >= 2""", "ev"))
def residual_periods(spark, sf_dir):
    """Runs of rows far from their kind's line over time."""
    x = events(spark, sf_dir).withColumn("x", (F.col("at") - START) / 3.6e9)
    f = x.groupBy("event_type").agg(F.regr_slope("value", "x").alias("b"), F.regr_intercept("value", "x").alias("a"))
    r = x.join(f, "event_type").withColumn("e", F.col("value") - F.col("a") - F.col("b") * F.col("x"))
    s = r.groupBy("event_type").agg(F.stddev_pop("e").alias("sd"))
    far = r.join(s, "event_type").where("abs(e) > 1.2 * sd").select("event_type", "user_id", F.col("at").alias("start"), F.col("at").alias("end"))
    return merge_islands(far, ["event_type", "user_id"], 48 * HOUR).where("n >= 2").select("event_type", "user_id", "start", "end", "n")


@query("""WITH l AS (SELECT l_suppkey AS grp, l_quantity AS x, l_extendedprice AS y FROM lineitem), a AS (SELECT grp, greatest(sum(x * y) / sum(x * x), 0) AS k FROM l GROUP BY grp),
r AS (SELECT grp, x, y, y - k * x AS e FROM l JOIN a USING (grp)), m AS (SELECT grp, median(e) AS med FROM r GROUP BY grp), q AS (SELECT grp, max(med) AS med, median(abs(e - med)) AS mad FROM r JOIN m USING (grp) GROUP BY grp),
t AS (SELECT grp, x, y, abs(e - med) <= 3 * mad AS near FROM r JOIN q USING (grp))
SELECT grp, count(*) AS n, count(*) FILTER (WHERE near) AS n_kept, round(greatest(sum(x * y) FILTER (WHERE near) / sum(x * x) FILTER (WHERE near), 0), 3) AS slope FROM t GROUP BY grp
HAVING count(*) >= 20 AND count(*) FILTER (WHERE near) >= 0.7 * count(*)""")
def calibration(spark, sf_dir):
    """Slope of at least zero through the origin, refitted once without what lies beyond three MADs; refused where few rows are left."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    slope = lambda x, y: F.greatest(F.sum(x * y) / F.sum(x * x), F.lit(0.0))
    x, y = F.col("x"), F.col("y")
    r = cut(l.join(l.groupBy("grp").agg(slope(x, y).alias("k")), "grp").select("grp", "x", "y", (y - F.col("k") * x).alias("e")))  # read by both medians
    r = r.join(percentiles(r, ["grp"], "e", {"med": 0.5}).select("grp", "med"), "grp").withColumn("off", F.abs(F.col("e") - F.col("med")))
    near = F.col("off") <= 3 * F.col("mad")
    t = r.join(percentiles(r, ["grp"], "off", {"mad": 0.5}).select("grp", "mad"), "grp").withColumn("near", near)
    kept = F.when(F.col("near"), x), F.when(F.col("near"), y)
    fit = t.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("near").alias("n_kept"), F.round(slope(*kept), 3).alias("slope"))
    return fit.where("n >= 20 AND n_kept >= 0.7 * n")


@query(sql("""WITH s AS (SELECT event_type, floor(value) AS score, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS hits FROM ev WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT event_type, score, CAST(sum(hits) OVER w AS BIGINT) AS hits, CAST(sum(n) OVER w AS BIGINT) AS n FROM s WINDOW w AS (PARTITION BY event_type ORDER BY score DESC))
SELECT event_type, CAST(min(score) AS BIGINT) AS threshold, arg_min(n, score) AS n FROM r WHERE hits >= 0.5 * n GROUP BY event_type""", "ev"))
def threshold_for_precision(spark, sf_dir):
    """Smallest cut-off with the target precision; scores are counted before they are sorted."""
    e = events(spark, sf_dir).where("value IS NOT NULL")
    s = e.groupBy("event_type", F.floor("value").alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 2 == 0).alias("hits"))
    w = Window.partitionBy("event_type").orderBy(F.desc("score"))
    r = s.select("event_type", "score", F.sum("hits").over(w).alias("hits"), F.sum("n").over(w).alias("n")).where("hits >= 0.5 * n")
    return r.groupBy("event_type").agg(F.min("score").cast("long").alias("threshold"), F.min_by("n", "score").alias("n"))


@query(sql("""SELECT event_type, "at" // 3600000000 AS hour_no, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS peak FROM ev GROUP BY ALL""", "ev"))
def hourly_aggregates(spark, sf_dir):
    """Hourly buckets; absent hours stay absent."""
    hour = F.expr(f"at div {HOUR}").alias("hour_no")
    return events(spark, sf_dir).groupBy("event_type", hour).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("peak"))


@query(sql("""WITH g AS (SELECT user_id, day, "at" - lag("at") OVER (PARTITION BY user_id, day ORDER BY "at") AS gap FROM ev)
SELECT user_id, day, count(*) AS n, coalesce(max(gap), 0) AS longest_gap, CASE WHEN count(*) < 2 THEN 'sparse' WHEN max(gap) >= 28800000000 THEN 'offline_part' ELSE 'present' END AS presence FROM g GROUP BY user_id, day""", "ev"))
def presence_daily(spark, sf_dir):
    """Daily totals and whether a long gap splits the day."""
    g = events(spark, sf_dir).withColumn("gap", F.col("at") - F.lag("at").over(Window.partitionBy("user_id", "day").orderBy("at")))
    d = g.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))
    return d.withColumn("presence", F.when(F.col("n") < 2, "sparse").when(F.col("longest_gap") >= 8 * HOUR, "offline_part").otherwise("present"))


@query(sql("""WITH h AS (SELECT DISTINCT user_id, "at" // 86400000000 AS d, "at" // 3600000000 % 24 AS hr FROM ev), c AS (SELECT user_id, d, count(*) AS n FROM h GROUP BY ALL),
p AS (SELECT a.user_id, a.d, a.n + b.n AS n FROM c a JOIN c b ON a.user_id = b.user_id AND b.d = a.d + 1), m AS (SELECT a.user_id, a.d, count(*) AS common FROM h a JOIN h b ON a.user_id = b.user_id AND b.d = a.d + 1 AND a.hr = b.hr GROUP BY ALL)
SELECT user_id, count(*) AS day_pairs, round(sum(24 - (n - 2 * coalesce(common, 0))) / (24e0 * count(*)), 4) AS regularity FROM p LEFT JOIN m USING (user_id, d) GROUP BY user_id""", "ev"))
def sleep_regularity(spark, sf_dir):
    """Share of hours in the same state a day later, over pairs of tracked days; a day's hours are bits of one number."""
    bits = F.bit_or(F.expr(f"shiftleft(1, cast(at div {HOUR} % 24 as int))"))
    d = events(spark, sf_dir).groupBy("user_id", F.expr(f"at div {DAY}").alias("d")).agg(bits.alias("hours"))
    w = Window.partitionBy("user_id").orderBy("d")
    p = d.withColumn("before", F.when(F.lag("d").over(w) == F.col("d") - 1, F.lag("hours").over(w))).where("before IS NOT NULL")
    return p.groupBy("user_id").agg(F.count("*").alias("day_pairs"), F.round(F.sum(24 - F.bit_count(F.col("hours").bitwiseXOR(F.col("before")))) / (24.0 * F.count("*")), 4).alias("regularity"))


@query(sql("""WITH h AS (SELECT event_type, "at" // 3600000000 % 24 AS hour, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT event_type, (hour + d + 24) % 24 AS hour, CAST(sum(n) AS BIGINT) AS total FROM h, (SELECT unnest([-1, 0, 1]) AS d) GROUP BY ALL)
SELECT event_type, CAST(arg_min(hour, total * 100 + hour) AS BIGINT) AS phase_hour, round(min(total) / 3e0, 4) AS level FROM s GROUP BY event_type""", "ev"))
def circadian_phase(spark, sf_dir):
    """Quietest hour after smoothing over three; ties to the earlier hour, hours with nothing near are left out."""
    h = events(spark, sf_dir).groupBy("event_type", F.expr(f"at div {HOUR} % 24").alias("hour")).agg(F.count("*").alias("n"))
    s = h.withColumn("d", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).groupBy("event_type", ((F.col("hour") + F.col("d") + 24) % 24).alias("hour")).agg(F.sum("n").alias("total"))
    return s.groupBy("event_type").agg(F.min_by("hour", F.struct("total", "hour")).cast("long").alias("phase_hour"), F.round(F.min("total") / 3.0, 4).alias("level"))


@query(sql("""WITH u AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM ev GROUP BY user_id), s AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM u),
e AS (SELECT user_id, day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad, count(*) FILTER (WHERE event_type = 'purchase') AS good FROM ev GROUP BY ALL)
SELECT user_id, day, CASE WHEN n IS NULL THEN 'unknown_no_sensor' WHEN good > 0 AND bad > 0 THEN 'ambiguous' WHEN good > 0 THEN 'evidenced_awake' WHEN bad > 0 THEN 'evidenced_sleep_unrecorded'
WHEN n >= 3 THEN 'tracked' ELSE 'unknown_no_pc_evidence' END AS state FROM s LEFT JOIN e USING (user_id, day)""", "ev"))
def classify_coverage(spark, sf_dir):
    """Every date between a key's first and last gets one state by layered evidence."""
    v = events(spark, sf_dir)
    kinds = [F.count_if(F.col("event_type") == k).alias(n) for k, n in (("error", "bad"), ("purchase", "good"))]
    e = v.groupBy("user_id", "day").agg(F.count("*").alias("n"), *kinds)
    s = e.groupBy("user_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("user_id", F.explode(F.sequence("lo", "hi")).alias("day"))
    good, bad = F.col("good") > 0, F.col("bad") > 0
    state = F.when(F.col("n").isNull(), "unknown_no_sensor").when(good & bad, "ambiguous").when(good, "evidenced_awake").when(bad, "evidenced_sleep_unrecorded").when(F.col("n") >= 3, "tracked")
    return s.join(e, ["user_id", "day"], "left").select("user_id", "day", state.otherwise("unknown_no_pc_evidence").alias("state"))


@query(sql("""WITH o AS (SELECT user_id, start, "end", max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o),
i AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY user_id, island)
SELECT user_id, start // 86400000000 AS night, count(*) - 1 AS naps, max("end" - start) AS main_us, CAST(sum("end" - start) AS BIGINT) AS total_us FROM i GROUP BY ALL""", "spans"))
def night_composites(spark, sf_dir):
    """Segments joined over short gaps; the longest of a night is its main episode, the rest are naps."""
    i = merge_islands(spans(spark, sf_dir).select("user_id", "start", "end"), ["user_id"], HOUR).withColumn("us", F.col("end") - F.col("start"))
    return i.groupBy("user_id", F.expr(f"start div {DAY}").alias("night")).agg((F.count("*") - 1).alias("naps"), F.max("us").alias("main_us"), F.sum("us").alias("total_us"))


@query(sql("""WITH d AS (SELECT user_id, greatest(value - lag(value) OVER (PARTITION BY user_id ORDER BY "at", event_id), 0) AS up FROM ev)
SELECT user_id, round(sum(up), 3) AS growth FROM d GROUP BY user_id ORDER BY growth DESC, user_id LIMIT 20""", "ev"))
def counter_growth(spark, sf_dir):
    """Keys with the most counter growth; a fall is a reset and counts nothing."""
    up = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    d = events(spark, sf_dir).withColumn("up", F.greatest(up, F.lit(0.0)))
    return d.groupBy("user_id").agg(F.round(F.sum("up"), 3).alias("growth")).orderBy(F.desc("growth"), "user_id").limit(20)


@query("""WITH e AS (SELECT l_partkey AS p_partkey, l_suppkey AS s_suppkey, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL ORDER BY weight DESC, p_partkey, s_suppkey LIMIT 50)
SELECT p_partkey, s_suppkey, weight, p_name, s_name FROM e LEFT JOIN part USING (p_partkey) LEFT JOIN supplier USING (s_suppkey)""")
def evidence_relations(spark, sf_dir):
    """Heaviest edges with their nodes' attributes; edges are ranked before anything is joined."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("weight"))
    top = F.broadcast(l.orderBy(F.desc("weight"), "p_partkey", "s_suppkey").limit(50))  # fifty rows
    part, supplier = table(spark, sf_dir, "part").select("p_partkey", "p_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return part.join(top, "p_partkey", "right").join(supplier, "s_suppkey", "left").select("p_partkey", "s_suppkey", "weight", "p_name", "s_name")


@query("""WITH c AS (SELECT role, length(coalesce(text, '')) AS chars, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT role, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (WHERE prev <> role) AS replies FROM c GROUP BY role""")
def speaker_stats(spark, sf_dir):
    """Turns, characters and replies to another speaker."""
    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    chars = F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars")
    return c.groupBy("role").agg(F.count("*").alias("n"), chars, F.count_if(F.col("prev") != F.col("role")).alias("replies"))


@query("""SELECT doc_id, sha256(lang || '|' || source) AS title_hash, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: starts_with(x, '>'))) AS quoted_lines,
len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT starts_with(x, '>'))) AS own_lines FROM documents""")
def quoted_lines(spark, sf_dir):
    """hash of a pair of names; own lines and quoted ones."""
    lines, quoted = F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.startswith(x, F.lit(">"))
    counts = [F.size(F.filter(lines, f)).cast("long").alias(n) for f, n in ((quoted, "quoted_lines"), (lambda x: ~quoted(x), "own_lines"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat("lang", F.lit("|"), "source"), 256).alias("title_hash"), *counts)


@query(sql("""SELECT strftime(day, '%Y-%m') AS "key", strftime(date_trunc('month', day) - INTERVAL 1 MONTH, '%Y-%m') AS prior, strftime(date_trunc('month', day) + INTERVAL 1 MONTH, '%Y-%m') AS next, count(*) AS n FROM commits GROUP BY ALL""", "commits"))
def period_keys(spark, sf_dir):
    """a month's key and its neighbours'."""
    month = commits(spark, sf_dir).groupBy(F.trunc("day", "month").alias("m")).agg(F.count("*").alias("n"))
    return month.select(*[F.date_format(F.add_months("m", k), "yyyy-MM").alias(n) for n, k in (("key", 0), ("prior", -1), ("next", 1))], "n")


@query(sql("""SELECT event_id, "at" FROM ev""", "ev"))
def timestamp_shapes(spark, sf_dir):
    """times written in three shapes are told apart by form and size."""
    e = events(spark, sf_dir)
    shapes = [F.col("at").cast("string"), (F.col("at") + 11_644_473_600_000_000).cast("string"), F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")]
    raw = F.when(F.col("event_id") % 3 == 0, shapes[0]).when(F.col("event_id") % 3 == 1, shapes[1]).otherwise(shapes[2])
    return e.select("event_id", parse_web_time(raw).alias("at"))


@query(sql("""SELECT day, count(*) AS n, round(sum(value), 3) AS total FROM ev GROUP BY day""", "ev"))
def lake_export(spark, sf_dir):
    """A lake partitioned by day, read back and counted from its files."""
    path = f"{shared_dir(spark)}/daybook-{uuid.uuid4().hex[:12]}/lake"
    events(spark, sf_dir).select("event_id", "value", "day").repartition("day").write.partitionBy("day").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def day_features(spark, sf_dir):
    """A row a user and day: counts, mean and next day's count."""
    e = events(spark, sf_dir)
    d = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("event_type").alias("kinds"))
    return d.withColumn("next_n", F.lead("n").over(Window.partitionBy("user_id").orderBy("day")))


@query()
def cluster_days(spark, sf_dir):
    """Days clustered by their features, lone states smoothed; random starts, no SQL."""
    found = cluster_rows(day_features(spark, sf_dir), ["n", "mean", "errors", "kinds"])
    return smooth_states(found, ["user_id"], "day", "cluster").select("user_id", "day", "cluster")


@query()
def forest_forecasts(spark, sf_dir):
    """Next day's count by a random forest, trained before 2024-01-24; random trees, no SQL."""
    early = F.col("day") < F.lit("2024-01-24").cast("date")
    return forest_forecast(day_features(spark, sf_dir), ["n", "mean", "errors", "kinds"], "next_n", early).select("user_id", "day", "next_n", "forecast")


@query()
def wake_blocks(spark, sf_dir):
    """A balanced classifier of hours trained on even days, its likely hours joined to blocks; fitted, no SQL."""
    e = events(spark, sf_dir)
    h = e.groupBy("user_id", F.expr(f"at div {HOUR}").alias("hour")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max((F.col("event_type") == "purchase").cast("int")).alias("label"))
    w = Window.partitionBy("user_id").orderBy("hour")
    h = h.withColumn("since", F.coalesce(F.col("hour") - F.lag("hour").over(w), F.lit(24)))
    scored = balanced_probability(h, ["n", "mean", "since"], "label", F.expr("hour div 24") % 2 == 0)
    likely = scored.where("probability >= 0.5").select("user_id", (F.col("hour") * HOUR).alias("start"), ((F.col("hour") + 1) * HOUR).alias("end"))
    return merge_islands(likely, ["user_id"], HOUR).select("user_id", "start", "end", "n")

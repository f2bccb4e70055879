"""Families of lagged correlations, and nights: exposure before them, their bounds, their gaps, sessions around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.functions.significance import correlation_p, correlation_p_sql, effective_n, with_q, with_q_sql
from daybook.operators.dedup import merge_islands
from daybook.operators.joins import interval_join
from daybook.operators.sessions import clip
from daybook.plans.registry import registry
from daybook.sources.tables import events, spans, sql

REGISTRY, query = registry()
MINUTE, HOUR = 60_000_000, 3_600_000_000
LEAST_PAIRS = 10
#: family, predictors, outcomes, greatest lag in days; a metric is a type's daily count (n), sum of values (sum) or distinct users (users).
FAMILIES = [
    ("lifestyle", ["purchase_n", "purchase_sum"], ["view_n", "view_sum"], 3),
    ("weather", ["signup_n", "signup_sum"], ["error_n", "error_sum", "error_users"], 3),
    ("mood", ["click_sum"], ["view_sum", "purchase_sum", "error_sum"], 2),
    ("architecture", ["view_n", "view_sum", "view_users"], ["purchase_n"], 1),
    ("exposure", ["click_n", "click_sum", "signup_n", "signup_sum", "purchase_n", "view_n"], ["error_sum"], 0),
    ("daytime_body", ["click_users"], ["error_users", "view_users"], 1),
    ("daytime_work", ["purchase_users"], ["error_users", "view_users"], 1),
    ("daytime_media", ["signup_users"], ["error_users", "view_users"], 1),
]
PLAN = [(f, p, o, lag) for f, ps, os, last in FAMILIES for p in ps for o in os for lag in range(last + 1)]
METRICS = """d AS (SELECT event_type, day, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL),
m AS (SELECT event_type || '_n' AS metric, day, n AS v FROM d UNION ALL SELECT event_type || '_sum', day, total FROM d UNION ALL SELECT event_type || '_users', day, users FROM d)"""


def metrics(spark, sf_dir):
    """metric, day, v: three rows a type and day, from one aggregate."""
    d = events(spark, sf_dir).groupBy("event_type", "day").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("sum"), F.countDistinct("user_id").alias("users"))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("v")) for c in ("n", "sum", "users")])).alias("k")
    return d.select("event_type", "day", kinds).select(F.concat("event_type", F.lit("_"), "k.kind").alias("metric"), "day", "k.v")


@query(sql("WITH " + METRICS + ", plan(family, predictor, outcome, lag) AS (VALUES " + ", ".join(map(str, PLAN)) + f"""),
r AS (SELECT family, predictor, outcome, lag, corr(a.v, b.v) AS r, count(*) AS n FROM plan JOIN m a ON a.metric = predictor JOIN m b ON b.metric = outcome AND b.day = a.day + lag GROUP BY ALL HAVING count(*) >= {LEAST_PAIRS}),
t AS (SELECT *, predictor || ' ' || outcome || ' ' || lag AS tie, """ + correlation_p_sql("r", "(n - 2)") + """ AS p FROM r WHERE r IS NOT NULL AND isfinite(r)), tested AS (""" + with_q_sql("t", "family", "tie") + """)
SELECT family, predictor, outcome, lag, n, round(r, 4) AS r, round(p, 4) AS p, round(q, 4) AS q, q < 0.05 AS significant FROM tested""", "ev"))
def family_correlations(spark, sf_dir):
    """Predictors against outcomes that many days later, r with p, and q over each family.

    Families by id: lifestyle (T26), weather (T27), mood (T28), architecture (T31), exposure (T33), the three of daytime (T34).
    The joins are over days and metrics, never events.
    """
    m = metrics(spark, sf_dir)
    plan = spark.createDataFrame(PLAN, "family string, predictor string, outcome string, lag int")  # FAMILIES, a fixed size
    a = m.select(F.col("metric").alias("predictor"), "day", F.col("v").alias("x"))
    b = m.select(F.col("metric").alias("outcome"), "day", F.col("v").alias("y"))
    pairs = a.join(F.broadcast(plan), "predictor").withColumn("day", F.date_add("day", F.col("lag"))).join(b, ["outcome", "day"])
    r = pairs.groupBy("family", "predictor", "outcome", "lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    r = r.where(f"n >= {LEAST_PAIRS} AND r IS NOT NULL AND NOT isnan(r)").withColumn("p", correlation_p(F.col("r"), F.col("n") - 2))
    r = with_q(r.withColumn("tie", F.concat_ws(" ", "predictor", "outcome", F.col("lag").cast("string"))), ["family"], ["tie"])
    return r.select("family", "predictor", "outcome", "lag", "n", *[F.round(c, 4).alias(c) for c in ("r", "p", "q")], (F.col("q") < 0.05).alias("significant"))


@query(sql(f"""WITH s AS (SELECT event_type, min(day) AS lo, max(day) AS hi FROM ev WHERE value >= 90 GROUP BY 1), spine AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
g AS (SELECT event_type, day, count(*) AS n FROM ev WHERE value >= 90 GROUP BY ALL), x AS (SELECT spine.*, coalesce(n, 0) AS dose FROM spine LEFT JOIN g USING (event_type, day)),
y AS (SELECT day, CAST(sum(floor(value)) AS BIGINT) AS v FROM ev WHERE value < 90 GROUP BY 1), l AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS lag),
r AS (SELECT event_type, lag, corr(dose, v) AS r, count(*) AS n FROM x, l JOIN y ON y.day = x.day + l.lag GROUP BY ALL HAVING count(*) >= {LEAST_PAIRS}),
t AS (SELECT *, """ + correlation_p_sql("r", "(n - 2)") + """ AS p FROM r WHERE r IS NOT NULL AND isfinite(r)), tested AS (""" + with_q_sql("t", "event_type", "lag") + """)
SELECT event_type AS substance, lag, n, round(r, 4) AS r, round(p, 4) AS p, round(q, 4) AS q FROM tested""", "ev"))
def logged_dose_correlations(spark, sf_dir):
    """Daily doses against later signals inside the logging period alone: a day without a dose counts as zero there, and not at all outside."""
    e = events(spark, sf_dir)
    doses = e.where("value >= 90").groupBy(F.col("event_type").alias("substance"), "day").agg(F.count("*").alias("n"))
    period = doses.groupBy("substance").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    x = period.join(doses, ["substance", "day"], "left").select("substance", "day", F.coalesce("n", F.lit(0)).alias("dose"))
    y = e.where("value < 90").groupBy("day").agg(F.sum(F.floor("value").cast("long")).alias("v"))
    later = x.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("day", F.date_add("day", F.col("lag"))).join(y, "day")
    r = later.groupBy("substance", "lag").agg(F.corr("dose", "v").alias("r"), F.count("*").alias("n")).where(f"n >= {LEAST_PAIRS} AND r IS NOT NULL AND NOT isnan(r)")
    r = with_q(r.withColumn("p", correlation_p(F.col("r"), F.col("n") - 2)), ["substance"], ["lag"])
    return r.select("substance", "lag", "n", *[F.round(c, 4).alias(c) for c in ("r", "p", "q")])


@query(sql("WITH " + METRICS + f""", a AS (SELECT x.metric AS score, y.metric AS signal, x.day, x.v AS x, y.v AS y FROM m x JOIN m y ON x.day = y.day AND x.metric LIKE '%\\_users' ESCAPE '\\' AND y.metric LIKE '%\\_sum' ESCAPE '\\'),
g AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM a WINDOW w AS (PARTITION BY score, signal ORDER BY day)),
c AS (SELECT score, signal, count(*) AS n, corr(x, y) AS r, corr(x, px) AS r1x, corr(y, py) AS r1y FROM g GROUP BY ALL HAVING count(*) >= {LEAST_PAIRS}),
e AS (SELECT *, CASE WHEN r1x * r1y > 0 THEN greatest(5, least(n * (1 - r1x * r1y) / (1 + r1x * r1y), n)) ELSE n END AS n_eff FROM c WHERE r IS NOT NULL AND isfinite(r)),
f AS (SELECT *, 1 AS family, score || ' ' || signal AS tie, greatest(CAST(round(n_eff, 6) AS BIGINT) - 2, 1) AS df FROM e), t AS (SELECT *, """ + correlation_p_sql("r", "df") + " AS p FROM f), tested AS (" + with_q_sql("t", "family", "tie") + """)
SELECT score, signal, n, round(n_eff, 3) AS n_eff, round(r, 4) AS r, round(p, 4) AS p, round(q, 4) AS q FROM tested""", "ev"))
def score_signal_correlations(spark, sf_dir):
    """Every score against every signal of its day, p at the effective sample size, q over all pairs."""
    m = metrics(spark, sf_dir)
    a = m.where("endswith(metric, '_users')").select(F.col("metric").alias("score"), "day", F.col("v").alias("x"))
    b = m.where("endswith(metric, '_sum')").select(F.col("metric").alias("signal"), "day", F.col("v").alias("y"))
    w = Window.partitionBy("score", "signal").orderBy("day")
    g = a.join(b, "day").withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    c = g.groupBy("score", "signal").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.corr("x", "px").alias("r1x"), F.corr("y", "py").alias("r1y"))
    c = c.where(f"n >= {LEAST_PAIRS} AND r IS NOT NULL AND NOT isnan(r)").withColumn("n_eff", effective_n(F.col("n"), F.col("r1x"), F.col("r1y")))
    c = c.withColumn("df", F.greatest(F.round(F.round("n_eff", 6)).cast("long") - 2, F.lit(1))).withColumn("p", correlation_p(F.col("r"), F.col("df")))
    t = with_q(c.withColumn("family", F.lit(1)).withColumn("tie", F.concat_ws(" ", "score", "signal")), ["family"], ["tie"])
    return t.select("score", "signal", "n", F.round("n_eff", 3).alias("n_eff"), *[F.round(x, 4).alias(x) for x in ("r", "p", "q")])


#: Disjoint stretches of a type's spans, by user.
ISLANDS = """i{n} AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY start, "end", event_id) AS k FROM (SELECT *, CASE WHEN start <= max("end")
OVER (PARTITION BY user_id ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM spans WHERE event_type = '{kind}' AND "end" > start)) GROUP BY user_id, k)"""


def stretches(spark, sf_dir, kind: str, start: str = "start", end: str = "end"):
    s = spans(spark, sf_dir).where((F.col("event_type") == kind) & (F.col("end") > F.col("start"))).select("user_id", "start", "end")
    return merge_islands(s, ["user_id"], 0).select("user_id", F.col("start").alias(start), F.col("end").alias(end))


@query(sql("WITH " + ISLANDS.format(n=1, kind="view") + """, n AS (SELECT event_id, user_id, "at" AS onset, "at" - 4 * 3600000000 AS since FROM ev WHERE event_type = 'error'),
l AS (SELECT *, since - since % 86400000000 + 23 * 3600000000 AS eve FROM n), k AS (SELECT *, CASE WHEN eve > onset THEN eve - 86400000000 ELSE eve END AS late FROM l),
o AS (SELECT k.*, CASE WHEN start IS NOT NULL THEN greatest(start, since) END AS s, CASE WHEN start IS NOT NULL THEN least("end", onset) END AS e FROM k LEFT JOIN i1 ON i1.user_id = k.user_id AND start < onset AND "end" > since)
SELECT event_id, CAST(coalesce(sum(e - s), 0) // 1000000 AS BIGINT) AS active_s, CAST(coalesce(sum(CASE WHEN e IS NOT NULL THEN greatest(e - greatest(s, late), 0) END), 0) // 1000000 AS BIGINT) AS late_s, CASE WHEN count(s) > 0 THEN (any_value(onset) - max(e)) // 1000000 END AS gap_s
FROM o GROUP BY event_id""", "ev", "spans"))
def evening_exposures(spark, sf_dir):
    """Activity in the four hours before each onset, the part of it after 23:00, and the quiet gap before the onset."""
    day = 24 * HOUR
    n = events(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id", F.col("at").alias("onset"), (F.col("at") - 4 * HOUR).alias("since"))
    eve = F.col("since") - F.col("since") % day + 23 * HOUR
    n = n.withColumn("late", F.when(eve > F.col("onset"), eve - day).otherwise(eve))
    seen = clip(n, stretches(spark, sf_dir, "view"), "user_id", HOUR, ("since", "onset"), ("start", "end"))
    late = F.greatest(F.col("to_us") - F.greatest("from_us", "late"), F.lit(0))
    sums = seen.groupBy("event_id").agg(F.sum(F.col("to_us") - F.col("from_us")).alias("active"), F.sum(late).alias("late_us"), F.max("to_us").alias("last"))
    seconds = lambda c: F.floor(c / 1_000_000)
    both = n.select("event_id", "onset").join(sums, "event_id", "left")
    return both.select("event_id", seconds(F.coalesce("active", F.lit(0))).alias("active_s"), seconds(F.coalesce("late_us", F.lit(0))).alias("late_s"), seconds(F.col("onset") - F.col("last")).alias("gap_s"))


#: Fixed values of the boundary rule: minutes that still agree, least samples, ratios to the core's mean, weight of the second recorder, furthest move.
AGREE, SAMPLES, ASLEEP, AWAKE, WEIGHT, FURTHEST = 10, 5, 1.10, 1.25, 0.3, 120
BOUND = f"""CASE WHEN abs(b{{k}} - a{{k}}) < {AGREE * MINUTE} THEN 'agree' WHEN core_n >= {SAMPLES} AND n{{k}} >= {SAMPLES} AND s{{k}} / n{{k}} <= core_s / core_n * {ASLEEP} THEN 'asleep'
WHEN core_n >= {SAMPLES} AND n{{k}} >= {SAMPLES} AND s{{k}} / n{{k}} >= core_s / core_n * {AWAKE} THEN 'awake' ELSE 'weighted' END"""
MOVED = """CASE basis{k} WHEN 'agree' THEN a{k} WHEN 'asleep' THEN {wide}(a{k}, b{k}) WHEN 'awake' THEN {narrow}(a{k}, b{k}) ELSE a{k} + CAST(floor((b{k} - a{k}) * 0.3{e}) AS BIGINT) END"""
HELD = f"greatest(least(m{{k}}, a{{k}} + {FURTHEST * MINUTE}), a{{k}} - {FURTHEST * MINUTE})"
SIDES = (("1", "least", "greatest"), ("2", "greatest", "least"))


@query(sql("""WITH x AS (SELECT *, user_id % 4 AS host FROM ev), b AS (SELECT host, day, min("at") FILTER (WHERE event_type = 'view') AS a1, max("at") FILTER (WHERE event_type = 'view') AS a2,
min("at") FILTER (WHERE event_type = 'click') AS b1, max("at") FILTER (WHERE event_type = 'click') AS b2 FROM x GROUP BY ALL HAVING a1 < a2 AND b1 < b2),
h AS (SELECT host, day, a1, a2, b1, b2, count(*) FILTER (WHERE "at" BETWEEN greatest(a1, b1) AND least(a2, b2)) AS core_n, coalesce(sum(value_h) FILTER (WHERE "at" BETWEEN greatest(a1, b1) AND least(a2, b2)), 0) AS core_s,
count(*) FILTER (WHERE "at" BETWEEN least(a1, b1) AND greatest(a1, b1)) AS n1, coalesce(sum(value_h) FILTER (WHERE "at" BETWEEN least(a1, b1) AND greatest(a1, b1)), 0) AS s1,
count(*) FILTER (WHERE "at" BETWEEN least(a2, b2) AND greatest(a2, b2)) AS n2, coalesce(sum(value_h) FILTER (WHERE "at" BETWEEN least(a2, b2) AND greatest(a2, b2)), 0) AS s2
FROM b JOIN (SELECT host, day, "at", CAST(floor(value * 100) AS DOUBLE) AS value_h FROM x WHERE event_type IN ('error', 'signup', 'purchase')) USING (host, day) GROUP BY ALL),
j AS (SELECT *, """ + ", ".join(BOUND.format(k=k) + f" AS basis{k}" for k, _, _ in SIDES) + " FROM h), v AS (SELECT *, " + ", ".join(MOVED.format(k=k, wide=w, narrow=n, e="e0") + f" AS m{k}" for k, w, n in SIDES) + " FROM j), z AS (SELECT *, "
+ ", ".join(HELD.format(k=k) + f" AS e{k}" for k, _, _ in SIDES) + """ FROM v)
SELECT host, day, CASE WHEN e2 <= e1 THEN a1 ELSE e1 END AS start, CASE WHEN e2 <= e1 THEN a2 ELSE e2 END AS "end", """ + ", ".join(f"CASE WHEN e2 <= e1 THEN 'agree' WHEN e{k} <> m{k} THEN basis{k} || '_capped' ELSE basis{k} END AS basis{k}" for k, _, _ in SIDES) + " FROM z", "ev"))
def boundary_estimates(spark, sf_dir):
    """Two recorders a night; where their bounds differ, samples in the disputed stretch against those of the core that both agree on decide."""
    e = events(spark, sf_dir).withColumn("host", F.col("user_id") % 4)
    edge = lambda f, kind: f(F.when(F.col("event_type") == kind, F.col("at")))
    b = e.groupBy("host", "day").agg(edge(F.min, "view").alias("a1"), edge(F.max, "view").alias("a2"), edge(F.min, "click").alias("b1"), edge(F.max, "click").alias("b2")).where("a1 < a2 AND b1 < b2")
    s = e.where("event_type IN ('error', 'signup', 'purchase')").select("host", "day", "at", F.floor(F.col("value") * 100).cast("double").alias("v"))
    inside = {"core": ("greatest(a1, b1)", "least(a2, b2)"), "1": ("least(a1, b1)", "greatest(a1, b1)"), "2": ("least(a2, b2)", "greatest(a2, b2)")}
    sums = []
    for k, (lo, hi) in inside.items():
        n, t = ("core_n", "core_s") if k == "core" else (f"n{k}", f"s{k}")
        within = F.expr(f"at BETWEEN {lo} AND {hi}")
        sums += [F.count_if(within).alias(n), F.coalesce(F.sum(F.when(within, F.col("v"))), F.lit(0.0)).alias(t)]
    h = b.join(s, ["host", "day"]).groupBy("host", "day", "a1", "a2", "b1", "b2").agg(*sums)
    # the rule is the same text on both engines; the tests hold it to hand-made nights
    j = h.select("*", *[F.expr(BOUND.format(k=k).replace(f"* {ASLEEP}", f"* {ASLEEP}D").replace(f"* {AWAKE}", f"* {AWAKE}D")).alias(f"basis{k}") for k, _, _ in SIDES])
    v = j.select("*", *[F.expr(MOVED.format(k=k, wide=w, narrow=n, e="D")).alias(f"m{k}") for k, w, n in SIDES])
    z = v.select("*", *[F.expr(HELD.format(k=k)).alias(f"e{k}") for k, _, _ in SIDES])
    bases = [F.expr(f"CASE WHEN e2 <= e1 THEN 'agree' WHEN e{k} <> m{k} THEN basis{k} || '_capped' ELSE basis{k} END").alias(f"basis{k}") for k, _, _ in SIDES]
    return z.select("host", "day", F.expr("CASE WHEN e2 <= e1 THEN a1 ELSE e1 END AS start"), F.expr("CASE WHEN e2 <= e1 THEN a2 ELSE e2 END").alias("end"), *bases)


@query(sql("WITH " + ISLANDS.format(n=1, kind="view") + """, g AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM i1),
w AS (SELECT user_id, "end" AS start, nxt AS "end" FROM g WHERE nxt - "end" <= 21600000000),
f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = w.user_id AND event_type <> 'view' AND "at" >= w.start AND "at" < w."end")),
p AS (SELECT user_id, start, "end" FROM i1 UNION ALL SELECT * FROM f), o AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM p),
k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY start, "end") AS k FROM o) SELECT user_id, min(start) AS start, max("end") AS "end" FROM k GROUP BY user_id, k""", "ev", "spans"))
def validated_intervals(spark, sf_dir):
    """Gaps of at most six hours inside an episode without any sign of waking are filled, then stretches merge again; longer gaps stay."""
    s = stretches(spark, sf_dir, "view")
    nxt = F.lead("start").over(Window.partitionBy("user_id").orderBy("start"))
    gaps = s.withColumn("nxt", nxt).where(F.col("nxt") - F.col("end") <= 360 * MINUTE).select("user_id", F.col("end").alias("gap_start"), F.col("nxt").alias("gap_end"))
    awake = events(spark, sf_dir).where("event_type <> 'view'").select("user_id", "at", (F.col("at") + 1).alias("until"))
    woken = interval_join(gaps, awake, "user_id", 6 * HOUR, ("gap_start", "gap_end"), ("at", "until")).select("user_id", "gap_start").distinct()
    filled = gaps.join(woken, ["user_id", "gap_start"], "left_anti").select("user_id", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    return merge_islands(s.unionByName(filled), ["user_id"], 0).select("user_id", "start", "end")


@query(sql("WITH " + ISLANDS.format(n=1, kind="view") + ", " + ISLANDS.format(n=2, kind="click") + """, c AS (SELECT i1.user_id, greatest(i1.start, i2.start) AS start, least(i1."end", i2."end") AS "end" FROM i1 JOIN i2 ON i1.user_id = i2.user_id AND i1.start < i2."end" AND i2.start < i1."end"),
o AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1800000000 THEN 0 ELSE 1 END AS o FROM c), k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY start) AS k FROM o),
s AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM k GROUP BY user_id, k)
SELECT s.user_id, s.start, s."end", count(p.event_id) AS commits, CAST(coalesce(sum(floor(p.value)), 0) AS BIGINT) AS lines FROM s LEFT JOIN ev p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND p."at" >= s.start - 300000000 AND p."at" <= s."end" + 300000000 GROUP BY ALL""", "ev", "spans"))
def coding_sessions(spark, sf_dir):
    """Views clipped to active stretches, merged over gaps of half an hour, with the commits within five minutes of each and their sums."""
    active = stretches(spark, sf_dir, "click", "from", "to")
    clipped = clip(stretches(spark, sf_dir, "view"), active, "user_id", HOUR, ("start", "end"), ("from", "to"))
    s = merge_islands(clipped.select("user_id", F.col("from_us").alias("start"), F.col("to_us").alias("end")), ["user_id"], 30 * MINUTE).select("user_id", "start", "end")
    near = s.withColumn("since", F.col("start") - 5 * MINUTE).withColumn("until", F.col("end") + 5 * MINUTE + 1)  # half open: the last microsecond belongs
    c = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "at", (F.col("at") + 1).alias("after"), F.floor("value").cast("long").alias("v"))
    found = interval_join(near, c, "user_id", HOUR, ("since", "until"), ("at", "after")).groupBy("user_id", "start").agg(F.count("*").alias("commits"), F.sum("v").alias("lines"))
    return s.join(found, ["user_id", "start"], "left").na.fill(0, ["commits", "lines"])


@query("""WITH d AS (SELECT doc_id, CAST(doc_id % 30 AS INTEGER) AS day, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS words, quality, toxic FROM documents JOIN labels USING (doc_id)),
g AS (SELECT day, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, avg(quality - toxic) AS mean, count(DISTINCT source) AS sources FROM d WHERE words >= 3 GROUP BY 1),
l AS (SELECT day, lang, count(*) AS k FROM d WHERE words >= 3 GROUP BY ALL), b AS (SELECT day, lang FROM l QUALIFY row_number() OVER (PARTITION BY day ORDER BY k DESC, lang) = 1)
SELECT day, n, words, round(mean, 4) AS mean, sources, lang AS dominant FROM g JOIN b USING (day)""")
def daily_scores(spark, sf_dir):
    """Scored texts by day: mean, words, sources and the dominant label; texts under three words take no part, days without texts are absent."""
    from daybook.sources.tables import table

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select((F.col("doc_id") % 30).cast("int").alias("day"), "lang", "source", F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+', 0)")).alias("words"), (F.col("quality") - F.col("toxic")).alias("score"))
    d = d.where("words >= 3")
    by = d.groupBy("day", "lang").agg(F.count("*").alias("k"))
    best = by.groupBy("day").agg(F.min(F.struct((-F.col("k")).alias("k"), "lang")).alias("b")).select("day", F.col("b.lang").alias("dominant"))
    return d.groupBy("day").agg(F.count("*").alias("n"), F.sum("words").cast("long").alias("words"), F.round(F.avg("score"), 4).alias("mean"), F.countDistinct("source").alias("sources")).join(best, "day")

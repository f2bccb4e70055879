"""What watchers of a desk saw: stores read as one, outages and silence, repaired presence, titles, hidden regimes, anomalies across metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators import night_gaps, presence, titles
from daybook.operators.regimes import hidden_states
from daybook.plans.models import day_features
from daybook.plans.registry import registry
from daybook.plans.stats import DAILY, daily
from daybook.sources.stores import one_store
from daybook.sources.tables import events, spans, sql, table

REGISTRY, query = registry()
MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


@query(sql("""WITH b AS (SELECT min(start) AS lo, max("end") AS hi FROM spans), c AS (SELECT lo + (hi - lo) // 4 AS since, hi - (hi - lo) // 4 AS until FROM b)
SELECT DISTINCT 'watch-' || event_type || '_' || user_id AS bucket, start, "end", CAST(("end" - start) // 60000000 AS VARCHAR) AS data FROM spans, c
WHERE event_type IN ('view', 'click') AND start < until AND "end" > since""", "spans"))
def store_events(spark, sf_dir):
    """Two stores with bucket numbers of their own that overlap by two weeks, read as one by prefixes of names, within bounds, repeats gone."""
    s = spans(spark, sf_dir)
    lo, hi = s.agg(F.min("start"), F.max("end")).first()
    lo, hi = lo or 0, hi or 0
    mid, quarter = (lo + hi) // 2, (hi - lo) // 4
    name = F.concat(F.lit("watch-"), "event_type", F.lit("_"), F.col("user_id").cast("string"))
    stores = []
    for number, held in ((F.col("user_id") * 256 + F.ascii("event_type"), s.where(F.col("start") < mid + 7 * DAY)), (F.col("user_id") * 512 + F.ascii("event_type") + 7, s.where(F.col("start") >= mid - 7 * DAY))):
        minutes = F.expr("(end - start) div 60000000").cast("string")
        stores.append((held.select(number.alias("id"), name.alias("name")).distinct(), held.select(number.alias("bucket"), "start", "end", minutes.alias("data"))))
    return one_store(stores, ["watch-view", "watch-cl"], lo + quarter, hi - quarter)


def _bounds(s: DataFrame) -> DataFrame:
    """Every user with the first start and the last end of all spans: a row, met with each user."""
    lo, hi = s.agg(F.min("start"), F.max("end")).first()
    return s.select("user_id").distinct().select("user_id", F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))


@query(sql("""WITH b AS (SELECT min(start) AS lo, max("end") AS hi FROM spans), u AS (SELECT DISTINCT user_id FROM spans),
p AS (SELECT user_id, start, "end", 1 AS o FROM spans WHERE event_type = 'view' UNION ALL SELECT user_id, lo, lo, 0 FROM u, b UNION ALL SELECT user_id, hi, hi, 2 FROM u, b),
g AS (SELECT user_id, max("end") OVER (PARTITION BY user_id ORDER BY start, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start, start AS gap_end FROM p),
l AS (SELECT * FROM g WHERE gap_end - gap_start >= 43200000000)
SELECT l.user_id, gap_start, gap_end, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS windows, count(*) FILTER (WHERE event_type = 'error') AS web,
CASE WHEN windows > 0 THEN 'C' WHEN web > 0 THEN 'B' ELSE 'A' END AS pattern
FROM l LEFT JOIN spans s ON s.user_id = l.user_id AND s.start >= gap_start AND s.start < gap_end GROUP BY ALL""", "spans"))
def outage_patterns(spark, sf_dir):
    """Half a day or more without presence, within the bounds of all spans, by which of the other two streams went on."""
    s = spans(spark, sf_dir)
    is_ = lambda *kinds: s.where(F.col("event_type").isin(*kinds))
    return presence.outages(is_("view"), is_("click", "purchase"), is_("error"), _bounds(s), "user_id", 12 * HOUR, DAY)


@query(sql("""WITH w AS (SELECT event_id, user_id, start, "end" FROM spans WHERE event_type = 'view' AND "end" > start), k AS (SELECT user_id, "at" FROM ev WHERE event_type IN ('click', 'error')),
p AS (SELECT w.event_id, w.user_id, k."at" AS t FROM w JOIN k ON k.user_id = w.user_id AND k."at" >= w.start AND k."at" <= w."end" UNION ALL SELECT event_id, user_id, start FROM w UNION ALL SELECT event_id, user_id, "end" FROM w),
g AS (SELECT user_id, event_id, t AS start, lead(t) OVER (PARTITION BY event_id ORDER BY t) AS "end" FROM p) SELECT * FROM g WHERE "end" - start >= 1800000000""", "spans", "ev"))
def silent_stretches(spark, sf_dir):
    """Half an hour or more without a press, within each span of presence."""
    views = spans(spark, sf_dir).where("event_type = 'view' AND end > start").select("user_id", "event_id", "start", "end")
    presses = events(spark, sf_dir).where("event_type IN ('click', 'error')").select("user_id", "at")
    return presence.silent_windows(views, presses, "user_id", "event_id", "at", 30 * MINUTE, DAY)


@query(sql("""WITH e AS (SELECT user_id, event_id, start, "end", CASE WHEN event_id % 5 = 0 THEN 'AFK' WHEN event_id % 7 = 0 THEN NULL ELSE 'not-afk' END AS status FROM spans WHERE event_type = 'view'),
own AS (SELECT * FROM e WHERE status = 'not-afk' AND "end" > start),
commands AS (SELECT user_id, "at" FROM ev WHERE event_type = 'error'), presses AS (SELECT user_id, "at" FROM ev WHERE event_type = 'purchase'),
cover AS (SELECT user_id, min("at" // 86400000000) AS f, max("at" // 86400000000) AS l FROM presses GROUP BY 1),
sleep AS (SELECT o.event_id, o.user_id, greatest(o.start, s.start) AS s, least(o."end", s."end") AS t FROM own o JOIN spans s ON s.user_id = o.user_id AND s.event_type = 'signup' AND s.start < o."end" AND o.start < s."end" AND s."end" > s.start),
focus AS (SELECT o.event_id, o.user_id, greatest(o.start, s.start) AS s, least(o."end", s."end") AS t, s."end" - s.start AS long, s.event_id % 3 = 0 AS no_app FROM own o JOIN spans s ON s.user_id = o.user_id AND s.event_type = 'click' AND s.start < o."end" AND o.start < s."end" AND s."end" > s.start WHERE o."end" - o.start >= 3600000000),
still AS (SELECT * FROM focus f WHERE long >= 7200000000 AND NOT EXISTS (SELECT 1 FROM commands c WHERE c.user_id = f.user_id AND c."at" >= f.s AND c."at" < f.t)),
lg AS (SELECT o.* FROM own o JOIN cover c USING (user_id) WHERE o."end" // 86400000000 >= f AND o.start // 86400000000 <= l),
pt AS (SELECT event_id, user_id, start AS t FROM lg UNION ALL SELECT event_id, user_id, "end" FROM lg UNION ALL SELECT lg.event_id, lg.user_id, p."at" FROM lg JOIN presses p ON p.user_id = lg.user_id AND p."at" >= lg.start AND p."at" <= lg."end"),
gp AS (SELECT event_id, user_id, t AS s, lead(t) OVER (PARTITION BY event_id ORDER BY t) AS t FROM pt),
quiet AS (SELECT * FROM gp g WHERE t - s >= 1800000000 AND NOT EXISTS (SELECT 1 FROM sleep z WHERE z.event_id = g.event_id AND z.s <= g.s AND z.t >= g.t) AND NOT EXISTS (SELECT 1 FROM commands c WHERE c.user_id = g.user_id AND c."at" >= g.s AND c."at" < g.t)),
f AS (SELECT event_id, s, t, 0 AS r FROM sleep UNION ALL SELECT event_id, s, t, 1 FROM focus WHERE no_app UNION ALL SELECT event_id, s, t, 2 FROM still UNION ALL SELECT event_id, s, t, 3 FROM quiet),
g AS (SELECT *, CASE WHEN s <= max(t) OVER (PARTITION BY event_id ORDER BY s, t, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM f),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY event_id ORDER BY s, t, r ROWS UNBOUNDED PRECEDING) AS run FROM g), m AS (SELECT event_id, min(s) AS s, max(t) AS t, min(r) AS r FROM h GROUP BY event_id, run),
n AS (SELECT event_id, s, t, r FROM m UNION ALL SELECT event_id, "end", "end", NULL FROM own),
laid AS (SELECT own.user_id, n.event_id, coalesce(lag(n.t) OVER (PARTITION BY n.event_id ORDER BY n.s, n.r IS NULL), own.start) AS since, n.s, n.t, n.r FROM n JOIN own USING (event_id))
SELECT user_id, event_id, since AS start, s AS "end", 'not-afk' AS status, 'not-afk' AS original_status, '' AS source FROM laid WHERE s > since
UNION ALL SELECT user_id, event_id, s, t, 'afk', 'not-afk', CASE r WHEN 0 THEN 'sleep-overlap' WHEN 1 THEN 'empty-app' WHEN 2 THEN 'stuck-window' ELSE 'keylog-silent' END FROM laid WHERE r IS NOT NULL
UNION ALL SELECT user_id, event_id, start, "end", lower(coalesce(status, 'unknown')), lower(coalesce(status, 'unknown')), '' FROM e WHERE status IS DISTINCT FROM 'not-afk' OR "end" <= start""", "spans", "ev"))
def repaired_presence(spark, sf_dir):
    """Presence split where sleep, windows without an app, windows that stand still and silence of presses show absence, by the strongest source."""
    s, e = spans(spark, sf_dir), events(spark, sf_dir)
    status = F.when(F.col("event_id") % 5 == 0, "AFK").when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise("not-afk")
    seen = s.where("event_type = 'view'").select("user_id", "event_id", "start", "end", status.alias("status"))
    windows = s.where("event_type = 'click'").select("user_id", "start", "end", F.when(F.col("event_id") % 3 == 0, "").otherwise("app").alias("app"))
    points = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "at")
    sleep = s.where("event_type = 'signup' AND end > start").select("user_id", "start", "end")
    return presence.repair(seen, sleep, windows, points("purchase"), points("error"), "user_id", "not-afk", 30 * MINUTE, 120 * MINUTE, 60 * MINUTE, DAY)


#: Categories of the given pages' hosts, laid over the general ones.
CATEGORIES = {"example.com": "code", "example.org": "docs", "example.net": "reading"} | titles.CATEGORIES
_CATEGORY = "CASE " + " ".join(f"WHEN domain = '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " " + " ".join(f"WHEN ends_with(domain, '{k}') OR ends_with('{k}', domain) THEN '{v}'" for k, v in CATEGORIES.items()) + " END"


@query(r"""WITH t AS (SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)', 1) || ' - ' || url, '') AS title FROM pages),
d AS (SELECT page_id, regexp_replace(lower(coalesce(nullif(regexp_extract(title, ' - https?://([^/\s]+)', 1), ''), nullif(regexp_extract(title, 'https?://([^/\s]+)', 1), ''))), '^www\.', '') AS domain FROM t)
SELECT page_id, 'browser' AS app_kind, domain, """ + _CATEGORY + " AS domain_category, coalesce(domain IN ('chatgpt.com', 'claude.ai', 'aistudio.google.com'), false) AS is_ai_tool FROM d")
def title_features(spark, sf_dir):
    """the features of a browser's titles (a page's title and its address); terminals, editors and the rest are held to hand-made titles in the tests."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(" - "), "url").alias("title"))
    f = p.select("page_id", titles.title_features(F.lit("firefox"), F.col("title"), ["alpha", "beta"], categories=CATEGORIES).alias("f"))
    return f.select("page_id", *[f"f.{c}" for c in ("app_kind", "domain", "domain_category", "is_ai_tool")])


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents),
n AS (SELECT doc_id, line, regexp_replace(t, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS nt FROM l), m AS (SELECT *, lower(nt) AS low FROM n),
s AS (SELECT *, CASE WHEN low IN ('mit', 'x11') THEN 'mit' WHEN low IN ('apache', 'al2') THEN 'apache' WHEN low LIKE 'mit-%' OR low LIKE 'x11-%' THEN 'mit' WHEN low LIKE 'apache-%' OR low LIKE 'al2-%' THEN 'apache'
  WHEN contains(low, 'mit license') THEN 'mit' WHEN contains(low, 'apache license') THEN 'apache' END AS subject FROM m),
r AS (SELECT doc_id, line, CASE WHEN low IN ('start coding session', 'claude-code:idle', 'claude code', 'codex resume --last', 'codex') THEN 'lifecycle' WHEN subject IS NOT NULL THEN 'project' WHEN regexp_matches(low, '\A[a-z0-9]+(?:-[a-z0-9]+){2,}\z') THEN 'slug'
  WHEN length(nt) BETWEEN 8 AND 100 AND regexp_matches(nt, '\A[A-Z][A-Za-z0-9]*(?:[\x20\x09-\x0D]+[A-Za-z0-9/.\-]+){1,15}\z') THEN 'sentence' END AS rule, subject FROM s)
SELECT doc_id, CAST(line AS INTEGER) AS line, rule, CASE WHEN rule = 'project' THEN subject END AS subject, CASE rule WHEN 'slug' THEN 0.6 WHEN 'sentence' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM r WHERE rule IS NOT NULL""")
def title_rules(spark, sf_dir):
    """every line of the documents as a terminal's title, by the first rule that fits."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "t"))
    rule = titles.title_rule(F.lit("kitty"), F.col("t"), ["mit", "apache"], {"x11": "mit", "al2": "apache"}, {}, {"mit license": "mit", "apache license": "apache"})
    # generated, so that neither the filter nor the columns compute the rule anew
    return d.select("doc_id", "line", F.inline(F.array(rule))).where("rule IS NOT NULL").select("doc_id", "line", "rule", "subject", "confidence")


FEATURES = ["n", "mean", "errors", "kinds"]


@query()
def hidden_regimes(spark, sf_dir):
    """Each user's days by the likeliest path of a Markov model with Gaussian states over their features; starts are random, no SQL: planted states and all paths of a short series in the tests."""
    return hidden_states(day_features(spark, sf_dir), "user_id", "day", FEATURES)[0]


@query()
def regime_profiles(spark, sf_dir):
    """Size, mean and deviation of every feature of each hidden state, and how long a stay in it is; as hidden_regimes, no SQL."""
    days = day_features(spark, sf_dir)
    found = hidden_states(days, "user_id", "day", FEATURES)[0]
    w = Window.partitionBy("user_id").orderBy("day")
    opened = found.withColumn("_new", (~F.col("state").eqNullSafe(F.lag("state").over(w))).cast("int"))
    rows = opened.join(days, ["user_id", "day"])
    spread = [f(c).alias(f"{c}_{name}") for c in FEATURES for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return rows.groupBy("state").agg(F.count("*").alias("days"), (F.count("*") / F.sum("_new")).alias("stay"), *spread)


@query(sql(DAILY + """, z AS (SELECT event_type, day, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z, count(v) OVER w AS k FROM d WINDOW w AS (PARTITION BY event_type)),
a AS (SELECT event_type, day, z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM z WHERE k >= 20 AND (z > 2.5 OR z < -2))
SELECT a.event_type, a.day, a.direction, round(a.z, 4) AS z, z.event_type AS other, round(z.z, 4) AS other_z FROM a LEFT JOIN z ON z.day = a.day AND z.event_type <> a.event_type""", "ev"))
def anomaly_crossref(spark, sf_dir):
    """Days on which a metric of 20 days or more stands 2.5 deviations above its mean or 2 below, with how far every other metric stood that day."""
    w = Window.partitionBy("event_type")
    z = (F.col("v") - F.avg("v").over(w)) / F.nullif(F.stddev_samp("v").over(w), F.lit(0.0))
    all_ = daily(spark, sf_dir).select("event_type", "day", z.alias("z"), F.count("v").over(w).alias("k"))
    odd = all_.where("k >= 20 AND (z > 2.5 OR z < -2)").select("event_type", "day", F.when(F.col("z") > 0, "high").otherwise("low").alias("direction"), F.round("z", 4).alias("z"))
    rest = all_.select(F.col("event_type").alias("other"), "day", F.round("z", 4).alias("other_z"))
    return odd.join(rest, (odd["day"] == rest["day"]) & (odd["event_type"] != rest["other"]), "left").select("event_type", odd["day"], "direction", "z", "other", "other_z")


_SEGMENTS = """s AS (SELECT user_id % 4 AS who, start, "end" FROM spans WHERE event_type = 'view' AND "end" > start),
r0 AS (SELECT *, max("end") OVER (PARTITION BY who ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
r1 AS (SELECT *, CASE WHEN reach IS NULL OR start - reach > 10800000000 THEN 1 ELSE 0 END AS fresh FROM r0), r2 AS (SELECT *, sum(fresh) OVER (PARTITION BY who ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS episode FROM r1),
ep AS (SELECT who, episode, min(start) AS lo, max("end") AS hi, min(start) // 86400000000 AS night FROM r2 GROUP BY ALL),
main AS (SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY who, night ORDER BY hi - lo DESC, lo) = 1),
gaps AS (SELECT r2.who, night, reach AS gap_start, start AS gap_end, true AS intra FROM r2 JOIN main USING (who, episode) WHERE fresh = 0 AND start > reach
UNION ALL SELECT * FROM (SELECT who, night, lag(hi) OVER (PARTITION BY who, night ORDER BY lo) AS gap_start, lo AS gap_end, false FROM ep) WHERE gap_start IS NOT NULL),
mn AS (SELECT user_id % 4 AS who, "at" // 60000000 * 60000000 AS m, avg(value) FILTER (WHERE event_type = 'click') AS h, avg(value / 50) FILTER (WHERE event_type = 'error') AS v, count(*) FILTER (WHERE event_type = 'purchase' AND value > 120) AS p
FROM ev GROUP BY ALL),
ev1 AS (SELECT g.who, g.gap_start, g.gap_end, count(h) AS hr_minutes, avg(h) AS hr, avg(v) AS mv, count(*) FILTER (WHERE p > 0) AS press_minutes FROM gaps g JOIN mn ON mn.who = g.who AND m >= g.gap_start // 60000000 * 60000000 AND m < g.gap_end GROUP BY ALL),
st AS (SELECT user_id % 4 AS who, start // 60000000 AS a, ("end" + 59999999) // 60000000 AS b FROM spans WHERE event_type = 'signup' AND "end" > start),
st1 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY who ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM st), st2 AS (SELECT *, sum(f) OVER (PARTITION BY who ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM st1),
st3 AS (SELECT who, min(a) AS a, max(b) AS b FROM st2 GROUP BY who, i),
sm AS (SELECT g.who, g.gap_start, g.gap_end, sum(least(b, (g.gap_end + 59999999) // 60000000) - greatest(a, g.gap_start // 60000000)) AS stage_minutes FROM gaps g JOIN st3 ON st3.who = g.who AND a < (g.gap_end + 59999999) // 60000000 AND b > g.gap_start // 60000000 GROUP BY ALL),
bs AS (SELECT n.who, n.night, list(h ORDER BY h) AS hs FROM main n JOIN mn ON mn.who = n.who AND h IS NOT NULL AND m >= n.lo // 60000000 * 60000000 - 7200000000 AND m < n.hi + 7200000000 GROUP BY ALL HAVING count(*) >= 2),
b1 AS (SELECT who, night, nullif(hs[greatest(CAST(floor(len(hs) * 0.2) AS BIGINT), 1)], 0) AS base FROM bs),
j AS (SELECT g.*, coalesce(hr_minutes, 0) AS hr_minutes, hr, hr / base AS ratio, mv, coalesce(press_minutes, 0) AS press_minutes, CAST(coalesce(stage_minutes, 0) AS BIGINT) AS stage_minutes FROM gaps g LEFT JOIN ev1 USING (who, gap_start, gap_end) LEFT JOIN sm USING (who, gap_start, gap_end) LEFT JOIN b1 USING (who, night))"""


@query(sql("WITH " + _SEGMENTS + """ SELECT who, night, gap_start, gap_end, intra, hr_minutes, round(hr, 6) AS hr_mean, round(ratio, 6) AS hr_ratio, round(mv, 6) AS movement_mean, press_minutes, stage_minutes,
CASE WHEN press_minutes > 0 THEN 'confirmed_wake_pc' WHEN hr_minutes < 2 THEN 'sensor_absent' WHEN stage_minutes / ((gap_end - gap_start) / 60000000.0) >= 0.5 THEN 'stage_continuous' WHEN mv >= 2 THEN 'genuine_wake' WHEN ratio >= 1.15 THEN 'genuine_wake' WHEN ratio < 1.15 THEN 'missed_sleep' ELSE 'undetermined' END AS verdict FROM j""", "spans", "ev"))
def gap_verdicts(spark, sf_dir):
    """Every gap within and between the episodes of a night, by what the sensors saw in it; streams of events stand for the sensors."""
    s, e = spans(spark, sf_dir).withColumn("who", F.col("user_id") % 4), events(spark, sf_dir).withColumn("who", F.col("user_id") % 4)
    of = lambda kind: e.where(F.col("event_type") == kind)
    part = lambda kind: s.where(F.col("event_type") == kind).select("who", "start", "end")
    presses = of("purchase").where("value > 120").select("who", "at")
    found = night_gaps.gap_evidence(part("view"), of("click").select("who", "at", "value"), of("error").select("who", "at", (F.col("value") / 50).alias("value")), presses, part("signup"), "who", 3 * HOUR, 2)
    return found.withColumns({c: F.round(c, 6) for c in ("hr_mean", "hr_ratio", "movement_mean")})

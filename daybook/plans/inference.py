"""Baselines, mentions, renames, nights, capped walks, forecasts by time, and what a measurement can bear."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.operators import baselines, folds, graph, mentions, names, nights, slopes
from daybook.plans.evidence_graph import all_edges, reference_edges
from daybook.plans.registry import registry
from daybook.sources.shared import dealt
from daybook.sources.tables import changes, commits, events, sql, table

REGISTRY, query = registry()
MINUTE = 60_000_000


@query("""WITH e AS (SELECT event_type, CAST(ts - INTERVAL 6 HOUR AS DATE) AS day, value AS v FROM events WHERE value IS NOT NULL), d AS (SELECT event_type, day, avg(v) AS mean, max(v) AS most, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT d.event_type, d.day, median(h.v) AS baseline FROM d JOIN e h ON h.event_type = d.event_type AND h.day >= d.day - 28 AND h.day < d.day GROUP BY ALL HAVING count(*) >= 7),
s AS (SELECT m.event_type, m.day, max(baseline) AS baseline, median(abs(h.v - baseline)) * 1.4826 AS sd FROM m JOIN e h ON h.event_type = m.event_type AND h.day >= m.day - 28 AND h.day < m.day GROUP BY ALL)
SELECT d.event_type, d.day, round(mean, 4) AS mean, most, n, round(baseline, 4) AS baseline, round(CASE WHEN sd > 0 THEN (mean - baseline) / sd END, 4) AS deviation, coalesce(sd > 0 AND abs((mean - baseline) / sd) >= 2, false) AS flagged
FROM d LEFT JOIN s USING (event_type, day)""")
def stress_baselines(spark, sf_dir):
    """Each day's values against the median and spread of the 28 calendar days before it, by added-up histograms."""
    e = events(spark, sf_dir).withColumn("logical_day", F.to_date(F.timestamp_micros(F.col("at") - 6 * 60 * MINUTE)))
    b = baselines.trailing_baselines(e, "event_type", "logical_day", "value")
    return b.select("event_type", "day", F.round("mean", 4).alias("mean"), "most", "n", F.round("baseline", 4).alias("baseline"), F.round("deviation", 4).alias("deviation"), "flagged")


#: A registry of names: the first two words of every benchmark item, under its id.
NAMES = """b AS (SELECT item_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ') AS w FROM benchmark),
names AS (SELECT array_to_string(w[1:2], ' ') AS name, 'item ' || item_id AS canonical FROM b WHERE len(w) >= 2)"""


def name_registry(spark, sf_dir):
    words = F.split(F.trim(mentions.folded(F.col("text"))), " ")
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where(F.size("w") >= 2)
    return b.select(F.array_join(F.slice("w", 1, 2), " ").alias("name"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("canonical"))


@query("WITH " + NAMES + """, d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT DISTINCT doc_id, canonical FROM d JOIN names ON regexp_matches(t, '(^|[^\\p{L}\\p{N}_-])' || regexp_escape(name) || '($|[^\\p{L}\\p{N}_-])')""")
def registry_mentions(spark, sf_dir):
    """the names of a registry, of several words, that stand in each document, by one pass over its text."""
    return mentions.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", name_registry(spark, sf_dir))


#: Tags of texts as SQL: a needle anywhere in the text with A-Z in lower case.
TAGS = "SELECT doc_id, category, label, confidence FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents), (VALUES " + ", ".join(f"('{c}', '{label}', {list(needles)!r}, {p})" for c, label, needles, p in mentions.TEXT_TAGS) + ") AS g(category, label, needles, confidence) WHERE len(list_filter(needles, lambda n: contains(t, n))) > 0"


@query(TAGS)
def text_annotations(spark, sf_dir):
    """The annotation step of G10 for texts: a row for each document and tag of which a needle stands in it."""
    return mentions.text_tags(table(spark, sf_dir, "documents"), "doc_id", "text")


def tagged_graph(spark, sf_dir):
    """nodes (id, kind, source, project, day), edges (source, target, relation) and annotations (id, label) of orders, events and documents."""
    c, e = commits(spark, sf_dir, deal=True), events(spark, sf_dir)
    order, event = F.expr("'order:' || sha"), F.expr("'event:' || event_id")
    kind = F.when(F.col("event_type") == "error", "machine_pressure_incident").otherwise("terminal_session")
    doc = table(spark, sf_dir, "documents").select(F.expr("'doc:' || doc_id").alias("id"), F.lit("raw_log").alias("kind"), F.lit("documents").alias("source"), F.col("lang").alias("project"), F.lit(None).cast("date").alias("day"), "text")
    nodes = c.select(order.alias("id"), F.lit("commit").alias("kind"), F.lit("orders").alias("source"), "project", "day")
    nodes = nodes.unionByName(e.select(event.alias("id"), kind.alias("kind"), F.lit("events").alias("source"), F.col("event_type").alias("project"), "day")).unionByName(doc.drop("text"))
    references = reference_edges(spark, sf_dir).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation")
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    near = dealt(e.select("user_id", "at", "event_id"), e.count(), "user_id").select(event.alias("target"), F.lag(event).over(w).alias("source"), (F.col("at") - F.lag("at").over(w)).alias("gap")).where(f"gap <= {90 * MINUTE}")
    near = near.select("source", "target", F.lit("temporal_proximity").alias("relation"))
    same_day = mentions.group_edges(c, ["project", "day"], "sha", "same_project_day")
    same_day = same_day.select(F.expr("'order:' || source").alias("source"), F.expr("'order:' || target").alias("target"), "relation")
    labels = c.select(order.alias("id"), F.lit("code_change").alias("label")).unionByName(e.select(event.alias("id"), F.when(F.col("event_type") == "error", "risk_signal").otherwise("terminal_execution").alias("label")))
    labels = labels.unionByName(mentions.text_tags(doc, "id", "text").select("id", "label"))
    return nodes, references.unionByName(near).unionByName(same_day), labels


@query()
def weak_tag_clusters(spark, sf_dir):
    """Clusters of tagged nodes under four relations, with score, sources, labels and which are moments; recursive SQL is too slow here, held to a union-find in the tests."""
    return mentions.weak_clusters(*tagged_graph(spark, sf_dir))


def symbols(spark, sf_dir):
    """project, name, day, change: a line's part as a named symbol, added, deleted or (shipped at no charge) renamed."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.lower(F.translate(F.concat_ws("_", "p_name", "p_type", "p_brand"), " #", "_")).alias("name"))
    kind = F.when(F.col("change") == "A", "ADDED").when(F.col("change") == "R", "DELETED").when(F.col("line") == 7, "RENAMED").otherwise("MODIFIED")
    return changes(spark, sf_dir).join(p, "path").select(F.col("owner").alias("project"), "name", "day", kind.alias("change"))


@query()
def rename_candidates(spark, sf_dir):
    """Renames said outright, and names added on or after the day on which a similar one was deleted in the same project.

    Names alike to 0.9: these names share much of their make-up. The ratio of matching blocks has no SQL; held to all pairs in the tests.
    """
    r = names.rename_candidates(symbols(spark, sf_dir), 0.9)
    return r.withColumn("similarity", F.round("similarity", 3))


@query()
def inferred_nights(spark, sf_dir):
    """Nights from records, absences, key presses and media, each layer a type of event; choices depend on earlier ones, so no SQL: held to a plain walk in the tests."""
    e = events(spark, sf_dir).withColumn("start", F.col("at"))
    of = lambda kind, minutes: e.where(F.col("event_type") == kind).select("user_id", "start", (F.col("start") + (minutes * MINUTE).cast("long")).alias("end"), "value")
    watch = of("view", F.floor("value") * 4 + 1).select("user_id", "start", "end", F.when(F.col("value") > 10, F.col("value")).alias("score"), F.lit(None).cast("double").alias("minutes"))
    active = of("click", F.floor("value") + 1).unionByName(of("signup", F.floor("value") + 1))
    keys = e.where("event_type = 'purchase'").select("user_id", "at")
    covered = e.groupBy("user_id", F.to_date(F.timestamp_micros("at")).alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("k")).where("k > 0")
    covered = covered.select("user_id", F.unix_micros(F.col("day").cast("timestamp")).alias("start"), F.unix_micros(F.date_add("day", 1).cast("timestamp")).alias("end"))
    return nights.infer_nights(watch, active, keys, covered, of("error", F.floor("value") + 1))


def _walk_sql(depth: int, most: int) -> str:
    out = ["""WITH refs AS (SELECT DISTINCT 'order:' || l_orderkey AS s, 'order:' || l_partkey AS t FROM lineitem JOIN orders o ON o.o_orderkey = l_partkey WHERE l_returnflag = 'R' AND l_partkey <> l_orderkey),
steps AS (SELECT s AS parent, t AS node, 'out' AS direction FROM refs UNION ALL SELECT t, s, 'in' FROM refs),
v0 AS (SELECT min('order:' || o_orderkey) AS start, min('order:' || o_orderkey) AS node, 0 AS depth, NULL::VARCHAR AS parent, NULL::VARCHAR AS direction FROM orders GROUP BY o_orderpriority)"""]
    for d in range(1, depth + 1):
        out.append(f"""a{d} AS (SELECT l.start, x.node, min(x.parent) AS parent, arg_min(x.direction, x.parent || ' ' || x.direction) AS direction FROM v{d - 1} l JOIN steps x ON x.parent = l.node WHERE l.depth = {d - 1} AND NOT EXISTS (SELECT 1 FROM v{d - 1} z WHERE z.start = l.start AND z.node = x.node) GROUP BY ALL),
v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT start, node, {d}, parent, direction FROM (SELECT a.*, row_number() OVER (PARTITION BY a.start ORDER BY node) AS k, {most} - n AS room FROM a{d} a JOIN (SELECT start, count(*) AS n FROM v{d - 1} GROUP BY 1) USING (start)) WHERE k <= room)""")
    return ",\n".join(out) + f" SELECT start, node, depth, parent, direction FROM v{depth}"


@query(_walk_sql(3, 50))
def evidence_neighbourhoods(spark, sf_dir):
    """What lies within three references, either way, of the first order of each priority: at most 50 nodes a start."""
    o = table(spark, sf_dir, "orders").select(F.expr("'order:' || o_orderkey").alias("id"), "o_orderpriority")
    starts = o.groupBy("o_orderpriority").agg(F.min("id").alias("id"))
    steps, _ = graph.walk_evidence(all_edges(spark, sf_dir), o.select("id"), starts.select("id"), ["references"], 3, 50, "both")
    return steps.drop("relation")


#: A day of commits, its features a day before, and four stretches of days to forecast.
FEATURES = ["n", "lines", "threads", "weekday"]
FOLDS = """d AS (SELECT project, day, count(*) AS n, sum(lines) / 1000 AS lines, count(DISTINCT thread) AS threads, dayofweek(day) + 1 AS weekday FROM commits GROUP BY ALL),
x AS (SELECT a.project, a.day, a.n AS target, b.n AS n_before, b.lines AS lines_before, b.threads AS threads_before, b.weekday AS weekday_before FROM d a JOIN d b ON b.project = a.project AND b.day = a.day - 1),
f AS (SELECT *, CAST(k - 1 AS INTEGER) AS fold FROM x JOIN (SELECT day, ntile(5) OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM x)) USING (day))"""


def folded_days(spark, sf_dir):
    d = commits(spark, sf_dir).groupBy("project", "day").agg(F.count("*").alias("n"), (F.sum("lines") / 1000).alias("lines"), F.countDistinct("thread").alias("threads")).withColumn("weekday", F.dayofweek("day"))
    return folds.time_folds(folds.lagged_features(d, ["project"], "day", FEATURES, "n"), "day", 4)


@query(sql("WITH " + FOLDS + """, e AS (UNPIVOT (SELECT fold, target, CAST(n_before AS DOUBLE) AS n_before, CAST(lines_before AS DOUBLE) AS lines_before, CAST(threads_before AS DOUBLE) AS threads_before, CAST(weekday_before AS DOUBLE) AS weekday_before FROM f)
ON n_before, lines_before, threads_before, weekday_before INTO NAME feature VALUE v) SELECT CAST(k AS INTEGER) AS fold, feature, count(*) AS n, round(coalesce(corr(v, target), 0), 6) AS r FROM e, (SELECT unnest(range(1, 5)) AS k) WHERE fold < k GROUP BY ALL""", "commits"))
def predictor_correlations(spark, sf_dir):
    """Each feature of the day before against the day's commits, over the rows before each fold alone."""
    c = folds.past_correlations(folded_days(spark, sf_dir), [f"{f}_before" for f in FEATURES], [1, 2, 3, 4])
    return c.withColumn("r", F.round("r", 6))


@query()
def fold_forecasts(spark, sf_dir):
    """The day's commits by a linear fit and by a forest, each fold fitted on what came before it; random trees, no SQL."""
    return folds.fold_scores(folded_days(spark, sf_dir), [f"{f}_before" for f in FEATURES])


#: A day of sessions: providers are types of event, a session's engaged share its value over 100, an error a session given up.
SESSIONS = """s AS (SELECT event_type AS provider, day, least(value, 100) AS engaged, 100.0 AS wall, event_type = 'error' AS left_off FROM ev WHERE value > 0),
b AS (SELECT min(day) AS lo, max(day) AS hi FROM ev), spine AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)"""


@query(sql("WITH " + SESSIONS + """ SELECT spine.day, count(engaged) AS sessions, count(engaged) > 0 AS has_data, round(sum(engaged), 4) AS engaged, round(avg(engaged / wall), 6) AS efficiency, round(sum(engaged) / sum(wall), 6) AS pooled,
round(count(*) FILTER (WHERE left_off) * 1.0 / nullif(count(engaged), 0), 6) AS abandoned FROM spine LEFT JOIN s USING (day) GROUP BY ALL""", "ev"))
def session_days(spark, sf_dir):
    """A77, by day: every day of the range, those without sessions flagged and not zero."""
    s = events(spark, sf_dir).where("value > 0").select("day", F.least("value", F.lit(100.0)).alias("e"), (F.col("event_type") == "error").alias("left_off"))
    lo, hi = events(spark, sf_dir).agg(F.min("day"), F.max("day")).first()
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).alias("day")) if lo else s.select("day").limit(0)
    g = spine.join(s, "day", "left").groupBy("day").agg(F.count("e").alias("sessions"), F.sum("e").alias("total"), F.avg(F.col("e") / 100).alias("efficiency"), F.count_if(F.col("left_off")).alias("off"))
    share = lambda c: F.round(F.col(c) / F.when(F.col("sessions") > 0, F.col("sessions")), 6)
    return g.select("day", "sessions", (F.col("sessions") > 0).alias("has_data"), F.round("total", 4).alias("engaged"), F.round("efficiency", 6).alias("efficiency"), F.round(F.col("total") / (100.0 * F.when(F.col("sessions") > 0, F.col("sessions"))), 6).alias("pooled"), share("off").alias("abandoned"))


@query(sql("WITH " + SESSIONS + """, h AS (SELECT *, lo + CAST((hi - lo) // 2 AS INTEGER) AS mid FROM b), p AS (SELECT provider, unnest(CASE WHEN day <= mid THEN ['full', 'early'] ELSE ['full', 'late'] END) AS part, engaged, wall FROM s, h),
g AS (SELECT part, provider, count(*) AS n, avg(engaged / wall) AS efficiency FROM p GROUP BY ALL) SELECT part, provider, n, round(efficiency, 6) AS efficiency, round(n * 1.0 / sum(n) OVER (PARTITION BY part), 6) AS share FROM g""", "ev"))
def provider_shares(spark, sf_dir):
    """A77, by provider: efficiency and share of sessions in the whole range and in its early and late halves."""
    e = events(spark, sf_dir)
    lo, hi = e.agg(F.min("day"), F.max("day")).first()
    mid = F.lit(lo + (hi - lo) // 2 if lo else None).cast("date")
    parts = F.explode(F.array(F.lit("full"), F.when(F.col("day") <= mid, "early").otherwise("late")))
    g = e.where("value > 0").select(F.col("event_type").alias("provider"), parts.alias("part"), (F.least("value", F.lit(100.0)) / 100).alias("r")).groupBy("part", "provider").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("efficiency"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("part")), 6))


@query(sql("WITH " + SESSIONS + """, d AS (SELECT day, count(*) AS n FROM s GROUP BY 1), p AS (SELECT row_number() OVER (ORDER BY day) AS i, n FROM d), q AS (SELECT a.i, b.i AS j, b.n - a.n AS gap FROM p a JOIN p b ON a.i < b.i),
t AS (SELECT sum(k * (k - 1) * (2 * k + 5)) AS ties FROM (SELECT count(*) AS k FROM d GROUP BY n)), v AS (SELECT CAST(sum(sign(gap)) AS BIGINT) AS s, median(gap / (j - i)) AS slope, max(j) AS n FROM q),
z AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var FROM v, t) SELECT n, s, round(slope, 6) AS slope, round(CASE WHEN var = 0 OR s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END, 6) AS z FROM z""", "ev"))
def session_trend(spark, sf_dir):
    """A77, over days: Mann-Kendall of the sessions of days that have some, by counted inversions and selected slopes."""
    d = events(spark, sf_dir).where("value > 0").groupBy("day").agg(F.count("*").alias("n")).withColumn("series", F.lit("sessions"))
    t = slopes.trend(d, "series", "day", "n")
    ties = d.groupBy("n").agg(F.count("*").alias("k")).agg(F.sum(F.expr("k * (k - 1) * (2 * k + 5)")).alias("ties"))
    z = t.join(ties.withColumn("series", F.lit("sessions")), "series").withColumn("var", F.expr("(n * (n - 1) * (2 * n + 5) - ties) / 18.0D"))
    return z.select("n", "s", F.round("slope", 6).alias("slope"), F.round(F.expr("CASE WHEN var = 0 OR s = 0 THEN 0D ELSE (s - signum(s)) / sqrt(var) END"), 6).alias("z"))


#: Runs: a user's events of one type in order; a run over 50 is cut off (censored).
RUNS = """r AS (SELECT event_type AS stage, user_id AS unit, event_id, "at", value AS v, value > 50 AS cut_off, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY "at", event_id) AS before FROM ev),
g AS (SELECT stage, unit, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM r GROUP BY ALL), w AS (SELECT stage, count(*) AS units, sum(n) AS n, sum(s) AS s, sum(q - s * s / n) AS within_ss, sum(s * s / n) AS mean_ss, sum(n * n) AS nn, count(*) FILTER (WHERE n >= 3) AS repeated FROM g GROUP BY 1)"""


@query(sql("WITH " + RUNS + """, c AS (SELECT stage, corr(v, before) AS carryover, count(before) AS pairs, count(*) FILTER (WHERE cut_off) AS cut_off FROM r GROUP BY 1),
k AS (SELECT stage, n, units, repeated, within_ss / (n - units) AS within_var, (mean_ss - s * s / n) / (units - 1) AS between_ms, (n - nn / n) / (units - 1) AS size FROM w WHERE units > 1 AND n > units)
SELECT stage, CAST(n AS BIGINT) AS n, units, repeated, round(within_var, 4) AS within_var, round(greatest((between_ms - within_var) / size, 0), 4) AS between_var, round(greatest((between_ms - within_var) / size, 0) / (greatest((between_ms - within_var) / size, 0) + within_var), 6) AS reliability,
pairs, round(carryover, 4) AS carryover, cut_off, CASE WHEN repeated >= 3 THEN 'passed' WHEN repeated > 0 THEN 'limited' ELSE 'missing' END AS status FROM k JOIN c USING (stage)""", "ev"))
def measurement_checks(spark, sf_dir):
    """Variance within and between the units of each stage from partial sums, carryover from the run before, censoring, repeatability."""
    w = Window.partitionBy("event_type", "user_id").orderBy("at", "event_id")
    r = events(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("user_id").alias("unit"), F.col("value").alias("v"), F.lag("value").over(w).alias("before"))
    g = r.groupBy("stage", "unit").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    k = g.groupBy("stage").agg(F.count("*").alias("units"), F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum(F.expr("q - s * s / n")).alias("ss"), F.sum(F.expr("s * s / n")).alias("ms"), F.sum(F.expr("n * n")).alias("nn"), F.count_if(F.col("n") >= 3).alias("repeated")).where("units > 1 AND _n > units")
    k = k.select("stage", F.col("_n").alias("n"), "units", "repeated", F.expr("ss / (_n - units)").alias("within_var"), F.expr("((ms - _s * _s / _n) / (units - 1) - ss / (_n - units)) / ((_n - nn / _n) / (units - 1))").alias("b")).withColumn("b", F.greatest("b", F.lit(0.0)))
    c = r.groupBy("stage").agg(F.corr("v", "before").alias("carryover"), F.count("before").alias("pairs"), F.count_if(F.col("v") > 50).alias("cut_off"))
    status = F.when(F.col("repeated") >= 3, "passed").when(F.col("repeated") > 0, "limited").otherwise("missing")
    return k.join(c, "stage").select("stage", "n", "units", "repeated", F.round("within_var", 4).alias("within_var"), F.round("b", 4).alias("between_var"), F.round(F.expr("b / (b + within_var)"), 6).alias("reliability"), "pairs", F.round("carryover", 4).alias("carryover"), "cut_off", status.alias("status"))


#: A frame of orders with their lines: what may be missing, what is cut off (an order still open), and what says the outcome outright.
FRAME = """l AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity, max(l_shipdate) AS shipped, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
x AS (SELECT o_totalprice AS outcome, o_orderstatus <> 'F' AS cut_off, CAST(lines AS DOUBLE) AS lines, quantity, CAST(returned AS DOUBLE) AS returned, o_totalprice * 1.1 AS taxed, CAST(o_custkey AS DOUBLE) AS customer FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)"""
COLUMNS = ["lines", "quantity", "returned", "taxed", "customer"]


@query("WITH " + FRAME + ", e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v, outcome, cut_off FROM x" for c in COLUMNS) + """) SELECT name, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS missing, round(count(*) FILTER (WHERE v IS NULL) * 1.0 / count(*), 6) AS missing_share,
count(*) FILTER (WHERE cut_off) AS cut_off, coalesce(stddev_pop(v) = 0, true) AS constant, coalesce(abs(corr(v, outcome)) > 0.999, false) AS leaks FROM e GROUP BY name""")
def frame_flags(spark, sf_dir):
    """For each column of a feature frame, as one map: rows missing and cut off, whether it is constant, whether it leaks the outcome. One pass."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returned"))
    x = table(spark, sf_dir, "orders").join(l, "o_orderkey", "left").withColumn("taxed", F.col("o_totalprice") * 1.1).withColumn("customer", F.col("o_custkey").cast("double"))
    flags = lambda c: F.struct(
        F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_if(F.col("o_orderstatus") != "F").alias("cut_off"),
        F.coalesce(F.stddev_pop(c) == 0, F.lit(True)).alias("constant"), F.coalesce(F.abs(F.corr(c, "o_totalprice")) > 0.999, F.lit(False)).alias("leaks"),
    )
    held = x.agg(F.create_map(*[y for c in COLUMNS for y in (F.lit(c), flags(c))]).alias("flags"))
    f = held.select(F.explode("flags").alias("name", "f"))
    return f.select("name", "f.n", "f.missing", F.round(F.col("f.missing") / F.col("f.n"), 6).alias("missing_share"), "f.cut_off", "f.constant", "f.leaks")

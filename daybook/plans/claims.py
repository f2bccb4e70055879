"""Contrasts of cohorts, claims with the support that their evidence allows, and episodes explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators import ranks
from daybook.operators.dedup import merge_islands
from daybook.operators.joins import interval_join
from daybook.plans.registry import registry
from daybook.plans.significance import rank_tests
from daybook.sources.tables import events, spans, sql, table

REGISTRY, query = registry()
DRAWS = 500
#: Fixed values of the signal rule: greatest q, least size of a side.
SIGNAL_Q, SIDE = 0.10, 5


@query()
def cohort_contrasts(spark, sf_dir):
    """Each cohort against the rest: medians' difference, ratio, bootstrap interval, rank test with p and q, Cliff's delta, and the signal rule.

    A screening signal needs q of at most 0.10, an interval without zero, and five rows a side; held to a plain bootstrap in the tests.
    """
    held = ranks.in_stretches(events(spark, sf_dir), "event_type", "value")
    m = ranks.median_contrasts(held, DRAWS)
    t = rank_tests(held).select("cohort", F.col("n1").alias("n"), F.col("n2").alias("n_rest"), F.expr("2 * u / n1 / n2 - 1").alias("cliffs_delta"), "p", "q")
    signal = (F.col("q") <= SIGNAL_Q) & (F.col("low") * F.col("high") > 0) & (F.least("n", "n_rest") >= SIDE)
    rounded = [F.round(x, 4).alias(x) for x in ("median_delta", "median_ratio", "low", "high", "cliffs_delta", "p", "q")]
    return m.join(t, "cohort").select("cohort", "n", "n_rest", *rounded, F.when(signal, "screening_signal").otherwise("descriptive").alias("signal"))


#: A claim is a customer's: gates on its orders, a matched design where its events lie on both sides of the middle of all days, a negative control that
#: fails where errors are over a third of its events, an experiment where both halves of ids (the arms) hold four events of a kind or more.
ASSESSED = """c AS (SELECT o_custkey AS id, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1), h AS (SELECT min(day) + CAST((max(day) - min(day)) // 2 AS INTEGER) AS mid FROM ev),
e AS (SELECT user_id AS id, count(*) AS seen, count(*) FILTER (WHERE day < mid) AS before, count(*) FILTER (WHERE day >= mid) AS after, count(*) FILTER (WHERE event_type = 'error') AS errors,
count(*) FILTER (WHERE event_type = 'click' AND event_id % 2 = 0) AS arm_a, count(*) FILTER (WHERE event_type = 'click' AND event_id % 2 = 1) AS arm_b FROM ev, h GROUP BY 1),
a AS (SELECT c.id, c_mktsegment AS mechanism, c_nationkey AS project, coalesce(before, 0) >= 5 AND coalesce(after, 0) >= 5 AS matched, coalesce(errors, 0) * 3 > coalesce(seen, 0) AS control_failed, coalesce(arm_a, 0) >= 4 AND coalesce(arm_b, 0) >= 4 AS controlled, seen IS NULL AS unmeasured,
list_filter([CASE WHEN n < 5 THEN 'few orders' END, CASE WHEN kinds < 3 THEN 'narrow' END], lambda x: x IS NOT NULL) AS reasons FROM c JOIN customer ON c_custkey = c.id LEFT JOIN e USING (id)),
claims AS (SELECT *, CASE WHEN controlled THEN 'controlled' WHEN len(reasons) > 0 THEN 'insufficient' WHEN matched AND NOT control_failed THEN 'natural_experiment' WHEN unmeasured THEN 'candidate' ELSE 'observational' END AS level FROM a)"""


def assessed(spark, sf_dir) -> DataFrame:
    """id, mechanism, project, the joined evidence, reasons of refusal and the level that all of it supports."""
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("kinds"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("mechanism"), F.col("c_nationkey").alias("project"))
    e = events(spark, sf_dir)
    lo, hi = e.agg(F.min("day"), F.max("day")).first()
    mid = F.lit(lo + (hi - lo) // 2 if lo else None).cast("date")
    click = F.col("event_type") == "click"
    held = e.groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("seen"), F.count_if(F.col("day") < mid).alias("before"), F.count_if(F.col("day") >= mid).alias("after"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(click & (F.col("event_id") % 2 == 0)).alias("arm_a"), F.count_if(click & (F.col("event_id") % 2 == 1)).alias("arm_b"),
    )
    a = c.join(who, "id").join(held, "id", "left").withColumn("unmeasured", F.col("seen").isNull()).na.fill(0, held.columns[1:])
    a = a.withColumn("reasons", F.array_compact(F.array(F.when(F.col("n") < 5, "few orders"), F.when(F.col("kinds") < 3, "narrow"))))
    a = a.select("id", "mechanism", "project", F.expr("before >= 5 AND after >= 5 AS matched"), F.expr("errors * 3 > seen AS control_failed"), F.expr("arm_a >= 4 AND arm_b >= 4 AS controlled"), "unmeasured", "reasons")
    return a.withColumn("level", F.expr("CASE WHEN controlled THEN 'controlled' WHEN size(reasons) > 0 THEN 'insufficient' WHEN matched AND NOT control_failed THEN 'natural_experiment' WHEN unmeasured THEN 'candidate' ELSE 'observational' END"))


@query(sql("WITH " + ASSESSED + " SELECT id, level, matched, control_failed, controlled, array_to_string(reasons, ',') AS reasons FROM claims", "ev"))
def attribution_claims(spark, sf_dir):
    """The support level of each claim from gates, matched design, negative control and experiment; refusals are rows too."""
    return assessed(spark, sf_dir).select("id", "level", "matched", "control_failed", "controlled", F.array_join("reasons", ",").alias("reasons"))


@query(sql("WITH " + ASSESSED + """, k AS (SELECT id, level, 'blocker resolved: ' || unnest(reasons) AS assumption, 'claim_support' AS scope, 'failed' AS status FROM claims UNION ALL SELECT id, level, 'instrument available', 'measurement', 'untestable' FROM claims WHERE unmeasured),
o AS (SELECT * FROM k UNION ALL SELECT id, level, unnest(['no other change at the boundary', 'control not affected']), 'design', unnest(['untestable', 'passed']) FROM claims WHERE level = 'natural_experiment' AND id NOT IN (SELECT id FROM k)
UNION ALL SELECT id, level, 'arms assigned by id', 'design', 'passed' FROM claims WHERE level = 'controlled' AND id NOT IN (SELECT id FROM k)) SELECT * FROM o""", "ev"))
def assumption_checks(spark, sf_dir):
    """The ledger of each claim: every blocker failed, every missing instrument untestable, and where there is neither, the assumptions of its design."""
    check = lambda what, scope, status: F.struct((what if not isinstance(what, str) else F.lit(what)).alias("assumption"), F.lit(scope).alias("scope"), F.lit(status).alias("status"))
    none = F.expr("CAST(array() AS array<struct<assumption:string,scope:string,status:string>>)")
    blocked = F.transform("reasons", lambda r: check(F.concat(F.lit("blocker resolved: "), r), "claim_support", "failed"))
    gaps = F.when(F.col("unmeasured"), F.array(check("instrument available", "measurement", "untestable"))).otherwise(none)
    design = F.when(F.col("level") == "natural_experiment", F.array(check("no other change at the boundary", "design", "untestable"), check("control not affected", "design", "passed")))
    design = F.coalesce(design.when(F.col("level") == "controlled", F.array(check("arms assigned by id", "design", "passed"))), none)
    a = assessed(spark, sf_dir).withColumn("open", F.concat(blocked, gaps))
    return a.select("id", "level", F.inline(F.when(F.size("open") > 0, F.col("open")).otherwise(design)))


@query(sql("WITH " + ASSESSED + """ SELECT mechanism, count(*) AS candidates, count(DISTINCT project) AS projects, array_to_string(list_sort(list(DISTINCT level)), ',') AS levels, count(*) FILTER (WHERE len(reasons) > 0) AS refused,
array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') AS refusal_reasons FROM claims GROUP BY 1""", "ev"))
def mechanism_families(spark, sf_dir):
    """Hypotheses by mechanism: candidates, projects, support levels and reasons of refusal; levels and reasons are few, so sets stay small."""
    g = assessed(spark, sf_dir).groupBy("mechanism").agg(F.count("*").alias("candidates"), F.countDistinct("project").alias("projects"), F.collect_set("level").alias("levels"), F.count_if(F.size("reasons") > 0).alias("refused"), F.collect_set("reasons").alias("reasons"))
    sorted_list = lambda c: F.array_join(F.array_sort(c), ",")
    return g.select("mechanism", "candidates", "projects", sorted_list(F.col("levels")).alias("levels"), "refused", sorted_list(F.array_distinct(F.flatten("reasons"))).alias("refusal_reasons"))


@query(sql("""WITH x AS (SELECT *, CAST(user_id % 8 AS INTEGER) AS host FROM ev), s AS (SELECT host, "at", "at" - lag("at") OVER (PARTITION BY host ORDER BY "at", event_id) AS gap, event_id, value FROM x WHERE event_type = 'error'),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY "at", event_id) AS run FROM s),
p AS (SELECT host, run AS episode, min("at") AS start, max("at") AS "end", count(*) AS samples, max(value) AS peak, CAST(max(gap) FILTER (WHERE gap > 7200000000) // 1000000 AS BIGINT) AS gap_before_s FROM r GROUP BY ALL),
c AS (SELECT p.host, episode, user_id, sum(CAST(floor(x.value * 100) AS BIGINT)) AS used FROM p JOIN x ON x.host = p.host AND x."at" >= start AND x."at" <= "end" AND event_type = 'purchase' GROUP BY ALL),
b AS (SELECT host, episode, user_id FROM c QUALIFY row_number() OVER (PARTITION BY host, episode ORDER BY used DESC, user_id) = 1),
k AS (SELECT p.host, episode, count(*) AS kills FROM p JOIN x ON x.host = p.host AND x."at" >= start AND x."at" <= "end" AND event_type = 'signup' GROUP BY ALL)
SELECT host, CAST(episode AS BIGINT) AS episode, start, "end", samples, round(peak, 2) AS peak, gap_before_s, user_id AS culprit, coalesce(kills, 0) AS kills FROM p LEFT JOIN b USING (host, episode) LEFT JOIN k USING (host, episode)""", "ev"))
def explained_episodes(spark, sf_dir):
    """Part of M51: runs of samples split at gaps over two hours, each with its peak, the gap before it, its heaviest process and its kills."""
    e = events(spark, sf_dir).withColumn("host", (F.col("user_id") % 8).cast("int"))
    w = Window.partitionBy("host").orderBy("at", "event_id")
    s = e.where("event_type = 'error'").withColumn("gap", F.col("at") - F.lag("at").over(w))
    s = s.withColumn("episode", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 7_200_000_000), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = s.groupBy("host", "episode").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("samples"), F.round(F.max("value"), 2).alias("peak"), F.floor(F.max(F.when(F.col("gap") > 7_200_000_000, F.col("gap"))) / 1_000_000).alias("gap_before_s"))
    asked = p.select("host", "episode", F.col("start").alias("since"), (F.col("end") + 1).alias("until"))
    seen = e.where("event_type IN ('purchase', 'signup')").select("host", "user_id", "event_type", F.floor(F.col("value") * 100).alias("used"), "at", (F.col("at") + 1).alias("after"))
    near = interval_join(asked, seen, "host", 7_200_000_000, ("since", "until"), ("at", "after"))
    by = near.groupBy("host", "episode", "user_id").agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("used"))).alias("used"), F.count_if(F.col("event_type") == "signup").alias("killed"))
    best = F.min(F.when(F.col("used").isNotNull(), F.struct((-F.col("used")).alias("less"), "user_id")))
    found = by.groupBy("host", "episode").agg(best["user_id"].alias("culprit"), F.sum("killed").alias("kills"))
    return p.join(found, ["host", "episode"], "left").na.fill(0, ["kills"])


LANES = ("click", "purchase", "signup", "view")


@query(sql("WITH " + ", ".join(f"""{k} AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY start, "end", event_id) AS k FROM (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY user_id ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o
FROM spans WHERE event_type = '{k}' AND "end" > start)) GROUP BY user_id, k)""" for k in LANES) + ", l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS lane, * FROM {k}" for k in LANES) + """), t AS (SELECT user_id, lane, sum("end" - start) AS us FROM l GROUP BY ALL),
x AS (SELECT a.user_id, a.lane, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS us FROM l a JOIN l b ON a.user_id = b.user_id AND a.lane <> b.lane AND a.start < b."end" AND b.start < a."end" GROUP BY ALL)
SELECT t.user_id AS session, lane, CAST(t.us // 1000000 AS BIGINT) AS seconds, round(t.us * 1.0 / sum(t.us) OVER (PARTITION BY t.user_id), 4) AS share, CAST(coalesce(x.us, 0) // 1000000 AS BIGINT) AS shared_s FROM t LEFT JOIN x USING (user_id, lane)""", "spans"))
def lane_composition(spark, sf_dir):
    """A session's time by lane, each lane's share, and the time that it overlaps the other lanes."""
    s = spans(spark, sf_dir).where(F.col("event_type").isin(*LANES) & (F.col("end") > F.col("start"))).select("user_id", F.col("event_type").alias("lane"), "start", "end")
    l = merge_islands(s, ["user_id", "lane"], 0).select("user_id", "lane", "start", "end")
    t = l.groupBy("user_id", "lane").agg(F.sum(F.col("end") - F.col("start")).alias("us"))
    other = l.select("user_id", F.col("lane").alias("lane_b"), F.col("start").alias("from"), F.col("end").alias("to"))
    both = interval_join(l, other, "user_id", 3_600_000_000, ("start", "end"), ("from", "to")).where("lane <> lane_b")
    x = both.groupBy("user_id", "lane").agg(F.sum(F.least("end", "to") - F.greatest("start", "from")).alias("shared"))
    whole = F.sum("us").over(Window.partitionBy("user_id"))  # a row a lane
    return t.withColumn("share", F.round(F.col("us") / whole, 4)).join(x, ["user_id", "lane"], "left").select(F.col("user_id").alias("session"), "lane", F.floor(F.col("us") / 1_000_000).alias("seconds"), "share", F.floor(F.coalesce("shared", F.lit(0)) / 1_000_000).alias("shared_s"))

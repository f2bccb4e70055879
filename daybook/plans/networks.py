"""Shape of the whole link graph, and claims ranked by the evidence under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.operators.graph import betweenness, longest_chain, strong_components
from daybook.plans.graphs import WHOLE, edges, nodes
from daybook.plans.registry import registry
from daybook.sources.shared import dealt, stored
from daybook.sources.tables import events, sql, table

REGISTRY, query = registry()


@query()
def node_betweenness(spark, sf_dir):
    """Betweenness of every supplier from every supplier, over all lines; held to a plain count of shortest paths in the tests."""
    return betweenness(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("WITH RECURSIVE " + WHOLE + """, r AS (SELECT s_suppkey AS a, s_suppkey AS b FROM supplier UNION SELECT a, target FROM r JOIN e ON b = source),
c AS (SELECT x.a AS id, min(x.b) AS part FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1), z AS (SELECT part, count(*) AS n FROM c GROUP BY 1),
g AS (SELECT DISTINCT s.part AS f, t.part AS t FROM e JOIN c s ON e.source = s.id JOIN c t ON e.target = t.id WHERE s.part <> t.part),
w AS (SELECT part, 1 AS depth FROM z UNION SELECT t, depth + 1 FROM w JOIN g ON part = f), k AS (SELECT count(*) AS m FROM e), v AS (SELECT count(*) AS n FROM supplier)
SELECT n AS nodes, m AS edges, round(m / (n * (n - 1.0)), 6) AS density, (SELECT count(*) FROM z) AS components, (SELECT count(*) FROM z WHERE n > 1) AS larger_components,
(SELECT max(n) FROM z) AS largest, (SELECT max(depth) FROM w) AS depth, round(m / CAST(n AS DOUBLE), 4) AS mean_degree FROM k, v""")
def graph_shape(spark, sf_dir):
    """The rest of G13: density, strong components, their sizes and the depth of the graph of them; one row."""
    kept = stored(edges(spark, sf_dir), "links")
    parts = strong_components(kept, nodes(spark, sf_dir))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    shape = sizes.agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.count_if(F.col("n") > 1).alias("larger_components"), F.max("n").alias("largest"))
    depth = longest_chain(kept, parts)
    m = kept.agg(F.count("*").alias("edges"))
    both = shape.join(m, F.lit(True))  # a row each
    return both.select("nodes", "edges", F.round(F.expr("edges / (nodes * (nodes - 1.0D))"), 6).alias("density"), "components", "larger_components", "largest", F.lit(depth).alias("depth"), F.round(F.expr("edges / CAST(nodes AS DOUBLE)"), 4).alias("mean_degree"))


#: A unit of work is a customer: orders are its commits, events of five types the other sources. Relations are weekdays with both orders and events.
WORK = """WITH o AS (SELECT o_custkey AS unit, count(*) AS commits, list_sort(list(DISTINCT isodow(o_orderdate))) AS days FROM orders GROUP BY 1),
e AS (SELECT user_id AS unit, count(*) FILTER (WHERE event_type = 'signup') AS ai_sessions, count(*) FILTER (WHERE event_type = 'click') AS refs, count(*) FILTER (WHERE event_type = 'error') AS raw_logs,
coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = 'view'), 0) AS focus, count(*) FILTER (WHERE event_type = 'purchase') AS commands, list_sort(list(DISTINCT isodow(day))) AS seen FROM ev GROUP BY 1),
u AS (SELECT coalesce(o.unit, e.unit) AS unit, coalesce(commits, 0) AS commits, coalesce(ai_sessions, 0) AS ai_sessions, coalesce(refs, 0) AS refs, coalesce(raw_logs, 0) AS raw_logs, CAST(coalesce(focus, 0) AS BIGINT) AS focus,
coalesce(commands, 0) AS commands, coalesce(len(list_intersect(days, seen)), 0) AS relations FROM o FULL JOIN e ON o.unit = e.unit),
s AS (SELECT *, CAST(commits > 0 AS INT) + CAST(ai_sessions > 0 AS INT) + CAST(refs > 0 AS INT) + CAST(raw_logs > 0 AS INT) + CAST(focus > 0 AS INT) + CAST(commands > 0 AS INT) AS sources FROM u)"""


def work_units(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("commits"), F.collect_set(F.weekday("o_orderdate")).alias("days"))
    e = events(spark, sf_dir)
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    focus = F.sum(F.when(F.col("event_type") == "view", F.floor("value").cast("long")))
    e = e.groupBy(F.col("user_id").alias("unit")).agg(of("signup").alias("ai_sessions"), of("click").alias("refs"), of("error").alias("raw_logs"), focus.alias("focus"), of("purchase").alias("commands"), F.collect_set(F.weekday("day")).alias("seen"))
    counted = ["commits", "ai_sessions", "refs", "raw_logs", "focus", "commands"]
    u = o.join(e, "unit", "full").na.fill(0, counted).withColumn("relations", F.coalesce(F.size(F.array_intersect("days", "seen")), F.lit(0)))
    u = u.withColumn("relations", F.greatest("relations", F.lit(0)))  # size of null is -1 where legacy sizes are on
    return u.withColumn("sources", sum(((F.col(c) > 0).cast("int") for c in counted), F.lit(0))).drop("days", "seen")


@query(sql(WORK + """ SELECT unit, sources, relations, round(sources + least(relations, 6) * 0.35e0 + least(commits, 5) * 0.12e0 + least(ai_sessions, 3) * 0.2e0 + least(focus / 60.0e0, 6.0e0) * 0.08e0 + least(commands, 12) * 0.04e0, 3) AS score,
CASE WHEN sources >= 3 AND relations >= 1 THEN 'strong' WHEN sources >= 2 THEN 'moderate' ELSE 'weak' END AS level FROM s""", "ev"))
def work_claims(spark, sf_dir):
    """Claim scores from all six capped terms, with the level that sources and relations support."""
    score = F.expr("sources + least(relations, 6) * 0.35D + least(commits, 5) * 0.12D + least(ai_sessions, 3) * 0.2D + least(focus / 60.0D, 6.0D) * 0.08D + least(commands, 12) * 0.04D")
    level = F.expr("CASE WHEN sources >= 3 AND relations >= 1 THEN 'strong' WHEN sources >= 2 THEN 'moderate' ELSE 'weak' END")
    return work_units(spark, sf_dir).select("unit", "sources", "relations", F.round(score, 3).alias("score"), level.alias("level"))


@query(sql(WORK + """ SELECT unit, sources, commits, ai_sessions, refs, raw_logs, focus, commands FROM s ORDER BY sources DESC, commits DESC, ai_sessions DESC, refs DESC, raw_logs DESC, focus DESC, commands DESC, unit LIMIT 12""", "ev"))
def strongest_work(spark, sf_dir):
    """The twelve units of the richest support, ranked by seven keys in turn (the limit is the feature)."""
    keys = ["sources", "commits", "ai_sessions", "refs", "raw_logs", "focus", "commands"]
    return work_units(spark, sf_dir).select("unit", *keys).orderBy(*[F.desc(k) for k in keys], "unit").limit(12)


#: Three families over changes: roots (parts, by supplier) with churn, broad orders, and segments whose orders are returned.
CLAIMS = """WITH h AS (SELECT l_suppkey AS project, l_partkey AS subject, count(DISTINCT l_orderkey) AS n, CAST(sum(l_quantity) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2),
hot AS (SELECT 'hotspot' AS family, project, subject, CASE WHEN n >= 3 OR lines >= 1000 THEN 'moderate' ELSE 'weak' END AS level, lines * n AS score FROM h WHERE n >= 2 OR lines >= 500),
b AS (SELECT l_orderkey AS subject, count(*) AS files, CAST(sum(l_quantity) * 20 AS BIGINT) AS lines FROM lineitem GROUP BY 1),
broad AS (SELECT 'broad_change' AS family, 0 AS project, subject, CASE WHEN files >= 40 OR lines >= 5000 THEN 'moderate' ELSE 'weak' END AS level, files * greatest(lines, 1) AS score FROM b WHERE files >= 20 OR lines >= 2500),
w AS (SELECT l_suppkey AS project, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS again FROM lineitem GROUP BY 1),
rework AS (SELECT 'rework' AS family, project, project AS subject, CASE WHEN again * 1.0 / n >= 0.35 OR again >= 5 THEN 'moderate' ELSE 'weak' END AS level, again AS score FROM w WHERE n >= 3 AND again > 0 AND (again * 1.0 / n >= 0.25 OR again >= 3)),
every AS (SELECT * FROM hot UNION ALL SELECT * FROM broad UNION ALL SELECT * FROM rework),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, project, subject) <= 25),
c AS (SELECT *, CASE family || level WHEN 'hotspotmoderate' THEN 0.7 WHEN 'hotspotweak' THEN 0.45 WHEN 'broad_changemoderate' THEN 0.68 WHEN 'broad_changeweak' THEN 0.42 WHEN 'reworkmoderate' THEN 0.66 ELSE 0.4 END AS confidence FROM best)"""
#: The confidence of each family by level.
CONFIDENCE = {"hotspot": (0.70, 0.45), "broad_change": (0.68, 0.42), "rework": (0.66, 0.40)}


@query(CLAIMS + """ SELECT family, CAST(project AS BIGINT) AS project, CAST(subject AS BIGINT) AS subject, level, CAST(confidence AS DOUBLE) AS confidence, CAST(score AS BIGINT) AS score FROM c ORDER BY confidence DESC, score DESC, family, project, subject LIMIT 25""")
def history_claims(spark, sf_dir):
    """Hotspots, broad changes and rework pressure as ranked claims, the best 25 of each family and then of all (the limits are the feature)."""
    l = table(spark, sf_dir, "lineitem")
    rows = l.count()
    level = lambda moderate: F.when(F.expr(moderate), "moderate").otherwise("weak").alias("level")
    whole = lambda c, by=1: (F.sum(c) * by).cast("long")
    by = dealt(l.select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity"), rows, "l_suppkey", "l_partkey")
    by = by.groupBy("l_suppkey", "l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"))  # counted before the distinct orders
    h = by.groupBy(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("subject")).agg(F.count("*").alias("n"), whole("q").alias("lines")).where("n >= 2 OR lines >= 500")
    hot = h.select(F.lit("hotspot").alias("family"), "project", "subject", level("n >= 3 OR lines >= 1000"), F.expr("lines * n AS score"))
    b = dealt(l.select("l_orderkey", "l_quantity"), rows, "l_orderkey").groupBy(F.col("l_orderkey").alias("subject")).agg(F.count("*").alias("files"), whole("l_quantity", 20).alias("lines")).where("files >= 20 OR lines >= 2500")
    broad = b.select(F.lit("broad_change").alias("family"), F.lit(0).cast("long").alias("project"), "subject", level("files >= 40 OR lines >= 5000"), F.expr("files * greatest(lines, 1L) AS score"))
    w = l.groupBy(F.col("l_suppkey").alias("project")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("again")).where("n >= 3 AND again > 0 AND (again / n >= 0.25 OR again >= 3)")
    rework = w.select(F.lit("rework").alias("family"), "project", F.col("project").alias("subject"), level("again / n >= 0.35 OR again >= 5"), F.col("again").alias("score"))
    # each family is cut to its best 25 by a sort with a limit, which keeps 25 rows a task
    order = [F.desc("score"), "project", "subject"]
    best = hot.orderBy(*order).limit(25).unionByName(broad.orderBy(*order).limit(25)).unionByName(rework.orderBy(*order).limit(25))
    sure = F.coalesce(*[F.when((F.col("family") == f) & (F.col("level") == lv), F.lit(x)) for f, pair in CONFIDENCE.items() for lv, x in zip(("moderate", "weak"), pair)])
    return best.withColumn("confidence", sure).orderBy(F.desc("confidence"), F.desc("score"), "family", "project", "subject").limit(25)

"""Evidence edges, walks, closure, components and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.operators.graph import connected, pagerank, walk
from daybook.plans.registry import registry
from daybook.sources.tables import commits, events, sql, table

REGISTRY, query = registry()
#: Suppliers that follow each other in an order, over all lines.
WHOLE = """e AS (SELECT DISTINCT l_suppkey AS source, nxt AS target FROM (SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND nxt <> l_suppkey)"""


def edges(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    return l.select(F.col("l_suppkey").alias("source"), nxt.alias("target")).where("target IS NOT NULL AND target <> source").distinct()


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


def both_degrees(e, nodes):
    long = e.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = long.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.join(d, "id", "left").na.fill(0)


@query("WITH RECURSIVE " + WHOLE + """, r AS (SELECT min(s_suppkey) AS start, min(s_suppkey) AS node, 0 AS depth FROM supplier GROUP BY s_nationkey
UNION SELECT start, target, depth + 1 FROM r JOIN e ON node = source WHERE depth < 5) SELECT start, node, min(depth) AS depth FROM r GROUP BY ALL""")
def whole_evidence_walk(spark, sf_dir):
    """Cycle-safe reach up to depth 5 over all lines, from the first supplier of every nation."""
    first = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("id"))
    return walk(edges(spark, sf_dir), first.select("id"), 5)


@query()
def whole_weak_components(spark, sf_dir):
    """Connected components over all lines; recursive SQL is too slow here, held to a union-find in the tests."""
    return connected(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("WITH " + WHOLE + """SELECT s_suppkey AS id, (SELECT count(*) FROM e WHERE source = s_suppkey) AS out_degree, (SELECT count(*) FROM e WHERE target = s_suppkey) AS in_degree FROM supplier""")
def whole_degrees(spark, sf_dir):
    """The degrees of G13, over all lines."""
    return both_degrees(edges(spark, sf_dir), nodes(spark, sf_dir))


@query()
def page_rank(spark, sf_dir):
    """Forty damped iterations over all lines; held to a dense power iteration in the tests."""
    return pagerank(edges(spark, sf_dir), nodes(spark, sf_dir)).select("id", F.round("rank", 8).alias("rank"))


@query(sql("""SELECT least(a.kind, b.kind) AS kind_a, greatest(a.kind, b.kind) AS kind_b, count(*) AS n, round(sum(1.0 / (1 + abs(a.day - b.day))), 4) AS weight FROM commits a JOIN commits b
ON a.thread = b.thread AND a.sha < b.sha AND a.kind <> b.kind GROUP BY ALL""", "commits"))
def dataset_correlations(spark, sf_dir):
    """Weighted pairs of kinds that share a key."""
    c = commits(spark, sf_dir).groupBy("thread", "kind", "day").agg(F.count("*").alias("k"))  # equal rows combine: a thread has few kinds and days
    b = c.select("thread", F.col("kind").alias("kind_b"), F.col("day").alias("day_b"), F.col("k").alias("k_b"))
    p = c.withColumnRenamed("kind", "kind_a").join(b, "thread").where("kind_a < kind_b").withColumn("n", F.col("k") * F.col("k_b"))
    weight = F.col("n") / (1 + F.abs(F.datediff("day", "day_b")))
    return p.groupBy("kind_a", "kind_b").agg(F.sum("n").alias("n"), F.round(F.sum(weight), 4).alias("weight"))


@query(sql("""WITH v AS (SELECT event_id, user_id, "at" FROM ev WHERE event_type = 'view'), c AS (SELECT v.event_id AS view_id, v.user_id, min(e."at") AS click_at FROM v JOIN ev e ON e.user_id = v.user_id AND e.event_type = 'click' AND e."at" > v."at" AND e."at" - v."at" <= 86400000000 GROUP BY ALL)
SELECT view_id, min(p."at") - min(click_at) AS to_purchase FROM c JOIN ev p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p."at" > click_at AND p."at" - click_at <= 86400000000 GROUP BY view_id""", "ev"))
def causal_chains(spark, sf_dir):
    """One of the eight templates of G07: view, then the next click, then the next purchase, each within a day: one sort a key, no pair join."""
    back = Window.partitionBy("user_id").orderBy(-F.col("at")).rangeBetween(-86_400_000_000, -1)
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "at")
    nearest = lambda kind, value: F.min(F.when(F.col("event_type") == kind, value)).over(back)
    e = e.withColumn("purchase_at", nearest("purchase", F.col("at")))
    e = e.withColumn("click", F.min(F.when(F.col("event_type") == "click", F.struct("at", "purchase_at"))).over(back))
    return e.where("event_type = 'view' AND click IS NOT NULL AND click.purchase_at IS NOT NULL").select(F.col("event_id").alias("view_id"), (F.col("click.purchase_at") - F.col("click.at")).alias("to_purchase"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT 'day' AS scale, CAST(day AS VARCHAR) AS key, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT event_type) AS kinds FROM d GROUP BY day
UNION ALL SELECT 'month', strftime(day, '%Y-%m'), CAST(sum(n) AS BIGINT), count(DISTINCT event_type) FROM d GROUP BY 2""")
def period_synthesis(spark, sf_dir):
    """The same rollup at several scales, from one daily aggregate."""
    d = events(spark, sf_dir).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    keys = F.explode(F.array(F.struct(F.lit("day").alias("scale"), F.col("day").cast("string").alias("key")), F.struct(F.lit("month").alias("scale"), F.date_format("day", "yyyy-MM").alias("key"))))
    return d.select(keys.alias("k"), "n", "event_type").groupBy("k.scale", "k.key").agg(F.sum("n").alias("n"), F.countDistinct("event_type").alias("kinds"))


@query(sql("""WITH p AS (SELECT project, count(*) AS n, count(DISTINCT kind) AS kinds, count(DISTINCT thread) AS threads FROM commits GROUP BY project)
SELECT project, round(kinds + 0.35e0 * least(threads, 6) + 0.12e0 * least(n, 5), 4) AS score, CASE WHEN kinds >= 4 THEN 'strong' WHEN kinds >= 2 THEN 'moderate' ELSE 'weak' END AS level FROM p""", "commits"))
def supported_claims(spark, sf_dir):
    """Part of A05: claim scores from three of its six capped counts."""
    p = commits(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.countDistinct("thread").alias("threads"))
    score = F.col("kinds") + 0.35 * F.least("threads", F.lit(6)) + 0.12 * F.least("n", F.lit(5))
    return p.select("project", F.round(score, 4).alias("score"), F.when(F.col("kinds") >= 4, "strong").when(F.col("kinds") >= 2, "moderate").otherwise("weak").alias("level"))
